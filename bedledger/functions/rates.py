"""Percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bedledger.functions.guards import _col


def percent(part: str | Column, whole: str | Column) -> Column:
    """part / whole * 100, NULL where whole is 0."""
    whole = F.nullif(_col(whole).cast("double"), F.lit(0.0))
    return _col(part).cast("double") / whole * 100


def round_tenth(c: Column) -> Column:
    """Round half away from zero to one digit, in decimal arithmetic.

    A double such as 12.249999999999998 stands for the exact tie 12.25 and has to go up,
    so the value is first taken at 13 decimals (15 significant digits for a percentage).
    """
    return c.try_cast("decimal(18,13)").cast("decimal(5,1)").cast("double")


def rate(part: str | Column, whole: str | Column) -> Column:
    """Percentage at one digit, at most 100, and 0 where there is no whole."""
    value = F.least(round_tenth(percent(part, whole)), F.lit(100.0))
    return F.when(_col(whole) > 0, value).otherwise(F.lit(0.0))


def percent_or_zero(part: str | Column, whole: str | Column) -> Column:
    """Unrounded percentage, 0 where there is no whole."""
    return F.when(_col(whole) > 0, percent(part, whole)).otherwise(F.lit(0.0))
