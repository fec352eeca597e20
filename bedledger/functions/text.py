"""Number-to-text rules of the display tables (half-even on the exact binary value)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bedledger.functions.guards import _col


def _or_special(c: Column, text: Column, plus: str = "") -> Column:
    inf = F.lit(float("inf"))
    return (
        F.when(F.isnan(c), F.lit(plus + "nan"))
        .when(c == inf, F.lit(plus + "inf"))
        .when(c == -inf, F.lit("-inf"))
        .otherwise(text)
    )


def count_text(c: str | Column) -> Column:
    """12345.6 -> '12,346'."""
    c = _col(c).cast("double")
    return _or_special(c, F.format_number(c, 0))


def signed_count_text(c: str | Column) -> Column:
    """12345.6 -> '+12,346'."""
    c = _col(c).cast("double")
    return _or_special(c, F.call_function("format_number", c, F.lit("+#,##0;-#,##0")), "+")


def percent_text(c: str | Column) -> Column:
    """12.34 -> '12.3%'."""
    c = _col(c).cast("double")
    number = _or_special(c, F.call_function("format_number", c, F.lit("0.0")))
    return F.concat(number, F.lit("%"))


def signed_percent_text(c: str | Column) -> Column:
    """12.34 -> '+12.3%'; missing (NULL or NaN) -> 'N/A'."""
    c = F.nullif(_col(c).cast("double"), F.lit(float("nan")))
    number = _or_special(c, F.call_function("format_number", c, F.lit("+0.0;-0.0")), "+")
    return F.coalesce(F.concat(number, F.lit("%")), F.lit("N/A"))


def percent_text_or_na(c: str | Column) -> Column:
    """12.34 -> '12.3%'; missing (NULL or NaN) -> 'N/A'."""
    c = F.nullif(_col(c).cast("double"), F.lit(float("nan")))
    return F.coalesce(percent_text(c), F.lit("N/A"))
