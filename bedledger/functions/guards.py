"""Column expressions that make raw metrics safe to add up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bedledger.schema import SUPPRESSED

# What a cast takes beyond decimal or exponent notation, the infinities and nan: a type letter at the
# end (1.5d) and hexadecimal notation. Plain numbers end with a digit or a point (1.).
_PLAIN = r"^[^xX]*[0-9.] *\z|^ *(?i:[+-]?inf(?:inity)?|nan) *\z"

_ZERO = 0.0


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nonneg(c: str | Column) -> Column:
    """NaN, NULL and negative values (suppression code included) become 0."""
    c = F.nanvl(_col(c).cast("double"), F.lit(_ZERO))
    return F.greatest(F.coalesce(c, F.lit(_ZERO)), F.lit(_ZERO))


def nonneg_keep_nan(c: str | Column) -> Column:
    """NULL and negative values become 0, but NaN passes and sorts above every number.

    The COVID ranking questions are defined with this laxer guard, so one NaN report
    puts its state on top.
    """
    return F.greatest(F.coalesce(_col(c).cast("double"), F.lit(_ZERO)), F.lit(_ZERO))


def _plainly_spelled(c: Column) -> Column:
    """Whether a text that can be cast holds no letter but an exponent's, or is one of the names."""
    return c.rlike(_PLAIN)


def number_from_text(c: str | Column) -> Column:
    """Text to double; anything that is not a number becomes NULL."""
    c = _col(c)
    return F.when(_plainly_spelled(c), F.nanvl(c.try_cast("double"), F.lit(None).cast("double")))


def number_or_zero(c: str | Column) -> Column:
    """Text to double, each text read once: a missing number, blank or NaN is 0, a text that is no number NULL."""
    c = _col(c)
    read = F.when(_plainly_spelled(c), F.nanvl(c.try_cast("double"), F.lit(_ZERO)))
    return F.coalesce(read, F.when(c.isNull() | (F.trim(c) == ""), F.lit(_ZERO)))


def is_not_a_number(c: str | Column) -> Column:
    """Whether a text is there that stands neither for a number nor for a missing one."""
    return number_or_zero(c).isNull()


def suppressed_to_null(c: str | Column) -> Column:
    return F.nullif(_col(c), F.lit(SUPPRESSED).cast("double"))


def missing_to_zero(c: str | Column) -> Column:
    c = F.nanvl(_col(c), F.lit(_ZERO))
    return F.coalesce(c, F.lit(_ZERO))


def finite_or_null(c: str | Column) -> Column:
    """NaN and the infinities become NULL, so a sum skips them."""
    c = _col(c).cast("double")
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def clip(c: str | Column, low: float, high: float) -> Column:
    """Limit to [low, high]; NaN stays NaN."""
    c = _col(c)
    return F.when(F.isnan(c), c).otherwise(
        F.least(F.greatest(c, F.lit(low)), F.lit(high))
    )
