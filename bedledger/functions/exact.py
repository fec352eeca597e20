"""Sums and differences without binary rounding.

The tables hold decimal fractions in doubles. A finite value is taken at its shortest decimal text, added as
a decimal, and turned back into a double at the very end, so 16.4 - 11.4 is 5 and the order of the rows
does not matter. NaN and the infinities have no decimal: they are carried beside the sum.

Nearly all values are a whole number of ten-thousandths. These are added as whole numbers, which hash aggregates keep
in place; only the others go through decimals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bedledger.functions.guards import _col

# 16 digits before the point and 12 behind it: a sum has room for a billion of the largest values.
_KIND = "decimal(28,12)"
_SUM = "decimal(37,12)"
_BOUND = 1e16
# Up to 1e8 a double that is the nearest to a number of steps has no shorter decimal text: 12 digits name one double each.
_STEPS = 10_000.0
_STEPPED = 1e8
# Steps are added in two parts of 20 bits each, so 8 million million rows cannot overflow a sum.
_LOW = 20


def _finite(c: Column) -> Column:
    return F.abs(c) < F.lit(float("inf"))  # NaN is above infinity


def _decimal(c: Column) -> Column:
    too_large = F.raise_error(F.lit("a metric of 1e16 or more cannot be added exactly"))
    return (
        F.when(c.isNull(), F.lit(None).cast(_KIND))
        .when(F.abs(c) < F.lit(_BOUND), c.cast(_KIND))
        .otherwise(too_large.cast(_KIND))
    )


def _steps(c: Column) -> Column:
    return F.rint(c * F.lit(_STEPS))


def _stepped(c: Column) -> Column:
    """Whether a value is a whole number of steps."""
    return (F.abs(c) < F.lit(_STEPPED)) & (_steps(c) / F.lit(_STEPS) == c)


def exact_sum(c: str | Column) -> Column:
    """Aggregate: the sum as a double; NaN if a value is NaN, else infinite if one is, else exact."""
    c = _col(c).cast("double")
    odd = F.max(F.when(~_finite(c), c))
    whole = F.when(_stepped(c), _steps(c).cast("long"))
    high, low = F.sum(F.shiftright(whole, _LOW)), F.sum(whole.bitwiseAND(F.lit((1 << _LOW) - 1)))
    steps = high.cast("decimal(20,0)") * F.lit(1 << _LOW).cast("decimal(7,0)") + low.cast("decimal(20,0)")
    stepped = (steps * F.lit("0.0001").cast("decimal(4,4)")).cast(_SUM)
    rest = F.sum(_decimal(F.when(_finite(c) & ~_stepped(c), c))).cast(_SUM)
    return F.coalesce(odd, F.coalesce(stepped + rest, stepped, rest).cast("double"))


def exact_or_plain_sum(c: str | Column) -> Column:
    """The same for columns of any size: a sum of doubles where a finite value is too large to be added exactly."""
    c = _col(c).cast("double")
    largest = F.max(F.when(_finite(c), F.abs(c)))
    # the exact sum must not meet the values that it refuses
    exact = exact_sum(F.when((F.abs(c) < F.lit(_BOUND)) | ~_finite(c), c))
    return F.when(largest >= F.lit(_BOUND), F.sum(c)).otherwise(exact)


def _exactly(a: Column, b: Column, combine) -> Column:
    a, b = a.cast("double"), b.cast("double")
    # a quotient of whole numbers is the double next to it; adding 0 turns -0 into 0
    stepped = combine(_steps(a), _steps(b)) / F.lit(_STEPS) + F.lit(0.0)
    exact = combine(_decimal(a), _decimal(b)).cast("double")
    return (
        F.when(_stepped(a) & _stepped(b), stepped)
        .when(_finite(a) & _finite(b), exact)
        .otherwise(combine(a, b))
    )


def exact_plus(a: str | Column, b: str | Column) -> Column:
    return _exactly(_col(a), _col(b), lambda x, y: x + y)


def exact_minus(a: str | Column, b: str | Column) -> Column:
    return _exactly(_col(a), _col(b), lambda x, y: x - y)
