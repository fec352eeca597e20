import math
import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from bedledger.functions import guards, rates, regions, text

NAN = float("nan")
INF = float("inf")


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))


def test_guards_differ_on_nan_only(values):
    raw = [NAN, None, -999999.0, 0.0, 5.0]
    assert values(guards.nonneg, "double", raw) == [0, 0, 0, 0, 5]
    lax = values(guards.nonneg_keep_nan, "double", raw)
    assert math.isnan(lax[0]) and lax[1:] == [0, 0, 0, 5]


def test_guards_take_integers(values):
    assert values(guards.nonneg, "int", [None, -3, 4]) == [0, 0, 4]
    assert values(guards.nonneg_keep_nan, "int", [None, -3, 4]) == [0, 0, 4]


def test_number_from_text(values):
    raw = ["1", " 2.5 ", "-3e2", ".5", "7.", "1.5d", "2f", "0x1A", "1,000", "n/a", "", None, "inf",
           "-Infinity", "nan"]
    expected = [1.0, 2.5, -300.0, 0.5, 7.0, None, None, None, None, None, None, None, INF, -INF, None]
    assert values(guards.number_from_text, "string", raw) == expected


def test_what_is_not_a_number(values):
    raw = ["1", " 2.5 ", "NaN", "", "  ", None, "-inf", "many", "1.5d", "1,000"]
    assert values(guards.is_not_a_number, "string", raw) == [False] * 7 + [True] * 3


def test_finite_or_null(values):
    assert values(guards.finite_or_null, "double", [1.0, NAN, INF, -INF, None]) == [
        1.0, None, None, None, None]


def test_clip_keeps_nan(values):
    got = values(lambda c: guards.clip(c, 0.0, 100.0), "double", [-1.0, 50.0, 101.0, NAN, INF])
    assert got[:3] == [0.0, 50.0, 100.0] and math.isnan(got[3]) and got[4] == 100.0


def test_rate_rounds_exact_ties_up(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(0, t + 1), t) for t in (rng.randrange(1, 5000) for _ in range(4000))]
    pairs += [(k, 400) for k in range(401)] + [(k, 2000) for k in range(2001)]
    df = spark.createDataFrame([(float(o), float(t)) for o, t in pairs], "o double, t double")
    got = [r[0] for r in df.select(rates.rate("o", "t")).collect()]
    exact = [
        float((Decimal(o) * 100 / Decimal(t)).quantize(Decimal("0.1"), ROUND_HALF_UP))
        for o, t in pairs
    ]
    assert got == exact


def test_rate_without_whole_is_zero(spark):
    df = spark.createDataFrame([(3.0, 0.0), (0.0, 0.0), (9.0, 3.0)], "o double, t double")
    assert [r[0] for r in df.select(rates.rate("o", "t")).collect()] == [0.0, 0.0, 100.0]


def numbers():
    rng = random.Random(2)
    fixed = [0.0, 0.25, 0.35, 2.5, 3.5, -0.4, -31.0, 12345.5, 12346.5, 1e9, 99.95, 0.05, 1234567.891]
    return fixed + [rng.uniform(-1e6, 1e6) for _ in range(300)]


def test_texts_match_python_format(values):
    xs = numbers()
    assert values(text.count_text, "double", xs) == [f"{x:,.0f}" for x in xs]
    assert values(text.percent_text, "double", xs) == [f"{x:.1f}%" for x in xs]
    assert values(text.signed_count_text, "double", xs) == [f"{x:+,.0f}" for x in xs]
    assert values(text.signed_percent_text, "double", xs) == [f"{x:+.1f}%" for x in xs]


def test_texts_of_special_values(values):
    special = [NAN, INF, -INF]
    assert values(text.count_text, "double", special) == [f"{x:,.0f}" for x in special]
    assert values(text.signed_count_text, "double", special) == [f"{x:+,.0f}" for x in special]
    assert values(text.percent_text, "double", special) == [f"{x:.1f}%" for x in special]
    assert values(text.signed_percent_text, "double", [NAN, None, INF]) == ["N/A", "N/A", "+inf%"]
    assert values(text.percent_text_or_na, "double", [NAN, None, 1.0]) == ["N/A", "N/A", "1.0%"]


def test_region_of_state(values):
    got = values(regions.get_region_for_state, "string", ["ME", "KS", "DC", "HI", "PR", None])
    assert got == ["Northeast", "Midwest", "South", "West", "Other", "Other"]
    assert values(regions.named_region, "string", ["PR", None]) == [None, None]


def test_regions_have_51_states():
    sizes = {r: len(s) for r, s in regions.REGION_STATES.items()}
    assert sizes == {"Northeast": 9, "Midwest": 12, "South": 17, "West": 13}


def test_selection_expands_without_repeats(spark):
    names = ["Northeast", "NY", "PR"]
    expected = sorted(["ME", "NH", "VT", "MA", "RI", "CT", "NY", "NJ", "PA", "PR"])
    frame = spark.createDataFrame([(n,) for n in names], "selection string")
    assert sorted(r.state for r in regions.expand_selection(frame).collect()) == expected
    assert sorted(regions.get_states_for_selection(names)) == expected


def test_missing_and_suppressed(spark):
    df = spark.createDataFrame([(NAN,), (None,), (-999999.0,), (4.0,)], "x double")
    both = guards.suppressed_to_null(guards.missing_to_zero(F.col("x")))
    assert [r[0] for r in df.select(both).collect()] == [0.0, 0.0, None, 4.0]
