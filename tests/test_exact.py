"""Decimal results from metrics that are stored as doubles."""

import math
from decimal import Decimal

import pytest

from bedledger.functions.exact import exact_minus, exact_or_plain_sum, exact_plus, exact_sum
from bedledger.plans import questions
from frames import NAN, hospital, report, tables

DAY, BEFORE = "2021-03-12", "2021-03-05"


def summed(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double").agg(exact_sum("x")).first()[0]


def test_sums_do_not_depend_on_order(spark):
    assert summed(spark, [0.1, 0.2]) == 0.3
    assert summed(spark, [0.1] * 10) == 1.0
    assert summed(spark, [0.1, None]) == 0.1
    assert summed(spark, [None]) is None
    assert math.isnan(summed(spark, [1.0, NAN, math.inf]))
    assert summed(spark, [1.0, math.inf]) == math.inf


def test_values_out_of_range_raise(spark):
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            with pytest.raises(Exception, match="added exactly"):
                summed(spark, [1e16])
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")


def test_differences_of_tenths(spark):
    rows = [(k / 10 + 5, k / 10) for k in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double").select(exact_minus("a", "b").alias("d"))
    assert {r.d for r in df.collect()} == {5.0}
    odd = spark.createDataFrame([(NAN, 1.0), (math.inf, 1.0), (None, 1.0)], "a double, b double")
    nan, inf, null = (r.s for r in odd.select(exact_plus("a", "b").alias("s")).collect())
    assert math.isnan(nan) and inf == math.inf and null is None


@pytest.mark.parametrize("partitions", [3, 200])
def test_changes_of_exactly_five_are_listed_and_tie(spark, partitions):
    pairs = {"A00001": (16.4, 11.4), "A00002": (8.2, 3.2), "A00003": (20.6, 15.6), "A00004": (9.9, 5.0)}
    reports = [report(pk, day, covid=v) for pk, p in pairs.items() for day, v in zip((DAY, BEFORE), p)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        t = tables(spark, [hospital(pk, "NY") for pk in pairs], reports)
        got = questions.get_hospitals_with_significant_changes(t, DAY).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [(r.hospital_name, r.absolute_change) for r in got] == [(f"Hospital A0000{k}", 5.0) for k in (1, 2, 3)]


def test_equal_sums_share_a_rank_and_nan_is_first(spark):
    reports = [report("A00001", DAY, covid=0.1), report("A00002", DAY, covid=0.2), report("A00003", DAY, covid=0.3),
               report("A00004", DAY, covid=NAN)]
    t = tables(spark, [hospital("A00001", "NY"), hospital("A00002", "NY"), hospital("A00003", "AL"), hospital("A00004", "TX")], reports)
    ranks = {r.state: r["rank"] for r in questions.get_state_covid_map_data(t, DAY).collect()}
    assert ranks == {"TX": 1, "NY": 2, "AL": 2}
    assert questions.get_top_states_by_covid(t, DAY).first().state == "TX"


def test_metrics_stay_hash_aggregates(spark):
    t = tables(spark, [hospital("A00001", "NY")], [report("A00001", DAY, 1.5, 0.5, 0.1)])
    plan = questions.get_metrics(t, DAY, ["NY"])._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_sums_of_columns_of_any_size(spark):
    def added(values):
        return spark.createDataFrame([(v,) for v in values], "x double").agg(exact_or_plain_sum("x")).first()[0]

    assert added([0.1, 0.2, None]) == 0.3 and added([0.1] * 10) == 1.0
    assert added([1e300, 1e299, 0.5]) == 1.1e300
    assert added([None]) is None and math.isnan(added([1.0, math.nan]))
    assert added([1 / 3, 0.25, -1e8, 1e8]) == pytest.approx(1 / 3 + 0.25, abs=1e-12)


def test_steps_and_other_values_are_added_together(spark):
    values = [1234.5678, 0.00001, -99999999.9999, 123456789.12345, 1e15, -0.0, 0.1 + 0.2]
    total = sum(Decimal(repr(v)) for v in values)
    found = spark.createDataFrame([(v,) for v in values], "x double").agg(exact_sum("x")).first()[0]
    assert found == float(total.quantize(Decimal("1e-12")))
