from decimal import Decimal

import math

import pytest

from pyspark.sql import functions as F

from bedledger.operators import beds

BEDS = "total_adult_beds double, occupied_adult_beds double, total_pediatric_beds double, " \
       "occupied_pediatric_beds double, covid_beds double, state string"
INF = float("inf")
NAN = float("nan")


def sample(spark, adult=10.0, pediatric=5.0):
    rows = [
        (adult, 5.0, pediatric, 3.0, 2.0, "NY"),
        (20.0, 25.0, 15.0, 10.0, 20.0, "CA"),
        (30.0, 15.0, 25.0, 20.0, 10.0, "TX"),
        (None, 5.0, None, 2.0, 1.0, "FL"),
    ]
    return spark.createDataFrame(rows, BEDS)


def by(df, key="state"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_clean_makes_counts_consistent(spark):
    rows = by(beds.validate_and_clean_bed_data(sample(spark)))
    assert set(rows) == {"NY", "CA", "TX"}
    for r in rows.values():
        assert r["occupied_adult_beds"] <= r["total_adult_beds"]
        assert r["occupied_pediatric_beds"] <= r["total_pediatric_beds"]
        assert r["covid_beds"] <= r["occupied_adult_beds"] + r["occupied_pediatric_beds"]
    assert rows["CA"]["occupied_adult_beds"] == 20 and rows["CA"]["total_occupied"] == 30


def test_clean_drops_negative_rows(spark):
    rows = by(beds.validate_and_clean_bed_data(sample(spark, adult=-10.0)))
    assert set(rows) == {"CA", "TX"}
    assert all(v >= 0 for r in rows.values() for v in r.values() if isinstance(v, float))


def test_clean_is_idempotent(spark):
    once = beds.validate_and_clean_bed_data(sample(spark))
    assert by(once) == by(beds.validate_and_clean_bed_data(once))


def test_clean_reads_text_and_keeps_infinity(spark):
    kinds = BEDS.replace("total_adult_beds double", "total_adult_beds string")
    rows = [
        ("10", 5.0, 5.0, 3.0, 2.0, "NY"),
        ("n/a", 5.0, 5.0, 3.0, 2.0, "CA"),
        ("inf", 5.0, 5.0, 3.0, 2.0, "TX"),
        ("7", 5.0, NAN, 3.0, 2.0, "FL"),
    ]
    rows = by(beds.validate_and_clean_bed_data(spark.createDataFrame(rows, kinds)))
    assert set(rows) == {"NY", "TX"} and math.isinf(rows["TX"]["total_adult_beds"])


@pytest.mark.parametrize(
    "state, total, occupied, rate, covid",
    [
        ("NY", 15, 8, 800 / 15, 25.0),
        ("CA", 35, 30, 3000 / 35, 200 / 3),
        ("TX", 55, 35, 3500 / 55, 1000 / 35),
    ],
)
def test_occupancy(spark, state, total, occupied, rate, covid):
    row = by(beds.calculate_occupancy_stats(sample(spark)))[state]
    assert (row["total_beds"], row["occupied_beds"]) == (total, occupied)
    assert row["occupancy_rate"] == pytest.approx(rate, abs=1e-9)
    assert row["covid_percentage"] == pytest.approx(covid, abs=1e-9)


def test_no_beds_means_zero_rates(spark):
    row = by(beds.calculate_occupancy_stats(sample(spark, adult=0.0, pediatric=0.0)))["NY"]
    assert row["occupancy_rate"] == 0 and row["covid_percentage"] == 0


def test_region_sums_of_raw_frame(spark):
    rows = by(beds.get_region_stats(sample(spark, adult=None)), "region")
    names = BEDS.replace(" double", "").replace(", state string", "").split(", ")
    got = {region: [r[c] for c in names] for region, r in rows.items()}
    assert got == {
        "Northeast": [0, 5, 5, 3, 2],
        "Midwest": [0, 0, 0, 0, 0],
        "South": [30, 20, 25, 22, 11],
        "West": [20, 25, 15, 10, 20],
    }


def test_region_rows_are_four_and_in_order(spark):
    rows = beds.region_rollup(sample(spark)).collect()
    assert [r.region for r in rows] == ["Northeast", "Midwest", "South", "West"]
    assert not any(v is None or v != v for r in rows for v in r.asDict().values())
    northeast = rows[0]
    assert northeast.total_beds == 15 and northeast.occupancy_rate == pytest.approx(800 / 15)


def test_region_skips_missing_infinite_and_foreign(spark):
    rows = [(1.0, 2, True, "NY"), (INF, 3, False, "NJ"), (-INF, 4, True, "ME"), (NAN, 5, True, "PA"),
            (9.0, 9, True, "PR"), (9.0, 9, True, None)]
    df = spark.createDataFrame(rows, "x double, n int, flag boolean, state string")
    result = beds.get_region_stats(df)
    assert result.columns == ["x", "n", "region"]
    assert by(result, "region")["Northeast"] == {"region": "Northeast", "x": 1.0, "n": 14.0}
    assert by(result, "region")["West"]["n"] == 0


def test_region_sums_keep_decimals(spark):
    df = spark.createDataFrame([("NY", "0.1"), ("NY", "0.2"), ("CA", None)], "state string, beds string")
    df = df.withColumn("beds", F.col("beds").cast("decimal(10,1)"))
    got = {r.region: r.beds for r in beds.get_region_stats(df).collect()}
    assert got == {"Northeast": Decimal("0.3"), "Midwest": 0, "South": 0, "West": 0}


def test_region_rates_come_from_sums(spark):
    df = beds.calculate_occupancy_stats(
        spark.createDataFrame(
            [(10.0, 10.0, 0.0, 0.0, 5.0, "NY"), (30.0, 0.0, 0.0, 0.0, 0.0, "NJ")], BEDS
        )
    )
    row = by(beds.region_rates(df), "region")["Northeast"]
    assert (row["occupancy_rate"], row["covid_percentage"]) == (25.0, 50.0)
    assert by(beds.get_region_stats(df), "region")["Northeast"]["occupancy_rate"] == 100.0
