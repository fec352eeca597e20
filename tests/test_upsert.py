import random
from datetime import datetime, timedelta

from bedledger.operators import checks, upsert
from bedledger.schema import HOSPITAL_COLUMNS, HOSPITAL_SCHEMA, QUALITY_SCHEMA, WEEKLY_COLUMNS, WEEKLY_METRICS
from frames import COVID, NAN, REPORT_SCHEMA, hospital, rating, report

WEEK = "2021-03-12"


def with_seq(spark, rows, schema):
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{fields}, seq int")


def test_equal_hospital_rows_collapse_before_the_last_one_wins(spark):
    names = {"A00001": "ABA", "A00002": "AAB", "A00003": "ABC", "A00004": "ABAB"}
    rows = [hospital(pk, "NY", name=letter) for i in range(4) for pk, s in names.items() for letter in s[i:i + 1]]
    existing = spark.createDataFrame([hospital("A00001", "CA"), hospital("B00001", "TX")], HOSPITAL_SCHEMA)
    got = upsert.upsert_hospital(existing, with_seq(spark, rows, HOSPITAL_SCHEMA), "seq")
    assert {r.hospital_pk: (r.hospital_name, r.state) for r in got.collect()} == {
        "A00001": ("B", "NY"), "A00002": ("B", "NY"), "A00003": ("C", "NY"), "A00004": ("B", "NY"),
        "B00001": ("Hospital B00001", "TX")}
    assert got.columns == HOSPITAL_COLUMNS


def test_weekly_last_row_wins_without_collapse(spark):
    rows = [report("A00001", WEEK, covid=v) for v in (1.0, 2.0, 1.0)]
    existing = spark.createDataFrame(
        [report("A00001", WEEK, covid=9.0), report("A00001", "2021-03-05", covid=8.0)], REPORT_SCHEMA)
    got = upsert.upsert_weekly(existing, with_seq(spark, rows, REPORT_SCHEMA), "seq")
    assert sorted((r.collection_week.day, r[COVID]) for r in got.collect()) == [(5, 8.0), (12, 1.0)]


def test_null_and_nan_replace_values(spark):
    existing = spark.createDataFrame([report("A00001", WEEK, covid=9.0)], REPORT_SCHEMA)
    for value in (None, NAN):
        batch = with_seq(spark, [report("A00001", WEEK, covid=value)], REPORT_SCHEMA)
        (row,) = upsert.upsert_weekly(existing, batch, "seq").collect()
        assert row[COVID] is None or row[COVID] != row[COVID]


def test_rating_years_are_separate_keys(spark):
    existing = spark.createDataFrame([rating("A00001", "1", 2020)], QUALITY_SCHEMA)
    rows = [rating("A00001", "2", 2021), rating("A00001", "3", 2021)]
    got = upsert.upsert_quality(existing, with_seq(spark, rows, QUALITY_SCHEMA), "seq")
    assert sorted((r.rating_year, r.overall_quality_rating) for r in got.collect()) == [(2020, "1"), (2021, "3")]


def test_upsert_twice_is_upsert_once(spark):
    batch = with_seq(spark, [report("A00001", WEEK, covid=v) for v in (1.0, 2.0)], REPORT_SCHEMA)
    empty = spark.createDataFrame([], REPORT_SCHEMA)
    once = upsert.upsert_weekly(empty, batch, "seq")
    twice = upsert.upsert_weekly(once, batch, "seq")
    assert once.collect() == twice.collect()


def test_distinct_treats_nulls_and_nans_as_equal(spark):
    df = spark.createDataFrame([("a", None, NAN, 3), ("a", None, NAN, 1), ("a", "x", NAN, 2)],
                               "k string, s string, x double, seq int")
    got = {(r.k, r.s): r.seq for r in upsert.first_of_each_row(df, "seq").collect()}
    assert got == {("a", None): 1, ("a", "x"): 2}


def test_random_batches_with_a_hot_key_match_a_row_by_row_upsert(spark):
    rng = random.Random(7)
    start = datetime(2021, 1, 1)

    def row():
        # a third of all rows share one hospital
        pk = "A00000" if rng.random() < 0.34 else f"A{rng.randrange(40):05}"
        when = (start + timedelta(days=7 * rng.randrange(6))).isoformat()
        return report(pk, when, covid=float(rng.randrange(5)), total=rng.choice([None, NAN, 1.0, 2.0]))

    stored, batch = [row() for _ in range(300)], [row() for _ in range(3000)]
    table = {}
    for r in stored:
        table[r[:2]] = r
    existing = spark.createDataFrame(list(table.values()), REPORT_SCHEMA)
    for r in batch:
        table[r[:2]] = r
    frame = with_seq(spark, batch, REPORT_SCHEMA).repartition(7)
    got = upsert.upsert_weekly(existing, frame, "seq").select(*WEEKLY_COLUMNS).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, table.values()))


def test_random_hospital_batches_match_a_row_by_row_upsert(spark):
    rng = random.Random(8)
    batch = [hospital(f"A0000{rng.choice([0, 0, 0, 1, 2, 3])}", rng.choice(["NY", None]), name=rng.choice("AB"))
             for _ in range(400)]
    table = {}
    for r in dict.fromkeys(batch):
        table[r[0]] = r
    empty = spark.createDataFrame([], HOSPITAL_SCHEMA)
    got = upsert.upsert_hospital(empty, with_seq(spark, batch, HOSPITAL_SCHEMA).repartition(5), "seq")
    assert sorted(map(tuple, got.collect())) == sorted(table.values())


def test_known_hospitals(spark):
    ratings = spark.createDataFrame([rating("A00001", "1", 2020), rating("B00001", "1", 2020)], QUALITY_SCHEMA)
    hospitals = spark.createDataFrame([hospital("A00001", "NY")], HOSPITAL_SCHEMA)
    assert [r.hospital_pk for r in upsert.known_hospitals_only(ratings, hospitals).collect()] == ["A00001"]
    assert [r.hospital_pk for r in checks.orphan_rows(ratings, hospitals).collect()] == ["B00001"]


def test_contract_checks(spark):
    reports = spark.createDataFrame([report("A00001", WEEK), report("A00001", WEEK), report("A00002", WEEK)],
                                    REPORT_SCHEMA)
    got = checks.duplicate_keys(reports, ["hospital_pk", "collection_week"]).collect()
    assert [(r.hospital_pk, r.copies) for r in got] == [("A00001", 2)]
    widths = spark.createDataFrame([("AL ", "123456"), ("ALA", "12345"), (None, None)], "state string, fips_code string")
    got = checks.width_overflow(widths, {"state": 2, "fips_code": 5}).collect()
    assert sorted(map(tuple, got)) == [("fips_code", 1), ("state", 1)]


def test_metrics_list_is_the_table(spark):
    assert WEEKLY_COLUMNS == [f.name for f in REPORT_SCHEMA.fields] and len(WEEKLY_METRICS) == 8
