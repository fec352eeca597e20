"""What the physical plans must and must not contain."""

import io
from contextlib import redirect_stdout
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bedledger.plans import questions
from bedledger.schema import WEEKLY_KEY, WEEKLY_METRICS
from bedledger.sources.manifest import read_state
from bedledger.sources.tables import SCHEMAS, Tables, files_with_keys, read_tables, scan, table_of, write_table, write_version
from testbed import derive
from testbed.registry import DAY, NORTHEAST, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="test tables not there")


def plan(df, mode="formatted"):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain(mode)
    return text.getvalue()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("db"))
    derived = derive.tables(spark, SF)
    for name in SCHEMAS:
        write_table(getattr(derived, name), root, name)
    return read_tables(spark, root)


@pytest.mark.parametrize("key", [k for k in QUERIES if not k.startswith("src_")])
def test_no_pairing_and_no_python(spark, key):
    text = plan(QUERIES[key](spark, SF), "simple")
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert operator not in text


@pytest.mark.parametrize(
    "key",
    ["week_over_week", "bed_availability", "significant_changes", "non_reporting", "top_states", "tile_reporting"],
)
def test_limits_are_top_k(spark, key):
    assert "TakeOrderedAndProject" in plan(QUERIES[key](spark, SF), "simple")


def test_windows_run_on_aggregates_only(spark):
    for key in QUERIES:
        if key.startswith("src_"):
            continue
        text = plan(QUERIES[key](spark, SF), "simple")
        at = text.find(" Window [")
        if at >= 0:
            assert "HashAggregate" in text[at:], key


@pytest.mark.parametrize(
    "question, columns",
    [
        (lambda t: questions.get_metrics(t, DAY, NORTHEAST), 5),
        (lambda t: questions.get_state_metrics_for_map(t, DAY), 5),
        (lambda t: questions.get_state_covid_map_data(t, DAY), 1),
        (lambda t: questions.get_bed_availability_comparison(t, DAY), 5),
        (lambda t: questions.get_quality_rating_analysis(t, DAY), 4),
        (lambda t: questions.get_hospitals_with_significant_changes(t, DAY), 1),
    ],
)
def test_stored_weeks_and_columns_are_pruned(stored, question, columns):
    text = plan(question(stored))
    scans = [block for block in text.split("\n\n") if "Scan parquet" in block and "week" in block]
    weekly = [b for b in scans if "7_day_avg" in b]
    assert weekly
    for scan in weekly:
        (line,) = [x for x in scan.splitlines() if x.startswith("PartitionFilters")]
        assert "isnotnull(week" in line
        schema = scan.split("ReadSchema: ")[1]
        assert schema.count("7_day_avg") == columns


def test_counting_hospitals_needs_no_shuffle_of_its_own(stored):
    text = plan(questions.get_metrics(stored, DAY, NORTHEAST), "simple")
    assert text.count("Exchange hashpartitioning") == 2  # by hospital, by state


def test_a_small_hospital_table_is_broadcast(stored):
    for frame in (questions.get_state_metrics_for_map(stored, DAY), questions.get_trend_data(stored, NORTHEAST)):
        text = plan(frame, "simple")
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_last_report_reads_keys_only(stored):
    text = plan(questions.get_non_reporting_hospitals(stored, DAY))
    assert "7_day_avg" not in text.split("(1) ")[-1]


def test_dates_come_from_partitions(stored):
    text = plan(questions.get_available_dates(stored))
    assert "ReadSchema: struct<>" in text


def test_a_hot_week_is_written_by_several_tasks(spark, tmp_path):
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k",
                "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    hot = "DATE '2021-03-12' + CAST(IF(id % 2 = 0, 0, 7 * (id % 5)) AS INT) AS week"
    rows = spark.range(60_000).selectExpr(
        "CAST(id AS STRING) AS hospital_pk", hot, *(f"CAST(id AS DOUBLE) AS {c}" for c in WEEKLY_METRICS)
    ).selectExpr("*", "CAST(week AS TIMESTAMP_NTZ) AS collection_week")
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        write_table(rows, str(tmp_path), "weekly_hospital_stats")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "weekly_hospital_stats").glob("version=*/week=*")}
    assert len(files) == 5
    # a small week may share the shuffle partition of the hot one, and so its splits
    assert files["week=2021-03-12"] == max(files.values()) > 3
    assert min(files.values()) == 1


def test_a_hot_hospital_is_split_in_a_shuffled_join(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    # one hospital holds half of the reports, at as many timestamps
    reports = spark.range(200_000).selectExpr(
        "lpad(IF(id % 2 = 0, 0, id % 5000), 6, '0') AS hospital_pk",
        "TIMESTAMP_NTZ'2021-01-01' + make_dt_interval(0, 0, 0, id) AS collection_week",
        *(f"CAST(id % 7 AS DOUBLE) AS {c}" for c in WEEKLY_METRICS),
    )
    hospitals = spark.range(5000).selectExpr("lpad(id, 6, '0') AS hospital_pk", "'NY' AS state")
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        trend = questions.get_trend_data(Tables(hospitals, reports, None), ["NY"])
        rows = trend.collect()
        text = plan(trend, "simple")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "SortMergeJoin(skew=true)" in text.split("Initial Plan")[0]
    assert sum(r.total_beds for r in rows) == 2 * sum(i % 7 for i in range(200_000))


def test_a_load_reads_only_the_keys_of_files_in_reach(spark, tmp_path):
    root = str(tmp_path)
    reports = derive.weekly(spark, SF, "2001-05-28", "2001-06-04")
    write_table(reports, root, "weekly_hospital_stats")
    state = read_state(spark, root)
    one = reports.filter("week = DATE '2001-06-04'").limit(1)
    found = files_with_keys(spark, root, "weekly_hospital_stats", one, WEEKLY_KEY, state)
    assert {f.part for f in found} == {"2001-06-04"} and len(found) == 1
    text = plan(scan(spark, root, "weekly_hospital_stats", found).join(one.select(*WEEKLY_KEY), WEEKLY_KEY, "left_semi").select("week"))
    near = next(b for b in text.split("\n\n") if "Scan parquet" in b and "2001-06-04" in b and root in b)
    assert "7_day_avg" not in near
    nobody = one.withColumn("hospital_pk", F.lit("zzzzzz"))
    assert files_with_keys(spark, root, "weekly_hospital_stats", nobody, WEEKLY_KEY, state) == []
    assert files_with_keys(spark, root, "weekly_hospital_stats", one.filter("false"), WEEKLY_KEY, state) == []


def test_only_live_files_are_listed(spark, tmp_path):
    root = str(tmp_path)
    reports = derive.weekly(spark, SF, "2001-05-28", "2001-06-04").coalesce(1)
    write_table(reports, root, "weekly_hospital_stats")
    # versions that nobody sees, as cut loads leave them
    for n in range(50):
        write_version(reports.limit(5), root, "weekly_hospital_stats", f"dead{n}")
    state = read_state(spark, root)
    opened = set(table_of(spark, root, "weekly_hospital_stats", state).inputFiles())
    assert len(opened) == len(state.of("weekly_hospital_stats")) and not any("dead" in f for f in opened)
    text = plan(questions.get_metrics(read_tables_of(spark, root), DAY, NORTHEAST))
    scan_of = next(b for b in text.split("\n\n") if "Scan parquet" in b and "7_day_avg" in b)
    assert "dead" not in scan_of


def read_tables_of(spark, root):
    state = read_state(spark, root)
    return Tables(*(table_of(spark, root, name, state) for name in SCHEMAS))


@pytest.mark.parametrize("key", ["upsert_weekly", "upsert_hospital", "upsert_quality"])
def test_upserts_are_hash_aggregates(spark, key):
    text = plan(QUERIES[key](spark, SF), "simple")
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_silent_hospitals_read_old_weeks_only_for_the_others(spark, stored):
    text = plan(questions.get_non_reporting_hospitals(stored, DAY))
    filters = [b for b in text.split("\n\n") if "Scan parquet" in b and "PartitionFilters" in b and "week#" in b]
    assert any(">= 2001-05-21" in b for b in filters) and any("< 2001-05-21" in b for b in filters)


def test_ship_dates_reach_the_scan(spark):
    text = plan(QUERIES["state_metrics"](spark, SF))
    assert "GreaterThanOrEqual(l_shipdate,2001-06-04" in text
    assert "LessThan(l_shipdate,2001-06-11" in text
