"""Every registered query against its SQL in DuckDB, on the given and on altered tables."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import SAME_TYPE, TABLES, differences
from testbed.registry import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="test tables not there")


def assert_all_equal(spark, sf_dir, keys=None):
    for key, _, _, problem, kinds in differences(spark, sf_dir, keys or list(QUERIES)):
        assert problem is None, f"{key}: {problem}"
        odd = {c: k for c, k in kinds.items() if SAME_TYPE.get(k[0]) != k[1]}
        assert not odd, f"{key}: {odd}"


def test_every_query_has_sql():
    assert set(QUERIES) <= set(queries()) and set(QUERIES) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_given_tables(spark):
    assert_all_equal(spark, SF)


def altered(folder, changed):
    """The given tables with some of them replaced by a selection from themselves."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(
            f"COPY ({changed.get(t, 'SELECT *')} FROM '{SF}/{t}.parquet') "
            f"TO '{folder}/{t}.parquet' (FORMAT PARQUET)"
        )
    return str(folder)


def test_one_supplier_and_one_state_hold_a_third(spark, tmp_path):
    """A hot supplier in a hot week, and a nation with a third of all suppliers."""
    changed = {
        "lineitem": """SELECT * REPLACE (
            CASE WHEN l_orderkey % 3 = 0 THEN 3 ELSE l_suppkey END AS l_suppkey,
            CASE WHEN l_orderkey % 3 = 0 AND l_linenumber = 1
                 THEN TIMESTAMP '2001-06-05' ELSE l_shipdate END AS l_shipdate)""",
        "supplier": "SELECT * REPLACE (CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_nationkey END AS s_nationkey)",
    }
    assert_all_equal(spark, altered(tmp_path, changed))


def test_copies_of_one_row_are_a_third_of_each_table(spark, tmp_path):
    """Keys that should be unique are not: joins still give what SQL gives."""

    def with_copies(table, condition, copies):
        return (
            f"SELECT * EXCLUDE (copy) FROM (SELECT 0 AS copy, * FROM '{SF}/{table}.parquet' UNION ALL "
            f"SELECT copy, t.* FROM '{SF}/{table}.parquet' t, range({copies}) AS c(copy) WHERE {condition})"
        )

    changed = {
        "supplier": with_copies("supplier", "s_suppkey = 3", 5),
        "customer": with_copies("customer", "c_custkey = 7", 75),
        "lineitem": with_copies("lineitem", "l_orderkey = 5 AND l_linenumber = 1", 3000),
    }
    con = duckdb.connect()
    altered(tmp_path, {})
    for t, sql in changed.items():
        before = con.execute(f"SELECT count(*) FROM '{SF}/{t}.parquet'").fetchone()[0]
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT PARQUET)")
        after = con.execute(f"SELECT count(*) FROM '{tmp_path}/{t}.parquet'").fetchone()[0]
        assert after >= before * 4 / 3
    assert_all_equal(spark, str(tmp_path))


@pytest.mark.parametrize(
    "settings",
    [
        {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "3"},
        {"spark.sql.session.timeZone": "America/Los_Angeles"},
        {"spark.sql.adaptive.enabled": "false", "spark.sql.ansi.enabled": "false"},
    ],
    ids=["shuffled joins", "other time zone", "no adaptive execution"],
)
def test_settings_do_not_change_results(spark, settings):
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        assert_all_equal(spark, SF, [
            "state_metrics", "state_map", "quality_rating", "covid_rank", "significant_changes",
            "non_reporting", "trend", "upsert_hospital", "upsert_weekly", "upsert_quality",
            "quality_known", "dq_fk", "clean_hhs", "region_rollup"])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
