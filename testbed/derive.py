"""Spark derivations of the hospital data from the test tables (see FIXTURES.md section 3).

Suppliers play hospitals and line items their weekly reports. Every derivation reads its
tables whole. Odd values (NaN, NULL, suppression code, malformed text) are put in by
arithmetic on the row, so that the guards have something to do; no row is left out.
"""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bedledger.schema import QUALITY_COLUMNS, SUPPRESSED, WEEKLY_COLUMNS, WEEKLY_METRICS
from bedledger.session import scratch_folder
from bedledger.sources.tables import Tables

# Two letters per nation key; nation 24 has no state.
STATE_CODES = "MENYPAMAOHILMIMNTXFLGANCVACAWAORCOAZPRNJWITNNVUT.."
RATING_YEARS = (2000, 2001)


_schemas: dict[str, StructType] = {}


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. Its schema is looked up in the file once, which takes a job."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def key36(number: str, width: int = 6) -> str:
    """Fixed-width key in base 36: six places are enough for two billion hospitals."""
    return f"lpad(conv(CAST({number} AS STRING), 10, 36), {width}, '0')"


SUPPLIER_FACILITY = [
    f"{key36('s_suppkey + 1')} AS hospital_pk",
    "s_suppkey AS number",
    "s_nationkey AS nation",
    "s_name AS name",
]
NATION_OFFICE = [
    "concat('N', lpad(n_nationkey, 5, '0')) AS hospital_pk",
    "CAST(n_nationkey AS BIGINT) AS number",
    "n_nationkey AS nation",
    "concat('Office ', n_name) AS name",
]
HOSPITAL_OF_FACILITY = [
    "hospital_pk",
    "name AS hospital_name",
    "concat('Street ', number) AS address",
    "concat('CITY_', nation) AS city",
    f"nullif(substr('{STATE_CODES}', 2 * nation + 1, 2), '..') AS state",
    "lpad(number % 100000, 5, '0') AS zip",
    "concat(lpad(nation + 1, 2, '0'), lpad(number % 1000, 3, '0')) AS fips_code",
]


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "supplier").selectExpr(*SUPPLIER_FACILITY)


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers, and one office per nation that never reports."""
    offices = scan(spark, sf_dir, "nation").selectExpr(*NATION_OFFICE)
    return suppliers(spark, sf_dir).unionByName(offices)


def as_hospitals(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(*HOSPITAL_OF_FACILITY)


def hospital(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_hospitals(facilities(spark, sf_dir))


ITEMS_OF_WEEK = [
    "count(*) AS items",
    "sum(l_quantity) AS adult",
    "sum(l_linenumber) AS pediatric",
    "sum(floor(l_quantity * (l_linenumber % 5) / 3)) AS adult_occupied",
    "sum(l_partkey % 6) AS pediatric_occupied",
    "sum(l_linenumber % 3) AS icu",
    "sum(l_linenumber % 2) AS icu_used",
    "sum(floor(l_quantity * (l_orderkey % 4) / 6)) AS covid",
    "sum(l_partkey % 2) AS icu_covid",
]
_MIX = "(l_suppkey * 7 + items + CAST(adult AS BIGINT))"
METRICS_OF_WEEK = [
    f"IF({_MIX} % 31 = 0, double('NaN'), adult / 10)",
    "pediatric / 10",
    "adult_occupied / 10",
    f"IF({_MIX} % 29 = 0, NULL, pediatric_occupied / 10)",
    "icu / 10",
    "icu_used / 10",
    f"CASE WHEN {_MIX} % 23 = 0 THEN {SUPPRESSED} WHEN {_MIX} % 397 = 0 THEN double('NaN') "
    # outbreaks, so that weeks differ
    f"WHEN {_MIX} % 3 = 0 THEN covid ELSE covid / 10 END",
    "icu_covid / 10",
]


def weekly(
    spark: SparkSession, sf_dir: str, first: str | None = None, last: str | None = None
) -> DataFrame:
    """One report per supplier and week with line items.

    A question about certain days passes them on as `first` and `last`. The ship dates of
    those weeks are then a plain range on the scanned column, which Parquet can skip row
    groups by; the reports of the weeks are the same as without it.
    """
    items = scan(spark, sf_dir, "lineitem")
    if first is not None:
        items = items.filter(f"l_shipdate >= DATE '{_monday(first)}'")
    if last is not None:
        items = items.filter(f"l_shipdate < DATE '{_monday(last) + timedelta(days=7)}'")
    reports = items.groupBy(
        "l_suppkey", F.expr("trunc(CAST(l_shipdate AS DATE), 'week') AS week")
    ).agg(*map(F.expr, ITEMS_OF_WEEK))
    return reports.selectExpr(
        f"{key36('l_suppkey + 1')} AS hospital_pk",
        # some reports are stamped at noon
        f"CAST(week AS TIMESTAMP_NTZ) + IF({_MIX} % 19 = 0, INTERVAL 12 HOURS, INTERVAL 0 HOURS) AS collection_week",
        *(f"CAST({c} AS DOUBLE) AS {name}" for c, name in zip(METRICS_OF_WEEK, WEEKLY_METRICS)),
        "week",
    )


def _monday(day: str) -> date:
    d = date.fromisoformat(day)
    return d - timedelta(days=d.weekday())


def _rating(number: str) -> str:
    text = f"IF(({number}) % 6 = 0, 'Not Available', CAST(({number}) % 6 AS STRING))"
    return f"IF(({number}) % 13 = 0, NULL, {text})"


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rating per facility and year."""
    years = ", ".join(map(str, RATING_YEARS))
    rated = facilities(spark, sf_dir).selectExpr("*", f"explode(array({years})) AS rating_year")
    return rated.selectExpr(
        "hospital_pk",
        "name AS facility_name",
        "concat('Type ', number % 3) AS type_of_hospital",
        "concat('Owner ', number % 4) AS type_of_ownership",
        "number % 2 = 0 AS emergency_services",
        f"{_rating('number + rating_year')} AS overall_quality_rating",
        "rating_year",
    )


class DerivedTables(Tables):
    """The three tables, each put together when a question first asks for it."""

    def __init__(self, spark: SparkSession, sf_dir: str, first: str | None, last: str | None):
        make = {
            "hospital": lambda: hospital(spark, sf_dir),
            "weekly_hospital_stats": lambda: weekly(spark, sf_dir, first, last),
            "hospital_quality": lambda: quality(spark, sf_dir),
        }
        object.__setattr__(self, "_make", make)

    def __getattr__(self, name: str) -> DataFrame:
        # called only for a table that is not there yet
        if name not in self._make:
            raise AttributeError(name)
        object.__setattr__(self, name, self._make[name]())
        return self.__dict__[name]


def tables(
    spark: SparkSession, sf_dir: str, first: str | None = None, last: str | None = None
) -> Tables:
    return DerivedTables(spark, sf_dir, first, last)


# ---- Bed frame ------------------------------------------------------------


def bed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bed frame of all reports: adult totals as text, and some impossible values."""
    t = tables(spark, sf_dir)
    adult, pediatric, adult_occupied, pediatric_occupied, _, _, covid, _ = WEEKLY_METRICS
    states = t.hospital.select("hospital_pk", "state")
    return t.weekly_hospital_stats.join(states, "hospital_pk").selectExpr(
        "hospital_pk",
        "week",
        "state",
        f"IF(hospital_pk LIKE '%5', 'n/a', CAST({adult} AS STRING)) AS total_adult_beds",
        f"{adult_occupied} AS occupied_adult_beds",
        f"IF(hospital_pk LIKE '%6', -1, {pediatric}) AS total_pediatric_beds",
        f"{pediatric_occupied} AS occupied_pediatric_beds",
        f"IF(hospital_pk LIKE '%8', double('Infinity'), {covid}) AS covid_beds",
    )


# ---- Feeds ----------------------------------------------------------------


def hhs_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly tables as a text feed with the defects real feeds have."""
    t = tables(spark, sf_dir)
    pediatric = WEEKLY_METRICS[1]
    mix = f"(unix_date(week) + CAST(floor({pediatric}) AS BIGINT))"
    # a NaN metric is a blank field
    metrics = {
        c: f"CAST(nullif({c}, double('NaN')) AS STRING)" for c in WEEKLY_METRICS
    }
    metrics[pediatric] = f"IF({mix} % 47 = 0, 'many', {metrics[pediatric]})"
    return t.weekly_hospital_stats.join(t.hospital, "hospital_pk").selectExpr(
        f"IF({mix} % 37 = 0, substr(hospital_pk, 2), hospital_pk) AS hospital_pk",
        "hospital_name",
        "address",
        "city",
        f"IF({mix} % 43 = 0, concat(state, 'X'), state) AS state",
        "zip",
        "'Short Term' AS hospital_subtype",
        "fips_code",
        f"""CASE WHEN {mix} % 41 = 0 THEN 'junk'
                 WHEN {mix} % 4 = 1 THEN replace(CAST(week AS STRING), '-', '/')
                 WHEN {mix} % 4 = 2 THEN concat(week, ' 00:00:00')
                 WHEN {mix} % 8 = 3 THEN date_format(week, 'MM/dd/yyyy 00:00')
                 ELSE CAST(week AS STRING) END AS collection_week""",
        *(f"{c} AS {name}" for name, c in metrics.items()),
    )


def quality_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratings of 2001 as a text feed; customers are facilities outside the table."""
    customers = scan(spark, sf_dir, "customer").selectExpr(
        f"concat('C', substr({key36('c_custkey', 12)}, 8)) AS hospital_pk",
        "c_custkey AS number",
        "c_name AS name",
    )
    rated = facilities(spark, sf_dir).drop("nation").unionByName(customers)
    return rated.selectExpr(
        "IF(number % 11 = 0, substr(hospital_pk, 2), hospital_pk) AS `Facility ID`",
        "name AS `Facility Name`",
        "concat('Type ', number % 3) AS `Hospital Type`",
        "concat('Owner ', number % 4) AS `Hospital Ownership`",
        "CASE number % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN ' yes\t' WHEN 2 THEN 'No' END"
        " AS `Emergency Services`",
        f"{_rating('number + 2001')} AS `Hospital overall rating`",
    )


def written_as_csv(feed: DataFrame, name: str) -> str:
    """Write a feed to the shared scratch folder as compressed CSV files, one per task, and say where."""
    path = f"{scratch_folder(feed.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (
        feed.write.option("header", True)
        .option("compression", "gzip")
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


# ---- Upsert batches -------------------------------------------------------


def hospital_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows per supplier in the name patterns A,B,A / A,A,B / A,B,C."""
    versions = as_hospitals(suppliers(spark, sf_dir)).selectExpr(
        "*",
        "element_at(array('ABA', 'AAB', 'ABC'), CAST(zip AS INT) % 3 + 1) AS pattern",
        "explode(array(0, 1, 2)) AS seq",
    )
    name = F.expr("concat(hospital_name, ' ', substr(pattern, seq + 1, 1))")
    return versions.withColumn("hospital_name", name).drop("pattern")


def weekly_split(spark: SparkSession, sf_dir: str, day: str) -> tuple[DataFrame, DataFrame]:
    """(existing, batch): reports before the day, and reports from four weeks before it on.

    Reports with more than 2 COVID beds arrive a second time with one bed more.
    """
    existing = weekly(spark, sf_dir, last=_day_before(day, 7)).select(*WEEKLY_COLUMNS)
    reports = weekly(spark, sf_dir, first=_day_before(day, 28)).select(*WEEKLY_COLUMNS)
    covid = WEEKLY_METRICS[6]
    copies = f"explode(IF({covid} > 2, array(0, 1), array(0))) AS seq"
    batch = reports.selectExpr("*", copies).withColumn(covid, F.expr(f"{covid} + seq"))
    return existing, batch


def _day_before(day: str, days: int) -> str:
    return str(date.fromisoformat(day) - timedelta(days=days))


def quality_versions(ratings: DataFrame) -> DataFrame:
    """Each rating of a table three times, as A,B,A: `facility_name` differs in the middle."""
    versions = ratings.selectExpr("*", "explode(array(0, 1, 2)) AS seq")
    name = F.expr("IF(seq = 1, concat(facility_name, ' B'), facility_name)")
    return versions.withColumn("facility_name", name).select(*QUALITY_COLUMNS, "seq")
