"""The three tables: how they are stored, read and queried.

Under a root folder each write of a table has a folder of its own, `<table>/version=<id>`, with one
folder per partition below it: the calendar day of collection_week (`week`), or rating_year. The publish log (`manifest.py`)
says which files are live; a scan opens these alone, however many older ones lie beside them. A publish takes out only
the files that hold one of its keys. A reader sees all of a publish or nothing of it, and a write that was cut short
stays invisible. Every date predicate of the questions becomes a partition filter.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedledger.operators.upsert import replace_rows
from bedledger.schema import HOSPITAL_SCHEMA, QUALITY_SCHEMA, WEEK, WEEKLY_SCHEMA
from bedledger.sources.manifest import (
    Change,
    DataFile,
    MissingTables,  # noqa: F401
    State,
    commit,
    describe_files,
    filesystem,
    fold,
    forget,
    read_state,
    stored_path,
)

# In the order in which they are published: rows refer to hospitals only.
SCHEMAS = {
    "hospital": HOSPITAL_SCHEMA,
    "weekly_hospital_stats": WEEKLY_SCHEMA,
    "hospital_quality": QUALITY_SCHEMA,
}
# Results that loads keep up to date (operators/stored_views.py).
STATE_TREND, LAST_REPORT = "state_trend", "last_report"
VIEW_SCHEMAS = {
    STATE_TREND: T.StructType(
        [
            T.StructField("state", T.StringType()),
            *(T.StructField(c, T.DoubleType()) for c in ("total_beds", "occupied_beds", "covid_beds")),
            T.StructField(WEEK, T.DateType()),
        ]
    ),
    LAST_REPORT: T.StructType(
        [T.StructField("hospital_pk", T.StringType()), T.StructField("last_report_date", T.DateType())]
    ),
}
PARTITION_COLUMN = {"weekly_hospital_stats": WEEK, "hospital_quality": "rating_year", STATE_TREND: WEEK}


def schema_of(name: str) -> T.StructType:
    return SCHEMAS[name] if name in SCHEMAS else VIEW_SCHEMAS[name]


def with_week(weekly: DataFrame) -> DataFrame:
    """Make sure the calendar day of the report is there as `week`."""
    if WEEK in weekly.columns:
        return weekly
    return weekly.withColumn(WEEK, F.to_date("collection_week"))


@dataclass(frozen=True)
class Tables:
    """What every question takes: the three base relations, however they came about.

    The other two are results that a root folder may keep (`build_views`); questions that need them work them out otherwise.
    """

    hospital: DataFrame
    weekly_hospital_stats: DataFrame
    hospital_quality: DataFrame
    state_trend: DataFrame | None = None
    last_report: DataFrame | None = None


VERSION = "version"
# The part of a table without partitions.
WHOLE = ""
KEY = "hospital_pk"
# Rows lie in the order of this column within a partition, and the log keeps its range in each file.
ORDER = {STATE_TREND: "state"}
#: `compact` rewrites parts that have more files than this, of fewer rows than that on average.
MANY_FILES, FEW_ROWS = 8, 1_000_000


def scan(spark: SparkSession, root: str, name: str, files: Iterable[DataFile]) -> DataFrame:
    """The rows of these stored files, with the version they lie in; no other folder is listed."""
    fields = [*schema_of(name).fields, T.StructField(VERSION, T.StringType())]
    paths = sorted(f"{root}/{f.path}" for f in files)
    if not paths:
        return spark.createDataFrame([], T.StructType(fields))
    return spark.read.schema(T.StructType(fields)).option("basePath", f"{root}/{name}").parquet(*paths)


def table_of(spark: SparkSession, root: str, name: str, state: State) -> DataFrame:
    """The live rows of a table; empty if the state has none."""
    return scan(spark, root, name, state.of(name)).select(*schema_of(name).names)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return table_of(spark, root, name, read_state(spark, root))


def read_tables(spark: SparkSession, root: str) -> Tables:
    """All three tables as one publish left them."""
    state = read_state(spark, root)
    views = {name: table_of(spark, root, name, state) for name in VIEW_SCHEMAS if state.of(name)}
    return Tables(*(table_of(spark, root, name, state) for name in SCHEMAS), **views)


def write_version(df: DataFrame, root: str, name: str, version: str) -> list[DataFile]:
    """Write rows as files that nobody sees yet, and describe them.

    The rebalance hint lets AQE size the output files from the shuffle it measured: a
    partition that holds most of the rows is split over many tasks, small ones share one.
    A partitioned write sorts by the partition anyway; with the key behind it, equal keys
    lie together and the key ranges of files and row groups become useful.
    """
    spark, partition, path = df.sparkSession, PARTITION_COLUMN.get(name), f"{root}/{name}/{VERSION}={version}"
    df = df.select(*schema_of(name).names)
    if partition is None:
        df.hint("rebalance").write.mode("overwrite").parquet(path)
    else:
        rows = df.hint("rebalance", partition).sortWithinPartitions(partition, ORDER.get(name, KEY))
        rows.write.mode("overwrite").partitionBy(partition).parquet(path)
    return describe_files(spark.read.schema(schema_of(name)).parquet(path), name, ORDER.get(name, KEY), partition)


def replaced_parts(name: str, added: list[DataFile], state: State) -> Change:
    """The change that puts written files in the place of everything in their parts."""
    parts = frozenset(f.part for f in added) if name in PARTITION_COLUMN else frozenset([WHOLE])
    return Change(name, parts, added, frozenset(f.path for f in state.of(name, parts)))


def write_table(df: DataFrame, root: str, name: str) -> None:
    """Replace `hospital`, or only those partitions of a partitioned table `df` has rows for.

    The results of `build_views` go; build them again if they are wanted.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    added = write_version(df, root, name, f"v{version}")
    while True:
        state = read_state(spark, root, or_empty=True)
        # the stored results no longer fit
        views = [Change(v, frozenset(), [], frozenset(f.path for f in state.of(v))) for v in VIEW_SCHEMAS]
        if commit(spark, root, version, [replaced_parts(name, added, state), *views], state):
            return


def matched_files(
    spark: SparkSession, root: str, name: str, rows: DataFrame, key: list[str], state: State
) -> tuple[list[DataFile], set[str]]:
    """The live files that hold a key of `rows`, and the paths of those that hold no other rows.

    The log's key ranges leave out most files of the rows' parts; of the others only the key columns are read, and only
    keys and the number of the file are shuffled.
    """
    if not state.of(name):
        return [], set()
    partition = PARTITION_COLUMN.get(name)
    part = F.col(partition).cast("string") if partition else F.lit(WHOLE)
    # one row per day or year in the batch
    ranges = rows.groupBy(part.alias("part")).agg(F.min(KEY).alias("first"), F.max(KEY).alias("last")).collect()
    span = {r["part"]: (r["first"], r["last"]) for r in ranges}
    near = [
        f for f in state.of(name, span)
        # a file or batch of null keys has no range
        if None in (f.first_key, f.last_key, *span[f.part]) or (f.first_key <= span[f.part][1] and span[f.part][0] <= f.last_key)
    ]
    if not near:
        return [], set()
    place = F.substring_index(F.col("_metadata.file_path"), f"/{name}/", -1)
    stored = scan(spark, root, name, near).select(*key, F.xxhash64(place).alias("_file"))
    # an inner join with distinct keys: Spark would move a semi-join below the number, and shuffle the long paths
    hit = stored.join(rows.select(*key).distinct(), key).groupBy("_file").count().collect()  # one row per file
    counts = {r["_file"]: r["count"] for r in hit}
    numbers = spark.createDataFrame([(f.path.partition("/")[2],) for f in near], "place string")
    found = [(f, r["number"]) for f, r in zip(near, numbers.select(F.xxhash64("place").alias("number")).collect(), strict=True)]
    alike = Counter(number for _, number in found)
    # files of one number are told apart by nothing here, so they count as held in part
    whole = {f.path for f, number in found if alike[number] == 1 and counts.get(number) == f.rows}
    return [f for f, number in found if number in counts], whole


def files_with_keys(spark: SparkSession, root: str, name: str, rows: DataFrame, key: list[str], state: State) -> list[DataFile]:
    """The live files that hold a key of `rows`."""
    return matched_files(spark, root, name, rows, key, state)[0]


def merged(root: str, name: str, winners: DataFrame, key: list[str], state: State, version: str) -> Change:
    """Write the winners, and what else is in the live files that hold one of their keys.

    Files of which every row is replaced are not read again.
    """
    spark, partition = winners.sparkSession, PARTITION_COLUMN.get(name)
    touched, whole = matched_files(spark, root, name, winners, key, state)
    partly = [f for f in touched if f.path not in whole]
    columns = schema_of(name).names
    rows = replace_rows(scan(spark, root, name, partly).select(*columns), winners.select(*columns), key) if partly else winners
    added = write_version(rows, root, name, version)
    parts = frozenset(f.part for f in added) if partition else frozenset([WHOLE])
    return Change(name, parts, added, frozenset(f.path for f in touched))


def compact(spark: SparkSession, root: str, name: str, many_files: int = MANY_FILES, few_rows: int = FEW_ROWS) -> int:
    """Put small files of a part together, as many small loads leave them; returns how many were taken out.

    Loads may run meanwhile: a part they change is left for the next call.
    """
    state, version = read_state(spark, root), uuid.uuid4().hex
    small = [f for f in state.of(name) if f.rows < few_rows]
    crowded = {p for p in {f.part for f in small} if sum(f.part == p for f in small) > many_files}
    old = [f for f in small if f.part in crowded]
    if not old:
        return 0
    added = write_version(scan(spark, root, name, old), root, name, f"v{version}")
    base = state
    while True:
        still = frozenset(p for p in crowded if not Change(name, frozenset([p]), [], frozenset()).clashes(base, state))
        gone = frozenset(f.path for f in old if f.part in still)
        if not gone:
            return 0
        if commit(spark, root, version, [Change(name, still, [f for f in added if f.part in still], gone)], state):
            return len(gone)
        state = read_state(spark, root)


def expire(spark: SparkSession, root: str) -> int:
    """Remove data files that are no longer live, and fold the log; returns how many files.

    Call it while no load runs and no reader still uses an older state.
    """
    state = read_state(spark, root)
    removed = 0
    for name in (*SCHEMAS, *VIEW_SCHEMAS):
        depth = f"{root}/{name}/{VERSION}=*" + ("/*=*" if name in PARTITION_COLUMN else "")
        pattern, files = filesystem(spark, f"{depth}/*.parquet")
        for found in files.globStatus(pattern) or []:
            if stored_path(found.getPath().toString(), name) not in state.files:
                files.delete(found.getPath(), False)
                removed += 1
    fold(spark, root, state)
    forget(spark, root, state)
    return removed


def read_sql_query(sql: str, tables: Tables, params: dict | None = None) -> DataFrame:
    """Run SQL text against the tables, with named parameters (`:name`).

    The text is resolved in a session of its own in which the tables have their plain names, so it may be any query, with
    comments, recursive or nested WITH lists, quoted names or names of the tables used again inside. The caller's
    settings and current database hold there; its temporary views and functions are not seen.
    """
    spark = tables.hospital.sparkSession
    scope, mark = _scope(spark), uuid.uuid4().hex
    shared = {name: f"{name}_{mark}" for name in SCHEMAS}
    for name, view in shared.items():
        getattr(tables, name).createGlobalTempView(view)
    try:
        for name, view in shared.items():
            scope.sql(f"CREATE TEMPORARY VIEW {name} AS TABLE global_temp.{view}")
        return scope.sql(sql, args=params or {})
    finally:
        # the analysed query holds the relations themselves
        for view in shared.values():
            spark.catalog.dropGlobalTempView(view)


def _scope(spark: SparkSession) -> SparkSession:
    """A session with the settings of another and no views."""
    scope = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if scope.conf.get(key, None) != value and spark.conf.isModifiable(key):
            scope.conf.set(key, value)
    scope.catalog.setCurrentDatabase(spark.catalog.currentDatabase())
    return scope
