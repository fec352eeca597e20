"""File-to-table loads, all or nothing.

A load validates before it writes. The rows that win are staged; `publish` writes them as new files, together with the
other rows of those stored files that hold one of their keys, and one entry in the publish log makes all of them
live, so hospitals and reports change together. A load that was cut short has changed nothing: repeat it, or its
`publish`. A finished publish is not done again. Several loads may publish to a root folder at once: the second to commit
merges those tables again whose parts the first has changed, so the result is that of one load after the other.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from bedledger.operators.checks import duplicate_keys, orphan_rows, width_overflow
from bedledger.operators.cleaning import (
    TYPED,
    conform_quality,
    explain_hhs_rows,
    explain_quality_rows,
    reject_report,
    texts_read,
    typed_rows,
    with_typed_columns,
    without_read_texts,
)
from bedledger.operators.stored_views import changes_of_views, has_views
from bedledger.operators.upsert import (
    hospital_winners,
    quality_winners,
    replace_rows,
    suspects,
    weekly_winners,
    weekly_winners_apart,
)
from bedledger.schema import (
    ARRIVAL,
    BROKEN_LINE,
    HOSPITAL_COLUMNS,
    HOSPITAL_KEY,
    HOSPITAL_WIDTHS,
    QUALITY_COLUMNS,
    QUALITY_KEY,
    QUALITY_WIDTHS,
    WEEKLY_COLUMNS,
    WEEKLY_KEY,
)
from bedledger.session import scratch_folder
from bedledger.sources.feeds import read_hhs_csv, read_quality_csv
from bedledger.sources.manifest import Change, State, commit, read_state, remove_folder
from bedledger.sources.tables import (
    SCHEMAS,
    merged,
    table_of,
    with_week,
)

WIDTHS = {"hospital": HOSPITAL_WIDTHS, "hospital_quality": QUALITY_WIDTHS}
KEYS = {
    "hospital": HOSPITAL_KEY,
    "weekly_hospital_stats": WEEKLY_KEY,
    "hospital_quality": QUALITY_KEY,
}
#: Numbers of keys that are broadcast, 8 bytes each.
FEW_KEYS = 100_000


class LoadRejected(Exception):
    """Some rows cannot be stored, so nothing was."""


@dataclass(frozen=True)
class LoadResult:
    summary: dict[str, int]
    staging: str


def _records(columns: list[str], fits: Column) -> Column:
    # a struct is never NULL itself, so rows with NULL fields count as well
    return F.count_distinct(F.when(fits, F.struct(*columns)))


def hhs_load_summary(explained: DataFrame) -> DataFrame:
    """One row of counts: rows read, dropped, rejected, and records per table."""
    fits = ~F.col("bad_key") & F.col("reject_reason").isNull()
    return explained.agg(
        F.count("*").alias("rows_read"),
        F.count_if("bad_key").alias("rows_dropped"),
        F.count_if(~F.col("bad_key") & F.col("reject_reason").isNotNull()).alias("rows_rejected"),
        _records(HOSPITAL_COLUMNS, fits).alias("hospital_records"),
        F.count_if(fits).alias("weekly_records"),
    )


def quality_load_summary(explained: DataFrame) -> DataFrame:
    """As above for the quality feed; `known` says whether the hospital exists."""
    stored = ~F.col("bad_key") & (F.col("known") | F.col(BROKEN_LINE))
    fits = stored & F.col("reject_reason").isNull()
    columns = [c for c in QUALITY_COLUMNS if c != "rating_year"]
    return explained.agg(
        F.count("*").alias("rows_read"),
        F.count_if(~stored).alias("rows_dropped"),
        F.count_if(stored & F.col("reject_reason").isNotNull()).alias("rows_rejected"),
        _records(columns, fits).alias("quality_records"),
    )


def _stage(spark: SparkSession, staging: str | None) -> str:
    return f"{staging or scratch_folder(spark)}/load-{uuid.uuid4().hex}"


def _staged_feed(explained: DataFrame, dropped: Column, failing: Column, stage: str) -> tuple[DataFrame, dict]:
    """Parse the text once; all later steps read this columnar copy. The write itself counts its rows.

    Returns the copy, its arrivals as numbers, and the counts with the first row that fails.
    """
    seen, spark = Observation(), explained.sparkSession
    explained.observe(
        seen,
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(dropped).alias("rows_dropped"),
        F.count_if(failing).alias("rows_rejected"),
        F.count_if(~dropped & ~failing).alias("rows_left"),
        F.min(F.when(failing, F.struct(ARRIVAL, "hospital_pk", "reject_reason"))).alias("first"),
    ).write.parquet(f"{stage}/feed")
    stored = spark.read.schema(explained.schema).parquet(f"{stage}/feed")
    return numbered(stored), seen.get


def numbered(feed: DataFrame) -> DataFrame:
    """Arrivals as numbers in the same order, by which hash aggregates can reduce.

    A block of a file is read by one task, so its rows differ in the lower bits of their numbers there; the blocks are
    ranked by file time, file and place. There are as many as the reading had tasks.
    """
    in_block = F.col(f"{ARRIVAL}.row").bitwiseAND(F.lit((1 << 33) - 1))
    block = F.struct(*(F.col(f"{ARRIVAL}.{c}").alias(c) for c in ("file_time", "file", "block"))).alias("of_block")
    ranks = feed.select(block).distinct().select("of_block", F.row_number().over(Window.orderBy("of_block")).alias("at"))
    others = [c for c in feed.columns if c != ARRIVAL]
    number = F.shiftleft(F.col("at").cast("long"), 33).bitwiseOR(in_block)
    # blocks always have a rank; the table of ranks is small, and Spark sees its size
    return feed.withColumn("of_block", block).join(ranks, "of_block").select(*others, number.alias(ARRIVAL))


def _stage_winners(winners: DataFrame, stage: str, name: str, counted: str | None = None) -> int:
    """Write the winners of a batch, so that they are worked out once; returns the sum of a column that counts rows."""
    if counted:
        seen = Observation()
        winners = winners.observe(seen, F.sum(counted).alias("rows"))
    winners.select(*SCHEMAS[name].names).write.parquet(f"{stage}/new/{name}")
    return (seen.get["rows"] or 0) if counted else 0


def _report_winners(batch: DataFrame, stage: str) -> DataFrame:
    """The last report of each key. Feeds repeat few of them, and then the others need no shuffle."""
    seen, spark = Observation(), batch.sparkSession
    suspected = suspects(batch, WEEKLY_KEY)
    suspected.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{stage}/suspects")
    found = seen.get.get("rows") or 0
    if found > FEW_KEYS:
        return weekly_winners(batch)
    if not found:
        return batch.select(*WEEKLY_COLUMNS)
    return weekly_winners_apart(batch, spark.read.schema(suspected.schema).parquet(f"{stage}/suspects"))


def _accept(feed: DataFrame, seen: dict, on_reject: str, stage: str) -> DataFrame:
    """Feed rows that go on; raises when a row fails and rejects are not to be set aside."""
    if on_reject == "set_aside":
        typed = [c for c in feed.columns if c.startswith(TYPED)]
        # the tests are stored columns here, so the other rows need not pass through the report
        rejects = feed.filter("bad_key OR reject_reason IS NOT NULL")
        reject_report(rejects).drop(ARRIVAL, *typed).write.parquet(f"{stage}/rejects")
    elif seen["first"] is not None:
        first = seen["first"]
        raise LoadRejected(f"{first.hospital_pk}: {first.reject_reason}; see {stage}/feed")
    return feed.filter("reject_reason IS NULL")


def _check_mode(on_reject: str) -> None:
    if on_reject not in ("abort", "set_aside"):
        raise ValueError(f"on_reject must be 'abort' or 'set_aside', not {on_reject!r}")


def load_hhs_data(
    spark: SparkSession,
    file_path: str,
    root: str,
    on_reject: str = "abort",
    staging: str | None = None,
    multi_line: bool = False,
) -> LoadResult:
    """Load a weekly feed into `hospital` and `weekly_hospital_stats`.

    on_reject='abort' loads nothing if one row does not fit; 'set_aside' loads the other
    rows and keeps the misfits under `<staging>/rejects`. multi_line=True allows line
    breaks in quoted fields, at the price of one task per file.

    The text is read once. The staged copy is read once for the hospitals' columns and once for the reports'; the writes
    count the rows for the summary.
    """
    _check_mode(on_reject)
    stage = _stage(spark, staging)
    raw = read_hhs_csv(spark, file_path, multi_line, broken_lines="mark")
    failing = ~F.col("bad_key") & F.col("reject_reason").isNotNull()
    typed = with_typed_columns(explain_hhs_rows(texts_read(raw)))
    feed, seen = _staged_feed(without_read_texts(typed), F.col("bad_key"), failing, stage)
    batch = typed_rows(_accept(feed, seen, on_reject, stage))

    hospitals = _stage_winners(hospital_winners(batch, count="_rows"), stage, "hospital", "_rows")
    _stage_winners(with_week(_report_winners(batch, stage)), stage, "weekly_hospital_stats")
    return _published(spark, stage, root, seen, hospital_records=hospitals, weekly_records=seen["rows_left"])


def load_quality_data(
    spark: SparkSession,
    file_path: str,
    year: int,
    root: str,
    on_reject: str = "abort",
    staging: str | None = None,
    multi_line: bool = False,
) -> LoadResult:
    """Load the quality feed of one rating year; ratings of unknown hospitals are left out."""
    year = int(year)
    _check_mode(on_reject)
    stage = _stage(spark, staging)
    stored = table_of(spark, root, "hospital", read_state(spark, root, or_empty=True))
    hospitals = stored.select("hospital_pk", F.lit(True).alias("known"))
    raw = read_quality_csv(spark, file_path, multi_line, broken_lines="mark")
    marked = explain_quality_rows(raw).join(hospitals, "hospital_pk", "left").fillna(False, ["known"])
    # a rating of an unknown hospital is left out whatever else it holds
    counts = ~F.col("bad_key") & (F.col("known") | F.col(BROKEN_LINE))
    feed, seen = _staged_feed(marked, ~counts, counts & F.col("reject_reason").isNotNull(), stage)
    batch = conform_quality(_accept(feed, seen, on_reject, stage).filter("known"), year)

    ratings = _stage_winners(quality_winners(batch, count="_rows"), stage, "hospital_quality", "_rows")
    return _published(spark, stage, root, seen, quality_records=ratings)


def _published(spark: SparkSession, stage: str, root: str, seen: dict, **records: int) -> LoadResult:
    # keys, widths and references hold by the way these winners were made; `publish` checks them for other stages
    _commit_merged(spark, stage, root, _staged(spark, stage), read_state(spark, root, or_empty=True))
    for part in ("feed", "new", "suspects"):
        remove_folder(spark, f"{stage}/{part}")
    return LoadResult({c: seen[c] for c in ("rows_read", "rows_dropped", "rows_rejected")} | records, stage)


def _staged(spark: SparkSession, stage: str) -> dict[str, DataFrame]:
    """The staged rows of those tables that have some."""
    found = {}
    for name in KEYS:
        try:
            rows = spark.read.schema(SCHEMAS[name]).parquet(f"{stage}/new/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue  # another kind of load
        if not rows.isEmpty():
            found[name] = rows
    return found


def _check_contract(name: str, key: list[str], winners: DataFrame, stage: str) -> None:
    """Keys, widths and, for reports, references of the staged rows, before anything is written to a table.

    Ratings are joined with the stored hospitals when they are staged.
    """
    if not duplicate_keys(winners, key).isEmpty():
        raise LoadRejected(f"{name}: keys occur twice; see {stage}/new")
    widths = WIDTHS.get(name)
    if widths and not width_overflow(winners, widths).filter("overflow_rows > 0").isEmpty():
        raise LoadRejected(f"{name}: values are too wide; see {stage}/new")
    if name == "weekly_hospital_stats":
        hospitals = winners.sparkSession.read.schema(SCHEMAS["hospital"]).parquet(f"{stage}/new/hospital")
        if not orphan_rows(winners, hospitals).isEmpty():
            raise LoadRejected(f"{name}: rows without a hospital; see {stage}/new")


def publish(spark: SparkSession, stage: str, root: str) -> None:
    """Merge the staged winners into the stored tables and make the result live in one step.

    A finished publish is left alone, so an old stage cannot undo later loads.
    """
    state = read_state(spark, root, or_empty=True)
    if stage in state.publishes:
        return
    winners = _staged(spark, stage)
    for name, rows in winners.items():
        _check_contract(name, KEYS[name], rows, stage)
    _commit_merged(spark, stage, root, winners, state)


def _commit_merged(spark: SparkSession, stage: str, root: str, winners: dict[str, DataFrame], state: State) -> None:
    """Write and commit; whenever another publish comes first, merge what it has changed again."""
    changes: dict[str, Change] = {}
    while stage not in state.publishes:
        version = f"{stage.rpartition('/')[2]}-{state.seq + 1}"
        for name, rows in winners.items():
            if name not in changes:
                changes[name] = merged(root, name, rows, KEYS[name], state, version)
        done = list(changes.values())
        # the stored results depend on all of these, so they are made again whenever another publish comes first
        views = changes_of_views(spark, root, winners, done, state, version) if has_views(state) else []
        if commit(spark, root, stage, [*done, *views], state):
            return
        now = read_state(spark, root)
        changes = {name: c for name, c in changes.items() if not c.clashes(state, now)}
        state = now
