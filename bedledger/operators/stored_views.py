"""Two results that loads keep up to date beside the tables they come from.

`state_trend` has the sums of each week and state, one partition per week: what the trend shows of all history is read
from it. `last_report` has the last week of each hospital. A root folder has them once `build_views` was called. Every
load then brings them to its own state in the same publish, so readers never see one without the other: sums are made again
for the weeks whose reports or hospitals' states it changed, last reports are merged by hospital.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedledger.plans.slices import amounts, sums
from bedledger.schema import HOSPITAL_KEY, WEEK
from bedledger.sources.manifest import Change, State, commit, read_state
from bedledger.sources.tables import (
    LAST_REPORT,
    STATE_TREND,
    WHOLE,
    files_with_keys,
    merged,
    replaced_parts,
    scan,
    schema_of,
    write_version,
)

WEEKLY, HOSPITAL = "weekly_hospital_stats", "hospital"


def sums_by_week_and_state(weekly: DataFrame, hospital: DataFrame) -> DataFrame:
    """Beds, occupied and COVID beds of each week and state, before clamps and rates."""
    states = hospital.filter(F.col("state").isNotNull()).select("hospital_pk", "state")
    return (
        weekly.select("hospital_pk", WEEK, *amounts())
        .join(states, "hospital_pk")
        .groupBy(WEEK, "state")
        .agg(*sums("total_beds", "occupied_beds", "covid_beds"))
    )


def last_reports(weekly: DataFrame) -> DataFrame:
    return weekly.groupBy("hospital_pk").agg(F.max(WEEK).alias("last_report_date"))


def after(state: State, changes: list[Change]) -> State:
    """The live files once these changes are committed."""
    files = dict(state.files)
    for c in changes:
        for path in c.removed:
            files.pop(path, None)
        files.update({f.path: f for f in c.added})
    return State(state.seq, files, state.publishes)


def has_views(state: State) -> bool:
    return bool(state.of(LAST_REPORT)) or bool(state.of(STATE_TREND))


def _rows(spark: SparkSession, root: str, name: str, state: State, parts=None) -> DataFrame:
    return scan(spark, root, name, state.of(name, parts)).select(*schema_of(name).names)


def build_views(spark: SparkSession, root: str) -> None:
    """Make both results from the whole tables; call it again after tables were replaced by hand."""
    version = f"views-{uuid.uuid4().hex}"
    while True:
        state = read_state(spark, root)
        weekly, hospital = _rows(spark, root, WEEKLY, state), _rows(spark, root, HOSPITAL, state)
        changes = []
        for name, rows in ((STATE_TREND, sums_by_week_and_state(weekly, hospital)), (LAST_REPORT, last_reports(weekly))):
            added = write_version(rows, root, name, f"{version}-{state.seq + 1}")
            changes.append(Change(name, frozenset(), added, frozenset(f.path for f in state.of(name))))
        if commit(spark, root, version, changes, state):
            return


def _weeks_of_moved(spark: SparkSession, root: str, winners: DataFrame, state: State) -> set[str]:
    """Weeks with reports of hospitals whose state a load changes.

    A moved hospital may have reports in any week: the log's key ranges and the key column find them.
    """
    old = files_with_keys(spark, root, HOSPITAL, winners, HOSPITAL_KEY, state)
    was = scan(spark, root, HOSPITAL, old).select("hospital_pk", F.col("state").alias("was"))
    moved = winners.select("hospital_pk", "state").join(was, "hospital_pk").filter(~F.col("state").eqNullSafe(F.col("was")))
    if moved.isEmpty():
        return set()
    reports = scan(spark, root, WEEKLY, state.of(WEEKLY)).join(moved.select("hospital_pk"), "hospital_pk", "left_semi")
    return {r["part"] for r in reports.select(F.col(WEEK).cast("string").alias("part")).distinct().collect()}


def changes_of_views(
    spark: SparkSession, root: str, winners: dict[str, DataFrame], changes: list[Change], state: State, version: str
) -> list[Change]:
    """What a load does to the stored results, given what it does to the tables."""
    now, made = after(state, changes), []
    weeks = {p for c in changes if c.table == WEEKLY for p in c.parts}
    if HOSPITAL in winners:
        weeks |= _weeks_of_moved(spark, root, winners[HOSPITAL], state)
    if weeks:
        rows = sums_by_week_and_state(_rows(spark, root, WEEKLY, now, weeks), _rows(spark, root, HOSPITAL, now))
        added = write_version(rows, root, STATE_TREND, version)
        gone = replaced_parts(STATE_TREND, added, state).removed | {f.path for f in state.of(STATE_TREND, weeks)}
        made.append(Change(STATE_TREND, frozenset(weeks), added, gone))
    if WEEKLY in winners:
        fresh = last_reports(winners[WEEKLY])
        near = files_with_keys(spark, root, LAST_REPORT, fresh, HOSPITAL_KEY, state)
        old = scan(spark, root, LAST_REPORT, near).select("hospital_pk", F.col("last_report_date").alias("was"))
        latest = fresh.join(old, "hospital_pk", "left").select("hospital_pk", F.greatest("last_report_date", "was").alias("last_report_date"))
        change = merged(root, LAST_REPORT, latest, HOSPITAL_KEY, state, version)
        made.append(Change(LAST_REPORT, frozenset([WHOLE]), change.added, change.removed))
    return made
