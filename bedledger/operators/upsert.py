"""Keyed last-write-wins upserts as set operations.

`seq` names the column with the arrival order; it differs between the rows of a key. A batch may hold one key in a
large share of its rows: both reductions below are plain aggregations, so every map task sends at most one
row per key (or per distinct row) into the shuffle. Where the order is a number and all values are numbers, as
for weekly reports, the reduction is a hash aggregate; text and structs in the buffer make it a sort within each map
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedledger.schema import (
    ARRIVAL,
    HOSPITAL_COLUMNS,
    HOSPITAL_KEY,
    QUALITY_COLUMNS,
    QUALITY_KEY,
    WEEKLY_COLUMNS,
    WEEKLY_KEY,
)


def first_of_each_row(df: DataFrame, seq: str = ARRIVAL) -> DataFrame:
    """Full-row distinct (NULLs equal) that keeps the arrival of the first copy."""
    values = [c for c in df.columns if c != seq]
    return df.groupBy(*values).agg(F.min(seq).alias(seq))


def last_per_key(df: DataFrame, key: list[str], seq: str = ARRIVAL, count: str | None = None) -> DataFrame:
    """The last arrived row of every key, without `seq`; `count` names a column for the number of rows of the key."""
    values = [c for c in df.columns if c not in (*key, seq)]
    counts = [F.count(F.lit(1)).alias(count)] if count else []
    if all(isinstance(df.schema[c].dataType, T.NumericType) for c in (*values, seq)):
        return df.groupBy(*key).agg(*(F.max_by(c, seq).alias(c) for c in values), *counts)
    last = df.groupBy(*key).agg(F.max(seq).alias(seq), *counts)
    # arrivals differ, so a key and its last arrival find one row
    return df.join(last, [*key, seq]).select(*key, *values, *([count] if count else []))


def rows_to_keep(existing: DataFrame, winners: DataFrame, key: list[str]) -> DataFrame:
    """Existing rows that no winner replaces.

    Winners that are few enough are broadcast by Catalyst, and then the existing table is
    not shuffled at all.
    """
    return existing.join(winners.select(*key), key, "left_anti")


def replace_rows(existing: DataFrame, winners: DataFrame, key: list[str]) -> DataFrame:
    return rows_to_keep(existing, winners, key).unionByName(winners)


def hospital_winners(batch: DataFrame, seq: str = ARRIVAL, count: str | None = None) -> DataFrame:
    """Equal rows collapse to their first copy, then the last distinct row per key wins; `count` as above."""
    rows = first_of_each_row(batch.select(*HOSPITAL_COLUMNS, seq), seq)
    return last_per_key(rows, HOSPITAL_KEY, seq, count)


def quality_winners(batch: DataFrame, seq: str = ARRIVAL, count: str | None = None) -> DataFrame:
    """As for hospitals, with one row per hospital and rating year."""
    rows = first_of_each_row(batch.select(*QUALITY_COLUMNS, seq), seq)
    return last_per_key(rows, QUALITY_KEY, seq, count)


def weekly_winners(batch: DataFrame, seq: str = ARRIVAL) -> DataFrame:
    """The last row per hospital and timestamp wins; equal rows are not collapsed first."""
    return last_per_key(batch.select(*WEEKLY_COLUMNS, seq), WEEKLY_KEY, seq)


def suspects(batch: DataFrame, key: list[str]) -> DataFrame:
    """Numbers that stand for more than one row: `_number` of every key that occurs twice, and hardly any other.

    One whole number per row is shuffled, not the row.
    """
    return batch.select(key_number(key)).groupBy("_number").count().filter("count > 1").select("_number")


def key_number(key: list[str]) -> Column:
    return F.xxhash64(*key).alias("_number")


def weekly_winners_apart(batch: DataFrame, suspected: DataFrame, seq: str = ARRIVAL) -> DataFrame:
    """As `weekly_winners`, where few keys occur twice: `suspected` from above is broadcast.

    A row whose number nothing else has is the only one of its key, and is not shuffled.
    """
    rows = batch.select(*WEEKLY_COLUMNS, seq, key_number(WEEKLY_KEY))
    few = F.broadcast(suspected)
    alone = rows.join(few, "_number", "left_anti").select(*WEEKLY_COLUMNS)
    return alone.unionByName(weekly_winners(rows.join(few, "_number", "left_semi"), seq).select(*WEEKLY_COLUMNS))


def upsert_hospital(existing: DataFrame, batch: DataFrame, seq: str = ARRIVAL) -> DataFrame:
    return replace_rows(existing, hospital_winners(batch, seq), HOSPITAL_KEY)


def upsert_quality(existing: DataFrame, batch: DataFrame, seq: str = ARRIVAL) -> DataFrame:
    return replace_rows(existing, quality_winners(batch, seq), QUALITY_KEY)


def upsert_weekly(existing: DataFrame, batch: DataFrame, seq: str = ARRIVAL) -> DataFrame:
    return replace_rows(existing.select(*WEEKLY_COLUMNS), weekly_winners(batch, seq), WEEKLY_KEY)


def known_hospitals_only(ratings: DataFrame, hospital: DataFrame) -> DataFrame:
    """Ratings whose hospital is in the table."""
    # a semi-join takes repeated keys as they are, so they need not be made distinct
    return ratings.join(hospital.select("hospital_pk"), "hospital_pk", "left_semi")


def get_existing_hospitals(hospital: DataFrame) -> DataFrame:
    return hospital.select("hospital_pk").distinct()
