"""Exact de-duplication by Grace hashing.

Texts are equal when they are identical after each run of blanks is one space. Each scan task looks its texts up in an
open-addressing table of bounded size that compares complete contents; a full table is closed and a new one begun, so a
text is stored once per table however often it is repeated, and a hot text leaves each task as a few entries. The entries
are the first spill files, a Parquet table in the shared folder. They are partitioned by digits of their hash:
a bucket whose bytes fit goes to one task, which looks all its entries up in a table again and numbers the groups;
the entries of the larger buckets are written as the next spill files and partitioned by the next digit, until every
bucket fits or holds one hash only. Such a bucket needs no more room than its different texts, since copies stream past.

Defined results: a null text counts as empty; blanks at the ends of a text become one space and stay; texts of any length
are compared whole; ids that are null come after all others and name a group only if all its ids are null; of several
rows with the smallest id, and of repeated rows, exactly one is kept; an empty table gives an empty result; further
columns, whatever their names, are ignored by the digest and kept by `keep_unique`.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedledger.llm.common import map_stream
from bedledger.session import scratch_folder
from bedledger.sources.manifest import remove_folder

#: A scan task's table is closed at this many bytes of different texts, or this many rows.
TABLE_BYTES = 48 << 20
TABLE_ROWS = 1 << 18
#: Buckets up to this many bytes are dealt with by one task.
BUCKET_BYTES = 64 << 20
#: Room an entry takes in a task beside its text.
ENTRY_BYTES = 256
#: Most buckets into which one level divides a bucket.
FAN_OUT = 512
SEED = 7

_BLANKS = re.compile(rb"[\x20\x09-\x0d]+")
# the same runs for Spark's regular expressions
BLANKS = r"[\x20\x09-\x0D]+"

ROWS = "doc_id long, entry long, first boolean, copies long, hash long, bytes long, text binary"
_SENT = ("bucket", "hash", "entry", "doc_id", "copies", "text")
GROUPS = "entry long, keep_id long, keeper boolean, group_size long, text_sha256 string"


class ContentTable:
    """Open addressing with linear probing; a slot holds the number of a content, and contents are compared whole."""

    def __init__(self) -> None:
        self.contents: list[bytes] = []
        self.hashes: list[int] = []
        self.bytes = 0
        self._mask = 1023
        self._slots = [-1] * 1024

    def __len__(self) -> int:
        return len(self.contents)

    def number(self, content: bytes, hashed: int) -> int:
        """The number of `content`; a new one, the next, if it is not there yet."""
        slots, mask, at = self._slots, self._mask, hashed & self._mask
        while (n := slots[at]) >= 0:
            if self.hashes[n] == hashed and self.contents[n] == content:
                return n
            at = (at + 1) & mask
        slots[at] = n = len(self.contents)
        self.contents.append(content)
        self.hashes.append(hashed)
        self.bytes += len(content)
        if 2 * n > mask:
            self._grow()
        return n

    def _grow(self) -> None:
        self._mask = mask = 2 * self._mask + 1
        self._slots = slots = [-1] * (mask + 1)
        for n, hashed in enumerate(self.hashes):
            at = hashed & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = n


def normalised(text: bytes | None) -> bytes:
    return _BLANKS.sub(b" ", text or b"")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _least(ids: np.ndarray, known: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """The row of each group with the least known id, the earliest of equal ones; rows with unknown ids come last."""
    order = np.lexsort((np.arange(len(ids)), ids, ~known, group))
    starts = np.searchsorted(group[order], np.arange(groups))
    return order[starts]


def entries(documents: DataFrame, table_bytes: int = TABLE_BYTES, table_rows: int = TABLE_ROWS) -> DataFrame:
    """One row per document with the entry that stands for its text; `first` rows carry the text and its copies."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 36, 0
        table, numbers, ids = ContentTable(), [], []

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal table, numbers, ids, made
            group = np.array(numbers, np.int64)
            known = np.array([i is not None for i in ids])
            least = _least(np.array([i or 0 for i in ids], np.int64), known, group, len(table))
            copies = np.bincount(group, minlength=len(table))
            first = np.zeros(len(ids), bool)
            first[least] = True
            # rows that carry a text go out in pieces of a bounded size
            size, cuts = 0, [0]
            for row in np.sort(least).tolist():
                size += len(table.contents[group[row]])
                if size > BUCKET_BYTES // 8:
                    cuts.append(row + 1)
                    size = 0
            cuts += [len(ids)] if cuts[-1] < len(ids) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                shown = [(n if f else None) for n, f in zip(numbers[a:b], first[a:b].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[a:b], pa.int64()),
                        pa.array(task + made + group[a:b]),
                        pa.array(first[a:b]),
                        pa.array([None if n is None else int(copies[n]) for n in shown], pa.int64()),
                        pa.array([None if n is None else _signed(table.hashes[n]) for n in shown], pa.int64()),
                        pa.array([None if n is None else len(table.contents[n]) for n in shown], pa.int64()),
                        pa.array([None if n is None else table.contents[n] for n in shown], pa.binary()),
                    ],
                    names=["doc_id", "entry", "first", "copies", "hash", "bytes", "text"],
                )
            made += len(table)
            table, numbers, ids = ContentTable(), [], []

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                content = normalised(text)
                numbers.append(table.number(content, xxhash.xxh64_intdigest(content, SEED)))
                ids.append(doc_id)
                if table.bytes > table_bytes or len(ids) >= table_rows:
                    yield from closed()
        if ids:
            yield from closed()

    return map_stream(rows, ROWS, run)


def resolved(dealt: DataFrame) -> DataFrame:
    """The group of each entry; `dealt` has whole buckets in each partition, sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bucket, members = ContentTable(), None, []

        def closed() -> Iterator[pa.RecordBatch]:
            group, entry, ids, copies = (np.array([m[k] for m in members], np.int64) for k in range(4))
            known = np.array([m[4] for m in members])
            least = _least(ids, known, group, len(table))[group]
            sizes = np.bincount(group, weights=copies, minlength=len(table)).astype(np.int64)
            digests = [hashlib.sha256(c).hexdigest() for c in table.contents]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(entry),
                    pa.array(ids[least], pa.int64(), mask=~known[least]),
                    pa.array(least == np.arange(len(members))),
                    pa.array(sizes[group]),
                    pa.array([digests[g] for g in group.tolist()], pa.string()),
                ],
                names=["entry", "keep_id", "keeper", "group_size", "text_sha256"],
            )

        for batch in batches:
            for b, hashed, entry, doc_id, copies, text in zip(*(batch.column(c).to_pylist() for c in _SENT), strict=True):
                if b != bucket:
                    if members:
                        yield from closed()
                    table, bucket, members = ContentTable(), b, []
                members.append((table.number(text, hashed % (1 << 64)), entry, doc_id or 0, copies, doc_id is not None))
        if members:
            yield from closed()

    return map_stream(dealt, GROUPS, run)


def exact_groups(documents: DataFrame, bucket_bytes: int = BUCKET_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row.

    The texts are scanned once. What moves are the entries, one per different text of a scan task's table; the rows
    are joined with their entries' groups by small keys, each of which has the rows of one table at most.
    """
    spark = documents.sparkSession
    folder = f"{scratch_folder(spark)}/grace-{uuid.uuid4().hex}"
    entries(documents).write.parquet(f"{folder}/rows")
    rows = spark.read.schema(ROWS).parquet(f"{folder}/rows")
    spilled = rows.where("first").withColumn("bucket", F.lit(0).cast("long"))
    cores, level, shift = spark.sparkContext.defaultParallelism, 0, 0
    while True:
        total = spilled.agg(F.sum(F.col("bytes") + ENTRY_BYTES)).first()[0] or 0
        # some digits of the hash; more buckets than cores, and than the bytes ask for
        bits = (max(2, min(fan_out, max(2 * cores, 2 * total // bucket_bytes))) - 1).bit_length()
        digit = F.shiftrightunsigned("hash", shift).bitwiseAND(F.lit((1 << bits) - 1))
        dealt = spilled.withColumn("bucket", F.shiftleft("bucket", bits).bitwiseOR(digit))
        # one row per bucket, joined back by Spark's measured size
        size = dealt.groupBy("bucket").agg(F.sum(F.col("bytes") + ENTRY_BYTES).alias("size"), (F.min("hash") != F.max("hash")).alias("divides"))
        larger = size.where((F.col("size") > bucket_bytes) & F.col("divides")).select("bucket")
        last = larger.isEmpty()
        fits = dealt if last else dealt.join(larger, "bucket", "left_anti")
        tasks = max(cores, 2 * total // bucket_bytes)
        lying = fits.select(*_SENT).repartitionByRange(tasks, "bucket").sortWithinPartitions("bucket")
        resolved(lying).write.parquet(f"{folder}/groups/level={level}")
        if not last:
            dealt.join(larger, "bucket", "left_semi").write.parquet(f"{folder}/spilled-{level}")
            spilled = spark.read.parquet(f"{folder}/spilled-{level}")
        if level:
            remove_folder(spark, f"{folder}/spilled-{level - 1}")
        if last:
            break
        level, shift = level + 1, shift + bits
    groups = spark.read.schema(GROUPS).parquet(f"{folder}/groups")
    return rows.select("doc_id", "entry", "first").join(groups, "entry").select(
        "doc_id", "keep_id", "group_size", (F.col("first") & F.col("keeper")).alias("kept"), "text_sha256"
    )


def keep_unique(documents: DataFrame) -> DataFrame:
    """The rows of `documents` that stay, one of equal texts, with all their columns."""
    names = [f"c{i}" for i in range(len(documents.columns))]
    at = {c.lower(): n for c, n in zip(documents.columns, names, strict=True)}
    own, text = documents.toDF(*names), F.coalesce(F.col(at["text"]).cast("string"), F.lit(""))
    digest = F.sha2(F.regexp_replace(text, BLANKS, " "), 256)
    staying = exact_groups(documents.select("doc_id", "text")).where("kept").select(_row_key(F.col("doc_id"), F.col("text_sha256")))
    own = own.withColumn("key", _row_key(F.col(at["doc_id"]).cast("long"), digest))
    kept = own.join(staying, "key", "left_semi").dropDuplicates(["key"])
    return kept.select([F.col(n).alias(c) for n, c in zip(names, documents.columns, strict=True)])


def _row_key(doc_id: Column, digest: Column) -> Column:
    # without nulls, so that rows without an id are joined as well
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), digest).alias("key")
