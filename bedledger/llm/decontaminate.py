"""Benchmark decontamination by winnowing.

Of each `GUARANTEE` consecutive words the least hash of their `GRAM`-word grams is the fingerprint. A shared
span of that many words has the same fingerprint in a document and in a benchmark item, so joining the
fingerprints finds every one. A hit is extended to its whole window, and windows are joined word by
word, so hash collisions never count.

The join has two parts. The fingerprints of all items become a bitmap of fixed size (`FILTER_BITS`), which
every task holds; it leaves out almost all windows of the documents. The windows that pass are joined
exactly with the items' windows by Spark. A larger benchmark only lets more windows through to that join.

An item with fewer words than a window is one window of its own length; documents are tested at each
such length.

Defined results: a null text has no words; items without words are never found; repeated items count
once by item_id (a null one as `null`); repeated documents get one result row each; an empty table of
items leaves every document clean, an empty table of documents gives an empty result; further columns
are ignored by `contamination` and kept by `clean_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedledger.llm.common import checkpointed, map_batches, utf8

GUARANTEE, GRAM = 10, 5
FILTER_BITS = 24
#: Words that are hashed together.
CHUNK_WORDS = 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Word characters are digits, a to z after lower-casing, and everything beyond ASCII.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Mixed polynomial hash of each n consecutive word hashes."""
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out *= _ODD
        out += hashes[k : len(hashes) - n + 1 + k]
    out ^= out >> np.uint64(32)
    out *= _ODD
    out ^= out >> np.uint64(29)
    return out


def sliding_least(values: np.ndarray, n: int) -> np.ndarray:
    """Least of each n consecutive values."""
    width = 1
    while 2 * width <= n:
        values, width = np.minimum(values[:-width], values[width:]), 2 * width
    return np.minimum(values[: len(values) - (n - width)], values[n - width :]) if width < n else values


def window_fingerprints(hashes: np.ndarray, length: int) -> np.ndarray:
    """The fingerprint of each window of `length` words: winnowed for full windows, else that of the whole window."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    if length < GUARANTEE:
        return gram_hashes(hashes, length)
    return sliding_least(gram_hashes(hashes, GRAM), GUARANTEE - GRAM + 1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


# ---- Benchmark ----


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item, length, window, bit) of all windows of all items; a window is its words with spaces between."""
    rows = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text")
    )

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        items, lengths, windows, bits = [], [], [], []
        for item, text in zip(batch.column("item").to_pylist(), utf8(batch, "text"), strict=True):
            words = words_of(text)
            if words:
                n = min(GUARANTEE, len(words))
                made = [b" ".join(words[j : j + n]).decode() for j in range(len(words) - n + 1)]
                items += [item] * len(made)
                lengths += [n] * len(made)
                windows += made
                bits.append(window_fingerprints(word_hashes(words), n) >> np.uint64(64 - FILTER_BITS))
        bit = np.concatenate(bits).astype(np.int32) if bits else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(items, pa.string()), pa.array(lengths, pa.int32()), pa.array(windows, pa.string()), pa.array(bit)],
            names=["item", "length", "window", "bit"],
        )

    return map_batches(rows, "item string, length int, window string, bit int", run)


def fingerprint_filter(windows: DataFrame) -> tuple[list[int], np.ndarray]:
    """The window lengths that occur, and the bitmap of their fingerprints, of fixed size."""
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most GUARANTEE
    packed = windows.groupBy((F.col("bit") / 8).cast("int").alias("byte")).agg(
        F.bit_or(F.expr("shiftleft(1, bit % 8)")).alias("bits")
    )
    bitmap = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for batch in packed.toArrow().to_batches():  # at most one row per byte of the bitmap
        bitmap[batch.column("byte").to_numpy()] = batch.column("bits").to_numpy()
    return lengths, bitmap


# ---- Documents ----


def candidate_windows(texts: list[bytes | None], lengths: list[int], bitmap: np.ndarray) -> tuple[list[int], list[list[dict]]]:
    """Number of words of each text, and its windows that pass the bitmap."""
    sizes, found = [0] * len(texts), [[] for _ in texts]
    words, first = [], [0]
    began = 0

    def probe() -> None:
        hashes = word_hashes(words)
        starts = np.array(first)
        for n in lengths:
            prints = window_fingerprints(hashes, n) >> np.uint64(64 - FILTER_BITS)
            prints = prints.astype(np.int64)
            hits = np.flatnonzero((bitmap[prints >> 3] >> (prints & 7).astype(np.uint8)) & 1)
            owner = np.searchsorted(starts, hits, side="right") - 1
            inside = hits + n <= starts[np.minimum(owner + 1, len(starts) - 1)]
            for j, k in zip(hits[inside].tolist(), owner[inside].tolist(), strict=True):
                found[began + k].append({"at": j - first[k], "length": n, "window": b" ".join(words[j : j + n]).decode()})

    for i, text in enumerate(texts):
        own = words_of(text)
        sizes[i] = len(own)
        words += own
        first.append(len(words))
        if len(words) > CHUNK_WORDS or i == len(texts) - 1:
            probe()
            words, first, began = [], [0], i + 1
    return sizes, found


def with_candidates(documents: DataFrame, windows: DataFrame, names: tuple[str, str] = ("n_words", "hits")) -> DataFrame:
    """`documents` with the number of words and the windows that may be an item's; no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(fingerprint_filter(windows))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    hit = pa.struct([("at", pa.int64()), ("length", pa.int32()), ("window", pa.string())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, found = candidate_windows(utf8(batch, "text"), *shared.value)
        more = [pa.array(sizes, pa.int64()), pa.array(found, pa.list_(hit))]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    return map_batches(
        documents, f"{kinds}, `{names[0]}` long, `{names[1]}` array<struct<at: long, length: int, window: string>>", run
    )


def matched_windows(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, at, length, item) for the windows (row, at, length, window) that are an item's."""
    wanted = windows.select("length", "window", "item").distinct()
    return hits.join(wanted, ["length", "window"]).select("row", "at", "length", "item")


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of `documents`: words, words inside an item's window, items found, verdict."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    windows = checkpointed(item_windows(benchmark))
    tested = with_candidates(rows, windows).drop("text")
    tested = checkpointed(tested.withColumn("row", F.monotonically_increasing_id()))
    matched = matched_windows(tested.select("row", F.inline("hits")), windows)
    # where the next window begins before one ends, only the words up to it count here
    hit = F.expr(
        "aggregate(spans, named_struct('upto', 0L, 'n', 0L), (s, x) -> named_struct('upto', greatest(s.upto, x.at + x.length),"
        " 'n', s.n + greatest(0L, x.at + x.length - greatest(s.upto, x.at))), s -> s.n)"
    )
    told = matched.groupBy("row").agg(
        F.sort_array(F.collect_set(F.struct("at", "length"))).alias("spans"), F.sort_array(F.collect_set("item")).alias("items")
    ).select("row", hit.alias("hit"), "items")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return tested.join(told, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("hit").isNotNull().alias("contaminated"),
        items.alias("items"),
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `documents` without any window of an item; all columns stay.

    Rows without a candidate window go straight through; only the few others take part in the join.
    """
    names = [f"c{i}" for i in range(len(documents.columns))]
    text = names[[c.lower() for c in documents.columns].index("text")]
    plain = documents.toDF(*names).withColumnRenamed(text, "text")
    windows = checkpointed(item_windows(benchmark))
    tested = with_candidates(plain, windows, ("words", "hits"))
    clean = tested.where(F.size("hits") == 0).drop("words", "hits")
    doubtful = checkpointed(tested.where(F.size("hits") > 0).withColumn("row", F.monotonically_increasing_id()))
    matched = matched_windows(doubtful.select("row", F.inline("hits")), windows).select("row").distinct()
    spared = doubtful.join(matched, "row", "left_anti").drop("words", "hits", "row")
    return clean.unionByName(spared).toDF(*documents.columns)
