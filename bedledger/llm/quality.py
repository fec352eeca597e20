"""Quality rules with cross-document line frequency.

Base rules count words, symbols, repeated lines and repeated 3-word windows of each text. The method
then hashes every normalised line, counts the distinct documents of a host that have it, removes the
lines above the limit, and rejects documents of which too little is left. Equal texts count as one
document, so copies are left to de-duplication.

Defined results: a null text has no words and fails the base rules, as an empty one does; a null host
is a host of its own; repeated rows get the same verdict each; an empty table gives an empty result;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedledger.llm.common import checkpointed, map_batches

#: A line is common on a host when more than this many different documents there have it, however large the host is.
LINE_DOCUMENTS = 20
#: A document is depleted when less than this share of its words, or fewer than LEFT_WORDS, remain.
LEFT_SHARE = 0.5
LEFT_WORDS = 20
MIN_WORDS = 50

_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_NOT_WORD = re.compile(r"[\W_]+")
SPACES = " \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs at least twice."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    if len(seen) < 2_000_000:
        k = len(seen)
        windows = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:  # three ids of a longer text do not fit one number: number the pairs first
        pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * len(seen) + ids[2:]
    _, at, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[at] > 1
    hit = np.zeros(len(words), bool)
    for shift in range(3):
        hit[shift : len(words) - 2 + shift] |= twice
    return int(hit.sum())


def normalised(line: str) -> str:
    """Lower case, runs of anything but letters and digits as one space."""
    return _NOT_WORD.sub(" ", line.lower()).strip()


def text_counts(text: bytes) -> tuple[int, int, int, int, int, list[tuple[int, int]]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and (hash, words) of each line with words."""
    words, string = text.split(), text.decode()
    chars = len(string) - sum(map(string.count, SPACES))
    seen, dup, lines = set(), 0, {}
    for line in text.split(b"\n"):
        n = len(line.split())
        if not n:
            continue
        dup += line in seen
        seen.add(line)
        key = normalised(line.decode())
        if key:
            lines[key] = lines.get(key, 0) + n
    hashed = [
        (int.from_bytes(hashlib.blake2b(k.encode(), digest_size=8).digest(), "little", signed=True), n)
        for k, n in lines.items()
    ]
    return len(words), chars, len(_SYMBOLS.findall(text)), dup, repeated_words(words), hashed


ROWS = (
    "doc_id long, host string, text_key binary, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    "n_repeat_words long, lines array<struct<line: long, n: long>>"
)


def count_texts(documents: DataFrame, host: str) -> DataFrame:
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(host).cast("string").alias("host"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    line = pa.struct([("line", pa.int64()), ("n", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        counts = [text_counts(t) for t in texts]
        numbers = [pa.array([c[k] for c in counts], pa.int64()) for k in range(5)]
        lines = pa.array([[{"line": h, "n": n} for h, n in c[5]] for c in counts], pa.list_(line))
        keys = pa.array([hashlib.blake2b(t, digest_size=12).digest() for t in texts], pa.binary())
        names = ["doc_id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), keys, *numbers, lines], names=[*names, "lines"])

    return map_batches(rows, ROWS, run)


def line_documents(counted: DataFrame) -> DataFrame:
    """For each host and line, the number of different documents of the host that have it."""
    each = counted.select("host", "text_key", F.explode("lines.line").alias("line")).distinct()
    return each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents"))


def common_lines(counted: DataFrame, documents: int = LINE_DOCUMENTS, share: float = 0.0) -> DataFrame:
    """Lines in more documents than the limit, and in more than the share of the host's if one is given, by host."""
    counts = line_documents(counted).where(F.col("documents") > documents)
    if not share:
        return counts
    hosts = counted.select("host", "text_key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    same = counts["host"].eqNullSafe(hosts["host"])
    return counts.join(hosts, same).where(F.col("documents") > share * F.col("of")).select(counts["host"], "line", "documents")


def quality_rules(
    documents: DataFrame,
    host: str = "source",
    line_limit: int = LINE_DOCUMENTS,
    line_share: float = 0.0,
    left_share: float = LEFT_SHARE,
    left_words: int = LEFT_WORDS,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """Counts, base verdict, words left without common lines, and the final verdict of each row.

    The text is read once; the counted rows go to the shared folder. Line counts are partial sums, so a
    host or line with most of the rows is spread over all tasks; the join back to the documents carries
    only the lines above the limit.
    """
    counted = checkpointed(count_texts(documents, host))
    common = common_lines(counted, line_limit, line_share).withColumnRenamed("host", "on_host")
    each = counted.select("host", "text_key", F.inline("lines"))
    # the removed words depend on host and text alone: equal rows share them
    removed = (
        each.join(common, (each["line"] == common["line"]) & each["host"].eqNullSafe(common["on_host"]))
        .groupBy("host", "text_key", each["line"])
        .agg(F.first("n").alias("n"))
        .groupBy(F.col("host").alias("of_host"), F.col("text_key").alias("of_text"))
        .agg(F.sum("n").alias("removed"))
    )
    same = (counted["text_key"] == removed["of_text"]) & counted["host"].eqNullSafe(removed["of_host"])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce(F.col("removed"), F.lit(0))
    depleted = (left < left_words) | (left < left_share * F.col("n_words"))
    return counted.join(removed, same, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"),
        left.alias("n_words_left"),
    )
