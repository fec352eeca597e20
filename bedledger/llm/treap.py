"""Ranked lexical search over K2-treaps of the term-document grid.

A document's cell in the row of a term holds the term's impact, scale * tf div (1000 tf + 8 m), where m grows with the
document's length. Documents are indexed in shards: a shard's grid is divided into quadrants again and again, down to
single cells; only quadrants with entries are stored, as four bits of their parent (the k2-tree), each with the maximum of
its impacts, kept as the difference to its parent's maximum. Rows lie `2**SPREAD` apart, so a cell of that many documents
holds one term.

A query follows the paths of its terms' rows together: a range of documents has the node of each row, and the sum of
weight times maximum bounds the scores in it from above. The ranges with the highest bounds are halved first, until no
range can reach the k best documents, which are exact since a single document's maxima are its impacts. Ranges of equal
bounds are taken by document, and documents lie in the order of their ids, so ties need no further work. The term weights
depend on the whole collection and are not stored: the index stays right when documents are added to other shards.

Defined results: null texts and texts without terms are in no shard and never found; queries without terms, or whose
terms occur nowhere, have no rows; texts of any length are indexed whole; equal scores are ordered by doc_id, null ids last;
repeated documents are ranked each, repeated queries answered each; an empty table gives an empty result; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bedledger.llm.common import map_batches, map_stream
from bedledger.session import scratch_folder

#: Results per query.
BEST = 10
#: Length normalisation in hundredths, and the scale of impacts.
LENGTH_SHARE = 90
SCALE = 1_000_000_000
#: A shard is closed at this many postings or documents.
SHARD_POSTINGS = 1 << 20
SHARD_DOCUMENTS = 1 << 15
#: Bits between two rows of the grid.
SPREAD = 4
#: Queries are answered in blocks of at most this many terms (with repeats over queries) and queries.
BLOCK_TERMS = 1 << 17
BLOCK_QUERIES = 1 << 13
#: Ranges that are halved at once, after the first steps.
STEP = 256

# A-Z in lower case, digits and all bytes beyond ASCII stay; everything else separates terms.
_TERMS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_ONES = np.array([bin(x).count("1") for x in range(16)], np.uint8)

INDEX = "documents long, terms binary, df binary, doc_ids binary, unnamed long, side int, levels array<binary>, maxima array<binary>"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TERMS).split() if text else []


# ---- The treap of one shard ----


def _interleaved(rows: np.ndarray, columns: np.ndarray, bits: int) -> np.ndarray:
    """Cell codes: the bits of row and column by turns, the row's first."""
    code = np.zeros(len(rows), np.int64)
    for b in range(bits):
        code |= (((rows >> b) & 1) << (2 * b + 1)) | (((columns >> b) & 1) << (2 * b))
    return code


def _packed(values: np.ndarray) -> bytes:
    """Numbers in the fewest bytes each that hold all of them, then compressed."""
    top = int(values.max(initial=0))
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + len(values).to_bytes(8, "little") + pa.compress(values.astype(kind).tobytes(), "zstd", asbytes=True)


def _unpacked(blob: bytes) -> np.ndarray:
    width, n = blob[0], int.from_bytes(blob[1:9], "little")
    return np.frombuffer(pa.decompress(blob[9:], width * n, "zstd", asbytes=True), f"<u{width}").astype(np.int64)


def build(rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, n_rows: int, n_columns: int) -> tuple[int, list[bytes], list[bytes]]:
    """(bits of the side, child masks of each level, differences of the maxima of each level), from the root down."""
    side = max((max(n_rows - 1, 0) << SPREAD).bit_length(), max(n_columns - 1, 0).bit_length(), 1)
    code = _interleaved(rows << SPREAD, columns, side)
    order = np.argsort(code)
    code, top = code[order], impacts[order]
    masks, maxima = [], []
    for _ in range(side):
        parent = code >> 2
        starts = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        least = np.maximum.reduceat(top, starts)
        mask = np.bitwise_or.reduceat(1 << (code & 3), starts)
        sizes = np.diff(np.r_[starts, len(code)])
        maxima.append(_packed(np.repeat(least, sizes) - top))
        # two masks in a byte
        even = np.r_[mask, [0] * (len(mask) % 2)].astype(np.uint8)
        masks.append(_packed(even[::2] | even[1::2] << 4))
        code, top = parent[starts], least
    return side, masks[::-1], [_packed(top), *maxima[::-1]]


@dataclass
class Shard:
    """A shard in memory: nodes of all levels in one numbering; node 0 is the empty one, node 1 the root."""

    row_of: dict[bytes, int]
    df: np.ndarray
    doc_ids: np.ndarray
    unnamed: int
    side: int
    mask: np.ndarray
    child: np.ndarray
    maximum: np.ndarray

    @classmethod
    def load(cls, row: dict) -> Shard:
        masks, maxima = [np.zeros(1, np.uint8)], [np.zeros(1, np.int64), _unpacked(row["maxima"][0])]
        for packed, differences in zip(row["levels"], row["maxima"][1:], strict=True):
            pairs, above = _unpacked(packed).astype(np.uint8), maxima[-1]
            mask = np.stack([pairs & 15, pairs >> 4], axis=1).ravel()[: len(above)]
            masks.append(mask)
            maxima.append(np.repeat(above, _ONES[mask]) - _unpacked(differences))
        masks.append(np.zeros(len(maxima[-1]), np.uint8))
        mask = np.concatenate(masks)
        # children follow each other over all levels, so their places are the running sum of the masks' ones
        child = np.concatenate(([0, 2], 2 + np.cumsum(_ONES[mask[1:]], dtype=np.int64)))[: len(mask)].astype(np.int32)
        terms = row["terms"].split(b" ")
        return cls(
            dict(zip(terms, range(len(terms)), strict=True)),
            _unpacked(row["df"]),
            np.frombuffer(row["doc_ids"], "<i8"),
            row["unnamed"],
            row["side"],
            mask,
            child,
            np.concatenate(maxima),
        )

    def doc_id(self, column: int) -> int | None:
        return int(self.doc_ids[column]) if column < len(self.doc_ids) - self.unnamed else None

    def best(self, weights: dict[bytes, int], k: int, found: list[tuple]) -> list[tuple]:
        """The k best of `found` and this shard as (score, id key) in a heap, least first; id key is (-is null, -id)."""
        known = [(self.row_of[t], w) for t, w in weights.items() if w and t in self.row_of]
        if not known:
            return found
        rows, weight = (np.array(x, np.int64) for x in zip(*known, strict=True))
        rows, n_docs = rows << SPREAD, len(self.doc_ids)
        nodes, level, start = np.ones((1, len(rows)), np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = np.array([self.maximum[1] * weight.sum()], np.int64)
        step = 8
        while len(bound):
            if len(found) == k:
                # an equal bound helps only where a smaller id may come
                least, key = found[0]
                first = self.doc_ids[start]
                null = -(start >= n_docs - self.unnamed).astype(np.int64)
                before = (null > key[0]) | ((null == key[0]) & (-first > key[1]))
                better = (bound > least) | ((bound == least) & before)
                nodes, level, start, bound = nodes[better], level[better], start[better], bound[better]
                if not len(bound):
                    break
            if len(bound) > step:
                now = np.lexsort((start, -bound))
                now, later = now[:step], now[step:]
                rest = nodes[later], level[later], start[later], bound[later]
                nodes, level, start = nodes[now], level[now], start[now]
            else:
                rest = nodes[:0], level[:0], start[:0], bound[:0]
            step = min(2 * step, STEP)
            below = self.side - 1 - level
            row_bit = (rows[None, :] >> below[:, None]) & 1
            mask, child = self.mask[nodes], self.child[nodes]
            halves = []
            for half in (0, 1):
                bit = (1 << (2 * row_bit + half)).astype(np.uint8)
                went = np.where(mask & bit, child + _ONES[mask & (bit - 1)], 0).astype(np.int32)
                halves.append((went, level + 1, start + (half << below), self.maximum[went] @ weight))
            nodes, level, start, bound = (np.concatenate([h[i] for h in halves]) for i in range(4))
            there = bound > 0
            done = there & (level == self.side)
            for column, score in zip(start[done].tolist(), bound[done].tolist(), strict=True):
                doc_id = self.doc_id(column)
                entry = (score, (-1, 0) if doc_id is None else (0, -doc_id))
                if len(found) < k:
                    heapq.heappush(found, entry)
                elif entry > found[0]:
                    heapq.heapreplace(found, entry)
            going = there & ~done
            nodes, level, start, bound = (np.concatenate([x[going], y]) for x, y in zip((nodes, level, start, bound), rest, strict=True))
        return found


# ---- The index ----


def collection_size(documents: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms with repeats."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = [len(terms_of(t)) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([sum(s > 0 for s in sizes)]), pa.array([sum(sizes)])], names=["n", "terms"])

    row = map_batches(_texts(documents).select("text"), "n long, terms long", run).agg(F.sum("n"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def _texts(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").cast("binary").alias("text"))


def index_documents(documents: DataFrame, shard_postings: int = SHARD_POSTINGS, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """One row per shard: its terms with their numbers of documents, its ids, and its treap. Every row is indexed."""
    n_documents, n_terms = collection_size(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}
        docs: list[tuple] = []
        postings = 0

        def closed() -> pa.RecordBatch:
            # documents by id, nulls last; rows of the grid from the most frequent term down
            order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
            place = np.empty(len(docs), np.int64)
            place[order] = np.arange(len(docs))
            term = np.concatenate([d[1] for d in docs])
            tf = np.concatenate([d[2] for d in docs]).astype(np.int64)
            lengths = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * d[3] * n_documents // n_terms for d in docs], np.int64)
            sizes = [len(d[1]) for d in docs]
            names = list(numbers)
            df = np.bincount(term, minlength=len(names))
            by_df = np.lexsort((np.arange(len(names)), -df))
            rank = np.empty(len(names), np.int64)
            rank[by_df] = np.arange(len(names))
            impacts = SCALE * tf // (1000 * tf + 8 * np.repeat(lengths, sizes))
            side, levels, maxima = build(rank[term], np.repeat(place, sizes), impacts, len(names), len(docs))
            ids = np.array([docs[i][0] or 0 for i in order], "<i8")
            made = {
                "documents": len(docs), "terms": b" ".join(names[i] for i in by_df.tolist()), "df": _packed(df[by_df]),
                "doc_ids": ids.tobytes(), "unnamed": sum(d[0] is None for d in docs), "side": side, "levels": levels, "maxima": maxima,
            }
            kinds = {"side": pa.int32(), "levels": pa.list_(pa.binary()), "maxima": pa.list_(pa.binary())}
            return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(c)) for c, v in made.items()], names=list(made))

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = terms_of(text)
                if not words:
                    continue
                ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
                term, tf = np.unique(ids, return_counts=True)
                docs.append((doc_id, term, tf, len(words)))
                postings += len(term)
                if postings >= shard_postings or len(docs) >= shard_documents:
                    yield closed()
                    numbers, docs, postings = {}, [], 0
        if docs:
            yield closed()

    return map_stream(_texts(documents), INDEX, run)


def store_index(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The index as a table in the shared folder."""
    folder = f"{scratch_folder(spark)}/treap-{uuid.uuid4().hex}"
    index_documents(documents).write.parquet(folder)
    return spark.read.schema(INDEX).parquet(folder)


# ---- Search ----


def document_frequencies(index: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """In how many documents of all shards each of these terms occurs; the terms are those of one block of queries."""
    wanted = set(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bytes, int] = {}
        for batch in batches:
            for names, packed in zip(batch.column("terms").to_pylist(), batch.column("df").to_pylist(), strict=True):
                for name, n in zip(names.split(b" "), _unpacked(packed).tolist(), strict=True):
                    if name in wanted:
                        sums[name] = sums.get(name, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], names=["term", "n"])

    sums = map_stream(index.select("terms", "df"), "term binary, n long", run).groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r.term): r.n for r in sums.collect()}


def term_weight(n_documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


def _answers(index: DataFrame, queries: list[tuple[int, int | None, list[bytes]]], n_documents: int, k: int) -> DataFrame:
    """The k best documents of each query of one block; what is sent to the tasks is the block and its terms' weights."""
    df = document_frequencies(index, [t for _, _, terms in queries for t in terms])
    weights = [(no, item, {t: term_weight(n_documents, df[t]) for t in terms if t in df}) for no, item, terms in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the best of one shard are the bounds of the task's next
        best: dict[int, list[tuple]] = {no: [] for no, _, _ in weights}
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard.load(row)
                for no, _, wanted in weights:
                    best[no] = shard.best(wanted, k, best[no])
        made = [(no, item, None if key[0] else -key[1], score) for no, item, _ in weights for score, key in best[no]]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(kinds)], names=["no", "item_id", "doc_id", "score"])

    found = map_stream(index, "no long, item_id long, doc_id long, score long", run)
    # Spark keeps the first k of each task before it shuffles
    by = W.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(documents: DataFrame, queries: DataFrame, key: str = "item_id", k: int = BEST, index: DataFrame | None = None) -> DataFrame:
    """item_id, rank, doc_id and score of the `k` best documents of each query row.

    The queries pass the driver in blocks of bounded size; each block is answered by all shards.
    """
    spark = documents.sparkSession
    index = store_index(spark, documents) if index is None else index
    n_documents = index.agg(F.sum("documents")).first()[0] or 0
    folder, blocks = f"{scratch_folder(spark)}/ranked-{uuid.uuid4().hex}", 0
    block: list[tuple[int, int | None, list[bytes]]] = []
    size = 0

    def answered() -> None:
        nonlocal block, size, blocks
        _answers(index, block, n_documents, k).write.parquet(f"{folder}/block={blocks}")
        block, size, blocks = [], 0, blocks + 1

    for no, row in enumerate(_texts(queries, key).toLocalIterator()):
        terms = sorted(set(terms_of(bytes(row.text)))) if row.text else []
        if terms:
            block.append((no, row.id, terms))
            size += len(terms)
        if size >= BLOCK_TERMS or len(block) >= BLOCK_QUERIES:
            answered()
    if block or not blocks:
        answered()
    return spark.read.schema("item_id long, rank int, doc_id long, score long").parquet(*[f"{folder}/block={b}" for b in range(blocks)])
