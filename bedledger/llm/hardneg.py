"""Hard negatives by rotated one-bit codes.

Each vector is rotated into `EXPANSION` times its dimensions and stored with the signs there as its code, its length, and
its alignment, the cosine between the vector and its code vector. An anchor's rotated coordinates are cut into bit
planes, so that its product with a code vector is a sum of popcounts; the cut's error is known. What the vector has beside
its code vector is orthogonal to it and, by Cauchy and Schwarz, meets at most what the anchor has beside it: that gives an
interval that surely holds the score. Rows whose interval cannot reach the rows already found, or the wanted
range of scores, are left out; the rest are scored by the product of whole numbers. So results are exact.

Anchors are answered in blocks, first their positives (best rows of the same label), then for each positive the best rows
of other labels whose score is between `LEAST` and `MOST` hundredths of the positive's. All rows meet each
block in their own tasks, which keep the best few of each anchor only, however many rows tie or share a label.

Defined results: rows take no part if vec_id or label is null, or the vector or one of its components is null or not
finite; a vector without components has the score 0 with all; shorter vectors count as filled with zeros; equal scores are
ordered by vec_id; rows with the anchor's vec_id are no other rows; repeated rows are ranked each, and repeated anchors
answered each; components beyond 2**26 / 256 raise an error, since sums of their products may not fit 64 bits;
an empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bedledger.llm.common import map_batches, map_stream
from bedledger.session import scratch_folder

POSITIVES = 5
NEGATIVES = 3
#: Scores of negatives in hundredths of the positive's.
LEAST, MOST = 50, 95
#: Components become whole numbers of this fraction.
UNIT = 256
LARGEST = 1 << 26
#: Bits of a code per dimension, and bit planes of an anchor's coordinates.
EXPANSION = 4
PLANES = 6
SEED = 11
#: Anchors are answered in blocks of at most this many bytes of vectors.
BLOCK_BYTES = 4 << 20
#: Anchors, and rows, that are compared at once.
ANCHORS, ROWS = 64, 2048

CODED = "vec_id long, label long, anchor boolean, vector binary, code binary, length double, alignment double, span double"
FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@functools.lru_cache(maxsize=2)
def rotation(dims: int) -> np.ndarray:
    """Orthonormal columns: `dims` coordinates rotated into EXPANSION times as many, a multiple of 64."""
    wide = -(-EXPANSION * dims // 64) * 64
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((wide, dims)))[0]


def _words(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1).view(np.uint64)


def coded(embeddings: DataFrame, anchor: Column, dims: int) -> DataFrame:
    """The rows that take part, as whole numbers, with code, length, alignment, and the length of the code's vector."""
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("embedding")
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null becomes NaN
        sizes = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(len(sizes)), sizes)
        whole = np.floor(UNIT * flat)
        sound = np.bincount(owner, weights=~np.isfinite(whole), minlength=len(sizes)) == 0
        taken = np.flatnonzero(sound)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.full(len(sizes), -1)
        at[taken] = np.arange(len(taken))
        use = sound[owner]
        if np.abs(whole[use]).max(initial=0) > LARGEST:
            raise ValueError("a component is too large for whole products of 64 bits")
        vectors = np.zeros((len(taken), dims))
        vectors[at[owner[use]], place[use]] = whole[use]
        length = np.linalg.norm(vectors, axis=1)
        turn = rotation(dims)
        signs = vectors @ turn.T >= 0
        code = np.where(signs, 1.0, -1.0) @ turn
        span = np.linalg.norm(code, axis=1)
        alignment = (vectors * code).sum(axis=1) / np.maximum(length * span, 1e-300)
        packed = np.packbits(signs, axis=1)
        kept = batch.take(pa.array(taken))
        return pa.RecordBatch.from_arrays(
            [
                *(kept.column(c) for c in ("vec_id", "label", "anchor")),
                pa.array([v.tobytes() for v in vectors.astype("<i8")], pa.binary()),
                pa.array([c.tobytes() for c in packed], pa.binary()),
                pa.array(length), pa.array(np.minimum(alignment, 1.0)), pa.array(span),
            ],
            names=["vec_id", "label", "anchor", "vector", "code", "length", "alignment", "span"],
        )

    return map_batches(rows, CODED, run)


class Anchors:
    """A block of anchors, ready to be compared with coded rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.labels, self.vectors = ids, labels, vectors
        turned = vectors.astype(np.float64) @ rotation(vectors.shape[1]).T
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / ((1 << PLANES) - 1), 1e-9)
        steps = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.planes = np.stack([_words((steps >> p) & 1 == 1) for p in range(PLANES)], axis=1)
        self.ones = np.bitwise_count(self.planes).sum(axis=2, dtype=np.int64) @ (1 << np.arange(PLANES))
        cut = turned - (self.low[:, None] + self.step[:, None] * steps)
        self.cut = np.linalg.norm(cut, axis=1) * np.sqrt(turned.shape[1])
        self.square = (vectors.astype(np.float64) ** 2).sum(axis=1)

    def bounds(self, part: slice, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Numbers that the scores of these anchors with all `rows` are surely not below, and not above."""
        planes = self.planes[part]
        met = np.zeros((len(planes), len(rows.ids)), np.int32)
        for p in range(PLANES):
            count = np.zeros(met.shape, np.int32)
            for w in range(planes.shape[2]):
                count += np.bitwise_count(planes[:, p, w, None] & rows.code[None, :, w])
            met += count << p
        signed = 2 * met - self.ones[part, None]
        along = (self.low[part, None] * rows.balance + self.step[part, None] * signed) / rows.span
        off = self.cut[part, None] / rows.span
        beside = np.sqrt(np.maximum(self.square[part, None] - np.maximum(np.abs(along) - off, 0) ** 2, 0))
        centre = rows.reach * along
        # one unit more than what rounding of the floating-point numbers can come to
        margin = rows.reach * off + rows.rest * beside + 1 + 1e-9 * np.sqrt(self.square[part, None]) * rows.length
        return centre - margin, centre + margin


class Rows:
    """Coded rows as arrays."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        n = batch.num_rows
        self.ids, self.labels, self.length = column("vec_id"), column("label"), column("length")
        self.vectors = np.frombuffer(b"".join(batch.column("vector").to_pylist()), "<i8").reshape(n, -1)
        self.code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint64).reshape(n, -1)
        self.span = np.maximum(column("span"), 1e-300)
        self.balance = 2.0 * np.bitwise_count(self.code).sum(axis=1, dtype=np.int64) - 64 * self.code.shape[1]
        self.reach = self.length * column("alignment")
        self.rest = self.length * np.sqrt(np.maximum(1 - column("alignment") ** 2, 0))


def _first(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each owner, by score and then id."""
    order = np.lexsort((ids, -score, owner))
    ranked = owner[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k]


class Best:
    """The k best (score, id) of each of n owners, over all batches of a task."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.owner, self.score, self.ids = k, *(np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n, -np.inf)

    def add(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        owner, score, ids = np.r_[self.owner, owner], np.r_[self.score, score], np.r_[self.ids, ids]
        at = _first(owner, score, ids, self.k)
        self.owner, self.score, self.ids = owner[at], score[at], ids[at]
        full = np.bincount(self.owner, minlength=len(self.least)) == self.k
        last = np.full(len(self.least), np.inf)
        np.minimum.at(last, self.owner, self.score)
        self.least = np.where(full, last, -np.inf)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = ROWS // 8  # a few rows first, whose scores are the bar for the others
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            yield batch.slice(at, size)
            at, size = at + size, ROWS


def _compared(rows: DataFrame, block: tuple, schema: str, k: int, ratings: tuple | None) -> DataFrame:
    """Each task's k best rows of each anchor or, with `ratings`, of each (anchor, positive)."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(*block)
        n = len(anchors.ids)
        # the owners of an anchor's results, itself or its pairs with positives, lie together
        of, scores = (np.arange(n), None) if ratings is None else ratings
        owners, first = np.bincount(of, minlength=n), np.searchsorted(of, np.arange(n))
        best, have = Best(len(of), k), owners > 0
        for batch in _slices(batches):
            seen = Rows(batch)
            # what a score must reach, and not pass, to be of use to one of the anchor's owners
            bar = best.least if scores is None else np.maximum(best.least, LEAST * scores / 100)
            floor, ceiling = np.full(n, np.inf), np.full(n, np.inf)
            np.minimum.at(floor, of, bar)
            if scores is not None:
                ceiling[have] = -np.inf
                np.maximum.at(ceiling, of, MOST * scores / 100)
            gathered: list[tuple] = []
            for a in range(0, n, ANCHORS):
                part = slice(a, min(a + ANCHORS, n))
                low, high = anchors.bounds(part, seen)
                same = anchors.labels[part, None] == seen.labels
                fits = same & (anchors.ids[part, None] != seen.ids) if scores is None else ~same
                at, row = np.nonzero(fits & (high >= floor[part, None]) & (low <= ceiling[part, None]))
                whole = np.einsum("ij,ij->i", anchors.vectors[at + a], seen.vectors[row])
                each = owners[at + a]
                owner = np.repeat(first[at + a] - np.cumsum(each) + each, each) + np.arange(each.sum())
                whole, row = np.repeat(whole, each), np.repeat(row, each)
                use = whole >= best.least[owner]
                if scores is not None:
                    s = scores[owner]
                    use &= (LEAST * s <= 100 * whole) & (100 * whole <= MOST * s)
                gathered.append((owner[use], whole[use], seen.ids[row[use]]))
            if gathered:
                best.add(*(np.concatenate(x) for x in zip(*gathered, strict=True)))
        made = [best.owner, best.score, best.ids]
        yield pa.RecordBatch.from_arrays([pa.array(m.astype(np.int64)) for m in made], names=names)

    return map_stream(rows, schema, run)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    # Spark keeps the first k of each task before it shuffles
    by = W.partitionBy("owner").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows for which `anchor` is true.

    The anchors, a stated share of the rows, pass the driver in blocks of bounded size; all rows meet each block.
    """
    spark = embeddings.sparkSession
    folder = f"{scratch_folder(spark)}/negatives-{uuid.uuid4().hex}"
    dims = max(embeddings.agg(F.max(F.size("embedding"))).first()[0] or 1, 1)
    coded(embeddings, anchor, dims).write.parquet(f"{folder}/rows")
    rows = spark.read.schema(CODED).parquet(f"{folder}/rows")
    blocks, schema = 0, "owner long, score long, vec_id long"
    read = rows.drop("anchor")

    def answered(taken: list) -> None:
        ids, labels = (np.array([t[i] for t in taken], np.int64) for i in range(2))
        block = ids, labels, np.frombuffer(b"".join(t[2] for t in taken), "<i8").reshape(len(taken), -1)
        best = _ranked(_compared(read, block, schema, positives, None), positives).collect()  # a few per anchor of the block
        best.sort(key=lambda r: (r.owner, r.rank))
        of, scores, named = (np.array([r[c] for r in best], np.int64) for c in ("owner", "score", "vec_id"))
        found = _ranked(_compared(read, block, schema, negatives, (of, scores)), negatives)
        pairs = [(i, int(ids[o]), int(p), int(s)) for i, (o, p, s) in enumerate(zip(of, named, scores, strict=True))]
        told = spark.createDataFrame(pairs, "owner long, anchor_id long, positive_id long, positive_score long")
        found.join(told, "owner").select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ).write.parquet(f"{folder}/found/block={blocks}")

    block: list = []
    for row in rows.where("anchor").select("vec_id", "label", "vector").toLocalIterator():
        block.append((row[0], row[1], bytes(row[2])))
        if len(block) * 8 * dims >= BLOCK_BYTES:
            answered(block)
            block, blocks = [], blocks + 1
    if block:
        answered(block)
        blocks += 1
    if not blocks:
        return spark.createDataFrame([], FOUND)
    return spark.read.schema(FOUND).parquet(*[f"{folder}/found/block={b}" for b in range(blocks)])
