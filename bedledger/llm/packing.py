"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are tokenised; only those over `CAPACITY` tokens are cut, into full pieces after a first, shorter
one. A full piece is a sequence of its own. The others are dealt to islands of bounded size. On an
island each individual is a whole packing: a crossover injects whole well-filled bins of one
parent into the other, removes the bins that hold duplicates, and best-fits the displaced pieces. Between
epochs the elite bins of an island migrate to the next as length patterns, which it fills from its own
pieces, and the pieces of bins that are not full move on, regrouped into fewer islands, until one
island holds the rest or nothing is gained.

Defined results: a null or empty text is one piece of one token (the end); repeated rows are packed
each; an empty table gives an empty result; further columns are ignored. Numbers of sequences are
arbitrary, but those of one call differ.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedledger.llm.common import checkpointed, map_batches, ship_package

CAPACITY, END = 1024, 2
#: The special token's text and id in this vocabulary.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Pieces on an island, individuals, generations of an epoch, epochs at most.
ISLAND, POPULATION, GENERATIONS, EPOCHS = 4096, 4, 6, 4
#: A bin is done, and its pieces stay, when at most this many tokens are free; ELITE patterns migrate.
SLACK, ELITE = 1, 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def encoder(path: str):
    """Encoder with the vocabulary of `path`; the ranks file beside it holds the same one and is faster."""
    import tiktoken

    ranks = {}
    with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
        for line in f:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(path: str, text: str) -> list[int]:
    """Ids of the text, the special token's text read as that token, and the end."""
    ids: list[int] = []
    for k, part in enumerate(text.split(SPECIAL)):
        ids += [SPECIAL_ID] * (k > 0)
        ids += encoder(path).encode_ordinary(part)
    ids.append(END)
    return ids


def tokenised_pieces(documents: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            ids = np.array(encode(path, text.as_py() or ""), "<u4")
            first = (len(ids) - 1) % capacity + 1
            edges = [0, *range(first, len(ids) + 1, capacity)]
            for piece, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                made.append((doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
        columns = list(zip(*made, strict=True)) if made else [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        names = [f.split()[0] for f in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return map_batches(rows, PIECES, run)


# ---- One island ----


class Packing:
    """Bins of item numbers with the room left in each, for items of the given lengths."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.room: list[int] = []

    def copy(self) -> Packing:
        other = Packing(self.lengths, self.capacity)
        other.bins, other.room = [b[:] for b in self.bins], self.room[:]
        return other

    def add_bin(self, items: list[int]) -> None:
        self.bins.append(items)
        self.room.append(self.capacity - sum(self.lengths[i] for i in items))

    def best_fit(self, items: list[int]) -> None:
        """Each item, longest first, into the bin where the least room is left over."""
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        open_rooms = 0
        for b, room in enumerate(self.room):
            by_room[room].append(b)
            open_rooms |= 1 << room
        for i in sorted(items, key=lambda i: (-self.lengths[i], i)):
            n = self.lengths[i]
            fitting = open_rooms >> n
            if fitting:
                room = n + (fitting & -fitting).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    open_rooms &= ~(1 << room)
                self.bins[b].append(i)
            else:
                room, b = self.capacity, len(self.bins)
                self.bins.append([i])
                self.room.append(room)
            self.room[b] = room - n
            by_room[room - n].append(b)
            open_rooms |= 1 << (room - n)

    def fitness(self) -> tuple[float, float]:
        """Fewer bins are better, then a higher mean of squared fill."""
        full = 1 - np.array(self.room) / self.capacity
        return (-len(self.bins), float((full**2).mean()) if len(full) else 0.0)

    def take_out(self, bins: set[int]) -> list[int]:
        out = [i for b in sorted(bins) for i in self.bins[b]]
        self.bins = [x for b, x in enumerate(self.bins) if b not in bins]
        self.room = [x for b, x in enumerate(self.room) if b not in bins]
        return out

    def inject(self, groups: list[list[int]]) -> Packing:
        """Whole bins into a copy: bins that hold one of their items go, what they also held is best-fitted."""
        child, coming = self.copy(), {i for g in groups for i in g}
        hit = {b for b, items in enumerate(child.bins) if not coming.isdisjoint(items)}
        displaced = [i for i in child.take_out(hit) if i not in coming]
        for g in groups:
            child.add_bin(g[:])
        child.best_fit(displaced)
        return child


def pattern_bins(lengths: list[int], patterns: list[list[int]]) -> list[list[int]]:
    """Bins with the lengths of migrated elites, filled from this island's items."""
    free: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        free.setdefault(n, []).append(i)
    bins = []
    for pattern in patterns:
        taken = []
        for n in pattern:
            if not free.get(n):
                break
            taken.append(free[n].pop())
        else:
            bins.append(taken)
            continue
        for i in taken:
            free[lengths[i]].append(i)
    return bins


def evolve(
    lengths: list[int], patterns: list[list[int]], seed: int, capacity: int = CAPACITY, generations: int = GENERATIONS
) -> Packing:
    """The best packing of some generations."""
    rng, n = np.random.default_rng(seed), len(lengths)
    first = Packing(lengths, capacity)
    first.best_fit(list(range(n)))
    population = [first]
    lower = -(-sum(lengths) // capacity)
    while len(population) < POPULATION:
        other = first.copy()
        loose = np.argsort(-np.array(other.room), kind="stable")[: max(2, len(other.bins) // 4)]
        chosen = set(rng.choice(loose, max(1, len(loose) // 2), replace=False).tolist()) if len(loose) else set()
        out = other.take_out(chosen)
        rng.shuffle(out)
        other.best_fit(out[: len(out) // 2])
        other.best_fit(out[len(out) // 2 :])
        population.append(other)
    migrants = pattern_bins(lengths, patterns)
    if migrants:
        population.append(population[0].inject(migrants))
    for _ in range(generations):
        population.sort(key=Packing.fitness, reverse=True)
        population = population[:POPULATION]
        if len(population[0].bins) <= lower:
            break
        for a, b in ((0, 1), (1, 0)):
            giver, taker = population[b % len(population)], population[a % len(population)]
            filled = np.argsort(np.array(giver.room), kind="stable")[: max(1, len(giver.bins) // 2)]
            groups = [giver.bins[k] for k in rng.choice(filled, max(1, len(filled) // 4), replace=False)]
            child = taker.inject(groups)
            # mutation: the loosest bins are dissolved and best-fitted anew with some full ones
            loose = np.argsort(-np.array(child.room), kind="stable")[: max(1, len(child.bins) // 50)]
            mixed = rng.integers(0, len(child.bins), max(1, len(child.bins) // 50))
            child.best_fit(child.take_out({*loose.tolist(), *mixed.tolist()}))
            population.append(child)
    return max(population, key=Packing.fitness)


# ---- Islands over Spark ----

_STATE = "row long, length long, island long, bin long, place long, free long"


def epoch(pieces: DataFrame, elites: DataFrame | None, turn: int, capacity: int) -> DataFrame:
    """Evolve each island: rows with bin, order in the bin, and room left in it."""
    ship_package(pieces.sparkSession)

    def run(rows: pd.DataFrame, patterns: list[list[int]]) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)
        island = int(rows["island"].iloc[0])
        best = evolve(rows["length"].tolist(), patterns, island * 1000 + turn, capacity)
        at, of, place, free = [], [], [], []
        for b, items in enumerate(best.bins):
            at += items
            of += [b] * len(items)
            place += range(len(items))
            free += [best.room[b]] * len(items)
        out = rows.iloc[at].reset_index(drop=True)
        return out.assign(bin=of, place=place, free=free)[["row", "length", "island", "bin", "place", "free"]]

    if elites is None:
        return pieces.groupBy("island").applyInPandas(lambda rows: run(rows, []), _STATE)

    def both(rows: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in _STATE.split(", ")})
        return run(rows, sorted(list(map(int, p)) for p in other["pattern"]))

    return pieces.groupBy("island").cogroup(elites.groupBy("island")).applyInPandas(both, _STATE)


def elite_patterns(packed: DataFrame, islands: int, count: int = ELITE) -> DataFrame:
    """The lengths of each island's fullest bins, addressed to the next island."""
    pattern = F.sort_array(F.collect_list("length")).alias("pattern")
    bins = packed.groupBy("island", "bin").agg(pattern, F.first("free").alias("free"))
    best = bins.where(F.size("pattern") > 1).groupBy("island").agg(
        F.slice(F.sort_array(F.collect_set(F.struct("free", "pattern"))), 1, count).alias("best")
    )
    return best.select(F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.explode("best.pattern").alias("pattern"))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, island: int = ISLAND) -> DataFrame:
    """`pieces` (with a column length) with sequence_id and offset."""
    stored = checkpointed(pieces.withColumn("row", F.monotonically_increasing_id()))
    own = (F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    full = stored.where(F.col("length") == capacity).select(*pieces.columns, *own)
    rest = stored.where(F.col("length") < capacity).select("row", "length")
    done, elites, count = [], None, rest.count()
    islands = max(1, -(-count // island))
    for turn in range(EPOCHS):
        if not count:
            break
        dealt = rest.withColumn("island", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(islands)))
        packed = checkpointed(epoch(dealt, elites, turn, capacity))
        # numbers of sequences: above the rows' own, one range for each epoch
        numbered = packed.withColumn("sequence_id", -1 - (((F.col("island") * island * 8) + F.col("bin")) * EPOCHS + turn))
        last = turn == EPOCHS - 1 or islands == 1
        closed = numbered if last else numbered.where(F.col("free") <= SLACK)
        done.append(closed.select(F.col("row").alias("of"), "length", "sequence_id", "place"))
        if last:
            break
        elites = elite_patterns(packed, islands)
        rest = packed.where(F.col("free") > SLACK).select("row", "length")
        count = rest.count()
        fewer = max(1, -(-count // island))
        if fewer < islands:
            elites = elites.withColumn("island", F.pmod("island", F.lit(fewer)))
        islands = fewer
    if not done:
        return full
    placed = done[0]
    for other in done[1:]:
        placed = placed.unionByName(other)
    before = F.collect_list(F.struct("place", "of", "length"))
    # a sequence holds at most `capacity` pieces
    offsets = placed.groupBy("sequence_id").agg(F.sort_array(before).alias("items")).select(
        "sequence_id",
        F.inline(F.expr(
            "transform(items, (x, i) -> named_struct('of', x.of, 'offset',"
            " aggregate(slice(items, 1, i), 0L, (s, y) -> s + y.length)))"
        )),
    )
    joined = stored.where(F.col("length") < capacity).join(offsets, F.col("row") == F.col("of"))
    return full.unionByName(joined.select(*pieces.columns, "sequence_id", "offset"))


def pack_documents(documents: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    return pack_pieces(tokenised_pieces(documents, tokenizer_path, capacity), capacity)
