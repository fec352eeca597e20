"""SimHash near-duplicates by generalised pigeonhole.

A text's fingerprint has a bit set where more than half of its shingle hashes have it. Different
fingerprints within `DISTANCE` bits link. The 64 bits are divided into partitions of correlated bits; if
the thresholds of the m partitions add up to DISTANCE - m + 1, two linked fingerprints are within the
threshold in one of them. The layout and its (unequal) thresholds come from a dynamic programme over the
estimated candidates and probes. Each fingerprint probes the keys within a partition's threshold; what
it meets is verified on all 64 bits.

Buckets of more than `BUCKET` fingerprints are not paired. Their members instead emit the 65 keys within
one bit of themselves: two fingerprints within two bits share such a key, two that share one are within
two bits, and a key has at most 65 members. So the links found are the same, at a cost in proportion to
the members.

Defined results: null and empty texts have fingerprint zero and are linked like any other; a null
doc_id never names a component unless all its ids are null; repeated rows get one result row each; an
empty table gives an empty result; further columns are ignored. Rows with equal fingerprints are
connected through the fingerprint, copies are never expanded into pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedledger.llm.common import checkpointed, map_batches, utf8

DISTANCE = 2
BUCKET = 64
SHINGLE = 3
SEED = 42
BITS = 64
#: Cost of one probe row in candidates, for the choice of thresholds.
PROBE_COST = 4.0


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all shingles, unsigned."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, votes, digest = len(words) - shingle + 1, np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        a, b = starts[at : min(n, at + (1 << 16))].tolist(), ends[at + shingle - 1 : at + shingle - 1 + (1 << 16)].tolist()
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(a, b, strict=True)], ">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def add_fingerprints(documents: DataFrame, column: str = "fp") -> DataFrame:
    """`documents` and its fingerprints as a long column."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = pa.array([signed(fingerprint(t)) for t in utf8(batch, "text")], pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns, fps], names=[*batch.schema.names, column])

    return map_batches(documents, f"{kinds}, `{column}` long", run)


# ---- Layout and thresholds ----


def bit_counts(fingerprints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many of them have both of two bits set; 64 x 64 sums over all rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = batch.column("fp").to_numpy(zero_copy_only=False).astype(">i8")
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float64)
        both = np.rint(bits.T @ bits).astype(np.int64)
        at = np.arange(BITS * BITS, dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(both.ravel(), len(values)))], names=["at", "n"]
        )

    sums = map_batches(fingerprints.select("fp"), "at int, n long", run).groupBy("at").agg(F.sum("n").alias("n"))
    counts = np.zeros(BITS * BITS + 1, np.int64)
    for row in sums.collect():  # at most 4,097 rows
        counts[row["at"]] = row["n"]
    return int(counts[-1]), counts[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in `parts` groups of equal size, correlated bits together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    linked = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        room = (BITS - sum(map(len, groups))) // (parts - k)
        rest = sorted(free)
        group = [max(rest, key=lambda b: (linked[b, rest].sum(), -b))]
        free.discard(group[0])
        while len(group) < room:
            best = max(sorted(free), key=lambda b: (linked[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds that add up to `budget` at the least cost; costs[i][t + 1] is that of threshold t, from -1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        grown: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for t in range(-1, len(cost) - 1):
                option = (total + cost[t + 1], [*chosen, t])
                if used + t not in grown or option < grown[used + t]:
                    grown[used + t] = option
        best = grown
    return best[budget]


def mask_of(bits: list[int]) -> int:
    return signed(sum(1 << b for b in bits))


def plan_partitions(fingerprints: DataFrame, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed, from counts over all fingerprints."""
    n, both = bit_counts(fingerprints)
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    odds = differ / np.maximum(1 - differ, 1e-9)
    layouts = [group_bits(n, both, m) for m in range(2, distance + 3)]
    parts = [(k, bits) for k, groups in enumerate(layouts) for bits in groups]
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(mask_of(b))).alias("key")) for i, (_, b) in enumerate(parts)])
    met = (
        fingerprints.select(F.inline(keys))
        .groupBy("part", "key").agg(F.count(F.lit(1)).alias("c"))
        .groupBy("part").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs"))
    )
    pairs = {row["part"]: row["pairs"] for row in met.collect()}  # one row per partition
    options = []
    for k, groups in enumerate(layouts):
        costs = []
        for i, bits in enumerate(groups):
            at = sum(len(g) for g in layouts[:k]) + i
            one, w = odds[bits].sum(), len(bits)
            two = (one**2 - (odds[bits] ** 2).sum()) / 2
            # a threshold of t also meets keys that differ in up to t bits
            same = max(pairs.get(at, 0.0), 1.0)
            volume = (1, 1 + w, 1 + w + w * (w - 1) // 2)
            costs.append([0.0] + [same * (1 + (t > 0) * one + (t > 1) * two) + PROBE_COST * n * volume[t] for t in range(distance + 1)])
        options.append((*allocate(costs, distance - len(groups) + 1), k))
    _, thresholds, k = min(options)
    return [(bits, t) for bits, t in zip(layouts[k], thresholds, strict=True) if t >= 0]


# ---- Probe and verify ----


def links(fingerprints: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b), a < b, that connect the same different fingerprints as all pairs within `distance` bits."""
    if distance != 2:
        raise ValueError("crowded buckets are resolved for a distance of two bits")
    plan = plan_partitions(fingerprints, distance)
    fp = F.col("fp")

    def around(i: int, bits: list[int], t: int) -> list:
        base = fp.bitwiseAND(F.lit(mask_of(bits)))
        flips = [signed(1 << b) for b in bits] if t else []
        flips += [signed((1 << a) | (1 << b)) for a in bits for b in bits if a < b] if t > 1 else []
        return [F.struct(F.lit(i).alias("part"), key.alias("key")) for key in (base, *(base.bitwiseXOR(F.lit(x)) for x in flips))]

    stored = fingerprints.select("fp", F.inline(F.array(*[around(i, b, 0)[0] for i, (b, _) in enumerate(plan)])))
    probes = fingerprints.select("fp", F.inline(F.array(*[s for i, (b, t) in enumerate(plan) for s in around(i, b, t)])))
    sizes = stored.groupBy("part", "key").agg(F.count(F.lit(1)).alias("members"))
    exact = [i for i, (_, t) in enumerate(plan) if t == 0]
    # alone under an exact threshold there is nothing to meet
    sizes = sizes.where((F.col("members") > 1) | ~F.col("part").isin(exact) if exact else F.lit(True))
    sized = stored.join(sizes, ["part", "key"])
    small, crowded = F.col("members") <= bucket, F.col("members") > bucket
    pairs = (
        probes.withColumnRenamed("fp", "a")
        .join(sized.where(small).withColumnRenamed("fp", "b"), ["part", "key"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
        .select("a", "b")
    )
    dense = probes.join(sizes.where(crowded), ["part", "key"]).select("fp").distinct()
    near = F.array(fp, *[fp.bitwiseXOR(F.lit(signed(1 << b))) for b in range(BITS)])
    stars = (
        dense.select("fp", F.explode(near).alias("key"))
        .groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))  # at most 65
        .where(F.size("fps") > 1)
        .select(F.col("fps")[0].alias("a"), F.explode(F.expr("slice(fps, 2, size(fps))")).alias("b"))
    )
    return pairs.union(stars).distinct()


# ---- Components ----


def least_neighbour(edges: DataFrame) -> DataFrame:
    """For each node of the directed edges (u, v) the least of itself and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of the undirected edges (a, b): root is the least node of the component.

    Alternates large-star and small-star steps until nothing changes; each step is a partial aggregation
    and a join, and its result goes to the shared folder.
    """
    edges, before = checkpointed(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(least_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v").distinct()
        )
        # every row now has u > v
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        )
        edges = checkpointed(small)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.union(found.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(fingerprinted: DataFrame, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(fp, first): for each different fingerprint the first row of its component, as struct of `order`.

    Nulls come last. `fingerprinted` has the columns of `order` and `fp`; it is read several times.
    """
    key = F.struct(*[F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("value")).alias(f"by_{c}") for c in order])
    each = fingerprinted.groupBy("fp").agg(F.min(key).alias("own"))
    different = checkpointed(each)
    roots = components(links(different.select("fp")))
    linked = different.join(roots.withColumnRenamed("node", "fp"), "fp")
    first = linked.groupBy("root").agg(F.min("own").alias("least"))
    named = linked.join(first, "root").select(F.col("fp").alias("linked"), "least")
    first = F.coalesce("least", "own")
    return different.join(named, F.col("fp") == F.col("linked"), "left").select("fp", first.alias("first"))


def simhash_components(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), and component_id of each row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = checkpointed(add_fingerprints(rows).select("doc_id", "fp"))
    # read from the shared folder, so that both sides of the join are exchanges whose hot keys Spark can split
    named = checkpointed(near_duplicates(known)).withColumnRenamed("fp", "of")
    return known.join(named, F.col("fp") == F.col("of")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.by_doc_id.value").alias("component_id")
    )


def row_key(doc_id, fp):
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), fp)


def one_per_component(documents: DataFrame) -> DataFrame:
    """The rows of `documents` that come first in their component; one of equal rows. All columns stay."""
    names = [f"c{i}" for i in range(len(documents.columns))]
    at = {c.lower(): n for c, n in zip(documents.columns, names, strict=True)}
    plain = documents.toDF(*names).withColumnsRenamed({at["text"]: "text"})
    known = add_fingerprints(plain)
    few = checkpointed(known.select(F.col(at["doc_id"]).cast("long").alias("doc_id"), "fp"))
    first = near_duplicates(few, ("doc_id", "fp")).select("first").distinct()
    # one key without nulls, by which the joined rows also lie for the choice among equal rows: texts move once
    first = first.select(row_key(F.col("first.by_doc_id.value"), F.col("first.by_fp.value")).alias("key"))
    known = known.withColumn("key", row_key(F.col(at["doc_id"]).cast("long"), F.col("fp")))
    kept = known.join(first, "key", "left_semi").dropDuplicates(["key"])
    return kept.select([F.col("text" if n == at["text"] else n).alias(c) for n, c in zip(names, documents.columns, strict=True)])
