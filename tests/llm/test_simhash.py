import random

import numpy as np
import xxhash

from bedledger.llm import simhash
from helpers import LOWER, WORD, documents, needs_tables, odd_rows, table


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=2):
    """prints: {id: fingerprint}; the least id that can be reached."""
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def components_of(spark, prints):
    frame = spark.createDataFrame([(i, simhash.signed(p)) for i, p in prints.items()], "doc_id long, fp long")
    named = simhash.near_duplicates(frame).collect()
    by_print = {r.fp: r.first.by_doc_id.value for r in named}
    return {i: by_print[simhash.signed(p)] for i, p in prints.items()}


@needs_tables
def test_like_plain_python(spark):
    docs = table(spark, "documents")
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    expected = plain_components(prints)
    found = simhash.simhash_components(docs).collect()
    assert len(found) == len(prints)
    for r in found:
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", expected[r.doc_id])
    kept = simhash.one_per_component(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(expected.values())


def test_random_neighbourhoods_and_crowded_buckets(spark):
    rng = random.Random(4)
    prints = {}
    for c in range(40):
        centre = rng.getrandbits(64)
        for _ in range(12):
            prints[len(prints)] = centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
    base = rng.getrandbits(64)
    for _ in range(300):  # one region denser than a bucket, a chain through it
        prints[len(prints)] = base ^ sum(1 << b for b in rng.sample(range(14), rng.randint(0, 6)))
    assert components_of(spark, prints) == plain_components(prints)


def test_long_chain(spark):
    order = list(range(120))
    random.Random(2).shuffle(order)
    value, prints = 0, {}
    for n, i in enumerate(order):
        value ^= 3 << (n % 62) if n % 2 else 1 << (n % 64)
        prints[i] = value
    assert components_of(spark, prints) == plain_components(prints)


def test_thresholds_come_from_the_dynamic_programme():
    cost, chosen = simhash.allocate([[0, 10, 50, 90], [0, 1, 2, 3], [0, 10, 20, 30]], 0)
    assert sum(chosen) == 0 and cost == min(
        c1[a + 1] + c2[b + 1] + c3[c + 1]
        for c1, c2, c3 in [([0, 10, 50, 90], [0, 1, 2, 3], [0, 10, 20, 30])]
        for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3) if a + b + c == 0
    )


def test_correlated_bits_go_together():
    rng = np.random.default_rng(0)
    bits = rng.random((4000, 64)) < 0.5
    bits[:, 40] = bits[:, 3] ^ (rng.random(4000) < 0.02)
    x = bits.astype(float)
    groups = simhash.group_bits(4000, np.rint(x.T @ x).astype(int), 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert any({3, 40} <= set(g) for g in groups)


def test_odd_rows(spark):
    rows = odd_rows()
    found = simhash.simhash_components(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    assert {r.component_id for r in found if r.fingerprint == "0" * 16} == {1}
    assert {r.fingerprint for r in found} == {f"{plain_fingerprint(t):016x}" for _, t in rows}
    docs = documents(spark, rows)
    kept = simhash.one_per_component(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({(r.component_id, r.fingerprint if r.component_id is None else "") for r in found})
    assert simhash.simhash_components(docs.limit(0)).count() == 0
    assert simhash.one_per_component(docs.limit(0)).count() == 0


def test_many_shingles_like_few():
    text = " ".join(f"w{i * i % 977}" for i in range(70_000))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
