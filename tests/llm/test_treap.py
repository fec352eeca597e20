import math
import re
from collections import Counter

import numpy as np
import pytest
from bedledger.llm import queries, treap
from helpers import LOWER, SF, documents, needs_tables, odd_rows, rows_of, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def plain(docs, items, k=10):
    """(item_id, rank, doc_id, score) by scoring every document with every item."""
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, length = len(counts), sum(c[2] for c in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    found = []
    for item, text in items:
        wanted = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(plain_terms(text)) if df[t]}
        scored = []
        for doc_id, c, size in counts:
            m = 100 - 90 + 90 * size * n // length
            score = sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, w in wanted.items() if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        found += [(item, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(scored[:k], 1)]
    return sorted(found, key=repr)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "'x' AS score", "'x' AS rank", "'x' AS id", "'x' AS no")


@needs_tables
def test_query_like_plain_python(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
    assert rows_of(queries.op12_ranked_search(spark, SF)) == plain(docs, items)


def test_odd_rows_and_ties(spark):
    rows = odd_rows() + [(100 - n, f"same words here {n % 2}") for n in range(60)] + [(None, "same words")] * 3
    items = [(1, "same WORDS"), (2, None), (3, ""), (4, "??"), (5, "word17 a x"), (5, "ß 漢字"), (None, "here b"), (6, "nowhere")]
    found = treap.search(documents(spark, rows).repartition(5), items_of(spark, items))
    assert rows_of(found) == plain(rows, items)
    assert rows_of(treap.search(documents(spark, []), items_of(spark, items))) == []
    assert rows_of(treap.search(documents(spark, rows), items_of(spark, []))) == []


@pytest.mark.parametrize("seed", range(3))
def test_small_shards_and_blocks(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    text = lambda n: " ".join(f"t{int(x)}" for x in rng.zipf(1.3, n) % 300)
    rows = [(int(i), text(int(rng.integers(1, 60)))) for i in rng.permutation(400)]
    rows += [(1000 + n, rows[0][1]) for n in range(200)]  # copies tie
    items = [(n, text(8)) for n in range(20)]
    index = treap.index_documents(documents(spark, rows).repartition(3), shard_postings=900)
    assert index.count() > 6
    monkeypatch.setattr(treap, "BLOCK_QUERIES", 6)
    found = treap.search(documents(spark, rows), items_of(spark, items), index=index)
    assert rows_of(found) == plain(rows, items)
    assert rows_of(treap.search(documents(spark, rows), items_of(spark, items), k=3)) == plain(rows, items, 3)


def test_treap_holds_all_cells_and_few_ranges_are_opened():
    rng = np.random.default_rng(1)
    n_rows, n_docs = 50, 3000
    cells = {(int(r), int(c)): int(v) for r, c, v in zip(rng.zipf(1.5, 20000) % n_rows, rng.integers(0, n_docs, 20000), rng.integers(1, 10**6, 20000))}
    rows, columns = (np.array([c[i] for c in cells], np.int64) for i in range(2))
    side, levels, maxima = treap.build(rows, columns, np.array(list(cells.values())), n_rows, n_docs)
    shard = treap.Shard.load({
        "levels": levels, "maxima": maxima, "side": side, "unnamed": 0, "doc_ids": np.arange(n_docs).tobytes(),
        "terms": b" ".join(b"%d" % r for r in range(n_rows)), "df": treap._packed(np.bincount(rows, minlength=n_rows)),
    })
    assert shard.maximum[1] == max(cells.values())
    weights = {b"3": 2, b"7": 5, b"11": 1}
    sums = Counter()
    for (r, c), v in cells.items():
        sums[c] += v * weights.get(b"%d" % r, 0)
    best = sorted(((s, (0, -c)) for c, s in sums.items() if s), reverse=True)[:10]
    assert sorted(shard.best(weights, 10, []), reverse=True) == best
