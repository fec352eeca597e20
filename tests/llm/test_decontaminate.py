import hashlib
import re

import numpy as np
import pytest

from bedledger.llm import decontaminate
from helpers import LOWER, documents, needs_tables, odd_rows, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, items):
    windows = {}
    for item, text in items:
        words = WORD.findall((text or "").translate(LOWER))
        n = min(10, len(words))
        for j in range(len(words) - n + 1 if words else 0):
            windows.setdefault(tuple(words[j : j + n]), set()).add(str(item) if item is not None else "null")
    lengths, out = {len(w) for w in windows}, []
    for doc_id, text in docs:
        words = WORD.findall((text or "").translate(LOWER))
        hit, found = [False] * len(words), set()
        for n in lengths:
            for j in range(len(words) - n + 1):
                if tuple(words[j : j + n]) in windows:
                    found |= windows[tuple(words[j : j + n])]
                    hit[j : j + n] = [True] * n
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(words), sum(hit), len(found), sha, any(hit)))
    return sorted(out, key=repr)


def found_rows(docs, items):
    return sorted((tuple(r)[:6] for r in decontaminate.contamination(docs, items).collect()), key=repr)


@needs_tables
def test_like_plain_python(spark):
    docs, items = table(spark, "documents"), table(spark, "benchmark")
    expected = plain([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert found_rows(docs, items) == expected and any(r[5] for r in expected)
    kept = {r.doc_id for r in decontaminate.clean_documents(docs, items).collect()}
    assert kept == {r[0] for r in expected if not r[5]}


SPAN = "one two three four five six seven eight nine ten eleven twelve"


@pytest.mark.parametrize("n, expected", [(9, False), (10, True), (12, True)])
def test_every_span_of_ten_words_is_found(spark, n, expected):
    words = SPAN.split()
    rows = [(k, " ".join([*(f"x{i}" for i in range(k)), *words[k % 3 : k % 3 + n], "y"])) for k in range(8)]
    found = decontaminate.contamination(documents(spark, rows), spark.createDataFrame([(1, SPAN.upper())], "item_id long, text string"))
    assert {r.contaminated for r in found.collect() if (12 - n) >= r.doc_id % 3} == {expected}


def test_odd_rows_and_short_items(spark):
    rows = [*odd_rows(), (20, "A b!c"), (21, "c a b c"), (22, SPAN + " " + SPAN)]
    items = [(1, "a B"), (2, None), (3, ""), (None, "b c d e f"), (4, SPAN), (4, SPAN), (5, "漢字"), (6, "word1 word2 word3"), (7, "...")]
    frame = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS row", "1 AS length")
    docs = documents(spark, rows)
    assert found_rows(docs, frame) == plain(rows, items)
    kept = decontaminate.clean_documents(docs, frame)
    assert kept.columns == docs.columns and kept.count() == sum(not r[5] for r in plain(rows, items))
    assert found_rows(docs, frame.limit(0)) == plain(rows, [])
    assert decontaminate.contamination(docs.limit(0), frame).count() == 0


def test_windows_share_the_least_hash():
    hashes = decontaminate.word_hashes([b"%d" % (i % 40) for i in range(300)])
    prints = decontaminate.window_fingerprints(hashes, 10)
    grams = decontaminate.gram_hashes(hashes, 5)
    assert len(prints) == 291 and all(prints[j] == grams[j : j + 6].min() for j in range(291))
    assert np.array_equal(prints[:200], decontaminate.window_fingerprints(hashes[:209], 10))
