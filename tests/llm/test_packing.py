import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bedledger.llm import packing
from helpers import documents, needs_tables, odd_rows, table

PATH = public_tokenizers.path("byte_bpe_50k.json")
REFERENCE = Tokenizer.from_file(PATH)


def plain_ids(text):
    return [*REFERENCE.encode(text, add_special_tokens=False).ids, packing.END]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_those_of_the_tokenizer(text):
    assert packing.encode(PATH, text) == plain_ids(text)


def test_ids_of_special_and_long_texts():
    for text in ("a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> y", "a" * 30_000, " " * 5_000, "1" * 5_000, "\u3000\u200b né\r\n\r\n  x"):
        assert packing.encode(PATH, text) == plain_ids(text)


def check_packing(found, texts):
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, pieces in by_doc.items():
        ids, at = plain_ids(texts[doc_id] or ""), 0
        for n, r in enumerate(sorted(pieces, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert r.length == 1024 or n == 0
            at += r.length
        assert at == len(ids) and (len(ids) > 1024 or len(pieces) == 1)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return len(by_sequence), -(-sum(r.length for r in found) // 1024)


@needs_tables
def test_all_documents_are_packed(spark):
    docs = table(spark, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    used, least = check_packing(packing.pack_documents(docs).collect(), texts)
    assert used <= 1.02 * least + 1


def test_islands_migrate_and_stay_whole(spark):
    rng = random.Random(5)
    rows = [(n, min(1023, max(1, int(rng.lognormvariate(5.5, 0.8))))) for n in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, length long")
    found = packing.pack_pieces(frame, island=256).collect()
    assert sorted((r.doc_id, r.length) for r in found) == rows
    sums = {}
    for r in found:
        sums.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in s) <= 1024 for s in sums.values())
    assert all(o == sum(n for p, n in s if p < o) for s in sums.values() for o, _ in s)
    assert len(sums) <= 1.03 * -(-sum(n for _, n in rows) // 1024)


def test_crossover_injects_whole_bins():
    lengths = [600, 424, 500, 500, 24, 300, 300, 300]
    taker, giver = packing.Packing(lengths, 1024), packing.Packing(lengths, 1024)
    for bins, p in (([[0, 4], [1, 2], [3], [5, 6, 7]], taker), ([[0, 1], [2, 3, 4], [5, 6, 7]], giver)):
        for b in bins:
            p.add_bin(b)
    child = taker.inject([[0, 1], [2, 3, 4]])
    assert sorted(i for b in child.bins for i in b) == list(range(8))
    assert [0, 1] in child.bins and len(child.bins) == 3 and child.fitness() > taker.fitness()
    assert packing.pattern_bins(lengths, [[424, 600], [700], [500, 500]]) == [[1, 0], [3, 2]]


def test_odd_rows(spark):
    rows = odd_rows()
    found = packing.pack_documents(documents(spark, rows)).collect()
    texts = [t or "" for _, t in rows]
    assert sum(r.length for r in found) == sum(len(plain_ids(t)) for t in texts)
    assert sum(r.piece == 0 for r in found) == len(rows)
    assert packing.pack_documents(documents(spark, rows).limit(0)).count() == 0
