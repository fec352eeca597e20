import math
from collections import Counter

import numpy as np
import pytest

from bedledger.llm import lm
from helpers import LOWER, WORD, bucket, documents, needs_tables, odd_rows, table


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def check_base(found, texts):
    """texts: list of (doc_id, text)."""
    training = [t for i, t in texts if bucket("null" if i is None else i, 5) != 1]
    counts = Counter(w for t in training for w in tokens(t))
    total, distinct = counts.total(), len(counts)
    log = lambda c: math.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
    expected = sorted(
        (str(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), sum(log(counts[w]) for w in tokens(t))) for i, t in texts
    )
    rows = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score) for r in found)
    assert [r[:3] for r in rows] == [e[:3] for e in expected]
    assert [r[3] for r in rows] == pytest.approx([e[3] for e in expected])
    assert {r.train_tokens for r in found} == {total}


@needs_tables
def test_base_like_plain_python_and_held_out_gain(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 3000)  # most words take the joined path
    docs = table(spark, "documents")
    found = lm.score_documents(docs).collect()
    check_base(found, [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (bucket(r.doc_id, 5) == 1) for r in found)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def small_model():
    words, counts = [b"%d" % i for i in range(90)], [100 - i for i in range(90)]
    model = lm.new_model(words, counts, 40, 25)
    rng = np.random.default_rng(1)
    model["params"]["class_w"] += rng.normal(0, 0.5, model["params"]["class_w"].shape).astype(np.float32)
    model["params"]["word_w"] += rng.normal(0, 0.5, model["params"]["word_w"].shape).astype(np.float32)
    return model


def test_probabilities_add_up_to_one():
    model = small_model()
    h = np.random.default_rng(0).normal(size=(lm.HIDDEN, 1)).astype(np.float32)
    every = np.arange(model["other"] + 1)
    p = np.exp(lm.log_probabilities(model, np.repeat(h, len(every), axis=1), every))
    assert p.sum() == pytest.approx(1, abs=1e-4)


def test_scores_in_step_are_those_one_by_one(monkeypatch):
    model, rng = small_model(), np.random.default_rng(2)
    texts = [rng.integers(0, model["other"] + 1, n) for n in (1, 300, 7, 7, 64, 129)]
    together = lm.text_scores(model, texts)
    assert np.allclose(together, [lm.text_scores(model, [t])[0] for t in texts], atol=1e-3)
    monkeypatch.setattr(lm, "BULK", 50)  # the state is carried over the parts
    assert np.allclose(together, lm.text_scores(model, texts), atol=1e-3)


def test_output_gradients_by_difference():
    model = small_model()
    model["params"] = {k: v.astype(np.float64) for k, v in model["params"].items()}
    rng = np.random.default_rng(3)
    h, y = rng.normal(size=(lm.HIDDEN, 40)), rng.integers(0, model["other"] + 1, 40)
    grads, dh = lm.loss_gradients(model, h, y)
    loss = lambda: -lm.log_probabilities(model, h, y).sum()
    for array, grad in ((model["params"]["class_w"], grads["class_w"]), (model["params"]["word_w"], grads["word_w"]), (h, dh)):
        at = tuple(rng.integers(0, n) for n in array.shape)
        array[at] += 1e-5
        up = loss()
        array[at] -= 2e-5
        down = loss()
        array[at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(grad[at], abs=1e-3)


def test_training_lowers_the_loss():
    model = lm.new_model([b"a", b"b", b"c"], [300, 300, 300], 0, 10)
    stream = np.array([0, 1, 2] * 3000)
    before = lm.text_scores(model, [stream[:300]])[0]
    for _ in range(10):
        lm.train_stream(model, stream, 0.02)
    assert lm.text_scores(model, [stream[:300]])[0] > before + 100


def test_frequent_words_are_the_most_frequent(spark):
    rows = [(f"w{i}", 1 + 10_000 // (i + 1)) for i in range(2000)] + [("x" * 100, 10**6)]
    counts = spark.createDataFrame(rows, "word string, n long")
    found = lm.frequent_words(counts, 300)
    assert 200 <= len(found) <= 300
    assert found == sorted(((w.encode(), n) for w, n in rows if len(w) < 65), key=lambda x: (-x[1], x[0]))[: len(found)]


def test_odd_rows(spark):
    rows = odd_rows()
    found = lm.score_documents(documents(spark, rows)).collect()
    check_base(found, rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    none = lm.score_documents(documents(spark, [(i, "a b") for i in range(60) if bucket(i, 5) == 1])).collect()
    assert none and all(r.train_tokens == 0 and r.n_known == 0 for r in none)
    assert lm.score_documents(documents(spark, rows).limit(0)).count() == 0


def test_all_training_rows_are_learned(spark):
    # a third of the rows have one text; more than a million tokens
    row = "CASE WHEN id % 3 = 0 THEN repeat('a b c d ', 100) ELSE concat('w', id, ' ', repeat('e f g h ', 100)) END AS text"
    training = spark.range(3000).selectExpr(row)
    frequent = lm.frequent_words(lm.count_words(training))
    total = sum(n for _, n in frequent)
    model = lm.fit(training, frequent, total, 3000)
    assert model["learned"] == total + 3000 > 1_200_000
