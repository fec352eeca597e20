import numpy as np

from bedledger.llm import gru, language
from helpers import bucket, documents, needs_tables, odd_rows


@needs_tables
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    found = language.identify_held_out(docs).collect()
    assert len(found) == len(truth)
    assert all(r.held_out == (bucket(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in found)
    held = [r.lang_pred == truth[r.doc_id] for r in found if r.held_out]
    assert np.mean(held) > 0.97


def test_gradients_by_difference():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in gru.start(rng, 5, 3).items()}
    x, keep = rng.integers(0, 5, (6, 4)), (rng.random((6, 4)) > 0.2).astype(float)
    h, weight = rng.normal(size=(3, 4)), rng.normal(size=(6, 3, 4))

    def loss():
        return float((np.array(gru.forward(p, x, h, keep)[0]) * weight).sum())

    grads = gru.backward(p, x, gru.forward(p, x, h, keep)[1], list(weight), keep)
    for name in ("table", "state"):
        for at in [(0, 0), (4, 2), (8, 1)]:
            p[name][at] += 1e-5
            up = loss()
            p[name][at] -= 2e-5
            down = loss()
            p[name][at] += 1e-5
            assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-3


def test_the_merged_layer_is_both_layers():
    rng = np.random.default_rng(1)
    model = {"languages": ["a", "b"], "ahead": gru.start(rng, 256, 8), "back": gru.start(rng, 256, 8),
             "out": rng.normal(size=(2, 16)).astype(np.float32), "bias": np.zeros(2, np.float32)}
    windows = rng.integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    x, zero = windows.T.astype(int), np.zeros((8, 5), np.float32)
    h = np.stack([np.concatenate(s) for s in zip(gru.forward(model["ahead"], x, zero)[0], gru.forward(model["back"], x[::-1], zero)[0][::-1])])
    p = np.exp(np.matmul(model["out"], h))
    p /= p.sum(axis=1, keepdims=True)
    assert np.allclose(language.label_probabilities(model, windows), p.transpose(1, 0, 2), atol=1e-5)


def test_odd_rows(spark):
    rows = odd_rows()
    labelled = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog " * 20, "en"), ("der hund und die katze " * 20, "de")] * 30)]
    model = language.train(documents(spark, labelled))
    found = language.identify(documents(spark, rows), model).collect()
    assert len(found) == len(rows)
    assert {r.doc_id for r in found if r.lang_pred == "und"} >= {1, 2, 3, 8, 9, 10}
    assert {r.lang_pred for r in found if r.doc_id in (4, 5, 6, 7)} <= {"en", "de"}
    assert language.identify(documents(spark, rows).limit(0), model).count() == 0
    nothing = language.train(documents(spark, rows).where("lang IS NOT NULL"))
    assert {r.lang_pred for r in language.identify(documents(spark, rows), nothing).collect()} == {"und"}
