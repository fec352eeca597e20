import math
import re

import numpy as np
import pytest

from bedledger.llm import toxicity
from helpers import LOWER, documents, needs_tables, odd_rows, table


@needs_tables
def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    model = toxicity.train(docs, labels.where("doc_id % 3 <> 1"))
    rows = [r for r in toxicity.severity(docs, model).collect() if r.doc_id in truth and r.doc_id % 3 == 1]
    flagged = [r.toxic for r in rows if not truth[r.doc_id]]
    caught = [r.toxic for r in rows if truth[r.doc_id]]
    assert np.mean(flagged) < 0.01 and np.mean(caught) > 0.5


def test_ordinal_fit_shares_weights_across_ordered_thresholds():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(3000)]
    true = np.array([1.5, 1.5, 1.0, 0, 0, 0.0])
    scores = np.array([true[r].sum() for r in rows]) + rng.logistic(size=len(rows))
    grades = np.digitize(scores, [0.5, 1.5, 3.0])
    w, thresholds = toxicity.fit_ordinal(rows, grades, 6, l2=0)
    assert np.all(np.diff(thresholds) > 0)
    assert np.abs(w - true).max() < 0.3 and np.abs(thresholds - [0.5, 1.5, 3.0]).max() < 0.3
    p = toxicity.grade_probabilities(np.array([-2.0, 0.0, 4.0]), thresholds)
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all() and (np.diff(p @ np.arange(4)) > 0).all()


def labelled(spark):
    rows = [(n, f"plain words of text {n} " + ("vile nasty" if n % 4 == 0 else "")) for n in range(400)]
    labels = [(n, 1, int(n % 4 == 0)) for n in range(400)] + [(None, 1, 1), (7, 1, None), (9999, 0, 1)]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_odd_rows(spark):
    model = toxicity.train(*labelled(spark))
    rows = [*odd_rows(), (50, "VILE, nasty!"), (51, "a plain text")]
    docs = documents(spark, rows)
    found = toxicity.severity(docs, model).collect()
    assert len(found) == len(rows)
    assert {r.doc_id for r in found if r.toxic} == {50}
    assert all(0 <= r.expected_severity <= toxicity.GRADES for r in found)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 1
    assert toxicity.severity(docs.limit(0), model).count() == 0
    nothing = toxicity.train(docs, labelled(spark)[1].limit(0))
    assert not any(r.toxic for r in toxicity.severity(docs, nothing).collect())


@needs_tables
def test_severity_like_plain_python(spark):
    """Every row of the test table by a loop over its words and the cumulative probabilities."""
    docs = table(spark, "documents")
    model = toxicity.train(docs, table(spark, "labels"))
    assert model["number"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = toxicity.severity(docs, model).collect()
    assert len(found) == len(texts)
    for r in found:
        words = set(re.findall(r"[0-9a-z\x80-\U0010ffff]+", (texts[r.doc_id] or "").translate(LOWER)))
        score = sum(model["w"][model["number"][w.encode()]] for w in words if w.encode() in model["number"])
        upto = [1 / (1 + math.exp(min(score - t, 700))) for t in model["thresholds"]] + [1.0]
        p = [b - a for a, b in zip([0.0, *upto], upto)]
        expected = sum(k * q for k, q in enumerate(p))
        assert r.expected_severity == pytest.approx(expected, abs=1e-9)
        assert r.toxic == (r.expected_severity >= toxicity.LIMIT) and p[r.grade] == pytest.approx(max(p))
