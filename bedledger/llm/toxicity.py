"""Toxicity as cumulative-link ordinal regression over sparse text features.

P(grade <= k | x) = sigmoid(theta_k - w.x) with ordered thresholds theta and one weight vector for all of
them. Everything is fitted on a hash sample of the labels, whose size is bounded (`SAMPLE_DOCUMENTS`).
Features are the different words of a text that go with the label: for each word, documents with and without
the label are counted, and words whose association is clear are kept (a bounded number). The
grade of a labelled document is 0 if it is not toxic, else 1 to `GRADES` by how many different such words it
has. A text's result is its expected grade.

Defined results: a null or empty text has no features and gets the result of a text without any; without
labelled rows nothing is toxic; a document with several labels counts once for each; repeated rows get equal results; an
empty table gives an empty result; further columns are ignored by `severity` and kept by `keep_clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedledger.llm.common import checkpointed, map_batches, ship_package, utf8

GRADES = 3
#: Words kept as features at most, least labelled documents with the word, least z-score of the association.
FEATURES, LEAST_DOCUMENTS, LEAST_Z = 4096, 5, 5.0
#: Expected bound of the labels that the model is fitted on.
SAMPLE_DOCUMENTS = 20_000
#: A document is rejected from this expected grade on.
LIMIT = 0.5
HELD_WORDS = 400_000
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def labelled_texts(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(text, toxic) of the documents in a sample of the labels.

    The sample is drawn before the join, so its size is known and it is broadcast: no text is shuffled.
    """
    told = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("of"), (F.col("toxic") > 0).cast("int").alias("toxic")
    )
    share = min(1.0, sample / max(1, told.count()))
    mark = F.pmod(F.xxhash64(F.lit("label"), "of"), F.lit(1 << 20))
    chosen = F.broadcast(told.where(mark < share * (1 << 20)))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return checkpointed(rows.join(chosen, F.col("doc_id") == F.col("of")).select("text", "toxic"))


def word_labels(texts: DataFrame) -> DataFrame:
    """(word, toxic, clean): labelled documents with the word, for each label; summed in the tasks first."""
    ship_package(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def told() -> pa.RecordBatch:
            words = pa.array(list(held), pa.binary()).cast(pa.string())
            numbers = [pa.array([v[k] for v in held.values()], pa.int64()) for k in (1, 0)]
            held.clear()
            return pa.RecordBatch.from_arrays([words, *numbers], names=["word", "toxic", "clean"])

        for batch in batches:
            for text, toxic in zip(utf8(batch, "text"), batch.column("toxic").to_pylist(), strict=True):
                for word in {*words_of(text)}:
                    held.setdefault(word, [0, 0])[toxic] += 1
                if len(held) > HELD_WORDS:
                    yield told()
        yield told()

    return texts.mapInArrow(run, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def feature_words(texts: DataFrame) -> list[str]:
    """Words that go with the toxic label beyond chance, the clearest first."""
    sizes = texts.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    if not sizes["toxic"] or sizes["toxic"] == sizes["n"]:
        return []
    share = sizes["toxic"] / sizes["n"]
    n = F.col("toxic") + F.col("clean")
    z = (F.col("toxic") - n * share) / F.sqrt(n * share * (1 - share))
    found = word_labels(texts).where(n >= LEAST_DOCUMENTS).select("word", z.alias("z"), n.alias("n")).where(F.col("z") >= LEAST_Z)
    return [r["word"] for r in found.orderBy(F.desc("z"), "word").limit(FEATURES).collect()]


def sparse_features(texts: list[bytes | None], number: dict[bytes, int]) -> list[np.ndarray]:
    return [np.array(sorted({number[w] for w in words_of(t) if w in number}), np.int64) for t in texts]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def grade_probabilities(scores: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """(rows, grades) from w.x and the ordered thresholds."""
    upto = np.hstack([sigmoid(thresholds - scores[:, None]), np.ones((len(scores), 1))])
    return np.diff(upto, axis=1, prepend=0.0)


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, features: int, steps: int = 400, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds at the largest penalised likelihood, by Adam on all rows.

    The first threshold is free, each further one lies exp(gap) above the one before.
    """
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    top = int(grades.max(initial=1))
    params = {"w": np.zeros(features), "t": np.array([2.0, *np.zeros(top - 1)])}
    m = {k: np.zeros_like(v) for k, v in params.items()}
    v = {k: np.zeros_like(v) for k, v in params.items()}
    at = np.arange(len(grades))
    for n in range(1, steps + 1):
        thresholds = np.cumsum([params["t"][0], *np.exp(params["t"][1:])])
        scores = np.bincount(owner, params["w"][column], len(rows))
        upto = np.hstack([np.zeros((len(rows), 1)), sigmoid(thresholds - scores[:, None]), np.ones((len(rows), 1))])
        p = np.maximum(upto[at, grades + 1] - upto[at, grades], 1e-9)
        slope = upto * (1 - upto)
        # derivative of -log p by the thresholds above and below the grade
        above, below = -slope[at, grades + 1] / p, slope[at, grades] / p
        d = np.zeros((len(rows), top + 2))
        d[at, grades + 1] += above
        d[at, grades] += below
        by_threshold = d[:, 1:-1].sum(axis=0)
        later = np.cumsum(by_threshold[::-1])[::-1]
        gradient = {
            "w": np.bincount(column, (-(above + below))[owner], features) / len(rows) + l2 * params["w"] / 10,
            "t": np.array([later[0], *(later[1:] * np.exp(params["t"][1:]))]) / len(rows),
        }
        for k, g in gradient.items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            params[k] -= 0.1 * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)
    return params["w"], np.cumsum([params["t"][0], *np.exp(params["t"][1:])])


def train(documents: DataFrame, labels: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> dict:
    """Feature words, weights and thresholds from a bounded sample of the labelled rows."""
    texts = labelled_texts(documents, labels, sample_documents)
    words = feature_words(texts)
    number = {w.encode(): i for i, w in enumerate(words)}
    if not words:
        return {"number": {}, "w": np.zeros(0), "thresholds": np.full(GRADES, 20.0)}
    shared = documents.sparkSession.sparkContext.broadcast(number)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = sparse_features(utf8(batch, "text"), shared.value)
        return pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int64()))], names=["toxic", "found"])

    rows = map_batches(texts, "toxic int, found array<long>", run).collect()
    rows = sorted((r["toxic"], list(r["found"])) for r in rows)
    grades = np.array([min(GRADES, max(1, len(found))) if toxic else 0 for toxic, found in rows], np.int64)
    if not grades.any() or grades.all():
        return {"number": {}, "w": np.zeros(0), "thresholds": np.full(GRADES, 20.0)}
    w, thresholds = fit_ordinal([np.array(f, np.int64) for _, f in rows], grades, len(words))
    return {"number": number, "w": w, "thresholds": thresholds}


def expected_grades(model: dict, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Most likely grade and expected grade of each text."""
    found = sparse_features(texts, model["number"])
    scores = np.array([model["w"][f].sum() for f in found]) if len(found) else np.zeros(0)
    p = grade_probabilities(scores, model["thresholds"])
    return p.argmax(axis=1), p @ np.arange(p.shape[1])


def severity(documents: DataFrame, model: dict, limit: float = LIMIT) -> DataFrame:
    """doc_id, grade, expected_severity and toxic of each row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most FEATURES words
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        grade, expected = expected_grades(shared.value, utf8(batch, "text"))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(grade.astype(np.int32)), pa.array(expected), pa.array(expected >= limit)],
            names=["doc_id", "grade", "expected_severity", "toxic"],
        )

    return map_batches(rows, "doc_id long, grade int, expected_severity double, toxic boolean", run)


def keep_clean(documents: DataFrame, model: dict, limit: float = LIMIT) -> DataFrame:
    """The rows below the limit, all columns; no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(documents.columns))]
    text = names[[c.lower() for c in documents.columns].index("text")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(expected_grades(shared.value, utf8(batch, text))[1] < limit))

    plain = documents.toDF(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return map_batches(plain, schema, run).toDF(*documents.columns)
