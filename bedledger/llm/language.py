"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of `WINDOW` bytes in both directions, labels every byte position, and the
label probabilities of all positions of a document are averaged. It is trained in numpy by
backpropagation through time on a bounded sample of labelled documents.

Defined results: a null text, and one without a letter, is `und` with score 0; so is every text where no
labelled row exists. Repeated rows get equal results, ties take the language that sorts first, an empty
table gives an empty result, further columns are ignored. A text's last window is filled with spaces,
which do not count.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedledger.llm import gru
from bedledger.llm.common import id_bucket_column, map_batches, utf8

WINDOW = 64
HIDDEN = 8
#: Bounds of the training sample: documents of each language (expected number), and windows of each.
SAMPLE_DOCUMENTS = 400
SAMPLE_WINDOWS = 12
STEPS, BATCH = 400, 256
LANES = 2048
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts (one per row), the text each belongs to, and its number of real bytes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = -(-sizes // WINDOW)
    of = np.repeat(np.arange(len(texts)), counts)
    room = np.full((int(counts.sum()), WINDOW), 32, np.uint8)
    flat, first = room.reshape(-1), (np.cumsum(counts) - counts) * WINDOW
    for text, at, size in zip(texts, first.tolist(), sizes.tolist(), strict=True):
        flat[at : at + size] = np.frombuffer(text, np.uint8)
    real = np.full(len(room), WINDOW, np.int64)
    ends = np.cumsum(counts) - 1
    some = counts > 0
    real[ends[some]] = sizes[some] - (counts[some] - 1) * WINDOW
    return room, of, real


def merged(model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both directions as one layer: tables, block-diagonal state weights with gates together, output."""
    k = HIDDEN
    weights = np.zeros((6 * k, 2 * k), np.float32)
    for d, side in enumerate(("ahead", "back")):
        for gate in range(3):
            rows = slice(gate * 2 * k + d * k, gate * 2 * k + (d + 1) * k)
            weights[rows, d * k : (d + 1) * k] = model[side]["state"][gate * k : (gate + 1) * k]
    return model["ahead"]["table"], model["back"]["table"], weights


def label_probabilities(model: dict, windows: np.ndarray) -> np.ndarray:
    """(languages, WINDOW, windows): the probability of each label at each position."""
    k, n = HIDDEN, len(windows)
    ahead, back, weights = merged(model)
    x = np.ascontiguousarray(windows.T)
    h = np.zeros((2 * k, n), np.float32)
    states = np.empty((WINDOW, 2 * k, n), np.float32)
    a = np.empty((6 * k, n), np.float32)
    for t in range(WINDOW):
        for gate in range(3):
            rows = slice(gate * k, (gate + 1) * k)
            np.take(ahead[rows], x[t], axis=1, out=a[2 * gate * k : (2 * gate + 1) * k], mode="clip")
            np.take(back[rows], x[-1 - t], axis=1, out=a[(2 * gate + 1) * k : 2 * (gate + 1) * k], mode="clip")
        h = gru.step(a, weights, h)
        states[t, :k] = h[:k]
        states[-1 - t, k:] = h[k:]
    scores = np.matmul(model["out"], states) + model["bias"][:, None]  # (steps, languages, windows)
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores.transpose(1, 0, 2)


def pooled(model: dict, texts: list[bytes]) -> np.ndarray:
    """(texts, languages): mean label probability over all positions of each text."""
    sums = np.zeros((len(texts), len(model["languages"])))
    windows, of, real = windows_of(texts)
    inside = np.arange(WINDOW)[:, None]
    for at in range(0, len(windows), LANES):
        part = slice(at, at + LANES)
        p = label_probabilities(model, windows[part])
        here = (inside < real[part]).astype(np.float32)
        each = np.einsum("ltn,tn->ln", p, here)
        for i in range(len(each)):
            sums[:, i] += np.bincount(of[part], each[i], len(texts))
    return sums / np.maximum([[len(t)] for t in texts], 1)


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> dict:
    """Train on windows, each position with its document's language, by backpropagation through time."""
    rng, k = np.random.default_rng(seed), HIDDEN
    model = {
        "languages": languages,
        "ahead": gru.start(rng, 256, k),
        "back": gru.start(rng, 256, k),
        "out": rng.normal(0, 0.3, (len(languages), 2 * k)).astype(np.float32),
        "bias": np.zeros(len(languages), np.float32),
    }
    flat = {f"{s}_{name}": model[s][name] for s in ("ahead", "back") for name in ("table", "state")}
    flat |= {"out": model["out"], "bias": model["bias"]}
    adam = gru.Adam(flat, 0.02)
    for n in range(STEPS):
        pick = rng.integers(0, len(windows), BATCH)
        x, y = windows[pick].T.astype(np.int64), labels[pick]
        zero = np.zeros((k, BATCH), np.float32)
        states, memory = gru.forward(model["ahead"], x, zero)
        states_back, memory_back = gru.forward(model["back"], x[::-1], zero)
        h = np.stack([np.concatenate((s, b)) for s, b in zip(states, states_back[::-1], strict=True)])
        p = np.matmul(model["out"], h) + model["bias"][:, None]
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[:, y, np.arange(BATCH)] -= 1
        p /= BATCH * WINDOW / 16
        dh = np.matmul(model["out"].T, p)
        grads = {"out": np.einsum("tln,thn->lh", p, h), "bias": p.sum(axis=(0, 2))}
        for side, seen, kept, d in (("ahead", x, memory, dh[:, :k]), ("back", x[::-1], memory_back, dh[::-1, k:])):
            for name, g in gru.backward(model[side], seen, kept, list(d)).items():
                grads[f"{side}_{name}"] = g
        adam.update(grads, 1 - n / STEPS)
    return model


def training_windows(labelled: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of a hash sample of the labelled rows (text, lang): bounded per language and per document."""
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    rate = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample_documents / sizes[lang]))])
    chance = F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 30)) / float(1 << 30)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, made = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch, "text"), strict=True):
            windows = windows_of([text])[0]
            if len(windows) > SAMPLE_WINDOWS:  # spread over the whole text
                windows = windows[np.linspace(0, len(windows) - 1, SAMPLE_WINDOWS).astype(int)]
            langs += [lang] * len(windows)
            made += [w.tobytes() for w in windows]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(made, pa.binary())], names=["lang", "bytes"])

    sample = labelled.where(F.col("text").isNotNull() & (chance < rate[F.col("lang")]))
    rows = sorted(map(tuple, map_batches(sample, "lang string, bytes binary", run).collect()), key=lambda r: (r[0], bytes(r[1])))
    at = {lang: i for i, lang in enumerate(languages)}
    windows = np.frombuffer(b"".join(bytes(b) for _, b in rows), np.uint8).reshape(-1, WINDOW)
    return windows, np.array([at[lang] for lang, _ in rows], np.int64), languages


def identify(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score of each row; the text is the only input of the prediction."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, texts = shared.value, utf8(batch, "text")
        known = [i for i, t in enumerate(texts) if t and model["languages"] and _LETTER.search(t.decode())]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if known:
            p = pooled(model, [texts[i] for i in known])
            for i, best, score in zip(known, p.argmax(axis=1), p.max(axis=1), strict=True):
                names[i], scores[i] = model["languages"][best], min(1.0, float(score))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"]
        )

    return map_batches(rows, "doc_id long, lang_pred string, score double", run)


def train(labelled: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> dict:
    windows, labels, languages = training_windows(labelled, sample_documents)
    if not len(windows):
        return {"languages": []}
    return fit(windows, labels, languages)


def identify_held_out(documents: DataFrame) -> DataFrame:
    """Learn from rows with a language whose id's crc32 modulo 3 is not 1; predict all rows."""
    rest = id_bucket_column("doc_id", 3)
    labelled = documents.where(F.col("lang").isNotNull() & (rest != 1)).select("text", "lang")
    return identify(documents, train(labelled)).select(
        "doc_id", (rest == 1).alias("held_out"), "lang_pred", "score"
    )
