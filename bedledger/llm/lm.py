"""Scoring with a gated recurrent language model.

Words of all training documents are counted. The most frequent `VOCABULARY` words and the end of a text
are predicted through a class-factored softmax: a class first, then a word of the class. All other words
are one more class, in which a word has its smoothed share of that class's training words, so the score
is a log probability of the text over any words. The network is trained in numpy by truncated
backpropagation through time, the state carried from window to window and reset where a document begins;
workers, whose number grows with the corpus, train on parts of it and their parameters are averaged. A document is scored from its
first word to its end with the state carried through.

Counts and the network's weights come from all training documents: each row is learned once, in one of
`ROUNDS` rounds, by a worker that its row number chooses, so equal texts are spread over the workers.

Defined results: a null text is an empty one and has one token, the end; without training documents N
and V are 0 and the network keeps its initial weights; repeated rows get equal results; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedledger.llm import gru
from bedledger.llm.common import checkpointed, id_bucket_column, map_batches, ship_package, utf8

VOCABULARY, CLASSES, HIDDEN = 4096, 64, 16
#: Words with counts that every scorer holds; rarer ones are joined. Words over LONGEST bytes are joined, too.
FREQUENT, LONGEST = 200_000, 64
ROUNDS = 2
#: A worker trains on about so many tokens a round; there are at least LEAST_WORKERS. FAN parameter sets are averaged at once.
WORKER_TOKENS, LEAST_WORKERS, FAN = 1_000_000, 4, 16
#: Positions of a window, most sequences side by side, least windows of a pass, and the rate at 32 sequences, which grows with their root.
STEPS, LANES, LEAST_WINDOWS, RATE = 32, 512, 32, 0.02
WINDOW, BULK = 64, 1 << 16
#: A task hands on its word counts when it holds this many different words.
HELD_WORDS = 400_000


def tokens_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


# ---- Counts ----


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows of `texts`: counted in the tasks, then summed."""
    ship_package(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            words = pa.array(list(held), pa.binary()).cast(pa.string())
            made = pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for text in utf8(batch, "text"):
                held.update(tokens_of(text))
                if len(held) > HELD_WORDS:
                    yield told()
        yield told()

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---- The network ----


def new_model(words: list[bytes], counts: list[int], rest: int, ends: int, seed: int = 5) -> dict:
    """A network that starts as the unigram model of `words` by falling count, the end and the rest."""
    rng = np.random.default_rng(seed)
    size = len(words) + 1  # with the end, which is the last of the known
    c = np.array([*counts, ends], np.float64) + 0.5
    order = np.argsort(-c, kind="stable")
    width = max(1, -(-size // CLASSES))
    of, place = np.empty(size, np.int64), np.empty(size, np.int64)
    of[order], place[order] = np.arange(size) // width, np.arange(size) % width
    classes = -(-size // width)
    inside = np.full((classes, width), -1e9, np.float32)
    inside[of, place] = np.log(c)
    totals = np.append(np.bincount(of, c, classes), rest + 0.5)
    model = gru.start(rng, size + 1, HIDDEN) | {  # one input for all other words
        "class_w": rng.normal(0, 0.05, (classes + 1, HIDDEN)).astype(np.float32),
        "class_b": np.log(totals / totals.sum()).astype(np.float32),
        "word_w": rng.normal(0, 0.05, (classes, width, HIDDEN)).astype(np.float32),
        "word_b": inside,
    }
    return {"params": model, "of": np.append(of, classes), "place": np.append(place, 0), "end": size - 1, "other": size}


def softmax(x: np.ndarray) -> np.ndarray:
    """In place, over the first axis."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def log_probabilities(model: dict, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """ln P(y) at states h (features x positions); for the rest class that of the class."""
    p, of, place = model["params"], model["of"][y], model["place"][y]
    at = np.arange(len(y))
    scores = p["class_w"] @ h
    scores += p["class_b"][:, None]
    top = scores.max(axis=0)
    found = scores[of, at] - top
    scores -= top
    found -= np.log(np.exp(scores, out=scores).sum(axis=0))
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(len(p["word_b"]) + 1))
    # positions by class, so that each class works on adjacent columns
    sorted_h, sorted_place, more = h[:, order], place[order], np.zeros(len(y), found.dtype)
    for c, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if b > a:
            inner = p["word_w"][c] @ sorted_h[:, a:b]
            inner += p["word_b"][c][:, None]
            inner -= inner.max(axis=0)
            chosen = inner[sorted_place[a:b], np.arange(b - a)]
            more[a:b] = chosen - np.log(np.exp(inner, out=inner).sum(axis=0))
    found[order] += more
    return found


def loss_gradients(model: dict, h: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the summed negative log likelihood: of the output weights, and of h."""
    p, of, place = model["params"], model["of"][y], model["place"][y]
    d = p["class_w"] @ h
    d += p["class_b"][:, None]
    d = softmax(d)
    d[of, np.arange(len(y))] -= 1
    grads = {"class_w": d @ h.T, "class_b": d.sum(axis=1)}
    dh = p["class_w"].T @ d
    grads |= {"word_w": np.zeros_like(p["word_w"]), "word_b": np.zeros_like(p["word_b"])}
    # positions by class, so that each class works on adjacent columns
    order = np.argsort(of, kind="stable")
    sorted_h, sorted_place, inner = h[:, order], place[order], np.zeros_like(h)
    edges = np.searchsorted(of[order], np.arange(len(p["word_b"]) + 1))
    for c, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if b > a:
            own = sorted_h[:, a:b]
            d = p["word_w"][c] @ own
            d += p["word_b"][c][:, None]
            d = softmax(d)
            d[sorted_place[a:b], np.arange(b - a)] -= 1
            grads["word_w"][c], grads["word_b"][c] = d @ own.T, d.sum(axis=1)
            inner[:, a:b] = p["word_w"][c].T @ d
    dh[:, order] += inner
    return grads, dh


def train_stream(model: dict, stream: np.ndarray, rate: float) -> None:
    """One pass of truncated backpropagation over a stream of word numbers, each document closed by the end."""
    # wide windows cost less per token, but a short stream needs some steps as well
    lanes = max(1, min(LANES, len(stream) // (STEPS * LEAST_WINDOWS)))
    rate *= math.sqrt(max(lanes, 8) / 32)
    size = len(stream) // lanes
    if not size:
        return
    y = stream[: size * lanes].reshape(lanes, size).T
    x = np.vstack([np.full((1, lanes), model["end"]), y[:-1]])
    adam, h = gru.Adam(model["params"], rate), np.zeros((HIDDEN, lanes), np.float32)
    layer = {k: model["params"][k] for k in ("table", "state")}
    for at in range(0, size, STEPS):
        xs, ys = x[at : at + STEPS], y[at : at + STEPS]
        keep = (xs != model["end"]).astype(np.float32)
        states, memory = gru.forward(layer, xs, h, keep)
        h = states[-1]
        grads, dh = loss_gradients(model, np.concatenate(states, axis=1), ys.ravel())
        dh = dh.reshape(HIDDEN, len(xs), lanes).transpose(1, 0, 2)
        grads |= gru.backward(layer, xs, memory, list(dh), keep, gru.column_sums_of_many)
        adam.update({k: g / ys.size for k, g in grads.items()}, 1 - 0.9 * at / size)


def text_scores(model: dict, texts: list[np.ndarray]) -> np.ndarray:
    """ln P of each sequence of word numbers (end included), all in step, the state carried throughout."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-sizes, kind="stable")
    flat = np.concatenate([texts[i] for i in order]) if len(texts) else np.zeros(0, np.int64)
    sizes = sizes[order]
    first = np.cumsum(sizes) - sizes
    sums, table, weights = np.zeros(len(texts)), model["params"]["table"], model["params"]["state"]
    h, last = np.zeros((HIDDEN, len(texts)), np.float32), np.full(len(texts), model["end"])
    pending: list[tuple[np.ndarray, np.ndarray, int]] = []
    waiting = 0

    def score() -> None:
        nonlocal waiting
        if pending:
            states = np.concatenate([s for s, _, _ in pending], axis=1)
            found = log_probabilities(model, states, np.concatenate([y for _, y, _ in pending]))
            at = 0
            for _, _, n in pending:
                sums[:n] += found[at : at + n]
                at += n
        pending.clear()
        waiting = 0

    active = len(texts)
    for t in range(int(sizes[0]) if len(texts) else 0):
        while active and sizes[active - 1] <= t:
            active -= 1
        h = gru.step(np.take(table, last[:active], axis=1), weights, np.ascontiguousarray(h[:, :active]))
        last = flat[first[:active] + t]
        pending.append((h, last, active))
        waiting += active
        if waiting >= BULK:
            score()
    score()
    out = np.empty(len(texts))
    out[order] = sums
    return out


# ---- Training and scoring over Spark ----


def mean_parameters(rows: list[tuple[bytes, int]]) -> tuple[dict, int]:
    """Parameters averaged by the tokens they were trained on; sums run in a fixed order."""
    rows = sorted((n, p) for p, n in rows)
    weight = sum(n for n, _ in rows)
    total: dict = {}
    for n, packed in rows:
        for k, v in pickle.loads(packed).items():
            total[k] = total.get(k, 0) + v.astype(np.float64) * (n / weight)
    return {k: v.astype(np.float32) for k, v in total.items()}, weight


def averaged(trained: DataFrame, workers: int) -> tuple[dict, int] | None:
    """Mean over the rows (params, n) of all workers, FAN by FAN in tasks; the driver gets one set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(bytes(r["params"]), r["n"]) for batch in batches for r in batch.to_pylist()]
        if rows:
            mean, n = mean_parameters(rows)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(mean)], pa.binary()), pa.array([n])], names=["params", "n"])

    while workers > FAN:
        workers = -(-workers // FAN)
        trained = trained.repartition(max(FAN, workers)).mapInArrow(run, "params binary, n long")
    trained = trained.repartition(FAN).mapInArrow(run, "params binary, n long")
    trained = trained.repartition(1).mapInArrow(run, "params binary, n long")
    rows = [(bytes(r["params"]), r["n"]) for r in trained.collect()]  # one
    return mean_parameters(rows) if rows else None


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> list[tuple[bytes, int]]:
    """At most `most` words with their counts, the most frequent first.

    The least count taken comes from a histogram over all words (a few hundred rows), so no task and no driver sorts or
    holds more than the words that are taken.
    """
    short = counts.where(F.octet_length("word") <= LONGEST)
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = short.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least"))
    room, least = most, None
    for row in sorted(sizes.collect(), key=lambda r: -r["step"]):
        room -= row["words"]
        if room < 0:
            break
        least = row["least"]
    if least is None:
        return []
    taken = short.where(F.col("n") >= least).toArrow()
    words, numbers = taken.column("word").cast(pa.binary()).to_pylist(), taken.column("n").to_pylist()
    return sorted(zip(words, numbers, strict=True), key=lambda x: (-x[1], x[0]))


def fit(training: DataFrame, frequent: list[tuple[bytes, int]], total: int, documents: int) -> dict:
    """The network: vocabulary from all counts, weights from all rows, averaged over the workers; `learned` is the number of their tokens."""
    top = frequent[:VOCABULARY]
    words = [w for w, _ in top]
    model = new_model(words, [n for _, n in top], total - sum(n for _, n in top), documents)
    spark = training.sparkSession
    known = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    row, other, end = F.monotonically_increasing_id(), model["other"], model["end"]
    kind = np.dtype(np.uint16 if other < 1 << 16 else np.uint32)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        number = known.value
        ids = [np.array([*[number.get(w, other) for w in tokens_of(t)], end], kind).tobytes() for t in utf8(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column("mark"), batch.column("turn"), pa.array(ids, pa.binary())], names=["mark", "turn", "ids"])

    turn_of = F.pmod(F.xxhash64(F.lit("turn"), row), F.lit(ROUNDS)).alias("turn")
    numbered = training.select("text", F.xxhash64(F.lit("worker"), row).alias("mark"), turn_of)
    rows = checkpointed(map_batches(numbered, "mark long, turn long, ids binary", encode))
    workers = max(LEAST_WORKERS, math.ceil(total / (ROUNDS * WORKER_TOKENS)))
    learned_all = 0
    for turn in range(ROUNDS):
        now = spark.sparkContext.broadcast(pickle.dumps(model))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, parts, size = None, [], 0
            learned = 0

            def learn() -> None:
                nonlocal parts, size, learned
                stream = np.concatenate(parts)
                train_stream(own, stream, RATE / (1 + turn))
                learned += len(stream)
                parts, size = [], 0

            for batch in batches:
                own = own or pickle.loads(now.value)
                for ids in batch.column("ids").to_pylist():
                    parts.append(np.frombuffer(ids, kind).astype(np.int64))
                    size += len(parts[-1])
                    if size > 4_000_000:  # a long share is learned piece by piece
                        learn()
            if own:
                if parts:
                    learn()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([pickle.dumps(own["params"])], pa.binary()), pa.array([learned], pa.int64())], names=["params", "n"]
                )

        ship_package(spark)
        part = rows.where(F.col("turn") == turn).repartition(workers, "mark").sortWithinPartitions("mark")
        trained = part.select("ids").mapInArrow(run, "params binary, n long")
        mean = averaged(trained, workers)
        if mean:
            model["params"] = mean[0]
            learned_all += mean[1]
        now.destroy()
    return model | {"words": words, "learned": learned_all}


ROWS = "doc_id long, n_tokens long, known long, base double, network double, others long, rare array<struct<word: string, n: long>>"


def score_texts(rows: DataFrame, model: dict, frequent: list[tuple[bytes, int]]) -> DataFrame:
    """Per row: what the network and the frequent words' counts give, and the rarer words with their number."""
    words = model.pop("words")
    number = {w: i for i, w in enumerate(words)}
    # the place of each frequent word; at the places, numbers in the network and logarithms of the counts; last, those of others
    held = {w: i for i, (w, _) in enumerate(frequent)}
    numbers = np.array([*[number.get(w, model["other"]) for w, _ in frequent], model["other"]])
    logs_of = np.array([*[math.log10(n + 0.5) for _, n in frequent], 0.0])
    shared = rows.sparkSession.sparkContext.broadcast((model, held, numbers, logs_of))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        (model, held, numbers, logs_of), n = shared.value, batch.num_rows
        sequences, base, known, others_base, others, rare, size = [], np.zeros(n), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64), [], np.zeros(n, np.int64)
        other, end = model["other"], model["end"]
        for i, text in enumerate(utf8(batch, "text")):
            words = tokens_of(text)
            found = np.fromiter(map(held.get, words, repeat(len(held))), np.int64, len(words))
            ids, logs = numbers[found], logs_of[found]
            outside = ids == other
            unknown = Counter(words[k] for k in np.flatnonzero(found == len(held)).tolist())
            size[i], known[i] = len(words) + 1, len(words) - unknown.total()
            base[i], others_base[i], others[i] = logs.sum(), logs[outside].sum(), outside.sum()
            rare.append([{"word": w.decode(), "n": k} for w, k in unknown.items()])
            sequences.append(np.append(ids, end))
        network = text_scores(model, sequences) / math.log(10) + others_base
        kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(size), pa.array(known), pa.array(base), pa.array(network), pa.array(others), pa.array(rare, kind)],
            names=["doc_id", "n_tokens", "known", "base", "network", "others", "rare"],
        )

    return map_batches(rows, ROWS, run)


def score_documents(documents: DataFrame) -> DataFrame:
    """Learn from rows whose id's crc32 modulo 5 is not 1; score all rows."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held_out = id_bucket_column("doc_id", 5) == 1
    training = rows.where(~held_out)
    counts = checkpointed(count_words(training))
    documents_seen = training.count()
    # the end is a token of every document
    of = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total = of["n"] + documents_seen
    distinct = of["v"] + (documents_seen > 0)
    frequent = frequent_words(counts)
    model = fit(training, frequent, of["n"], documents_seen)
    inside = sum(n for _, n in frequent[:VOCABULARY])
    others_total = math.log10(of["n"] - inside + 0.5 * (of["v"] - min(VOCABULARY, len(frequent)) + 1))
    base_total = math.log10(total + 0.5 * (distinct + 1))
    end_log = math.log10(documents_seen + 0.5)

    scored = checkpointed(score_texts(rows, model, frequent).withColumn("row", F.monotonically_increasing_id()))
    log = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    rare = (
        scored.select("row", F.inline("rare"))
        .join(counts.select("word", F.col("n").alias("c")), "word", "left")
        .groupBy("row")
        .agg(F.sum(F.col("n") * log).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("rare_known"))
    )
    nothing = F.lit(0)
    rare_log, rare_known = F.coalesce("rare_log", nothing), F.coalesce("rare_known", nothing)
    return scored.drop("rare").join(rare, "row", "left").select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("known") + rare_known + int(documents_seen > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + rare_log + end_log - F.col("n_tokens") * base_total).alias("base_score"),
        (F.col("network") + rare_log - F.col("others") * others_total).alias("score"),
    )
