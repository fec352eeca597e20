r"""Personal data by candidate gradient boosting.

Strict rules find e-mail addresses, IP addresses, card and phone numbers; these spans always stay.
High-recall generators propose further, overlapping spans: each group of neighbouring pieces of a run of
digits and separators, and addresses with a written-out `at`. Boosted trees rate each candidate by its
format and context. They learn from candidates of a bounded sample of the documents. Positives are the strict spans, as
they stand and in disguise: phone numbers without plus and country code, addresses with `at` and `dot` written out, each
in the context of its strict span. Negatives are the candidates that touch no strict span, and the rest of a phone number after
its country code; those of a form in which strict spans appear in disguise, and those that the rules would take if they
stood alone, have no label, nor have other parts of strict spans. The threshold of each kind is
calibrated on the other half of the sample to a wanted precision. Of overlapping candidates the best-rated one is
added, and none that touches a strict span.

All positions are code points, ends are exclusive, whole texts are read. Defined results: a null text is
an empty one; repeated rows get equal results; without positives of a kind nothing of that kind is added; an
empty table gives an empty result; further columns are ignored by `find_spans` and kept by `redacted`.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedledger.llm.boosting import fit_trees, predict
from bedledger.llm.common import map_batches

EMAIL, IP, CARD, PHONE = KINDS = ("email", "ip", "card", "phone")
#: So many documents are expected in the sample that trains the trees (independent draws); their wanted precision.
SAMPLE_DOCUMENTS = 20_000
PRECISION = 0.95
LEAST_POSITIVES = 20
#: Code points around a strict span that its disguised form keeps.
CONTEXT = 64

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# all matches of the three number rules lie in such runs
_RUN = re.compile(r"[+0-9][\x20().0-9+-]*")
# the same matches as without the look-behind: a match never begins inside digits
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[^\W\d_]")
_CODE_BEFORE = re.compile(r"\+[0-9]{1,3}[\x20.-]?\Z")
_COUNTRY = re.compile(r"\+[0-9]{1,3}[\x20.-]*")
_PIECE = re.compile(r"[^\x20]+")
_WRITTEN = re.compile(
    r"(?<![\w.%+-])[\w.%+-]{1,64} ?(?:\(at\)|\[at\]) ?[\w-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[\w-]{1,63}){1,8}",
    re.I | re.A,
)

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def at_most_255(part: str) -> bool:
    """Whether a run of digits of any length stands for 255 or less."""
    return int(part.lstrip("0")[:4] or "0") <= 255


def strict_emails(text: str) -> list[Span]:
    spans, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            done = domain.end()
            spans.append((0, start, done))
        at = text.find("@", max(at + 1, done))
    return spans


def strict_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that pass their check, by kind, then start."""
    found: list[list[Span]] = [strict_emails(text), [], [], []]
    for run in _RUN.finditer(text):
        a, b = run.span()
        if b - a < 7:
            continue
        for m in _IP.finditer(text, a, b):
            if all(map(at_most_255, m.group().split("."))):
                found[1].append((1, *m.span()))
        for m in _CARD.finditer(text, a, b):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found[2].append((2, *m.span()))
        for m in _PHONE.finditer(text, a, b):
            if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                found[3].append((3, *m.span()))
    return [s for kind in found for s in kind]


# ---- Candidates ----


def candidates(text: str) -> list[Span]:
    """Overlapping spans that may be personal data, each for the kinds its characters allow."""
    out: list[Span] = [(0, s, e) for _, s, e in strict_emails(text)]
    if "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text:
        out += [(0, *m.span()) for m in _WRITTEN.finditer(text)]
    for run in _RUN.finditer(text):
        a, b = run.span()
        if b - a < 7:
            continue
        before = 1 if a and text[a - 1] == "(" else 0
        # without digits a piece neither begins nor ends a span; so at most 19 are stepped over from each
        pieces = [m.span() for m in _PIECE.finditer(text, a - before, b) if _DIGIT.search(text, *m.span())]
        for i in range(len(pieces)):
            digits = 0
            for j in range(i, len(pieces)):
                digits += len(_DIGIT.findall(text, *pieces[j]))
                if digits > 19:
                    break
                start, end = pieces[i][0], pieces[j][1]
                while end > start and not text[end - 1].isdigit():  # a closing full stop is no part
                    end -= 1
                if digits < 4 or start >= end:
                    continue
                part = text[start:end]
                if part.count(".") == 3 and i == j and digits <= 12:
                    out.append((1, start, end))
                if digits >= 13:
                    out.append((2, start, end))
                if 7 <= digits <= 15:
                    out.append((3, start, end))
    return list(dict.fromkeys(out))


def features(text: str, span: Span) -> list[float]:
    """Format of the span and its context."""
    kind, start, end = span
    part = text[start:end]
    groups = [len(g) for g in re.findall(r"[0-9]+", part)] or [0]
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    near = text[max(0, start - 24) : start].lower()
    digits = sum(groups)
    return [
        kind, end - start, digits, len(groups), groups[0], groups[-1], max(groups), min(groups),
        part.count("."), part.count("-"), part.count(" "), part.count("("), part.count("+"), part.count("@"),
        float(sum(c.isalpha() for c in part)),
        float(digits >= 12 and luhn("".join(c for c in part if c in "0123456789"))),
        float(max((int(g[-9:]) for g in re.findall(r"[0-9]+", part)), default=0) <= 255),
        float(before.isalnum()), float(after.isalnum()), float(before in "\"'=:/#"  and before != ""),
        float(after in "\"'/%" and after != ""), float(before.isdigit() or before in ".-+" and before != ""),
        float(any(w in near for w in ("mail", "call", "phone", "tel", "card", "contact", "address"))),
        float(any(w in near for w in ("version", "license", "token", "password", "page", "no."))),
        float(after_country(text, start)),
    ]


def after_country(text: str, start: int) -> bool:
    """Whether a plus and a country code stand right before."""
    return bool(_CODE_BEFORE.search(text, max(0, start - 6), start))


def disguised(text: str, span: Span) -> tuple[str, Span] | None:
    """A strict span without what gives it away, in its context; None if it has no other form."""
    kind, start, end = span
    part = text[start:end]
    if kind == 0:
        local, _, domain = part.partition("@")
        other = f"{local} (at) {domain.replace('.', ' (dot) ') if start % 2 else domain}"
    elif kind == 3:
        other = _COUNTRY.sub("", part, count=1)
    else:
        return None
    before = text[max(0, start - CONTEXT) : start]
    made = before + other + text[end : end + CONTEXT]
    found = (kind, len(before), len(before) + len(other))
    return (made, found) if found in candidates(made) else None


def shape(text: str, span: Span) -> str:
    """The form of a span: its kind, and its characters with each digit as 9 and each letter as a."""
    part = _LETTER.sub("a", _DIGIT.sub("9", text[span[1] : span[2]]))
    return f"{KINDS[span[0]]} {'' if span[0] == 0 else part}"


def merged_spans(spans: list[Span]) -> list[tuple[int, int]]:
    """The places that spans of any kind cover, sorted and disjoint."""
    covered: list[tuple[int, int]] = []
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if covered and start < covered[-1][1]:
            covered[-1] = (covered[-1][0], max(end, covered[-1][1]))
        else:
            covered.append((start, end))
    return covered


def labelled_candidates(text: str) -> list[tuple[list[float], int, str]]:
    """(features, label, form) of strict spans, 1, of those in disguise, 2, of what touches none, 0, and of what follows a code, -1."""
    strict = strict_spans(text)
    own, covered, found = set(strict), merged_spans(strict), []
    for s in candidates(text):
        if s in own:
            found.append((features(text, s), 1, shape(text, s)))
            if hidden := disguised(text, s):
                found.append((features(*hidden), 2, shape(*hidden)))
        elif not touches(covered, s) and (s[0], 0, s[2] - s[1]) not in strict_spans(text[s[1] : s[2]]):
            found.append((features(text, s), 0, shape(text, s)))
        elif s[0] == 3 and after_country(text, s[1]):
            found.append((features(text, s), -1, shape(text, s)))
    return found


# ---- Model ----


def fit(x: np.ndarray, y: np.ndarray, half: np.ndarray, precision: float = PRECISION) -> dict:
    """Trees on one half, thresholds by kind on the other: the least at which that half has the precision."""
    model = {"trees": None, "limit": [2.0] * len(KINDS)}
    if y[half].sum() < LEAST_POSITIVES or y[half].all():
        return model
    model["trees"] = fit_trees(x[half], y[half].astype(float))
    p = predict(model["trees"], x[~half])
    for kind in range(len(KINDS)):
        here = x[~half][:, 0] == kind
        truth, rated = y[~half][here], p[here]
        if truth.sum() < LEAST_POSITIVES:
            continue
        order = np.argsort(-rated, kind="stable")
        right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
        # equal ratings stand or fall together
        last = np.append(rated[order][1:] != rated[order][:-1], True)
        good = np.flatnonzero((right >= precision) & last)
        if len(good):
            # half way to the next rating, at which the precision is lost; 0 if it never is
            below = rated[order][good[-1] + 1] if good[-1] + 1 < len(order) else 0.0
            model["limit"][kind] = max(0.5, float(rated[order][good[-1]] + below) / 2)
    return model


def train(documents: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> dict:
    """Model from the candidates of a sample of the rows.

    Each row is drawn by itself, copies of one text too, so the sample's size is that of independent draws.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(
        F.col("text").isNotNull()
    )
    share = min(1.0, sample_documents / max(1, documents.count()))
    mark = F.pmod(F.xxhash64(F.lit("pii"), "text", "doc_id", F.monotonically_increasing_id()), F.lit(1 << 20))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        halves: list[bool] = []
        for text, mark in zip(batch.column("text").to_pylist(), batch.column("mark").to_pylist(), strict=True):
            found = labelled_candidates(text)
            rows += found
            halves += [mark % 2 == 0] * len(found)
        kinds = {"x": pa.list_(pa.float64()), "y": pa.int32(), "shape": pa.string()}
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(halves, pa.bool_())], names=[*kinds, "half"])

    chosen = texts.withColumn("mark", mark).where(F.col("mark") < share * (1 << 20))
    table = map_batches(chosen, "x array<double>, y int, shape string, half boolean", run).toArrow()
    if not table.num_rows:
        return {"trees": None, "limit": [2.0] * len(KINDS)}
    x = np.array(table.column("x").combine_chunks().flatten()).reshape(table.num_rows, -1)
    y, half = (table.column(c).to_numpy() for c in ("y", "half"))
    shapes = np.array(table.column("shape").to_pylist(), object)
    unjudged = np.isin(shapes.astype(str), np.unique(shapes[y == 2].astype(str)))
    labelled = (y != 0) | ~unjudged
    x, y, half = x[labelled], y[labelled] > 0, half[labelled]
    order = np.lexsort((*x.T, y, half))  # the same rows in the same order, however they were dealt
    return fit(x[order], y[order], half[order])


def added_spans(text: str, strict: list[Span], model: dict) -> list[Span]:
    """Candidates above their kind's threshold, the best first, none touching another span; by kind and start."""
    if model["trees"] is None:
        return []
    taken = merged_spans(strict)  # strict spans of different kinds may overlap
    own = set(strict)
    free = [c for c in candidates(text) if c not in own and not touches(taken, c)]
    if not free:
        return []
    rated = predict(model["trees"], np.array([features(text, c) for c in free]))
    chosen: list[Span] = []
    for k in sorted(range(len(free)), key=lambda k: (-rated[k], free[k][1] - free[k][2], free[k])):
        if rated[k] >= model["limit"][free[k][0]] and not touches(taken, free[k]):
            chosen.append(free[k])
            insort(taken, free[k][1:])
    return sorted(chosen)


def touches(spans: list[tuple[int, int]], span: Span) -> bool:
    """Whether one of the sorted, disjoint spans overlaps."""
    at = bisect_left(spans, (span[2], -1))
    return at > 0 and spans[at - 1][1] > span[1]


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_spans(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id, strict and added spans of each row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        strict, added = [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            base = strict_spans(text)
            more = added_spans(text, base, shared.value)
            for out, spans in ((strict, base), (added, more)):
                out.append([{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(strict, pa.list_(span)), pa.array(added, pa.list_(span))],
            names=["doc_id", "strict", "added"],
        )

    kind = "array<struct<kind: string, start: long, end: long>>"
    return map_batches(rows, f"doc_id long, strict {kind}, added {kind}", run)


def number_of(kind: str):
    return F.size(F.filter("strict", lambda s: s["kind"] == kind)).cast("long")


def span_digest(found: DataFrame) -> DataFrame:
    """Counts and texts of the spans."""
    kinds = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(
        F.concat("strict", "added"),
        lambda a, b: F.when(
            F.array_position(kinds, a["kind"]) != F.array_position(kinds, b["kind"]),
            F.array_position(kinds, a["kind"]) - F.array_position(kinds, b["kind"]),
        ).otherwise(a["start"] - b["start"]).cast("int"),
    )
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[number_of(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(text(F.col("strict")), 256).alias("base_sha256"),
        text(ordered).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def redact(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in brackets; overlapping ones become one."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redacted(documents: DataFrame, model: dict) -> DataFrame:
    """`documents` with texts redacted, and n_chars, where there is such a column, counted anew; no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(documents.columns))]
    lower = [c.lower() for c in documents.columns]
    at, count = lower.index("text"), lower.index("n_chars") if "n_chars" in lower else -1
    plain = documents.toDF(*names)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns, texts = list(batch.columns), []
        for text in batch.column(at).to_pylist():
            if text is not None:
                base = strict_spans(text)
                text = redact(text, base + added_spans(text, base, shared.value))
            texts.append(text)
        columns[at] = pa.array(texts, pa.string())
        if count >= 0:
            columns[count] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.column(count).type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return map_batches(plain, schema, run).toDF(*documents.columns)
