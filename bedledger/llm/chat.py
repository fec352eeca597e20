r"""Chat formatting with a loss mask aligned by token offsets.

A conversation is rendered as a whole:

    ### user:
    text of the turn</turn>
    ### assistant:
    text of the turn</turn>

Inside a text each of the characters `\`, `#` and `<` is followed by a backslash (in a role `:`
as well), so neither `###` nor `</turn>` can occur there, and reading pairs from the left restores
it. The rendered string is encoded once with offsets; the sorted spans of the trained turns are
intersected with the sorted token spans by binary search.

Defined results: null role or text counts as empty; rows of equal turn are ordered by role, then
text; repeated rows stay repeated turns; a null turn comes first; rows without conversation id form
one conversation with a null id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedledger.llm.common import map_batches
from bedledger.llm.packing import encoder

HEAD, MIDDLE, TAIL = "### ", ":\n", "</turn>\n"
_TEXT = re.compile(r"([\\#<])")
_ROLE = re.compile(r"([\\#<:])")
_PAIR = re.compile(r"([\\#<:])\\")
_TEXT_PAIR = re.compile(r"([\\#<])\\")

SCHEMA = (
    "conv_id long, formatted string, role array<string>, span_start array<long>, span_end array<long>,"
    "token_ids array<int>, token_start array<long>, token_end array<long>, loss_mask array<boolean>"
)


@lru_cache(maxsize=2)
def token_sizes(path: str) -> np.ndarray:
    """Bytes of each token."""
    encoding = encoder(path)
    sizes = np.zeros(encoding.n_vocab, np.int64)
    for token in encoding.token_byte_values():
        sizes[encoding.encode_single_token(token)] = len(token)
    return sizes


def encode_with_offsets(path: str, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and of each token the first code point and the one behind the last that it holds bytes of."""
    ids = np.array(encoder(path).encode_ordinary(text), np.int64)
    if not len(ids):
        return ids, ids, ids
    ends = np.cumsum(token_sizes(path)[ids])
    starts = np.concatenate(([0], ends[:-1]))
    raw = np.frombuffer(text.encode(), np.uint8)
    point = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
    return ids, point[starts], point[ends - 1] + 1


def escape(text: str) -> str:
    return _TEXT.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _TEXT_PAIR.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[int], list[int]]:
    """The conversation and, for each turn, the span of its escaped text."""
    parts, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = HEAD + _ROLE.sub(r"\1\\", role) + MIDDLE, escape(text)
        starts.append(at + len(head))
        ends.append(starts[-1] + len(body))
        at = ends[-1] + len(TAIL)
        parts += [head, body, TAIL]
    return "".join(parts), starts, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation, texts unescaped."""
    turns, at = [], 0
    while at < len(formatted):
        middle = formatted.index(MIDDLE, at)
        tail = formatted.index(TAIL, middle + len(MIDDLE))
        role = _PAIR.sub(r"\1", formatted[at + len(HEAD) : middle])
        turns.append((role, unescape(formatted[middle + len(MIDDLE) : tail])))
        at = tail + len(TAIL)
    return turns


def token_mask(starts, ends, token_start, token_end) -> np.ndarray:
    """Which tokens share a character with one of the sorted, disjoint spans."""
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    filled = ends > starts
    starts, ends = starts[filled], ends[filled]
    if not len(starts):
        return np.zeros(len(token_start), bool)
    at = np.searchsorted(ends, token_start, side="right")  # first span that ends after the token's start
    inside = at < len(starts)
    return inside & (starts[np.minimum(at, len(starts) - 1)] < token_end) & (np.asarray(token_end) > token_start)


def masked_text(formatted, starts, ends, token_start, token_end, mask) -> list[str]:
    """For each span, its characters under the mask."""
    starts, token_start, token_end = (np.asarray(x, np.int64) for x in (starts, token_start, token_end))
    token_start, token_end = token_start[mask], token_end[mask]
    texts = []
    for start, end in zip(starts.tolist(), ends, strict=True):
        first = int(np.searchsorted(token_end, start, side="right"))
        last = int(np.searchsorted(token_start, end, side="left"))
        done, parts = start, []
        for a, b in zip(token_start[first:last].tolist(), token_end[first:last].tolist(), strict=True):
            a, b = max(a, done), min(b, end)
            if b > a:
                parts.append(formatted[a:b])
                done = b
        texts.append("".join(parts))
    return texts


def format_conversations(
    conversations: DataFrame, tokenizer_path: str | None = None, trained_role: str = "assistant"
) -> DataFrame:
    """One row per conversation: rendered string, turn spans, tokens with offsets, and loss mask.

    Rows meet once, by conversation; a conversation is one row of the result and has to fit in memory.
    """
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    whole = (
        conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id"))
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .select("conv_id", F.col("turns.role").alias("role"), F.col("turns.text").alias("text"))
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
        made = [render(list(zip(r, t, strict=True))) for r, t in zip(roles, texts, strict=True)]
        parts: tuple[list, ...] = ([], [], [], [])
        for (formatted, starts, ends), role in zip(made, roles, strict=True):
            ids, first, last = encode_with_offsets(path, formatted)
            trained = [i for i, r in enumerate(role) if r == trained_role]
            mask = token_mask([starts[i] for i in trained], [ends[i] for i in trained], first, last)
            for column, value in zip(parts, (ids.astype(np.int32), first, last, mask), strict=True):
                column.append(value)
        at = np.cumsum([0, *map(len, parts[0])]).astype(np.int32)
        kinds = (np.int32, np.int64, np.int64, bool)
        flat = [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds, strict=True)]
        tokens = [pa.ListArray.from_arrays(pa.array(at), pa.array(f)) for f in flat]
        texts = pa.array([m[0] for m in made], pa.string())
        spans = [pa.array([m[k] for m in made], pa.list_(pa.int64())) for k in (1, 2)]
        names = [f.split()[0] for f in SCHEMA.split(",")]
        return pa.RecordBatch.from_arrays([batch.column("conv_id"), texts, batch.column("role"), *spans, *tokens], names=names)

    return map_batches(whole, SCHEMA, run)


def formatted_digest(formatted: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Turns and masked texts read back from the rendered conversations, as digests."""
    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        from hashlib import sha256

        rows, short = [], batch.select(["conv_id", "formatted", "role", "span_start", "span_end"]).to_pylist()
        for i, r in enumerate(short):
            formatted, turns = r["formatted"], parse(r["formatted"])
            trained = [k for k, role in enumerate(r["role"]) if role == trained_role]
            first, last, mask = (
                batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("token_start", "token_end", "loss_mask")
            )
            starts, ends = ([r[c][k] for k in trained] for c in ("span_start", "span_end"))
            loss = "".join(map(unescape, masked_text(formatted, starts, ends, first, last, mask.astype(bool))))
            told = sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode())
            rows.append((r["conv_id"], len(turns), told.hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(formatted)))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        columns = zip(*rows, strict=True) if rows else [()] * 6
        names = [f.split()[0] for f in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return map_batches(formatted, schema, run)
