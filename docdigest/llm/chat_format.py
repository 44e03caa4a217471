"""Chat formatting with loss masks aligned to token offsets."""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docdigest.llm.common import lean

# The template's control strings. Each is one token, so no token crosses the edge of a turn's text.
START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Where the tokenizer file is by default.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters that are rendered and encoded at once; a longer conversation goes on in a next part, cut between turns.
PART = 1 << 20

_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    """``text`` with one more backslash in whatever looks like the start of a control string."""
    return _CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and the spans of the assistant's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{MIDDLE}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}{END}\n")
        at += len(parts[-1])
    return "".join(parts), spans


def load_tokenizer(text: str):
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_str(text)
    tokenizer.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, MIDDLE, END)])
    return tokenizer


def masked(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each token the number of the span that it lies in, or -1: the last span that starts before it, found by binary search."""
    if not spans or not len(offsets):
        return np.full(len(offsets), -1)
    start, end = np.array(spans).T
    at = np.searchsorted(start, offsets[:, 0], "right") - 1
    return np.where((at >= 0) & (offsets[:, 1] <= end[np.maximum(at, 0)]) & (offsets[:, 0] < end[np.maximum(at, 0)]), at, -1)


def _encode(tokenizer, turns):
    text, spans = render(turns)
    code = tokenizer.encode(text, add_special_tokens=False)
    return code.ids, masked(np.array(code.offsets, np.int64).reshape(-1, 2), spans), len(text)


def _sorted(rows: DataFrame) -> DataFrame:
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _parts(batches):
    """(conv_id, turns, whether the conversation is over) of rows sorted by conversation and turn."""
    key, turns, size, any_row = None, [], 0, False
    for batch in batches:
        for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if any_row and conv_id != key:
                yield key, turns, True
                turns, size = [], 0
            elif size > PART:
                yield key, turns, False
                turns, size = [], 0
            key, any_row = conv_id, True
            turns.append((role, text))
            size += len(role) + len(text)
    if any_row:
        yield key, turns, True


def format_conversations(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(conv_id, part, input_ids, loss_mask)`` of ``rows(conv_id, turn, role, text)``: token ids, and 1 where the assistant speaks.

    Rows of a conversation are ordered by turn (ties by role and text); null roles and texts are empty; rows of a null
    conversation are one. Conversations of more than ``PART`` characters go on in further parts.
    """
    model = Path(tokenizer).read_text()

    kinds = {"conv_id": pa.int64(), "part": pa.int32(), "input_ids": pa.list_(pa.int32()), "loss_mask": pa.list_(pa.int32())}

    @lean
    def encode(batches):
        tok, part = load_tokenizer(model), 0
        for key, turns, over in _parts(batches):
            ids, mask, _ = _encode(tok, turns)
            row = (key, part, ids, (mask >= 0).astype(int).tolist())
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds.values(), strict=True)], list(kinds))
            part = 0 if over else part + 1

    return _sorted(rows).mapInArrow(encode, "conv_id long, part int, input_ids array<int>, loss_mask array<int>")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def describe_conversations(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``, read back from the token ids and masks that ``format_conversations`` makes.

    A part of a conversation is formatted, decoded and digested at a time, so a long one needs no more memory than a part.
    """
    model = Path(tokenizer).read_text()

    @lean
    def describe(batches):
        tok = load_tokenizer(model)
        out, fresh = [], True
        for key, turns, over in _parts(batches):
            if fresh:
                n, chars, lost, said, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            ids, mask, _ = _encode(tok, turns)
            formatted = tok.decode(ids, skip_special_tokens=False)
            for role, text in read_back(formatted):
                n += 1
                said.update(f"{role}\n{text}\n".encode())
            inside = np.flatnonzero(mask >= 0)
            edges = np.flatnonzero(np.diff(mask[inside], prepend=-1)) if len(inside) else []
            for group in np.split(inside, edges[1:]) if len(inside) else []:
                text = unescape(tok.decode([ids[i] for i in group], skip_special_tokens=False))
                lost += len(text)
                loss.update(text.encode())
            chars += len(formatted)
            if over:
                out.append((key, n, said.hexdigest(), lost, loss.hexdigest(), chars))
            fresh = over
            if len(out) >= 1000:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)

    return _sorted(rows).mapInArrow(describe, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], list(kinds))
