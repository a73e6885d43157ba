"""Chat formatting with loss masks that are aligned by offsets.

A conversation is rendered as a whole: control strings mark the start of a turn, the end of its role and the end of its
text. They are added to the tokenizer as tokens of their own, so that no token crosses the edge of a text, and a
conversation can be encoded in runs of whole turns with the tokens that it has as one string. Each run is encoded once
with offsets; the sorted spans of assistant texts are intersected with the token spans by binary search.

Inside texts and roles "<" and any backslashes before "|" get one backslash more, which no control string has and which
is undone exactly.

Rows are shuffled by conversation and sorted by turn; tasks stream over them and hold one run of turns at a time. So a
conversation of any length takes bounded memory, and gives several rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"

#: Characters after which a run of turns ends.
RUN = 1_000_000

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END) + "\n", re.S)

_loaded: dict[str, object] = {}


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def tokenizer(path: str):
    """The tokenizer of a file, with the control strings as tokens of their own; strings of its special tokens are text."""
    if path not in _loaded:
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(path)
        t.add_tokens([AddedToken(s, normalized=False, special=False) for s in (START, SEP, END)])
        t.encode_special_tokens = True
        _loaded[path] = t
    return _loaded[path]


def loss_tokens(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens (sorted spans) share a character with one of the sorted, disjoint spans."""
    if not len(spans) or not len(starts):
        return np.zeros(len(starts), bool)
    at = np.searchsorted(spans[:, 1], starts, side="right")  # the first span that ends after the token's start
    inside = at < len(spans)
    return inside & (spans[np.minimum(at, len(spans) - 1), 0] < ends) & (ends > starts)


_SCHEMA = "{0}, run int, turns int, formatted string, spans array<struct<role:string,start:int,end:int>>, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"


def format_conversations(df: DataFrame, path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", run: int = RUN) -> DataFrame:
    """One row per conversation and run of its turns: conv_id, run (from 0), turns, formatted text, spans of the texts in
    it, token ids, their spans and the loss mask, which has the texts of role assistant.

    Null roles and texts are empty. Turns that are null come first; ties are ordered by role, then text; a repeated row is
    a turn of its own. A null conversation is one of its own. Empty table: no rows. Other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = _SCHEMA.format(f"conv_id {df.schema[conv_col].dataType.simpleString()}")
    target = to_arrow_schema(StructType.fromDDL(schema))

    def encoded(conv, number: int, turns: list[tuple[str, str]]) -> pa.RecordBatch:
        pieces, spans, at = [], [], 0
        for role, text in turns:
            head = START + escape(role) + SEP
            body = escape(text)
            spans.append((role, at + len(head), at + len(head) + len(body)))
            pieces += [head, body, END, "\n"]
            at += len(head) + len(body) + len(END) + 1
        whole = "".join(pieces)
        e = tokenizer(path).encode(whole, add_special_tokens=False)
        offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
        wanted = np.array([(a, b) for r, a, b in spans if r == "assistant" and b > a], np.int32).reshape(-1, 2)
        mask = loss_tokens(offsets[:, 0], offsets[:, 1], wanted)
        named = [{"role": r, "start": a, "end": b} for r, a, b in spans]
        values = [conv], [number], [len(turns)], [whole], [named], [e.ids], [offsets[:, 0]], [offsets[:, 1]], [mask]
        return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(values, target)], schema=target)

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, number, turns, size = None, 0, [], 0
        for batch in batches:
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if turns and (c != conv or size >= run):
                    yield encoded(conv, number, turns)
                    number, turns, size = (number + 1 if c == conv else 0), [], 0
                elif c != conv:
                    number = 0
                conv = c
                turns.append((role or "", text or ""))
                size += len(role or "") + len(text or "")
        if turns:
            yield encoded(conv, number, turns)

    rows = df.select(F.col(f"`{conv_col}`").alias("c"), F.col(f"`{turn_col}`").alias("t"), F.col(f"`{role_col}`").cast("string").alias("r"), F.col(f"`{text_col}`").cast("string").alias("x"))
    return rows.repartition("c").sortWithinPartitions("c", "t", "r", "x").select("c", "r", "x").mapInArrow(run_all, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the formatted text and the mask alone.

    It follows format_conversations() in the same tasks, where the runs of a conversation are in order.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # conv, turns, their hash, characters and hash under the mask, characters in all

        def result() -> pa.RecordBatch:
            conv, n, turns, chars, loss, size = kept
            return pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], conv_type), "n_turns": [n], "turns_sha256": [turns.hexdigest()], "loss_chars": [chars], "loss_sha256": [loss.hexdigest()], "formatted_chars": [size]})

        conv_type = None
        for batch in batches:
            conv_type = batch.schema.field(0).type
            for c, number, text, starts, ends, mask in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 6, 7, 8))):
                if number == 0:
                    if kept:
                        yield result()
                    kept = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                kept[5] += len(text)
                for role, body in _TURN.findall(text):
                    kept[1] += 1
                    kept[2].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                m = np.array(mask, bool)
                a, b = np.array(starts, np.int64)[m], np.array(ends, np.int64)[m]
                if len(a):  # characters under the mask, in stretches of tokens that touch
                    cuts = np.flatnonzero(a[1:] > b[:-1])
                    for lo, hi in zip(a[np.concatenate([[0], cuts + 1])].tolist(), b[np.concatenate([cuts, [len(b) - 1]])].tolist()):
                        part = unescape(text[lo:hi])
                        kept[3] += len(part)
                        kept[4].update(part.encode())
        if kept:
            yield result()

    return formatted.mapInArrow(run_all, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
