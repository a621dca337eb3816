"""Chat formatting with offset-aligned loss masks.

Turns of a conversation, ordered by (turn, role, text), are rendered as one text: ``<|role|>`` and a line end, the
turn's text, ``<|end|>`` and a line end. The whole text is encoded once; as a byte-level vocabulary's tokens are the text's bytes cut into
pieces, the running sum of their lengths gives every token's offsets, and must end at the text's. Trained spans
are the assistant turns' texts and their end marks; they ascend, as tokens do, so binary searches give every span's
first and last token. A token is trained if it lies within one span entirely; one that reaches over a border isn't.

Defined results: rows with a null conversation id are left out. Null text is empty; a null role is ``user``. Ties in
``turn`` are ordered by role and text, null turns come first, and repeated rows are repeated turns. Marks within a
text are ordinary text, and nothing in it can change the spans. Very long texts are encoded whole. Extra columns are ignored. An empty
table gives no rows. A conversation's turns meet in one row, as its text is one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import common as C
from lexiloom.llm import tokens as T

TRAINED = ("assistant",)
ROWS = "conv_id long, n_turns int, n_tokens int, n_trained int, tokens array<int>, mask array<byte>"


@lru_cache(maxsize=2)
def token_bytes(path: str) -> np.ndarray:
    """The length of every token."""
    ranks = T.read_ranks(path)
    out = np.zeros(max(ranks.values()) + 1, np.int64)
    out[list(ranks.values())] = [len(t) for t in ranks]
    return out


def render(turns: list[tuple[str | None, str | None]], trained: tuple[str, ...] = TRAINED) -> tuple[bytes, list[tuple[int, int]]]:
    """(the conversation's text, byte spans to train on) of turns (role, text)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        role, body = role if role is not None else "user", (text or "").encode() + b"<|end|>"
        head = f"<|{role}|>\n".encode()
        if role in trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, b"\n"]
        at += len(head) + len(body) + 1
    return b"".join(parts), spans


def align(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for the tokens that lie within a span, by binary search of both borders among the tokens' ascending offsets."""
    mask = np.zeros(len(offsets), np.int8)
    if len(spans) and len(offsets):
        s = np.array(spans)
        first = np.searchsorted(offsets[:, 0], s[:, 0], "left")
        last = np.searchsorted(offsets[:, 1], s[:, 1], "right")
        step = np.zeros(len(offsets) + 1, np.int64)
        m = first < last
        np.add.at(step, first[m], 1)
        np.add.at(step, last[m], -1)
        mask[:] = np.cumsum(step[:-1]) > 0
    return mask


def _formatted(batches: Iterator[pa.RecordBatch], path: str, trained: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    encoder, size = T.Encoder(path), token_bytes(path)
    for b in batches:
        turns = b.column("turns")
        for lo in range(0, b.num_rows, 256):
            own = [[(x["role"], x["text"]) for x in c] for c in turns.slice(lo, 256).to_pylist()]
            made = [render(x, trained) for x in own]
            texts = pa.array([m[0] for m in made], pa.large_binary()).cast(pa.large_string())
            for at, ids, bounds in encoder.slices(texts):
                n = len(bounds) - 1
                ends = np.r_[np.int64(0), np.cumsum(size[ids])]
                begin = np.r_[np.int64(0), np.cumsum([len(m[0]) for m in made[at : at + n]])]
                if not np.array_equal(ends[bounds], begin):
                    raise ValueError("the vocabulary's tokens aren't the text's bytes")
                spans = [(s + int(t), e + int(t)) for m, t in zip(made[at : at + n], begin) for s, e in m[1]]
                mask = align(np.c_[ends[:-1], ends[1:]], spans)
                total = np.r_[np.int64(0), np.cumsum(mask)][bounds]
                lists = lambda x: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [b.column("conv_id").slice(lo + at, n), pa.array([len(x) for x in own[at : at + n]], pa.int32()), pa.array(np.diff(bounds).astype(np.int32)), pa.array(np.diff(total).astype(np.int32)), lists(ids), lists(mask)],
                    names=["conv_id", "n_turns", "n_tokens", "n_trained", "tokens", "mask"],
                )


def format_chats(turns: DataFrame, vocabulary: str | None = None, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """One row a conversation: token ids of its rendered text and the mask of those to train on."""
    path = vocabulary or C.tokenizer_path(T.VOCABULARY)
    whole = turns.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), "role", "text"))).alias("turns"))
    return whole.mapInArrow(lambda it: _formatted(it, path, trained), ROWS)
