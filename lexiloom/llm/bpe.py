"""Byte-pair encoding and decoding by a pair occurrence index.

A partition's texts are cut into pre-tokens; its distinct pre-tokens lie one after the other as byte tokens. An
index maps every mergeable pair to all its positions there. The active pairs' ranks are applied in ascending order:
one step merges all occurrences of a rank at once, then the pairs to the left and right of each merge leave
their old lists and enter new ones. Every text's ids are gathered from its pre-tokens' ids. Decoding gathers the
ids' bytes. Both are exact: ids equal those of encoding every pre-token alone, lowest rank and leftmost first.

Defined results: null gives null, empty text an empty list; repeated rows give their ids again; very long
texts are encoded whole. Encoding gives the id and the tokens alone; decoding keeps all columns, and names its text ``text_`` where
``text`` is taken. Decoding null gives null; an id that the vocabulary
lacks is an error. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import common as C
from lexiloom.llm import tokens as T

#: Bytes of text whose distinct pre-tokens are indexed together.
TOGETHER = 24 << 20


class Merges:
    """The vocabulary as arrays: which pairs of tokens merge to which, and every token's bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = sorted((ranks[t[:k]] * self.size + ranks[t[k:]], c) for t, c in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        self.keys = np.array([p[0] for p in pairs], np.int64)
        self.merged = np.array([p[1] for p in pairs], np.int64)
        # Tokens that are part of a pair of lower rank than their own: their merges go one at a time in a word.
        self.early = np.zeros(self.size, bool)
        a, b = np.divmod(self.keys, self.size)
        for x in (a, b):
            self.early[x[self.merged < x]] = True
        by_id = {c: t for t, c in ranks.items()}
        raw = [by_id.get(c, b"") for c in range(self.size)]
        self.length = np.array([len(t) for t in raw], np.int64)
        self.known = np.array([c in by_id for c in range(self.size)])
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merged token of every pair, -1 where there is none."""
        key = a * self.size + b
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, self.merged[k], -1)


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(T.read_ranks(path))


def encode_words(words: list[bytes], m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, bounds of each word's ids) by the pair occurrence index."""
    size = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(size)
    data = np.frombuffer(b"".join(words), np.uint8)
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
    word = np.repeat(np.arange(len(words)), size)
    token = m.byte[data]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    filled = size > 0
    after[ends[filled] - 1] = -1
    before[(ends - size)[filled]] = -1
    alive = np.ones(n, bool)
    now = np.full(n, -1, np.int64)
    inner = np.flatnonzero(after >= 0)
    now[inner] = m.pair(token[inner], token[inner + 1])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(at: np.ndarray) -> None:
        c = now[at]
        at, c = at[c >= 0], c[c >= 0]
        if not len(at):
            return
        order = np.argsort(c, kind="stable")
        at, c = at[order], c[order]
        cut = np.flatnonzero(c[1:] != c[:-1]) + 1
        for r, p in zip(c[np.r_[0, cut]].tolist(), np.split(at, cut) if len(cut) else [at]):
            if r in index:
                index[r].append(p)
            else:
                index[r] = [p]
                heapq.heappush(heap, r)

    enter(inner)
    while heap:
        c = heapq.heappop(heap)
        lists = index.pop(c)
        p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        p = p[now[p] == c]
        if len(p) > 1:
            if m.early[c]:
                first = np.r_[True, word[p[1:]] != word[p[:-1]]]
                if not first.all():
                    index[c] = [p[~first]]
                    heapq.heappush(heap, c)
                    p = p[first]
            else:
                touch = after[p[:-1]] == p[1:]
                if touch.any():  # overlapping occurrences: every second one of a chain, from the left
                    k = np.arange(len(p))
                    head = np.maximum.accumulate(np.where(np.r_[False, touch], 0, k))
                    p = p[(k - head) % 2 == 0]
        if not len(p):
            continue
        q = after[p]
        r = after[q]
        token[p] = c
        after[p] = r
        alive[q] = False
        now[q] = -1
        more = r >= 0
        before[r[more]] = p[more]
        left = before[p]
        changed = np.concatenate([p, left[left >= 0]])
        if len(changed) > 1:
            changed = np.unique(changed)
        nxt = after[changed]
        got = np.where(nxt >= 0, m.pair(token[changed], token[nxt]), -1)
        # A pair that occurs anew in its own list is found there when its rank comes up again.
        now[changed] = got
        enter(changed)
    keep = np.flatnonzero(alive)
    return token[keep], np.r_[0, np.cumsum(np.bincount(word[keep], minlength=len(words)))]


def decode_ids(ids: np.ndarray, bounds: np.ndarray, m: Merges) -> tuple[bytes, np.ndarray]:
    """(bytes of all texts, bounds of each text's bytes)."""
    if len(ids) and (ids.min() < 0 or ids.max() >= m.size or not m.known[ids].all()):
        raise ValueError("an id isn't in the vocabulary")
    size = m.length[ids]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    where = np.repeat(m.begin[ids] - ends + size, size) + np.arange(total)
    return m.bytes[where].tobytes(), np.r_[0, ends][bounds]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, check: bool) -> Iterator[pa.RecordBatch]:
    m, cutter = merges(path), T.Encoder(path)
    held: list[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]] = []
    hashes: list[np.ndarray] = []
    words: list[bytes] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal words
        # Slices know their own distinct pre-tokens; those of all slices are made distinct again.
        code, own = pd.factorize(np.concatenate(hashes))
        at = np.empty(len(own), np.int64)
        at[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        ids, bounds = encode_words([words[k] for k in at.tolist()], m)
        ids = ids.astype(np.int32)
        words = []
        done = 0
        for key, texts, local, cut in held:
            n = int(local.max()) + 1 if len(local) else 0
            mine = code[done : done + n][local]
            done += n
            lengths = np.diff(bounds)[mine]
            last = np.cumsum(lengths)
            total = int(last[-1]) if len(last) else 0
            where = np.repeat((bounds[:-1][mine] - last + lengths).astype(np.int32), lengths) + np.arange(total, dtype=np.int32)
            flat, ends = ids[where], np.r_[0, last][cut]
            null = np.array(texts.is_null())
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=np.r_[null, False]), pa.array(flat))
            columns, names = [key, lists], ["key", "tokens"]
            if check:
                raw, at_ = decode_ids(flat, ends, m)
                decoded = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(at_.astype(np.int64)), pa.py_buffer(raw)])
                columns.append(pc.equal(decoded, texts.cast(pa.large_binary())))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        held.clear()
        hashes.clear()

    for b in batches:
        for at, texts in T.row_slices(b.column("text"), 4 << 20):
            own, names, local, cut = cutter.pretokens(texts)
            held.append((b.column("key").slice(at, len(texts)), texts, local.astype(np.int32), cut))
            hashes.append(own)
            words += names
            size += texts.nbytes
            if size >= TOGETHER:
                yield from flush()
                size = 0
    if held:
        yield from flush()


def encode(docs: DataFrame, vocabulary: str | None = None, check: bool = False) -> DataFrame:
    """(doc_id, tokens), with ``check`` also ``decoded``: whether decoding gives the text's bytes again."""
    path = vocabulary or C.tokenizer_path(T.VOCABULARY)
    own = docs.select(F.col("doc_id").cast("long").alias("key"), "text").mapInArrow(lambda it: _encoded(it, path, check), "key long, tokens array<int>" + ", decoded boolean" * check)
    return own.withColumnRenamed("key", "doc_id")


def decode(rows: DataFrame, column: str = "tokens", vocabulary: str | None = None) -> DataFrame:
    """``rows`` with ``text``: the bytes of the ids in ``column`` as UTF-8, with U+FFFD for broken sequences."""
    path = vocabulary or C.tokenizer_path(T.VOCABULARY)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = merges(path)
        for b in batches:
            b = b.combine_chunks() if isinstance(b, pa.ChunkedArray) else b
            lengths = pc.fill_null(pc.list_value_length(b), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw, at = decode_ids(b.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(lengths)], m)
            null = np.array(b.is_null())
            yield pa.array([None if null[k] else raw[at[k] : at[k + 1]].decode("utf-8", "replace") for k in range(len(b))], pa.string())

    return rows.withColumn(C.free_name(rows, "text"), text(column))
