"""Token ids of whole texts with a public byte-level vocabulary, from each slice's distinct words."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex

from lexiloom.llm import common as C

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are encoded in slices of about so many bytes.
SLICE = 8 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


#: 0 white space, 1 letters (with the bytes of letters from U+00C0 to U+00FF), 2 digits, 3 other signs.
KIND = np.array([0 if b in (10, 32) else 1 if b >= 128 or chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)
#: Texts with such places are encoded whole: white space other than single spaces and line ends between other
#: signs, apostrophes, and signs outside ASCII and the letters above.
_WHOLE = r"^[ \n]|[ \n]$|[ \n][ \n]|'|[\x00-\x09\x0b-\x1f\x7f]|[^\x00-\x7f\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]"


def plain_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends of the pre-tokens of plain texts, bounds of each text's pre-tokens)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = KIND[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[offsets] = True
    cut = np.flatnonzero(edge)
    starts, ends = cut[:-1], cut[1:]
    space = data[starts] == 32
    # A space belongs to the run after it; none ends a text.
    starts = np.where(np.r_[False, space[:-1]], starts - 1, starts)[~space]
    return starts, ends[~space], np.searchsorted(starts, offsets, "left")


def row_slices(texts: pa.Array, most: int):
    """(first row, rows) of about ``most`` bytes each."""
    texts = C.strings(texts)
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + most, "right")))
        yield at, texts.slice(at, to - at)
        at = to


class Encoder:
    """Encodes columns of texts. In plain texts the pattern's pre-tokens are runs of one kind, with the space before
    them if there is one, and single line ends; a slice's distinct ones are found by hashes and encoded once, in
    one call for those with a space (each one's first id, and no other, starts with a space) and one for those
    without (joined by line ends). All other texts are encoded whole. Null counts as empty."""

    def __init__(self, path: str) -> None:
        self.own = encoder(path)
        ranks = self.own._mergeable_ranks
        self.spaced = np.zeros(max(ranks.values()) + 1, bool)
        self.spaced[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        self.line = ranks[b"\n"]
        self.pattern = regex.compile(PATTERN)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text's ids)."""
        texts = pc.fill_null(C.strings(texts), "")
        n = len(texts)
        if not n:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        slow = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False)
        easy = C.strings(pc.if_else(pa.array(slow), "", texts)) if slow.any() else texts
        offsets = np.frombuffer(easy.buffers()[1], np.int64, n + 1, easy.offset * 8)
        data = np.frombuffer(easy.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        starts, ends, bounds = plain_spans(data, offsets)
        code, names = pd.factorize(C.span_hashes(data, starts, ends))
        at = np.empty(len(names), np.int64)
        at[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        raw = data.tobytes()
        s, e = starts[at], ends[at]
        led = data[s] == 32
        line = data[s] == 10
        bare = ~led & ~line
        texts_of = lambda m, by: by.join([raw[x:y] for x, y in zip(s[m].tolist(), e[m].tolist())]).decode()
        size = np.ones(len(at), np.int64)
        begin = np.zeros(len(at), np.int64)
        ids = np.array(self.own.encode_ordinary(texts_of(led, b"")), np.int32)
        first = np.r_[np.flatnonzero(self.spaced[ids]), len(ids)]
        own = np.array(self.own.encode_ordinary(texts_of(bare, b"\n")), np.int32)
        stop = np.r_[-1, np.flatnonzero(own == self.line), len(own)]
        assert len(first) == led.sum() + 1 and (len(stop) == bare.sum() + 1 or not bare.any())
        size[led], begin[led] = np.diff(first), first[:-1]
        if bare.any():
            size[bare], begin[bare] = np.diff(stop) - 1, stop[:-1] + 1 + len(ids)
        begin[line] = len(ids) + len(own)
        flat = np.r_[ids, own, np.int32(self.line)].astype(np.int32)
        lengths = size[code]
        last = np.cumsum(lengths)
        total = int(last[-1]) if len(last) else 0
        where = np.repeat((begin[code] - last + lengths).astype(np.int32), lengths)
        where += np.arange(total, dtype=np.int32)
        out = flat[where]
        bounds = np.r_[0, last][bounds]
        if slow.any():
            pieces, done = [], 0
            count = np.diff(bounds)
            for i in np.flatnonzero(slow).tolist():
                whole = np.array(self.own.encode_ordinary(texts[i].as_py()), np.int32)
                pieces += [out[done : bounds[i]], whole]
                done = bounds[i + 1]
                count[i] = len(whole)
            out = np.concatenate([*pieces, out[done:]])
            bounds = np.r_[0, np.cumsum(count)]
        return out, bounds

    def pretokens(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """(hash and bytes of each distinct pre-token, which one every pre-token is, bounds of each text's)."""
        texts = pc.fill_null(C.strings(texts), "")
        n = len(texts)
        slow = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False)
        easy = C.strings(pc.if_else(pa.array(slow), "", texts)) if slow.any() else texts
        offsets = np.frombuffer(easy.buffers()[1], np.int64, n + 1, easy.offset * 8)
        data = np.frombuffer(easy.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        starts, ends, bounds = plain_spans(data, offsets - offsets[0])
        h = C.span_hashes(data, starts, ends)
        if slow.any():
            # Texts that aren't plain are cut by the pattern itself; their pre-tokens are put in at their places.
            cut = [self.pattern.findall(texts[i].as_py()) for i in np.flatnonzero(slow).tolist()]
            raw = [w.encode() for ws in cut for w in ws]
            size = np.array([len(w) for w in raw], np.int64)
            last = np.cumsum(size) + len(data)
            own = np.frombuffer(b"".join(raw), np.uint8)
            count = np.diff(bounds)
            count[slow] = [len(ws) for ws in cut]
            after = np.r_[0, np.cumsum(count)]
            which = np.repeat(slow, count)
            s, e, g = (np.empty(len(which), x) for x in (np.int64, np.int64, np.uint64))
            s[~which], e[~which], g[~which] = starts, ends, h
            s[which], e[which], g[which] = last - size, last, C.span_hashes(own, last - size - len(data), last - len(data))
            starts, ends, h, bounds, data = s, e, g, after, np.r_[data, own]
        code, names = pd.factorize(h)
        at = np.empty(len(names), np.int64)
        at[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        raw = data.tobytes()
        return names, [raw[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist())], code, bounds

    def slices(self, texts: pa.Array):
        """(first row, ids, bounds) for slices of the texts, so that memory doesn't depend on the batch."""
        for at, part in row_slices(texts, SLICE):
            yield at, *self.encode(part)
