"""N-gram Jaccard join with token-combination prefixes.

Tokens are the hashed word ``N``-grams of a text (lower case, cut at white space), taken as a set. Two texts join
if the Jaccard similarity of their sets is at least ``THRESHOLD``. ``classes`` gives one row a document: its class (all that
a chain of joins connects, named by the least id) and its number of links, that is of other rows that join it.

1. Equal sets, by 128-bit digest, are one node; copies are counted, and the rest works on one text a node.
2. Balls: nodes that agree on ``VOTES`` of ``BINS`` min-hashes name the least of them as centre. Only where the exact
   similarity with it is ``(1 + THRESHOLD) / 2`` or more does a node belong to its ball. Jaccard distance is a metric, so all nodes of
   a ball join each other: a group of thousands of near copies is linked by counting, without its pairs being made. What min-hashes
   miss is only left out of balls, and handled below like any other text.
3. Token classes: tokens that ``FREQUENT`` texts hold are class 2, all others class 1. The counts order the index and pick its
   keys; any counts give the same result.
4. Prefixes: tokens are ordered by (class, count, hash). A class 1 token weighs 1, a class 2 token too, but for the first of
   each of its text's partitions (tokens are spread by hash over as many partitions as the size class has). A prefix ends where the
   weights reach e + 1 + x, with e = n - ceil(THRESHOLD n) differing tokens allowed and x = n // ``EXTEND`` more.
   Two texts of n and m tokens that join overlap in o = ceil(THRESHOLD / (1 + THRESHOLD) (n + m)); so the part of each prefix
   that weighs n - o + 1 + x (x of the smaller text) keeps 1 + x of its weight when all tokens that aren't shared are taken out:
   they share as many keys at least, class 1 tokens or pairs of class 2 tokens of one partition.
5. Index keys: single class 1 tokens, and two-token combinations of class 2 tokens within a partition, under the size
   class of the text and the next one. Texts of two balls that meet are counted per pair, by the tokens within those parts, and pairs that share less drop.
6. Verification: what is left is connected; components, or blocks of large ones, meet, and each pair is compared exactly on
   whole sets. Nothing is estimated, and no list is cut.

Defined results: null, empty and blank texts have no token and join nothing (class of their own, no links); texts of fewer than N
words are one token. Rows with a null id are left out of the join and kept by ``one_of_each``. Every row with an id is a
document: repeated rows are copies of each other and count as links. An id with several texts has a row for each, which share
a class. Equality with the threshold joins. Very long texts are taken whole. Extra columns are ignored by the
join and kept by ``one_of_each``. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import common as C

N = 2
THRESHOLD = 0.55
#: Holders (a power of two) from which a token is class 2; holders from which its count takes part in the order, and the most
#: tokens whose counts are shipped (the commonest ones).
FREQUENT, ORDERED, MOST_ORDERED = 32, 4, 1 << 20
#: Min-hashes of a set, and how many must name the same centre.
BINS, VOTES = 4, 2
#: A text of n tokens has n // EXTEND more weight in its prefix than one shared token needs.
EXTEND = 32
#: Tokens of texts that are compared together; members of a ball that meet a copy of their centre.
BLOCK, STAR = 3_000_000, 512
#: Bits of a token that are counted.
COUNTED_BITS = 40
#: Tokens a task counts at a time, index entries a task packs at a time, and entries a range should have.
COUNTED, PACKED, RANGE = 2_000_000, 800_000, 1_000_000
#: Pairs that a task makes at a time.
CHUNK = 200_000
_K = np.uint64(C._MULT)


def token_sets(column: pa.Array, n: int = N) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct tokens of each text one after the other, bounds) for slices of the texts."""
    for at, rows, data, offsets in C.text_slices(pc.utf8_lower(C.strings(column))):
        starts, ends = C.token_spans(data, offsets, by_kind=False)
        h = C.span_hashes(data, starts, ends)
        bounds = C.per_text(starts, offsets)
        size = np.diff(bounds)
        grams = np.where(size > 0, np.maximum(1, size - n + 1), 0)
        ends_ = np.cumsum(grams)
        text = np.repeat(np.arange(rows), grams)
        p = np.arange(ends_[-1] if rows else 0) - np.repeat(ends_ - grams, grams) + bounds[text]
        g = np.zeros(len(p), np.uint64)
        last = bounds[1:][text]
        padded = np.r_[h, np.zeros(n, np.uint64)]
        for k in range(n):
            g = g * _K + np.where(p + k < last, padded[p + k], np.uint64(k + 1))
        g = C.mix(g)
        order = np.lexsort((g, text))
        g, text = g[order], text[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
        g, text = g[new], text[new]
        yield at, g, np.searchsorted(text, np.arange(rows + 1), "left")


def digests(g: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set's mixed tokens; equal for equal sets."""
    out = []
    for salt in (0xA3, 0x5C):
        total = np.zeros(len(g) + 1, np.uint64)
        np.cumsum(C.mix(g ^ np.uint64(salt * 0x0101010101010101)), out=total[1:])
        out.append(C.mix(total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def least_hashes(g: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least token of each of BINS sections of the hash values, whether there is one) of each set."""
    rows, shift = len(bounds) - 1, np.uint64(64 - (BINS - 1).bit_length())
    key = np.repeat(np.arange(rows), np.diff(bounds)) * BINS + (g >> shift).astype(np.int64)
    new = np.ones(len(g), bool)
    new[1:] = key[1:] != key[:-1]
    least, some = np.zeros(rows * BINS, np.int64), np.zeros(rows * BINS, bool)
    least[key[new]], some[key[new]] = g[new].view(np.int64), True
    return least.reshape(rows, BINS), some.reshape(rows, BINS)


_LEAST = [f"b{k}" for k in range(BINS)]
_ROWS = "doc_id long, h1 long, h2 long, n int, " + ", ".join(f"{c} long" for c in _LEAST)


def _row_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, g, bounds in token_sets(b.column("text"), n):
            rows = len(bounds) - 1
            h1, h2 = digests(g, bounds)
            least, some = least_hashes(g, bounds)
            bins = [pa.array(least[:, k], mask=~some[:, k]) for k in range(BINS)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, rows), pa.array(h1), pa.array(h2), pa.array(np.diff(bounds).astype(np.int32)), *bins], names=["doc_id", "h1", "h2", "n", *_LEAST])


_WIDE = (1 << 24) - 1


def packed_tokens(t: np.ndarray) -> bytes:
    """Ascending numbers: the first, then 3-byte steps. A step of _WIDE only leads on to the next."""
    step = np.diff(t.astype(np.int64))
    wide = step // _WIDE
    step = np.insert(step - wide * _WIDE, np.repeat(np.arange(len(step)), wide), _WIDE)
    return np.int64(t[0]).tobytes() + step.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unpacked_tokens(raw: bytes) -> np.ndarray:
    b = np.zeros((len(raw) // 3 - 2, 4), np.uint8)
    b[:, :3] = np.frombuffer(raw, np.uint8, offset=8).reshape(-1, 3)
    step = b.view("<u4").ravel().astype(np.int64)
    return np.r_[np.int64(0), np.cumsum(step)][np.r_[True, step != _WIDE]] + np.frombuffer(raw, np.int64, 1)[0]


def _held(batches: Iterator[pa.RecordBatch], ranges: int, n: int) -> Iterator[pa.RecordBatch]:
    """Every range's tokens (their first COUNTED_BITS bits) of some millions at a time."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        t = np.sort(np.concatenate(held))
        r = (t * np.int64(ranges)) >> np.int64(COUNTED_BITS)
        edge = np.searchsorted(r, np.arange(ranges + 1))
        own = np.flatnonzero(np.diff(edge))
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([packed_tokens(t[edge[x] : edge[x + 1]]) for x in own], pa.binary())], names=["part", "tokens"])

    for b in batches:
        for _, g, _ in token_sets(b.column("text"), n):
            held.append((g >> np.uint64(64 - COUNTED_BITS)).astype(np.int64))
            size += len(g)
            if size >= COUNTED:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def _often(t: pa.Table, frequent: int) -> pa.Table:
    every = np.sort(np.concatenate([unpacked_tokens(x) for x in t.column("tokens").to_pylist()]))
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    k = np.diff(np.r_[first, len(every)])
    m = k >= frequent
    return pa.table({"token": pa.array(every[first[m]]), "n": pa.array(k[m].astype(np.int64))})


def token_class(count: np.ndarray | int) -> np.ndarray:
    """1 + log2 of a count, rounded down; 0 stands for tokens whose counts aren't shipped."""
    return np.log2(np.maximum(1, count)).astype(np.uint8) + np.uint8(1)


def counted_tokens(docs: DataFrame, total: int, n: int = N, least: int = ORDERED) -> tuple[np.ndarray, np.ndarray]:
    """(tokens that ``least`` texts hold in ascending order, their token_class); a token stands for all with its first
    COUNTED_BITS bits.

    All of the ``total`` tokens are counted. Where more than MOST_ORDERED reach ``least``, only the commonest ones' counts
    are shipped, so that those stay bounded; which are known changes the cost alone.
    """
    ranges = max(6, -(-total // COUNTED))
    held = docs.select("text").mapInArrow(lambda it: C.trimmed(_held(it, ranges, n)), "part int, tokens binary")
    counted = held.groupBy("part").applyInArrow(lambda t: C.trimmed(_often(t, least)), "token long, n long")
    top = counted.orderBy(F.desc("n"), "token").limit(MOST_ORDERED).toArrow()
    t, k = (top.column(c).to_numpy() for c in ("token", "n"))
    order = np.argsort(t)
    return t[order], token_class(k[order])


def _allowed(n: np.ndarray, threshold: float) -> np.ndarray:
    """Tokens of a set of n that a joining one may lack at most."""
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64)


def least_shared(low: np.ndarray) -> np.ndarray:
    """The keys, class 1 tokens and combinations, that two joining sets, the smaller of this size, share within their prefixes."""
    return 1 + low // EXTEND


def within(place: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a key with this weight before it, in a set of n, is in the prefix that a set of m needs to meet it."""
    overlap = np.ceil(threshold / (1 + threshold) * (n + m) - 1e-9).astype(np.int64)
    return place < n - overlap + least_shared(np.minimum(n, m))


def _first_in_run(*keys: np.ndarray) -> np.ndarray:
    """Which elements are the first of theirs, by keys in any order; earlier places come first."""
    order = np.lexsort((np.arange(len(keys[0])), *keys))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    out = np.empty(len(order), bool)
    out[order] = new
    return out


def index_entries(g: np.ndarray, bounds: np.ndarray, tokens: np.ndarray, classes: np.ndarray, threshold: float, second: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, text of each key, weight of its text's prefix before it): even keys for single tokens, odd ones for
    combinations. Tokens of class ``second`` and above are class 2 of the method."""
    n = np.diff(bounds)
    text = np.repeat(np.arange(len(n)), n)
    rank = np.zeros(len(g), np.uint8)
    if len(tokens):
        short = (g >> np.uint64(64 - COUNTED_BITS)).astype(np.int64)
        k = np.minimum(np.searchsorted(tokens, short), len(tokens) - 1)
        rank = np.where(tokens[k] == short, classes[k], 0).astype(np.uint8)
    order = np.lexsort((g, rank, text))
    g, rank = g[order], rank[order]
    place = np.arange(len(g)) - bounds[:-1][text]
    weight = _allowed(n, threshold) + 1 + n // EXTEND
    rare = np.bincount(text[rank < second], minlength=len(n))
    single = (rank < second) & (place < weight[text])
    keys, owners, places = [C.mix(g[single] ^ np.uint64(0xA1)) & ~np.uint64(1)], [text[single]], [place[single]]
    # Texts whose class 1 tokens don't make a prefix; their class 2 tokens go on with it.
    more = (rank >= second) & (rare < weight)[text]
    g, text = g[more], text[more]
    size = np.frexp(n.astype(np.float64))[1][text]
    for up in (0, 1):
        scheme = size + up
        part = (C.mix(g ^ np.uint64(0xD3)) & ((np.uint64(1) << np.maximum(0, scheme - 4).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        adds = np.cumsum(~_first_in_run(part, text))
        start = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, np.int64)
        before = np.r_[0, adds][start] if len(start) else np.zeros(0, np.int64)
        length = np.diff(np.r_[start, len(text)])
        # A token is within the prefix as long as those before it don't have the weight.
        upto = np.r_[0, adds[:-1]] - np.repeat(before, length) if len(text) else np.zeros(0, np.int64)
        inside = upto < (weight - rare)[text]
        h, t, p, s, u = g[inside], text[inside], part[inside], scheme[inside], (rare[text] + upto)[inside]
        order = np.lexsort((np.arange(len(h)), p, t))
        h, t, p, s, u = h[order], t[order], p[order], s[order], u[order]
        here = np.arange(len(h))
        later = C.group_ends(t, p) - here - 1
        for lo, hi in C.cuts(later, CHUNK):
            i, j = C.expand(here[lo:hi] + 1, later[lo:hi])
            i += lo
            # The order within a prefix is the same for all texts, so a shared pair gives one key.
            keys.append(C.mix((h[i] * _K + h[j]) ^ s[i].astype(np.uint64)) | np.uint64(1))
            owners.append(t[i])
            places.append(u[j])
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(places)


_DOC = np.dtype([("node", "<i8"), ("ball", "<i8"), ("n", "<i4")])
#: ``doc`` numbers the texts of a blob in its upper 24 bits; the lower ones have the place in STEPS-ths of the text, rounded down.
_KEY = np.dtype([("key", "<u8"), ("doc", "<u4")])
STEPS = 256


def _own(b: pa.RecordBatch, at: int, g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which texts of a slice are their node's: those without a note, and those whose note has their digest."""
    rows = len(bounds) - 1
    h1, h2 = digests(g, bounds)
    n1, n2 = (b.column(c).slice(at, rows) for c in ("h1", "h2"))
    free = np.array(n1.is_null())
    return free | (n1.fill_null(0).to_numpy(zero_copy_only=False) == h1) & (n2.fill_null(0).to_numpy(zero_copy_only=False) == h2)


def _index(batches: Iterator[pa.RecordBatch], ranges: int, model, n: int, threshold: float, second: int) -> Iterator[pa.RecordBatch]:
    tokens, classes = model.value
    docs: list[np.ndarray] = []
    keys: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    seen = size = 0

    def flush() -> pa.RecordBatch:
        d, k, of = np.concatenate(docs), np.concatenate(keys), np.concatenate(owners)
        r = ((k["key"] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((k["key"], r))
        k, r, of = k[order], r[order], of[order]
        edge = np.searchsorted(r, np.arange(ranges + 1))
        out: list[tuple[int, bytes, bytes]] = []
        for x in np.flatnonzero(np.diff(edge)):
            part = k[edge[x] : edge[x + 1]].copy()
            own, at = np.unique(of[edge[x] : edge[x + 1]], return_inverse=True)
            part["doc"] |= at.astype(np.uint32) << np.uint32(8)
            out.append((int(x), d[own].tobytes(), part.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], names=["part", "docs", "keys"])

    for b in batches:
        node, ball = b.column("node").to_numpy(), b.column("ball").to_numpy()
        for at, g, bounds in token_sets(b.column("text"), n):
            own, of, place = index_entries(g, bounds, tokens, classes, threshold, second)
            m = _own(b, at, g, bounds)[of]
            own, of, place = own[m], of[m], place[m]
            d = np.zeros(len(bounds) - 1, _DOC)
            d["node"], d["ball"], d["n"] = node[at : at + len(d)], ball[at : at + len(d)], np.diff(bounds)
            k = np.zeros(len(own), _KEY)
            k["key"], k["doc"] = own, place * STEPS // np.maximum(1, d["n"][of])
            docs.append(d)
            keys.append(k)
            owners.append(of + seen)
            seen += len(d)
            size += len(k)
            if size >= PACKED or seen >= PACKED:
                yield flush()
                docs, keys, owners, seen, size = [], [], [], 0, 0
    if size:
        yield flush()


_MET = "part int, nodes binary, sizes binary, a binary, b binary, shared binary"


def _meetings(t: pa.Table, threshold: float, parts: int) -> pa.Table:
    """Pairs of nodes of different balls that share keys of one range, and how many, packed by a hash of the pair: two
    that are alike meet in nearly all ranges, so a row for each meeting would be most of what moves."""
    ds, keys, of, steps, n = [], [], [], [], 0
    for raw, packed in zip(t.column("docs").to_pylist(), t.column("keys").to_pylist()):
        d, k = np.frombuffer(raw, _DOC), np.frombuffer(packed, _KEY)
        keys.append(k["key"])
        of.append((k["doc"] >> np.uint32(8)).astype(np.int64) + n)
        steps.append((k["doc"] & np.uint32(STEPS - 1)).astype(np.uint8))
        n += len(d)
        ds.append(d)
    every, key, step = np.concatenate(ds), np.concatenate(keys), np.concatenate(steps)
    node, first, rep = np.unique(every["node"], return_index=True, return_inverse=True)
    size, ball = every["n"][first].astype(np.int64), np.unique(every["ball"][first], return_inverse=True)[1]
    doc = rep[np.concatenate(of)]
    del t, ds, keys, of, steps
    order = np.lexsort((doc, ball[doc], key))
    key, doc, step = key[order], doc[order], step[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc, step = key[new], doc[new], step[new]
    # Places are rounded down, so a token is never taken for one behind the prefix.
    place = step.astype(np.int64) * size[doc] // STEPS
    # Each holder of a key meets those of its other balls, which come after its own.
    own = C.group_ends(key, ball[doc])
    count = C.group_ends(key) - own
    pairs, shared = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for lo, hi in C.cuts(count, CHUNK):
        i, j = C.expand(own[lo:hi], count[lo:hi])
        i += lo
        x, y = doc[i], doc[j]
        n, m = size[x], size[y]
        ok = (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9) & within(place[i], n, m, threshold) & within(place[j], m, n, threshold)
        x, y = x[ok], y[ok]
        pairs, at = np.unique(np.r_[pairs, np.minimum(x, y) * len(node) + np.maximum(x, y)], return_inverse=True)
        shared = np.bincount(at, np.r_[shared, np.ones(len(x), np.int64)].astype(np.float64), minlength=len(pairs)).astype(np.int64)
    x, y = np.divmod(pairs, max(1, len(node)))
    part = ((C.mix(node[x].view(np.uint64) * _K + node[y].view(np.uint64)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[order], np.arange(parts + 1))
    out: list[list] = [[] for _ in range(6)]
    for p in np.flatnonzero(np.diff(edge)).tolist():
        own = order[edge[p] : edge[p + 1]]
        used, at = np.unique(np.r_[x[own], y[own]], return_inverse=True)
        at = at.astype("<u4")
        row = (p, node[used].tobytes(), size[used].astype("<u4").tobytes(), at[: len(own)].tobytes(), at[len(own) :].tobytes(), shared[own].astype("<i8").tobytes())
        for column, v in zip(out, row):
            column.append(v)
    return pa.table([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], names=["part", "nodes", "sizes", "a", "b", "shared"])


def _enough(t: pa.Table) -> pa.Table:
    """The pairs whose meetings in all ranges are as many as joining asks for."""
    nodes, sizes, a, b, shared = ([np.frombuffer(x, kind) for x in t.column(c).to_pylist()] for c, kind in (("nodes", "<i8"), ("sizes", "<u4"), ("a", "<u4"), ("b", "<u4"), ("shared", "<i8")))
    node, first, at = np.unique(np.concatenate(nodes), return_index=True, return_inverse=True)
    size = np.concatenate(sizes)[first].astype(np.int64)
    base = np.cumsum([0, *map(len, nodes)])
    x, y = (at[np.concatenate([i + np.int64(s) for i, s in zip(side, base)])] for side in (a, b))
    pairs, own = np.unique(np.minimum(x, y) * len(node) + np.maximum(x, y), return_inverse=True)
    total = np.bincount(own, np.concatenate(shared).astype(np.float64), minlength=len(pairs))
    x, y = np.divmod(pairs, len(node))
    ok = total >= least_shared(np.minimum(size[x], size[y]))
    return pa.table({"a": pa.array(node[x[ok]]), "b": pa.array(node[y[ok]])})


_OVERLAPS = "a long, b long, na int, nb int, overlap int"


def _compare(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Overlaps of the pairs of each cell, whose texts come before them."""
    sets: dict[int, np.ndarray] = {}
    last = None
    for b in batches:
        lead, lo, hi, kind = (b.column(c).to_numpy() for c in ("lead", "lo", "hi", "kind"))
        nodes, others = b.column("node").to_numpy(), b.column("other").fill_null(0).to_numpy()
        got: list[tuple[int, int, int, int, int]] = []
        held = None
        for at, g, bounds in token_sets(b.column("text"), n):
            own = _own(b, at, g, bounds)
            for i in range(len(bounds) - 1):
                k = at + i
                if (held := (lead[k], lo[k], hi[k])) != last:
                    sets, last = {}, held
                if kind[k] == 0:
                    if own[i]:
                        sets[nodes[k]] = g[bounds[i] : bounds[i + 1]].copy()
                else:
                    x, y = sets[nodes[k]], sets[others[k]]
                    if len(x) > len(y):
                        x, y = y, x
                    over = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
                    got.append((nodes[k], others[k], len(sets[nodes[k]]), len(sets[others[k]]), over))
        if got:
            r = np.array(got, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(r[:, i], pa.int64() if i < 2 else pa.int32()) for i in range(5)], names=["a", "b", "na", "nb", "overlap"])


class Join:
    """The steps of a join of one table; each is written to the shared folder once."""

    def __init__(self, docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> None:
        if not 0.5 < threshold <= 1:
            raise ValueError("the threshold must be over 0.5, and 1 at most")
        self.n, self.threshold = n, threshold
        self.docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.rows = C.materialize(self.docs.mapInArrow(lambda it: C.trimmed(_row_sets(it, n)), _ROWS), "sets")
        # Ids of several texts can't name a node.
        several = self.rows.groupBy("doc_id").agg(F.min("h1").alias("x"), F.max("h1").alias("y"), F.min("h2").alias("z"), F.max("h2").alias("w")).where("x <> y or z <> w")
        self.several = C.materialize(several.select("doc_id"), "several")
        grouped = self.rows.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"), *(F.first(c).alias(c) for c in ("n", *_LEAST)))
        odd = self.several.select(F.col("doc_id").alias("rep"), F.lit(True).alias("odd"))
        named = F.when(F.col("odd"), F.xxhash64("h1", "h2").bitwiseOR(F.lit(1 << 62))).otherwise(F.col("rep"))
        self.nodes = C.materialize(grouped.join(odd, "rep", "left").withColumn("node", named).drop("odd"), "nodes")
        self.balls = self._balls()

    def _texts(self, wanted: DataFrame) -> DataFrame:
        """Texts with the columns of ``wanted`` (doc_id, h1, h2, ...): one row for each of its rows and each text of the id."""
        return self.docs.join(C.checked_broadcast(wanted, wanted.count()), "doc_id")

    def overlaps(self, pairs: DataFrame) -> DataFrame:
        """Exact overlaps of pairs (lead, lo, hi, a, b); those of a cell (lead, lo, hi) meet in one task."""
        cell = ["lead", "lo", "hi"]
        members = pairs.select(*cell, F.col("a").alias("node")).unionAll(pairs.select(*cell, F.col("b").alias("node"))).distinct()
        wanted = C.materialize(members.join(self.nodes.select("node", F.col("rep").alias("doc_id"), "h1", "h2"), "node"), "members")
        text = self._texts(wanted).select(*cell, F.lit(0).alias("kind"), "node", F.lit(None).cast("long").alias("other"), "h1", "h2", "text")
        none = F.lit(None)
        asked = pairs.select(*cell, F.lit(1).alias("kind"), F.col("a").alias("node"), F.col("b").alias("other"), none.cast("long").alias("h1"), none.cast("long").alias("h2"), none.cast("string").alias("text"))
        parts = max(12, -(-wanted.count() // 2000))
        met = text.unionByName(asked).repartition(parts, *cell).sortWithinPartitions(*cell, "kind", "node")
        n = self.n
        return C.materialize(met.mapInArrow(lambda it: C.trimmed(_compare(it, n)), _OVERLAPS), "overlaps")

    def _balls(self) -> DataFrame:
        """(node, ball): nodes that belong to another node's ball."""
        least = self.nodes.select("node", F.posexplode(F.array(*_LEAST)).alias("bin", "value")).where("value is not null")
        centres = least.groupBy("bin", "value").agg(F.min("node").alias("centre"), F.count("*").alias("c")).where("c > 1").drop("c")
        votes = least.join(centres, ["bin", "value"]).where("centre < node").groupBy("node", "centre").agg(F.count("*").alias("v")).where(F.col("v") >= VOTES)
        named = C.materialize(votes.groupBy("node").agg(F.min(F.struct(-F.col("v"), "centre")).alias("s")).select("node", F.col("s.centre").alias("centre")), "centres")
        salts = named.groupBy("centre").agg(F.ceil(F.count("*") / STAR).alias("k"))
        cell = named.join(salts, "centre").select(F.col("centre").alias("lead"), F.lit(0).alias("lo"), F.pmod(F.xxhash64("node"), F.col("k")).cast("int").alias("hi"), F.col("node").alias("a"), F.col("centre").alias("b"))
        near = (1 + self.threshold) / 2
        over = self.overlaps(C.materialize(cell, "stars"))
        return C.materialize(over.where(F.col("overlap") >= near * (F.col("na") + F.col("nb") - F.col("overlap")) + 1e-6).select(F.col("a").alias("node"), F.col("b").alias("ball")), "balls")

    def meetings(self) -> DataFrame:
        """(a, b): pairs of nodes of different balls that may join."""
        total = self.rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        tokens, classes = counted_tokens(self.docs, total, self.n, ORDERED)
        second = int(token_class(FREQUENT))
        ranges = max(6, -(-int(total * (1 - self.threshold)) // RANGE))
        model = self.docs.sparkSession.sparkContext.broadcast((tokens, classes))
        n, threshold = self.n, self.threshold
        # Notes for copies, for members of balls and for ids of several texts; any other text is a node and ball of its own.
        noted = self.nodes.join(self.balls, "node", "left").withColumn("odd", F.col("node") != F.col("rep"))
        noted = noted.where("m > 1 or ball is not null or odd").select("h1", "h2", "rep", "node", F.coalesce("ball", "node").alias("ball"))
        notes = self.rows.select("doc_id", "h1", "h2").join(noted, ["h1", "h2"]).select("doc_id", "h1", "h2", F.when(F.col("doc_id") == F.col("rep"), F.col("node")).alias("node"), "ball")
        notes = C.materialize(notes.distinct(), "notes")
        own = self.docs.join(C.checked_broadcast(notes, notes.count()), "doc_id", "left").where("h1 is null or node is not null")
        own = own.select("text", "h1", "h2", F.coalesce("node", "doc_id").alias("node"), F.coalesce("ball", "doc_id").alias("ball"))
        packed = own.mapInArrow(lambda it: C.trimmed(_index(it, ranges, model, n, threshold, second)), "part int, docs binary, keys binary")
        parts = max(6, ranges // 2)
        met = packed.groupBy("part").applyInArrow(lambda t: C.trimmed(_meetings(t, threshold, parts)), _MET)
        return C.materialize(met.groupBy("part").applyInArrow(lambda t: C.trimmed(_enough(t)), "a long, b long"), "meetings")

    def pairs(self) -> DataFrame:
        """(a, b, na, nb, overlap): the joining pairs of nodes of different balls."""
        met = self.meetings()
        where = C.components(met)
        sized = where.join(self.nodes.select(F.col("node").alias("id"), "n"), "id")
        blocks = sized.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK).alias("k"))
        placed = C.materialize(where.join(blocks, "component").select("id", "component", F.pmod(F.xxhash64("id"), F.col("k")).cast("int").alias("block")), "blocks")
        cell = met.join(placed.select(F.col("id").alias("a"), F.col("component").alias("lead"), F.col("block").alias("x")), "a").join(placed.select(F.col("id").alias("b"), F.col("block").alias("y")), "b")
        cell = C.materialize(cell.select("lead", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "a", "b"), "cells")
        over = self.overlaps(cell)
        return over.where(F.col("overlap") >= self.threshold * (F.col("na") + F.col("nb") - F.col("overlap")) - 1e-6)

    def classes(self) -> DataFrame:
        """(doc_id, class_id, n_links), a row for each row of the table."""
        pairs = C.materialize(self.pairs().select("a", "b"), "pairs")
        name = self.nodes.select("node", "rep", "m")
        member = name.join(self.balls, "node", "left").withColumn("ball", F.coalesce("ball", "node"))
        held = member.groupBy("ball").agg(F.sum("m").alias("held"))
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        across = both.join(name.select(F.col("node").alias("b"), F.col("rep").alias("rep_b"), "m"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("m").alias("across"))
        linked = member.join(held, "ball").join(across, "node", "left").select("node", "rep", (F.col("held") - 1 + F.coalesce("across", F.lit(0))).alias("n_links"))
        # Classes connect ids: members with their balls' centres, joining pairs, and each id of several texts with those it copies.
        edges = pairs.unionAll(self.balls.select(F.col("node").alias("a"), F.col("ball").alias("b")))
        rep = name.select("node", "rep")
        edges = edges.join(rep.select(F.col("node").alias("a"), F.col("rep").alias("x")), "a").join(rep.select(F.col("node").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        texts = self.rows.join(self.several, "doc_id", "left_semi").join(self.nodes.select("h1", "h2", "rep"), ["h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        where = C.components(edges.unionAll(texts)).select(F.col("id").alias("rep"), "component")
        told = linked.join(where, "rep", "left").where("n_links > 0 or component is not null")
        told = told.join(self.nodes.select("node", "h1", "h2"), "node").select("h1", "h2", F.coalesce("component", "rep").alias("class_id"), F.col("n_links"))
        out = self.rows.select("doc_id", "h1", "h2").join(C.materialize(told, "told"), ["h1", "h2"], "left")
        return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links) of every row with an id: its class's least id, and how many other rows' texts join its own."""
    return Join(docs, n, threshold).classes()


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the texts that a chain of joining pairs connects to one of a lesser id."""
    gone = C.materialize(classes(docs, n, threshold).where("doc_id <> class_id").select("doc_id").distinct(), "gone")
    return docs.join(C.checked_broadcast(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)
