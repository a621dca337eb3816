"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks, over every word of every text.

Instances are fragments: words between white space, with the blank before them; runs of single characters
("x y z") are joined to one. The kernel counts common subsequences of three symbols, each occurrence weighing
``DECAY ** span`` for spans up to ``SPAN``, so gaps and inserted characters lower a match instead of losing it; it is
normalised by the fragments' lengths. A Nyström map over landmark fragments gives features for a linear
support vector machine with squared hinge loss, by Newton steps; as the map is linear in subsequence counts, the trained machine collapses
to one weight per subsequence, and scoring a text is a sum of table look-ups at every byte: no prefix, no cap.

Labels are given for texts (their sentences share it), while an insult is one fragment among many clean ones.
So training is multiple-instance: seed witnesses hold a five-symbol piece that significantly many toxic and no clean
sample texts hold, significance being taken anew over the texts that no piece is chosen for yet; then the machine is
refitted on each toxic text's best fragments, at least one a text. A text is rejected if any of its
fragments scores above the threshold, which lies between the clean sample's and the witnesses' scores.

Defined results: null, empty or blank texts score -1 and are kept; a score equal to the threshold is kept; very long texts are scored whole; repeated
rows are scored each; an empty table gives no rows; extra columns pass, and a result column whose name is taken gets
a "_". Null labels are left out; without toxic labelled rows the model keeps everything.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import common as C

#: Labelled texts that training takes at most of either kind, those with the least hash of their id.
TRAIN_ROWS = 1200
LANDMARKS = 160
#: Bounds of training beside TRAIN_ROWS, of distinct fragments: the clean sample's commonest and others that stand for it, those that score
#: highest and join it each time, and the witnesses whose disguises are added. They shape the model alone; scoring has no bound.
COMMON, CLEAN, HARDEST, DISGUISED = 40, 12_000, 1000, 24
SPAN, DECAY = 6, 0.75
#: Offsets of the second and third symbol; the weight of an occurrence depends on its span.
PATTERNS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def _symbols() -> np.ndarray:
    """64 symbols: 0 unused, 1 blank, 2-27 letters, 28 digits, 29 lead bytes, 30 other signs, 31 common punctuation, 32-63 continuation bytes."""
    out = np.full(256, 30, np.uint8)
    for b in range(256):
        c = chr(b)
        if b <= 32:
            out[b] = 1
        elif "a" <= c.lower() <= "z" and b < 128:
            out[b] = 2 + ord(c.lower()) - 97
        elif b < 128 and c.isdigit():
            out[b] = 28
        elif b >= 192:
            out[b] = 29
        elif b >= 128:
            out[b] = 32 + b % 32
        elif c in ".,;:!?":
            out[b] = 31
    return out


SYMBOL = _symbols()


def fragments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols with joined runs closed up, start and end of each fragment in them, bounds of each text's fragments).

    Every fragment starts with the blank symbol. A single character between blanks is joined to a fragment that is
    itself made of single characters, and the blank between them goes.
    """
    starts, ends = C.token_spans(data, offsets, by_kind=False)
    bounds = C.per_text(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint8), starts, ends, bounds
    lead = (data[starts] >= 192).astype(np.int64)
    lead += (data[starts] >= 224).astype(np.int64) + (data[starts] >= 240)
    single = (ends - starts - lead) == 1
    first = np.zeros(len(starts) + 1, bool)
    first[bounds] = True
    joined = np.zeros(len(starts), bool)
    joined[1:] = single[1:] & single[:-1] & ~first[1:-1]
    length = ends - starts + ~joined
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(length, out=at[1:])
    source = np.repeat(starts - ~joined - at[:-1], length) + np.arange(at[-1])
    out = SYMBOL[data[np.maximum(source, 0)]]
    heads = np.flatnonzero(~joined)
    out[at[heads]] = 1
    return out, at[heads], np.r_[at[heads[1:]], at[-1]], np.searchsorted(heads, bounds, "left")


def length_norm(length: np.ndarray) -> np.ndarray:
    """Square root of the summed squared weights of all occurrences in a fragment of this length."""
    total = np.zeros(len(length))
    for _, b in PATTERNS:
        total += np.maximum(0, length - b) * DECAY ** (2 * (b + 1))
    return np.sqrt(np.maximum(total, 1e-9))


def occurrences(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """For each pattern: (weight, positions at which it lies within one fragment, codes of the three symbols there)."""
    left = np.repeat(ends, ends - starts) - np.arange(len(symbols))
    s = symbols.astype(np.int32)
    where = {b: np.flatnonzero(left > b) for b in range(2, SPAN)}
    for a, b in PATTERNS:
        p = where[b]
        yield DECAY ** (b + 1), p, (s[p] << 12) | (s[p + a] << 6) | s[p + b]


def fragment_scores(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    got = np.zeros(len(symbols) + 1, np.float64)
    for weight, p, code in occurrences(symbols, starts, ends):
        got[p + 1] += weight * weights[code]
    np.cumsum(got, out=got)
    return (got[ends] - got[starts]) / length_norm(ends - starts) + bias


def _map(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, code, normalised weight) of the subsequences of fragments given as symbol strings."""
    symbols = np.frombuffer(b"".join(items), np.uint8)
    size = np.array([len(x) for x in items], np.int64)
    ends = np.cumsum(size)
    of = np.repeat(np.arange(len(items)), size)
    norm = length_norm(size)
    rows, codes, values = [], [], []
    for weight, p, code in occurrences(symbols, ends - size, ends):
        rows.append(of[p])
        codes.append(code)
        values.append(weight / norm[of[p]])
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(values)


def kernel(items: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """The kernel matrix; equal, up to length normalisation, to summing over all pairs of gapped occurrences."""
    r, c, v = _map(landmarks)
    used, at = np.unique(c, return_inverse=True)
    dense = np.zeros((len(used), len(landmarks)))
    np.add.at(dense, (at, r), v)
    out = np.zeros((len(items), len(landmarks)))
    for lo in range(0, len(items), 4000):
        part = items[lo : lo + 4000]
        r, c, v = _map(part)
        k = np.searchsorted(used, c)
        k[k == len(used)] = 0
        hit = used[k] == c
        order = np.argsort(r[hit], kind="stable")
        r, k, v = r[hit][order], k[hit][order], v[hit][order]
        for s in range(0, len(r), 20_000):
            part_r = r[s : s + 20_000]
            first = np.flatnonzero(np.r_[True, part_r[1:] != part_r[:-1]])
            out[lo + part_r[first]] += np.add.reduceat(dense[k[s : s + 20_000]] * v[s : s + 20_000, None], first, axis=0)
    return out


def hinge(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by Newton steps over the active examples."""
    xb = np.c_[x, np.ones(len(x))]
    ridge = np.eye(xb.shape[1]) / (2 * c)
    w = np.zeros(xb.shape[1])
    active = np.ones(len(xb), bool)
    for _ in range(steps):
        a = xb[active]
        new = np.linalg.solve(ridge + a.T @ a, a.T @ y[active])
        w = w + (new - w) * (1.0 if not w.any() else 0.7)
        now = y * (xb @ w) < 1
        if (now == active).all() and np.allclose(new, w, atol=1e-6):
            break
        active = now
    return w[:-1], float(w[-1])


def fit(bags: list[list[bytes]], toxic: list[bool]) -> tuple[np.ndarray, float, float]:
    """(weight of each subsequence code, bias, threshold) from texts given as lists of fragments."""
    nothing = np.zeros(1 << 18, np.float32), -1.0, 0.0
    if not any(toxic) or all(toxic):
        return nothing
    sets = [set(b) for b in bags]
    good = Counter(f for s, t in zip(sets, toxic) if not t for f in s)
    pieces: dict[bytes, set] = defaultdict(set)
    clean_pieces = {g[i : i + 5] for f in good for g in (f + b"\x01",) for i in range(max(1, len(g) - 4))}
    for k, (s, t) in enumerate(zip(sets, toxic)):
        if t:
            for f in s:
                if f not in good:
                    g = f + b"\x01"
                    for i in range(max(1, len(g) - 4)):
                        if (p := g[i : i + 5]) not in clean_pieces:
                            pieces[p].add(k)
    rivals = max(1, len(pieces) + len(clean_pieces))
    open_ = {k for k, t in enumerate(toxic) if t}
    chosen: list[bytes] = []
    # The fewer toxic texts are left without a chosen piece, the fewer of them need share one for it to be significant.
    while open_:
        enough = max(3 if len(open_) > 3 else 2, min(np.log(0.5 / rivals) / np.log(len(open_) / len(toxic)), len(open_)))
        held = {p: n for p, ks in pieces.items() if (n := len(ks & open_)) >= enough and 2 * n >= len(ks)}
        if not held and not chosen and pieces:
            held = {min(pieces, key=lambda p: (-len(pieces[p]), p)): 1}
        if not held:
            break
        chosen += sorted(held, key=lambda p: (-held[p], p))
        open_ = open_.difference(*(pieces[p] for p in held))
    if not chosen:
        return nothing
    whole, short = {p for p in chosen if len(p) == 5}, [p for p in chosen if len(p) < 5]

    def pieces_in(f: bytes) -> set[bytes]:
        g = f + b"\x01"
        return {p for i in range(len(g) - 4) if (p := g[i : i + 5]) in whole} | {p for p in short if p in g}

    seeds = {f for s, t in zip(sets, toxic) if t for f in s if f not in good and pieces_in(f)}
    many = [f for f, _ in good.most_common(COMMON)]
    spread = sorted(good, key=lambda f: int.from_bytes(f[-6:], "big") * 0x9E3779B97F4A7C15 % (1 << 64))
    clean = list(dict.fromkeys(many + spread[:CLEAN]))
    witnesses = sorted(seeds)
    # Landmarks: the commonest witnesses, greedily those of a new piece first, and clean fragments.
    popular = Counter(f for s, t in zip(sets, toxic) if t for f in s if f in seeds)
    marks, covered = [], set()
    for f, _ in sorted(popular.items(), key=lambda x: (-x[1], x[0])):
        own = pieces_in(f)
        if own - covered and len(marks) < LANDMARKS // 2:
            marks.append(f)
            covered |= own
    marks += [f for f, _ in sorted(popular.items(), key=lambda x: (-x[1], x[0])) if f not in set(marks)][: max(0, LANDMARKS // 2 - len(marks))]
    disguised = [v for f in marks[:DISGUISED] for v in variants(f)]
    marks += [v for f in marks[:DISGUISED] for v in variants(f)[:2]]
    marks += spread[: LANDMARKS // 4]
    others = [sorted(f for f in s if f not in good) for s, t in zip(sets, toxic) if t]
    bare = [o for o in others if o and not seeds.intersection(o)]
    weights, bias = np.zeros(1 << 18), 0.0
    for _ in range(3):
        r, c, v = _map(marks)
        base = kernel(marks, marks)
        lam, vec = np.linalg.eigh((base + base.T) / 2)
        keep = lam > lam.max() * 1e-6
        whiten = vec[:, keep] / np.sqrt(lam[keep])
        neg = kernel(clean, marks) @ whiten
        pos = kernel(witnesses + disguised, marks) @ whiten
        w, bias = hinge(np.r_[pos, neg], np.r_[np.ones(len(pos)), -np.ones(len(neg))])
        weights = np.bincount(c, v * (whiten @ w)[r], minlength=1 << 18)
        # Refit on the fragments of toxic texts above all clean ones, and on the clean fragments that score highest.
        names = list(good)
        hard = _score_list(names, weights, bias)
        clean = list(dict.fromkeys(clean + [names[i] for i in np.argsort(-hard, kind="stable")[:HARDEST]]))
        marks = list(dict.fromkeys(marks + [names[i] for i in np.argsort(-hard, kind="stable")[: LANDMARKS // 4]]))
        flat = sorted({f for o in others for f in o})
        above = _score_list(flat, weights, bias) > max(0.0, hard.max() + 0.1)
        # A toxic text without a seed gives its best fragment, whatever it scores.
        best = sorted({o[int(np.argmax(_score_list(o, weights, bias)))] for o in bare})
        marks = list(dict.fromkeys(marks + best[: LANDMARKS // 2]))
        witnesses = sorted(seeds.union(best) | {f for f, a in zip(flat, above) if a})
    final = dict(zip(good, _score_list(list(good), weights, bias)))
    worst = np.sort([max((final[f] for f in b), default=-1.0) for b, t in zip(sets, toxic) if not t])
    top = float(worst[max(0, len(worst) - 1 - len(worst) // 1000)])
    low = float(np.quantile(_score_list(sorted(seeds), weights, bias), 0.02))
    threshold = max((top + low) / 2, 0.35) if low > top else max(top + 0.02, 0.35)
    return weights.astype(np.float32), bias, float(round(threshold, 6))


def variants(f: bytes) -> list[bytes]:
    """Disguises of a fragment: signs between all its characters, then one sign or letter put in at each place."""
    body = [bytes([x]) for x in f[1:]]
    inner = range(2, len(f))
    return [f[:1] + b"\x1f".join(body), f[:1] + b"\x1e".join(body), *(f[:i] + x + f[i:] for i in inner for x in (b"\x1e", b"\x19"))]


def _score_list(items: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    out = [np.zeros(0)]
    for lo in range(0, len(items), 20000):
        part = items[lo : lo + 20000]
        size = np.array([len(x) for x in part], np.int64)
        ends = np.cumsum(size)
        out.append(fragment_scores(np.frombuffer(b"".join(part), np.uint8), ends - size, ends, weights, bias))
    return np.concatenate(out)


def cut(column: pa.Array) -> list[list[bytes]]:
    """The distinct fragments of each text, as symbol strings."""
    out = []
    for _, _, data, offsets in C.text_slices(column):
        symbols, starts, ends, bounds = fragments(data, offsets)
        raw = symbols.tobytes()
        s, e = starts.tolist(), ends.tolist()
        out += [sorted({raw[s[k] : e[k]] for k in range(lo, hi)}) for lo, hi in zip(bounds[:-1], bounds[1:])]
    return out


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float, float]:
    """The model, learnt in one task from at most ``rows`` labelled texts of either kind; it (1 MB) alone reaches the driver."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("_toxic"))
    pick = lambda t: known.where(F.col("_toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(pick(True).unionAll(pick(False))), "doc_id")

    def to_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_toxic"), pa.array(cut(b.column("text")), pa.list_(pa.binary()))], names=["doc_id", "toxic", "bag"])

    def learn(t: pa.Table) -> pa.Table:
        rows_ = sorted(zip(t.column("doc_id").to_pylist(), t.column("toxic").to_pylist(), t.column("bag").to_pylist()))
        w, b, threshold = fit([r[2] for r in rows_], [r[1] for r in rows_])
        del rows_
        return C.trimmed(pa.table({"w": pa.array([w.tobytes()], pa.binary()), "b": [b], "t": [threshold]}))

    got = sample.mapInArrow(to_bags, "doc_id long, toxic boolean, bag array<binary>").withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(learn, "w binary, b double, t double").collect()
    return (np.frombuffer(got[0][0], np.float32), got[0][1], got[0][2]) if got else (np.zeros(1 << 18, np.float32), -1.0, 0.0)


def text_scores(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """The best fragment's score of each whole text; -1 for a text without a fragment."""
    out = np.full(len(column), -1.0)
    for at, n, data, offsets in C.text_slices(column):
        symbols, starts, ends, bounds = fragments(data, offsets)
        some = np.flatnonzero(np.diff(bounds) > 0)
        if len(some):
            s = fragment_scores(symbols, starts, ends, weights, bias)
            out[at + some] = np.maximum.reduceat(s, bounds[:-1][some])
    return np.round(out, 6)


def score(docs: DataFrame, model: tuple[np.ndarray, float, float]) -> DataFrame:
    """``docs`` with ``toxicity_score`` and ``toxicity_reject``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w, bias, _ = shared.value
        for b in batches:
            yield pa.array(text_scores(b, w, bias))

    s = C.free_name(docs, "toxicity_score")
    k = C.free_name(docs, "toxicity_reject")
    return docs.withColumn(s, best("text")).withColumn(k, F.col(s) > model[2])


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Only the rows that aren't rejected, with the columns of ``docs``."""
    scored = score(docs, train(spark, docs, labels))
    return scored.where(~F.col(scored.columns[-1])).select(*docs.columns)
