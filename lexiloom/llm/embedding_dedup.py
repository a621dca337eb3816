"""Embedding near-duplicates: randomised-rotation binary codes whose error bounds decide which pairs are recomputed.

Every unit vector is turned by a seeded random rotation; its code is the signs, one bit a dimension, and its stored
factor is the inner product of the vector with its code's direction. For a pair, <code(x), y> / factor(x) is an
unbiased estimate of <x, y>, whose error is below ``WIDTH * sqrt(1 - f^2) / f / sqrt(D - 1)`` with high
probability. y takes part as 8-bit numbers with its own rounding bound. Pairs whose upper bound, from either side,
is under what is asked of them are dropped; only for all others are the full vectors joined and the exact cosine computed.

1. Balls: in ``SIGHTINGS`` hash tables every vector names the vector of its buckets that meets most others as its centre. If
   their exact angle is at most half the threshold's, it belongs to that centre's ball. Angles are a metric, so all of a ball are
   near-duplicates of each other: a group of any size is linked by counting, and none of its pairs is made.
2. Candidates: a bucket is the largest rotated coordinate (and its sign) under ``TURNS`` rotations; there are as many tables of
   buckets as find a pair at the threshold with probability ``RECALL`` at least, whatever the table's size. Buckets hold each
   ball once, so a hot group is one entry; two balls that meet, and whose codes differ in no more bits than their angle
   allows, are a candidate. Buckets of over ``CELL`` balls are compared in cells.
3. Decision: the codes' bounds drop balls that are too far apart for any of their members; the exact angle of the centres settles
   the members whose own angles leave no doubt, by the triangle inequality, and only the rest are estimated, and computed.

Defined results: one row for each row with an id: the least id of its class (all that a chain of near-duplicates connects) and the
number of other rows that are its near-duplicates. A null, empty or zero vector, or one with a null or non-finite component, has
none. Rows with a null id are left out. Vectors of each dimension are compared among themselves. Repeated rows of an id are
near-duplicates of each other like all others. A cosine equal to the threshold counts. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import common as C

THRESHOLD = 0.95
RECALL = 0.995
#: Rotations of a bucket, tables in which centres are looked for.
TURNS, SIGHTINGS = 3, 8
#: Deviations of the estimates that the bounds allow for.
WIDTH = 4.0
#: Balls of a cell of a bucket, pairs that are compared at a time, pairs that a task gathers.
CELL, PAIRED, GATHERED = 4096, 1_000_000, 500_000
#: Radians that rounding may take.
SLACK = 1e-5


@lru_cache(maxsize=512)
def rotation(dim: int, number: int, seed: int = 29) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, number, dim]).normal(size=(dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def largest(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The largest rotated coordinate of each vector, with its sign."""
    y = x @ turn.T
    k = np.argmax(np.abs(y), axis=1)
    return 2 * k + (y[np.arange(len(y)), k] < 0)


@lru_cache(maxsize=64)
def tables(dim: int, threshold: float = THRESHOLD, recall: float = RECALL, samples: int = 4000) -> int:
    """How many tables find a pair at the threshold with this probability; by seeded trial, so it depends on the dimension alone."""
    rng = np.random.default_rng([31, dim])
    x = rng.normal(size=(samples, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(samples, dim))
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    y = threshold * x + math.sqrt(1 - threshold * threshold) * y
    same = np.mean(largest(x, rotation(dim, 0)) == largest(y, rotation(dim, 0))) - 2 / math.sqrt(samples) / 2
    hit = min(0.999, max(0.01, same)) ** TURNS
    return max(SIGHTINGS, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
    # A scale first, so that squares neither vanish nor overflow.
    x = x.astype(np.float64) / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, factors, 8-bit rotated vectors, their scale) of unit vectors."""
    y = x @ turn.T
    factor = np.abs(y).sum(1) / math.sqrt(y.shape[1])
    scale = np.maximum(np.abs(y).max(1), 1e-12) / 127
    return np.packbits(y >= 0, axis=1), factor.astype(np.float32), np.round(y / scale[:, None]).astype(np.int8), scale.astype(np.float32)


def upper_bounds(sign: np.ndarray, factor: np.ndarray, y: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Upper confidence bounds of the cosines of pairs, row by row: the first by code (signs, factor), the second by 8-bit vector."""
    dim = sign.shape[1]
    f = np.minimum(factor.astype(np.float64), 1)
    estimate = np.einsum("ij,ij->i", sign, y.astype(np.float64)) * scale / (math.sqrt(dim) * f)
    error = WIDTH * np.sqrt(np.maximum(0, 1 - f * f)) / f / math.sqrt(max(1, dim - 1))
    # Rounding moves every component by half a step at most; its deviation is a step / sqrt(12).
    return estimate + error + WIDTH * scale / math.sqrt(12) / f


def most_bits(angle: np.ndarray, dim: np.ndarray | int) -> np.ndarray:
    """Bits in which the codes of vectors at this angle differ at most."""
    p = np.minimum(angle / math.pi, 0.5)
    return dim * p + WIDTH * np.sqrt(dim * p * (1 - p)) + 1e-9


def _by_dim(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(dimension, places) of the vectors of a batch."""
    sizes = column.value_lengths().to_numpy()
    for dim in np.unique(sizes).tolist():
        yield dim, np.flatnonzero(sizes == dim)


def _slices(b: pa.RecordBatch, rows: int = 2048) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """(dimension, unit vectors, their rows), some thousands at a time."""
    for dim, at in _by_dim(b.column("v")):
        for s in range(0, len(at), rows):
            part = b.take(pa.array(at[s : s + rows]))
            yield dim, unit(part.column("v"), dim), part


def _buckets(x: np.ndarray, dim: int, table: int) -> np.ndarray:
    key = np.full(len(x), (dim << 20) + table, np.uint64)
    for k in range(TURNS):
        key = C.mix(key * np.uint64(C._MULT) + largest(x, rotation(dim, 1 + table * TURNS + k)).astype(np.uint64))
    return key.view(np.int64)


def _sighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for dim, x, part in _slices(b):
            x = x.astype(np.float32)
            for k in range(SIGHTINGS):
                yield pa.RecordBatch.from_arrays([pa.array(_buckets(x, dim, k)), part.column("node")], names=["bucket", "node"])


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for dim, x, part in _slices(b):
            bits, factor, small, scale = codes(x.astype(np.float32), rotation(dim, 0))
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([r.tobytes() for r in bits], pa.binary()), pa.array(factor), pa.array([r.tobytes() for r in small], pa.binary()), pa.array(scale)], names=["node", "bits", "factor", "small", "scale"])


def _spread(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for dim, x, part in _slices(b):
            x = x.astype(np.float32)
            for k in range(tables(dim, threshold)):
                yield pa.RecordBatch.from_arrays([pa.array(_buckets(x, dim, k)), part.column("ball")], names=["bucket", "ball"])


_PAIRS = "a long, b long"


def _meetings(batches: Iterator[pa.RecordBatch], theta: float) -> Iterator[pa.RecordBatch]:
    """Pairs of balls of a cell whose codes allow an angle of the threshold and both radii."""
    out: list[np.ndarray] = []

    def gathered() -> pa.RecordBatch:
        p = np.unique(np.concatenate(out), axis=0)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    for t in C.whole_runs(batches, ["bucket", "lo", "hi"]):
        bucket, lo, hi, ball, part, radius, dim = (t.column(c).to_numpy() for c in ("bucket", "lo", "hi", "ball", "part", "radius", "dim"))
        raw = t.column("bits").to_pylist()
        width = max(map(len, raw))
        code = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in raw), np.uint8).reshape(len(raw), width)
        here = np.arange(len(ball))
        count = C.group_ends(bucket, lo, hi) - here - 1
        for s, e in C.cuts(count, PAIRED):
            i, j = C.expand(here[s:e] + 1, count[s:e])
            i += s
            # Blocks of two different parts meet only each other here; dimensions differ only where hashes of buckets are equal by chance.
            ok = ((lo[i] == hi[i]) | (part[i] != part[j])) & (dim[i] == dim[j])
            i, j = i[ok], j[ok]
            differ = np.zeros(len(i), np.int32)
            for byte in range(width):
                differ += np.bitwise_count(code[i, byte] ^ code[j, byte])
            ok = differ <= most_bits(theta + radius[i] + radius[j], dim[i])
            x, y = ball[i[ok]], ball[j[ok]]
            if len(x):
                out.append(np.c_[np.minimum(x, y), np.maximum(x, y)])
                if sum(map(len, out)) > GATHERED:
                    yield gathered()
    if out:
        yield gathered()


def _signs(column: pa.Array, dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(raw, axis=1, count=dim).astype(np.float64) * 2 - 1


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose upper bounds from either side reach the cosine that they need."""
    for b in batches:
        sizes = np.array([len(x) for x in b.column("small_a").to_pylist()])
        keep = np.zeros(b.num_rows, bool)
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            part = b.take(pa.array(at))
            small = {s: np.frombuffer(b"".join(part.column(f"small_{s}").to_pylist()), np.int8).reshape(-1, dim) for s in "ab"}
            number = lambda c: part.column(c).to_numpy().astype(np.float64)
            one, two = (upper_bounds(_signs(part.column(f"bits_{s}"), dim), number(f"factor_{s}"), small[o], number(f"scale_{o}")) for s, o in ("ab", "ba"))
            keep[at] = np.minimum(one, two) >= number("need") - 1e-9
        yield b.select(["a", "b"]).filter(pa.array(keep))


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cosine = np.zeros(b.num_rows)
        for dim, at in _by_dim(b.column("x")):
            part = b.take(pa.array(at))
            cosine[at] = np.einsum("ij,ij->i", unit(part.column("x"), dim), unit(part.column("y"), dim))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(cosine)], names=["a", "b", "cosine"])


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(node, id, v) of the rows that can be compared; nodes number them."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<float>").alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return C.materialize(rows.where((F.size("v") > 0) & finite).select(F.monotonically_increasing_id().alias("node"), "id", "v"), "vectors")


class Join:
    """The steps of a join of one table; each is written to the shared folder once."""

    def __init__(self, vectors: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", column: str = "embedding") -> None:
        if not 0 < threshold <= 1:
            raise ValueError("the threshold must be over 0, and 1 at most")
        self.threshold, self.theta = threshold, math.acos(threshold)
        self.own = usable(vectors, id_column, column)
        self.code = C.materialize(self.own.select("node", "v").mapInArrow(_coded, "node long, bits binary, factor float, small binary, scale float"), "codes")
        self.members = self._members()
        radius = self.members.groupBy("ball").agg(F.max("angle").alias("radius"), F.count("*").alias("held"))
        self.balls = C.materialize(radius, "balls")

    def possible(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of pairs (a, b, need) whose bounds reach the cosine that they need."""
        for side in "ab":
            own = self.code.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("bits", "factor", "small", "scale")))
            pairs = pairs.join(own, side)
        return pairs.mapInArrow(_possible, _PAIRS)

    def cosines(self, pairs: DataFrame) -> DataFrame:
        """(a, b, cosine) of pairs (a, b), in double precision."""
        for side, name in (("a", "x"), ("b", "y")):
            pairs = pairs.join(self.own.select(F.col("node").alias(side), F.col("v").alias(name)), side)
        return pairs.select("a", "b", "x", "y").mapInArrow(_exact, _PAIRS + ", cosine double")

    def _members(self) -> DataFrame:
        """(node, ball, angle): every vector's ball, its own if it has no centre, and the angle to that."""
        seen = C.materialize(self.own.select("node", "v").mapInArrow(_sighted, "bucket long, node long"), "sightings")
        size = seen.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
        hit = C.materialize(seen.join(size, "bucket"), "hits")
        score = hit.groupBy("node").agg(F.sum("c").alias("score"))
        centre = hit.join(score, "node").groupBy("bucket").agg(F.max(F.struct("score", (-F.col("node")).alias("s"))).alias("m")).select("bucket", F.col("m.score").alias("score"), (-F.col("m.s")).alias("centre"))
        votes = hit.join(centre, "bucket").groupBy("node", "centre").agg(F.count("*").alias("v"), F.max("score").alias("score"))
        named = votes.groupBy("node").agg(F.max(F.struct("v", "score", (-F.col("centre")).alias("s"))).alias("m")).select(F.col("node").alias("a"), (-F.col("m.s")).alias("b")).where("a <> b")
        half = self.theta / 2 - SLACK
        near = self.cosines(C.materialize(named, "centres")).where(F.col("cosine") >= math.cos(half) if half > 0 else F.lit(False))
        ball = near.select(F.col("a").alias("node"), F.col("b").alias("ball"), F.acos(F.least(F.col("cosine"), F.lit(1.0))).alias("angle"))
        ball = C.materialize(ball, "placed")
        return C.materialize(self.own.select("node", "id").join(ball, "node", "left").select("node", "id", F.coalesce("ball", "node").alias("ball"), F.coalesce("angle", F.lit(0.0)).alias("angle")), "members")

    def _met(self) -> DataFrame:
        """(a, b): balls that share a bucket and whose codes are alike enough."""
        threshold, theta = self.threshold, self.theta
        placed = self.own.select("node", "v").join(self.members.select("node", "ball"), "node").select("ball", "v")
        once = placed.mapInArrow(lambda it: _spread(it, threshold), "bucket long, ball long").distinct()
        once = C.materialize(once, "buckets")
        shared = once.groupBy("bucket").agg(F.ceil(F.count("*") / CELL).cast("int").alias("k"), F.count("*").alias("c")).where("c > 1").drop("c")
        facts = self.code.select(F.col("node").alias("ball"), "bits", F.length("small").alias("dim")).join(self.balls.select("ball", "radius"), "ball")
        rows = once.join(shared, "bucket").join(facts, "ball").withColumn("part", F.pmod(F.xxhash64("ball"), F.col("k")).cast("int"))
        cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("bucket", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "ball", "radius", "dim", "bits")
        met = cells.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "ball").mapInArrow(lambda it: _meetings(it, theta), _PAIRS)
        return C.materialize(met.distinct(), "met")

    def across(self) -> DataFrame:
        """(a, b): the near-duplicates (nodes) of different balls."""
        radius = self.balls.select("ball", "radius")
        met = self._met().join(radius.select(F.col("ball").alias("a"), F.col("radius").alias("ra")), "a").join(radius.select(F.col("ball").alias("b"), F.col("radius").alias("rb")), "b")
        reach = F.least(F.lit(self.theta) + F.col("ra") + F.col("rb") + SLACK, F.lit(math.pi))
        left = C.materialize(self.possible(met.select("a", "b", F.cos(reach).alias("need"))), "possible")
        centres = C.materialize(self.cosines(left).select("a", "b", F.acos(F.greatest(F.least(F.col("cosine"), F.lit(1.0)), F.lit(-1.0))).alias("gamma"), "cosine"), "angles")
        own = self.members
        p = own.select(F.col("ball").alias("a"), F.col("node").alias("x"), F.col("angle").alias("ax"))
        q = own.select(F.col("ball").alias("b"), F.col("node").alias("y"), F.col("angle").alias("ay"))
        each = centres.join(p, "a").join(q, "b")
        apart = F.col("ax") + F.col("ay")
        # Where both are the centres the cosine is known.
        known = (F.col("x") == F.col("a")) & (F.col("y") == F.col("b"))
        sure = F.when(known, F.col("cosine") >= self.threshold - 1e-9).when(F.col("gamma") + apart <= self.theta - SLACK, True).when(F.col("gamma") - apart > self.theta + SLACK, False)
        each = C.materialize(each.select(F.col("x").alias("a"), F.col("y").alias("b"), sure.alias("sure")).where("sure is null or sure"), "member-pairs")
        asked = each.where("sure is null").select("a", "b", F.lit(self.threshold).alias("need"))
        exact = self.cosines(self.possible(asked)).where(F.col("cosine") >= self.threshold - 1e-9).select("a", "b")
        return C.materialize(each.where("sure").select("a", "b").unionAll(exact), "across")

    def classes(self) -> DataFrame:
        """(id, class_id, n_links) of the vectors that have any near-duplicate or none."""
        across = self.across()
        both = across.unionAll(across.select(F.col("b").alias("a"), F.col("a").alias("b")))
        more = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("more"))
        linked = self.members.join(self.balls.select("ball", "held"), "ball").join(more, "node", "left").select("node", "id", "ball", (F.col("held") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
        name = self.own.select("node", "id")
        edges = across.unionAll(self.members.where("ball <> node").select(F.col("node").alias("a"), F.col("ball").alias("b")))
        edges = edges.join(name.select(F.col("node").alias("a"), F.col("id").alias("x")), "a").join(name.select(F.col("node").alias("b"), F.col("id").alias("y")), "b")
        where = C.components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
        return linked.join(where, "id", "left").select("id", F.coalesce("component", "id").alias("class_id"), "n_links")


def classes(vectors: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, class_id, n_links), a row for each row with an id."""
    join = Join(vectors, threshold, id_column, column)
    out = join.classes()
    every = vectors.select(F.col(id_column).cast("long").alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("n"))
    used = join.own.groupBy("id").agg(F.count("*").alias("u"))
    rest = every.join(used, "id", "left").withColumn("k", F.col("n") - F.coalesce("u", F.lit(0))).where("k > 0")
    rest = rest.select("id", F.explode(F.sequence(F.lit(1), "k"))).select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionAll(rest).withColumnRenamed("id", id_column)
