"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

A text is cut into words (runs of letters and digits) and symbol runs; a word equal to the one before it
(or before that) becomes one shared "repeat" word. Every unigram and bigram is hashed into ``2**BITS`` features, whose values
are their shares of the text's n-grams. Scoring is one sparse dot product a text, taken over whole texts.

Defined results: a null, empty or blank text has no n-gram; it scores 1 and is kept, as nothing
speaks against it. Very long texts are scored whole. Ties with the threshold are kept. Repeated rows are scored each. An empty table gives no rows.
Extra columns pass through; if an input column has the name of a result column, the result's gets a "_".
Labels that are null are left out; without labelled rows of both kinds the model keeps everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import common as C

BITS = 18
#: The labelled rows that training takes at most: those with the least hash of their id.
TRAIN_ROWS = 4000
#: Texts whose probability of good quality is below this are rejected.
THRESHOLD = 0.5
#: Length normalised counts are multiplied by this, so that a typical gradient is near 1.
SCALE = 8.0
_REPEAT, _AGAIN = np.uint64(0x5EED5EED5EED5EED), np.uint64(0xA6A14A6A14A6A14A)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature of every n-gram, bounds of each text's n-grams) for a slice of texts."""
    starts, ends = C.token_spans(data, offsets, by_kind=True)
    h = C.span_hashes(data, starts, ends)
    bounds = C.per_text(starts, offsets)
    first = np.zeros(len(h) + 1, bool)
    first[bounds] = True
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & ~first[1:-1]
    again = np.zeros(len(h), bool)
    again[2:] = (h[2:] == h[:-2]) & ~first[2:-1] & ~first[1:-2]
    h = np.where(same, _REPEAT, np.where(again, _AGAIN, h))
    previous = np.r_[np.uint64(0), h[:-1]] if len(h) else h
    previous = np.where(first[:-1], np.uint64(7), previous)
    both = np.empty(2 * len(h), np.uint32)
    both[0::2] = h >> np.uint64(64 - BITS)
    both[1::2] = C.mix(h + previous * np.uint64(C._MULT)) >> np.uint64(64 - BITS)
    return both, 2 * bounds


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 3, alpha: float = 0.5, beta: float = 0.1, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """Weights (the last is the bias) by per-coordinate FTRL-proximal; examples are (features, values, label) in order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    kinds = [sum(1 for e in examples if e[2] == k) for k in (0, 1)]
    if not min(kinds):
        return np.zeros((1 << BITS) + 1, np.float32)
    balance = [len(examples) / (2 * k) for k in kinds]

    def weights(i: np.ndarray | slice) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for i, x, y in examples:
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x * balance[y]
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(slice(None)).astype(np.float32)


def example(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i, k = np.unique(f, return_counts=True)
    return np.r_[i, 1 << BITS].astype(np.int64), np.r_[k * (SCALE / max(1, k.sum())), 1.0]


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learnt in one task from at most ``rows`` labelled texts; the model (1 MB) is what reaches the driver."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, _, data, offsets in C.text_slices(b.column("text")):
                f, bounds = features(data, offsets)
                out += [f[s:e].astype("<u4").tobytes() for s, e in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_y"), pa.array(out, pa.binary())], names=["doc_id", "y", "f"])

    def fit(t: pa.Table) -> pa.Table:
        ids, fs = t.column("doc_id").to_numpy(), t.column("f").to_pylist()
        order = sorted(range(len(fs)), key=lambda k: (int(C.mix(ids[k : k + 1].astype(np.uint64))[0]), ids[k], fs[k]))
        y = t.column("y").to_pylist()
        w = ftrl([(*example(np.frombuffer(fs[k], "<u4")), int(y[k] > 0)) for k in order])
        return pa.table({"w": pa.array([w.tobytes()], pa.binary())})

    got = sample.mapInArrow(featurise, "doc_id long, y int, f binary").withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(fit, "w binary").collect()
    return np.frombuffer(got[0][0], np.float32) if got else np.zeros((1 << BITS) + 1, np.float32)


def probabilities(column: pa.Array, w: np.ndarray) -> np.ndarray:
    out = np.zeros(len(column))
    for at, n, data, offsets in C.text_slices(column):
        f, bounds = features(data, offsets)
        total = np.zeros(len(f) + 1)
        np.cumsum(w[f], out=total[1:], dtype=np.float64)
        size = np.maximum(1, np.diff(bounds))
        m = (total[bounds[1:]] - total[bounds[:-1]]) / size * SCALE + w[-1]
        blank = np.diff(bounds) == 0
        out[at : at + n] = np.where(blank, 1.0, 1 / (1 + np.exp(-np.clip(m, -35, 35))))
    return np.round(out, 6)


def score(docs: DataFrame, w: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``quality_score`` (probability of good quality) and ``quality_keep``."""
    model = docs.sparkSession.sparkContext.broadcast(w)

    @F.arrow_udf("double")
    def prob(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(probabilities(b, model.value))

    s = C.free_name(docs, "quality_score")
    k = C.free_name(docs, "quality_keep")
    return docs.withColumn(s, prob("text")).withColumn(k, F.col(s) >= threshold)


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Only the rows that the classifier keeps, with the columns of ``docs``."""
    scored = score(docs, train(spark, docs, labels), threshold)
    return scored.where(F.col(scored.columns[-1])).select(*docs.columns)
