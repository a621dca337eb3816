"""Online training of sparse binary classifiers: Perceptron and Passive-Aggressive updates, linear or polynomial kernel.

``train_linear`` is exact: updates depend on the order of examples, so one task takes them all, sorted. ``train_mixed`` is
for corpora beyond that: every partition trains by itself and the weights are averaged after each epoch; its result is
another one than the exact training's.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.expressions import kernel_coefficients
from lexiloom.sources.store import scratch

VARIANTS = ("P", "PA", "PA-I", "PA-II")


def step(variant: str, margin: float, active: int, c: float = 1.0) -> float | None:
    """The step for an example of this margin and number of features; None where there is no update."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown update {variant!r}")
    if margin > (0.0 if variant == "P" else 1.0) or active == 0:
        return None
    loss = 1.0 - margin
    return {"P": 1.0, "PA": loss / active, "PA-I": min(c, loss / active), "PA-II": loss / (active + 1 / (2 * c))}[variant]


Examples = list[tuple[int, np.ndarray]]


def _order(examples: Examples, shuffle: int | None) -> Examples:
    """The examples as they are, or mixed once by a seed."""
    return examples if shuffle is None else [examples[k] for k in np.random.default_rng(shuffle).permutation(len(examples))]


def fit_linear(
    examples: Examples, variant: str = "PA-I", c: float = 1.0, epochs: int = 10, average: bool = True, start: dict[int, float] | None = None,
    shuffle: int | None = None, test: Examples | None = None, told: list[tuple[int, int]] | None = None,
) -> dict[int, float]:
    """Weights by online updates, from ``start`` on. Averaged ones are what the weights were on average over all steps.

    ``shuffle`` mixes the examples once. With ``test``, each epoch appends (right answers, examples) of its weights to ``told``.
    """
    w: dict[int, float] = dict(start or {})
    late: dict[int, float] = {}
    seen = 0
    own = _order(examples, shuffle)

    def now() -> dict[int, float]:
        return {f: x - late.get(f, 0.0) / (seen + 1) for f, x in w.items()} if average else w

    for _ in range(epochs):
        for y, fv in own:
            seen += 1
            fs = fv.tolist() if hasattr(fv, "tolist") else list(fv)
            tau = step(variant, y * sum(w.get(f, 0.0) for f in fs), len(fs), c)
            if tau is not None:
                for f in fs:
                    w[f] = w.get(f, 0.0) + y * tau
                    late[f] = late.get(f, 0.0) + y * tau * seen
        if test is not None and told is not None:
            mean = now()
            told.append((sum((sum(mean.get(f, 0.0) for f in fv) >= 0) == (y > 0) for y, fv in test), len(test)))
    return now()


def fit_kernel(examples: Examples, variant: str = "PA-I", c: float = 1.0, epochs: int = 10, degree: int = 2, s: int = 1, r: int = 1, average: bool = False, shuffle: int | None = None) -> dict[tuple[int, ...], float]:
    """Support vectors by their features; repeated ones share one entry. Margins come from expanded weights.

    With ``average`` the alphas are what they were on average over all steps; the learner itself goes on with the last ones."""
    weight = kernel_coefficients(degree, s, r)
    alpha: dict[tuple[int, ...], float] = {}
    late: dict[tuple[int, ...], float] = {}
    combo: dict[tuple[int, ...], float] = {}
    total, seen = 0.0, 0
    own = _order(examples, shuffle)
    for _ in range(epochs):
        for y, fv in own:
            seen += 1
            fs = tuple(sorted(fv))
            parts = [(t, k) for k in range(1, degree + 1) for t in combinations(fs, k)]
            m = y * (weight[0] * total + sum(weight[k] * combo.get(t, 0.0) for t, k in parts))
            tau = step(variant, m, len(fs), c)
            if tau is not None:
                alpha[fs] = alpha.get(fs, 0.0) + y * tau
                late[fs] = late.get(fs, 0.0) + y * tau * seen
                total += y * tau
                for t, _ in parts:
                    combo[t] = combo.get(t, 0.0) + y * tau
    return {v: a - late[v] / (seen + 1) for v, a in alpha.items()} if average else alpha


def number_features(examples: Examples, known: dict[int, int] | None = None) -> tuple[Examples, dict[int, int]]:
    """(examples with features by number, the numbers): a feature gets the next number, from 1, when it is first seen."""
    numbers = dict(known or {})
    out = [(y, np.sort([numbers.setdefault(int(f), len(numbers) + 1) for f in fv])) for y, fv in examples]
    return out, numbers


def _all(examples: DataFrame) -> DataFrame:
    return examples.select("y", "fv", "pos").withColumn("_g", F.lit(0)).groupBy("_g")


def _ordered(t: pd.DataFrame) -> list[tuple[int, np.ndarray]]:
    # A place may have several parts, which come as one record.
    place = [tuple(x.values()) if isinstance(x, dict) else x for x in t["pos"]]
    t = t.iloc[sorted(range(len(t)), key=place.__getitem__)]
    return list(zip(t["y"].astype(int).tolist(), t["fv"]))


def _with(examples: DataFrame, start: DataFrame | None, test: DataFrame | None):
    """One group of examples (part 0), weights to start from (1) and test examples (2)."""
    own = examples.select("y", "fv", "pos", F.lit(0).alias("part"), F.lit(0.0).alias("w"))
    none = F.lit(None)
    if start is not None:
        own = own.unionByName(start.select(none.cast("int").alias("y"), F.array(F.col("fid").cast("long")).alias("fv"), none.cast(examples.schema["pos"].dataType).alias("pos"), F.lit(1).alias("part"), F.col("w").cast("double")))
    if test is not None:
        own = own.unionByName(test.select("y", "fv", "pos", F.lit(2).alias("part"), F.lit(0.0).alias("w")))
    return own.withColumn("_g", F.lit(0)).groupBy("_g")


def train_linear(examples: DataFrame, variant: str = "PA-I", c: float = 1.0, epochs: int = 10, average: bool = True, start: DataFrame | None = None, shuffle: int | None = None) -> DataFrame:
    """(fid, w) from examples (pos, y, fv), in the order of ``pos`` or mixed by the seed ``shuffle``, from the weights of ``start`` on.

    In order and from nothing, the one task reads sorted examples from files, block by block; otherwise it holds them all."""
    if start is None and shuffle is None:
        blocks = blocks_of(examples, 1)

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                keys, seen = _keys(blocks, 0), 0
                w, late, touched = np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys), bool)
                for _ in range(epochs):
                    seen = _stream(blocks, 0, keys, w, touched, variant, c, late, seen)
                yield from _rows(keys[touched], (w - late / (seen + 1) if average else w)[touched])

        return examples.sparkSession.range(0, 1, 1, 1).mapInArrow(stream, "fid long, w double")

    def run(t: pd.DataFrame) -> pd.DataFrame:
        before = t[t["part"] == 1]
        w = fit_linear(_ordered(t[t["part"] == 0]), variant, c, epochs, average, {int(f[0]): x for f, x in zip(before["fv"], before["w"])}, shuffle)
        return pd.DataFrame({"fid": list(w), "w": list(w.values())}).astype({"fid": "int64", "w": "float64"})

    return _with(examples, start, None).applyInPandas(run, "fid long, w double")


def learning_curve(examples: DataFrame, test: DataFrame, variant: str = "PA-I", c: float = 1.0, epochs: int = 10, average: bool = True, shuffle: int | None = None) -> DataFrame:
    """(epoch, correct, n): how many test examples the weights after each epoch get right."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        told: list[tuple[int, int]] = []
        fit_linear(_ordered(t[t["part"] == 0]), variant, c, epochs, average, None, shuffle, _ordered(t[t["part"] == 2]), told)
        return pd.DataFrame([(k + 1, *x) for k, x in enumerate(told)], columns=["epoch", "correct", "n"])

    return _with(examples, None, test).applyInPandas(run, "epoch int, correct long, n long")


def train_kernel(examples: DataFrame, variant: str = "PA-I", c: float = 1.0, epochs: int = 10, degree: int = 2, average: bool = False, shuffle: int | None = None) -> DataFrame:
    """(sv_id, alpha, fv) from examples (pos, y, fv), in the order of ``pos`` or mixed by the seed ``shuffle``."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        a = fit_kernel(_ordered(t), variant, c, epochs, degree, average=average, shuffle=shuffle)
        return pd.DataFrame({"sv_id": range(len(a)), "alpha": list(a.values()), "fv": [list(k) for k in a]}).astype({"sv_id": "int64"})

    return _all(examples).applyInPandas(run, "sv_id long, alpha double, fv array<long>")


class Blocks:
    """Examples in files of the shared folder, some thousands each, by shard and in order: what a task reads of its shard again in
    every epoch, without a shuffle and without holding more than a block."""

    def __init__(self, spark: SparkSession, shards: int) -> None:
        self.path, self.shards = scratch(spark, "examples"), shards

    def write(self, shard: int, number: int, y: np.ndarray, size: np.ndarray, fv: np.ndarray) -> None:
        fs, root = _files(self.path)
        fs.create_dir(f"{root}/{shard}", recursive=True)
        table = pa.table({"y": pa.array(y, pa.int8()), "fv": pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), pa.array(fv, pa.int64()))})
        # Another attempt writes the same; a file appears whole.
        part = f"{root}/part-{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out, pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
            to.write_table(table)
        fs.move(part, f"{root}/{shard}/{number:020d}")

    def read(self, shard: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(y, sizes, features) of the shard's blocks, in order."""
        fs, root = _files(self.path)
        for f in sorted(fs.get_file_info(pafs.FileSelector(f"{root}/{shard}", allow_not_found=True)), key=lambda f: f.base_name):
            with fs.open_input_stream(f.path) as own:
                t = pa.ipc.open_stream(own).read_all().combine_chunks()
            fv = t.column("fv").chunk(0)
            yield t.column("y").to_numpy(), fv.value_lengths().to_numpy(), fv.flatten().to_numpy()


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def blocks_of(examples: DataFrame, shards: int) -> Blocks:
    """Examples (pos, y, fv), by a hash of ``pos`` and in its order."""
    out = Blocks(examples.sparkSession, shards)
    placed = examples.select("pos", F.col("y").cast("int").alias("y"), F.col("fv").cast("array<long>").alias("fv"), F.pmod(F.xxhash64("pos"), F.lit(shards)).cast("int").alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, b in enumerate(batches, first):
            shard = b.column("shard").to_numpy()
            for k in np.unique(shard):
                own = b.filter(pa.array(shard == k))
                out.write(int(k), number, own.column("y").to_numpy(), own.column("fv").value_lengths().to_numpy(), own.column("fv").flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    placed.repartition(shards, "shard").sortWithinPartitions("shard", "pos").select("shard", "y", "fv").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return out


def _keys(blocks: Blocks, shard: int) -> np.ndarray:
    """The features of a shard, sorted."""
    parts: list[np.ndarray] = []
    for _, _, fv in blocks.read(shard):
        parts.append(np.unique(fv))
        if len(parts) > 64:
            parts = [np.unique(np.concatenate(parts))]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def _stream(blocks: Blocks, shard: int, keys: np.ndarray, w: np.ndarray, touched: np.ndarray, variant: str, c: float, late: np.ndarray | None = None, seen: int = 0) -> int:
    """One pass over a shard: ``w`` and ``touched`` by place among ``keys`` become what ``fit_linear`` makes of them, ``late`` the sum of
    updates by the steps before them; returns how many steps have been taken."""
    for y, size, fv in blocks.read(shard):
        known, code = np.unique(fv, return_inverse=True)
        at = np.searchsorted(keys, known)
        own, hit, code, end = w[at].tolist(), touched[at].tolist(), code.tolist(), 0
        behind = None if late is None else late[at].tolist()
        for sign, n in zip(y.tolist(), size.tolist()):
            seen += 1
            fs = code[end : end + n]
            end += n
            tau = step(variant, sign * sum([own[f] for f in fs]), n, c)
            if tau is not None:
                for f in fs:
                    own[f] += sign * tau
                    hit[f] = True
                if behind is not None:
                    for f in fs:
                        behind[f] += sign * tau * seen
        w[at], touched[at] = own, hit
        if late is not None:
            late[at] = behind
    return seen


def _rows(f: np.ndarray, w: np.ndarray, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(f), most):
        yield pa.RecordBatch.from_arrays([pa.array(f[a : a + most]), pa.array(w[a : a + most])], names=["fid", "w"])


def _pass(blocks: Blocks, shard: int, before: str | None, variant: str, c: float) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) after one pass over a shard, as ``fit_linear`` gives them; of ``before``, features of the shard count."""
    keys = _keys(blocks, shard)
    w, touched = np.zeros(len(keys)), np.zeros(len(keys), bool)
    if before is not None and len(keys):
        for b in ds.dataset(_files(before)[1], filesystem=_files(before)[0], format="parquet").to_batches(columns=["fid", "w"]):
            fid = b.column("fid").to_numpy()
            at = np.minimum(np.searchsorted(keys, fid), len(keys) - 1)
            hit = keys[at] == fid
            w[at[hit]], touched[at[hit]] = b.column("w").to_numpy()[hit], True
    _stream(blocks, shard, keys, w, touched, variant, c)
    return keys[touched], w[touched]


def train_blocks(spark: SparkSession, blocks: Blocks, variant: str = "PA-I", c: float = 1.0, epochs: int = 10) -> DataFrame:
    """(fid, w): every epoch each shard starts at the average and takes one pass; weights of shards are averaged."""
    weights, path, shards = spark.createDataFrame([], "fid long, w double"), None, blocks.shards
    for _ in range(epochs):

        def run(batches: Iterator[pa.RecordBatch], before: str | None = path) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in b.column("id").to_pylist():
                    yield from _rows(*_pass(blocks, k, before, variant, c))

        each = spark.range(0, shards, 1, shards).mapInArrow(run, "fid long, w double")
        path = scratch(spark, "mixed")
        each.groupBy("fid").agg((F.sum("w") / shards).alias("w")).write.parquet(path)
        weights = spark.read.schema("fid long, w double").parquet(path)
    return weights


def train_mixed(examples: DataFrame, shards: int, variant: str = "PA-I", c: float = 1.0, epochs: int = 10) -> DataFrame:
    """(fid, w) by ``train_blocks``; examples (pos, y, fv) are sorted and written once."""
    return train_blocks(examples.sparkSession, blocks_of(examples, shards), variant, c, epochs)


def merge_support(svs: DataFrame) -> DataFrame:
    """(fv, alpha): equal vectors' alphas added."""
    return svs.groupBy(F.array_sort("fv").alias("fv")).agg(F.sum("alpha").alias("alpha"))


def fit_log_linear(examples: DataFrame, features: int, l1: bool = False, strength: float = 0.01):
    """A logistic regression by Spark's own learner, with an absolute or squared penalty; not the reference's algorithm."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    # Presence flags of all numbered features, made within Spark; numbers beyond ``features`` are left out.
    have = F.map_from_arrays(F.col("fv"), F.transform("fv", lambda f: F.lit(1.0)))
    flags = F.transform(F.sequence(F.lit(0), F.lit(features - 1)), lambda k: F.coalesce(have[k.cast("long")], F.lit(0.0)))
    data = examples.select(((F.col("y") + 1) / 2).alias("label"), array_to_vector(flags).alias("features"))
    return LogisticRegression(regParam=strength, elasticNetParam=1.0 if l1 else 0.0).fit(data)


def batches_of(examples: DataFrame) -> Iterator[tuple[int, list[int]]]:
    """Examples one by one, for callers that learn outside Spark."""
    for r in examples.orderBy("pos").toLocalIterator():
        yield r["y"], r["fv"]
