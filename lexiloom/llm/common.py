"""Helpers that the training-data operators share: tables, scratch space, names, hashed words, components."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text is taken in slices of about this many bytes, so that a worker's memory doesn't depend on the batch.
SLICE_BYTES = 1 << 20
_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where it is unset (tests) a local one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexiloom-"))
    return jsc.getCheckpointDir().get()


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/lexiloom-{what}-{uuid.uuid4().hex}"


def local_path(path: str) -> str:
    """A mounted shared folder's path without the file: scheme, for plain file access."""
    return path[len("file:") :].replace("//", "/", 1) if path.startswith("file:") else path


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession):
    """A query that ends herein deletes its shuffle files at once, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def materialize(df: DataFrame, what: str = "step", tight: bool = False) -> DataFrame:
    """Writes the rows as Parquet in the shared folder and reads them back: lineage ends, executors may be lost.
    ``tight``: in fewer bytes (Zstandard), and without leaving shuffle files."""
    spark = df.sparkSession
    path = scratch(spark, what)
    with _shuffles_dropped(spark) if tight else contextlib.nullcontext():
        df.write.parquet(path, compression="zstd" if tight else None)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def trimmed(made):
    """What a worker makes, rows or one table; then freed memory goes back to the system, as workers serve later stages too."""

    def trim() -> None:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    def batches():
        yield from made
        trim()

    if isinstance(made, pa.Table):
        trim()
        return made
    return batches()


def discard(df: DataFrame) -> None:
    """Deletes what ``materialize`` wrote, if it did, once nothing reads it any more."""
    if getattr(df, "_scratch", None) is None:
        return
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes of the fixed-width types; rows of any other type have no bound, and aren't broadcast.
_WIDTH = {"boolean": 8, "int": 8, "bigint": 8, "double": 8}


def checked_broadcast(df: DataFrame, rows: int, most: int = 64 << 20) -> DataFrame:
    """A broadcast hint only for a side of fixed-width columns whose counted rows take at most ``most`` bytes; otherwise
    Spark picks a shuffled join."""
    widths = [_WIDTH.get(kind) for _, kind in df.dtypes]
    return F.broadcast(df) if None not in widths and rows * (16 + sum(widths)) <= most else df


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << max(16, (n - 1).bit_length())
            inverse = pow(_MULT, -1, 1 << 64)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _MULT, np.uint64)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, inverse, np.uint64)], dtype=np.uint64)
        return self.up, self.down


_powers = _Powers()
_byte_keys = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A contiguous large_string array; nulls stay null and count as empty text in what follows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string())


def text_slices(column: pa.Array):
    """Yields (first row, number of rows, bytes, offsets): whole texts, about SLICE_BYTES at a time."""
    column = strings(column)
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to - at, whole[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


#: 0 white space and controls, 1 ASCII letters, digits and all bytes of other scripts, 2 symbols.
BYTE_KIND = np.array([0 if b <= 32 or b == 127 else 1 if b >= 128 or chr(b).isalnum() or b == 95 else 2 for b in range(256)], np.uint8)


def token_spans(data: np.ndarray, offsets: np.ndarray, by_kind: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts: runs between white space, with ``by_kind`` also cut where letters meet symbols."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = BYTE_KIND[data] if by_kind else (BYTE_KIND[data] > 0).view(np.uint8)
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[offsets] = True
    cut = np.flatnonzero(edge)
    word = kind[cut[:-1]] > 0
    return cut[:-1][word], cut[1:][word]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, wherever it lies: differences of a running polynomial sum, taken over
    stretches that fit the processor's cache. Spans ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + 65536, "right")))
        part = data[base : int(ends[hi - 1])]
        up, down = _powers.upto(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_byte_keys[part] * up[: len(part)], out=total[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        lo = hi
    return mix(out)


def per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bounds of each text's words among the words of all."""
    return np.searchsorted(starts, offsets, "left")


def expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with j from first[i] up, count[i] of them."""
    i = np.repeat(np.arange(len(count)), count)
    ends = np.cumsum(count)
    return i, np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count) + first[i]


def group_ends(*keys: np.ndarray) -> np.ndarray:
    """The end of each element's run of equal keys."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    head = np.flatnonzero(new)
    return np.repeat(np.r_[head[1:], n], np.diff(np.r_[head, n]))


def cuts(count: np.ndarray, most: int):
    """Stretches of elements whose counts add up to about ``most``."""
    total = np.cumsum(count)
    lo = 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable over the edges (a, b), by alternating large and small stars.

    Every round is written to the shared folder, so that lineage stays short and lost executors cost one round.
    Nulls and self-loops give no edge. An id without an edge isn't in the result.
    """
    now = materialize(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def summary(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    before = summary(now)
    while before[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        last, now = now, materialize(small, "stars")
        discard(last)
        after = summary(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def tokenizer_path(name: str) -> str:
    """A public vocabulary file. LEXILOOM_TOKENIZERS names the folder; it is never copied."""
    return os.path.join(os.environ.get("LEXILOOM_TOKENIZERS", "/opt/tokenizers"), name)


def whole_runs(batches, keys: list[str]):
    """Record batches, sorted by ``keys``, regrouped into tables of whole runs: rows that share all keys stay together."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t])
        n = t.num_rows
        if not n:
            continue
        last = [t.column(k)[n - 1] for k in keys]
        same = np.ones(n, bool)
        for k, v in zip(keys, last):
            same &= pc.equal(t.column(k), v).to_numpy(zero_copy_only=False)
        start = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if start:
            yield t.slice(0, start)
        held = t.slice(start)
    if held is not None and held.num_rows:
        yield held
