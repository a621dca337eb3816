"""Token-id files: flat unsigned integers and 64-bit document offsets, to be memory-mapped.

Every task writes one ``part-N.bin`` (unsigned 16-bit ids, 32-bit for vocabularies above 65,536) in the shared folder under
a name of its own attempt, renamed when whole, so a task that runs again replaces equal bytes. Prefix sums over the
parts' token totals give each part's base, and ``part-N.idx`` holds the documents' offsets in the concatenation
of all parts: one 64-bit number a document and one more for the end.

Defined results: null and empty texts take no token but have an offset; rows with a null id, repeated rows and
repeated ids are written like all others, in the order of their part. Extra columns are ignored. An empty table
gives files without a token or none at all, and no rows.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm import common as C
from lexiloom.llm.tokens import VOCABULARY, Encoder

OFFSETS = "part int, row int, doc_id long, start long, n_tokens int, crc long"


def _write(batches: Iterator[pa.RecordBatch], path: str, vocabulary: str) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(vocabulary)
    kind = np.dtype("<u2" if len(encoder.spaced) <= 1 << 16 else "<u4")
    part = TaskContext.get().partitionId()
    fs, root = pafs.FileSystem.from_uri(path)
    own = f"{root}/.part-{part:06d}-{uuid.uuid4().hex}"
    done = row = 0
    with fs.open_output_stream(own) as out:
        for b in batches:
            ids = b.column("doc_id")
            for at, tokens, bounds in encoder.slices(b.column("text")):
                out.write(tokens.astype(kind).tobytes())
                n = len(bounds) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n, dtype=np.int32)), ids.slice(at, n), pa.array(bounds[:-1] + done), pa.array(np.diff(bounds).astype(np.int32))],
                    names=["part", "row", "doc_id", "local", "n_tokens"],
                )
                done += len(tokens)
                row += n
    fs.move(own, f"{root}/part-{part:06d}.bin")


def _index(key: tuple, t: pa.Table, path: str, width: int) -> pa.Table:
    """Writes a part's offsets and reads its ids back through the memory map, for a checksum of every document."""
    t = t.sort_by("row")
    part, start, n = int(key[0].as_py()), t.column("start").to_numpy(), t.column("n_tokens").to_numpy().astype(np.int64)
    fs, root = pafs.FileSystem.from_uri(path)
    own = f"{root}/.idx-{part:06d}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(np.r_[start, start[-1] + n[-1]].astype("<i8").tobytes())
    fs.move(own, f"{root}/part-{part:06d}.idx")
    local = (start - start[0]) * width
    with fs.open_input_file(f"{root}/part-{part:06d}.bin") as f:
        if f.size() != local[-1] + n[-1] * width:
            raise OSError(f"part {part} has {f.size()} bytes")
    if C.local_path(path) != path or path.startswith("/"):
        data = np.memmap(f"{C.local_path(path)}/part-{part:06d}.bin", np.uint8, "r") if local[-1] + n[-1] else np.zeros(0, np.uint8)
    else:
        with fs.open_input_stream(f"{root}/part-{part:06d}.bin") as f:
            data = np.frombuffer(f.read(), np.uint8)
    crc = [zlib.crc32(data[s:e]) for s, e in zip(local.tolist(), (local + n * width).tolist())]
    return t.append_column("crc", pa.array(crc, pa.int64()))


def write(docs: DataFrame, path: str, vocabulary: str | None = None) -> DataFrame:
    """Writes the files to ``path`` (a URI that all executors share) and returns one row a document."""
    spark = docs.sparkSession
    vocabulary = vocabulary or C.tokenizer_path(VOCABULARY)
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    width = 2 if len(Encoder(vocabulary).spaced) <= 1 << 16 else 4
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _write(it, path, vocabulary), "part int, row int, doc_id long, local long, n_tokens int")
    rows = C.materialize(own, "token-rows")
    totals = rows.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("total"), F.count("*").alias("docs"))
    # One row a part: small enough for one task.
    bases = C.materialize(totals.withColumn("base", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "token-bases")
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"width": width, "parts": [r.asDict() for r in bases.orderBy("part").collect()]}).encode())
    placed = rows.join(C.checked_broadcast(bases.select("part", "base"), bases.count()), "part").select("part", "row", "doc_id", (F.col("local") + F.col("base")).alias("start"), "n_tokens")
    return placed.groupBy("part").applyInArrow(lambda k, t: _index(k, t, path, width), OFFSETS)


class TokenFiles:
    """Random access to written files: document ``i`` of the whole, by memory maps that open on demand."""

    def __init__(self, path: str) -> None:
        self.root = C.local_path(path)
        with open(f"{self.root}/manifest.json") as f:
            m = json.load(f)
        self.kind = np.dtype("<u2" if m["width"] == 2 else "<u4")
        self.parts = m["parts"]
        self.first = np.cumsum([0] + [p["docs"] for p in self.parts])
        self.maps: dict[int, tuple] = {}

    def __len__(self) -> int:
        return int(self.first[-1])

    def __getitem__(self, i: int) -> np.ndarray:
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = int(np.searchsorted(self.first, i, "right")) - 1
        if k not in self.maps:
            name = f"{self.root}/part-{self.parts[k]['part']:06d}"
            ids = np.memmap(f"{name}.bin", self.kind, "r") if self.parts[k]["total"] else np.zeros(0, self.kind)
            self.maps[k] = ids, np.memmap(f"{name}.idx", "<i8", "r")
        ids, at = self.maps[k]
        s, e = at[i - self.first[k] : i - self.first[k] + 2] - self.parts[k]["base"]
        return ids[s:e]
