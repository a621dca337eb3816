"""Packing by power-of-two decomposition: every document is cut into pieces of binary lengths, bucketed by length.

A document of L tokens gives L // MAX pieces of MAX tokens and then one piece for each set bit of the rest, longest
first. So no piece holds tokens of two documents, none is padded, and no token is lost. Pieces of one bucket
have equal lengths and are batched together; ``order_key`` is a seeded hash that mixes a bucket's pieces
without a global sort.

Defined results: null and empty texts have no token and give no piece. Rows with a null id give pieces with a null
id; repeated rows give their pieces again. Extra columns don't reach the pieces. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import common as C
from lexiloom.llm.tokens import VOCABULARY, Encoder

MAX_LENGTH = 8192
PIECES = "doc_id long, piece int, start long, length int, bucket int, tokens array<int>"


def decompose(lengths: np.ndarray, most: int = MAX_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(document of each piece, its length), documents in order and their pieces from first to last token."""
    assert most & (most - 1) == 0
    bits = most.bit_length() - 1
    powers = np.r_[most, 1 << np.arange(bits - 1, -1, -1)].astype(np.int64)
    times = np.c_[lengths // most, (lengths[:, None] >> np.arange(bits - 1, -1, -1)) & 1]
    flat = times.ravel()
    return np.repeat(np.repeat(np.arange(len(lengths)), bits + 1), flat), np.repeat(np.tile(powers, len(lengths)), flat)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, most: int) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(path)
    for b in batches:
        ids = b.column("doc_id")
        for at, tokens, bounds in encoder.slices(b.column("text")):
            doc, length = decompose(np.diff(bounds), most)
            ends = np.r_[0, np.cumsum(length)]
            first = np.searchsorted(doc, np.arange(len(bounds) - 1), "left")
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(doc + at)),
                    pa.array((np.arange(len(doc)) - first[doc]).astype(np.int32)),
                    pa.array(ends[:-1] - bounds[:-1][doc]),
                    pa.array(length.astype(np.int32)),
                    pa.array(np.log2(length).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens)),
                ],
                names=["doc_id", "piece", "start", "length", "bucket", "tokens"],
            )


def pack(docs: DataFrame, vocabulary: str | None = None, most: int = MAX_LENGTH, seed: int = 17) -> DataFrame:
    """One row for each piece; no shuffle, as a bucket is a column to write or batch by."""
    path = vocabulary or C.tokenizer_path(VOCABULARY)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: C.trimmed(_pieces(it, path, most)), PIECES)
    return own.withColumn("order_key", F.xxhash64("doc_id", "piece", F.lit(seed)))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Parquet with one folder for each length, from which equal lengths are batched."""
    pieces.write.partitionBy("bucket").parquet(path)
