"""Media columns: content-defined chunking of payloads, deduplicated by Spark joins, rebuilt and verified.

A gear hash rolls over every payload; it depends on the last 32 bytes alone, so it is computed for all bytes of a slice at
once by doubling. A chunk ends where the hash's top bits are zero, not before ``LEAST`` bytes and at ``MOST`` at the
latest, so an insertion moves only the cuts near it. Each distinct chunk (by SHA-256) is owned by the first place of
the payload of least digest that holds it; a payload's ordered chunk list names chunks and owners.

Every payload is rebuilt from its list and hashed again, chunk by chunk and as a whole; that alone sets ``verified``. One
that owns all its chunks is rebuilt from its own bytes, which meet its list. For one with foreign chunks, pieces are cut
from their owners, joined by place and put in order. Payloads are shuffled as Zstandard blocks, each by itself.

Defined results: a null payload has null digest, no chunks and null ``verified``; an empty payload has no chunk and verifies. Equal payloads share one list.
Rows keep null and repeated ids. A very long payload is cut and rebuilt
whole. Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import common as C

LEAST, AVERAGE_BITS, MOST = 256, 10, 8192
_GEAR = (C.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
CHUNKS = "media binary, seq int, at long, length int, digest binary"


def gear_cuts(data: np.ndarray, bits: int = AVERAGE_BITS) -> np.ndarray:
    """Ends of chunks that the rolling hash proposes: sum over the last 32 bytes of gear[byte] << age."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1


def chunk_ends(length: int, proposed: list[int], least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of a payload's chunks; ``proposed`` ascends."""
    ends, at, k = [], 0, 0
    while at < length:
        k = bisect_left(proposed, at + least, k)
        end = min(length, at + most, proposed[k] if k < len(proposed) else length)
        ends.append(end)
        at = end
    return ends


def chunks_of(payload: bytes) -> list[tuple[int, int]]:
    """(start, end) of a payload's chunks."""
    ends = chunk_ends(len(payload), gear_cuts(np.frombuffer(payload, np.uint8)).tolist())
    return list(zip([0, *ends], ends))


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        column = b.column("payload").cast(pa.large_binary())
        media = b.column("media").to_pylist()
        for at, n, data, offsets in C.text_slices(column.view(pa.large_string())):
            cuts = gear_cuts(data)
            bounds = np.searchsorted(cuts, offsets, "right")
            raw = memoryview(data)
            out: tuple[list, ...] = ([], [], [], [], [])
            for i in range(n):
                s, e = int(offsets[i]), int(offsets[i + 1])
                start = 0
                for k, end in enumerate(chunk_ends(e - s, (cuts[bounds[i] : bounds[i + 1]] - s).tolist())):
                    for x, v in zip(out, (media[at + i], k, start, end - start, hashlib.sha256(raw[s + start : s + end]).digest())):
                        x.append(v)
                    start = end
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary())], names=["media", "seq", "at", "length", "digest"])


def _payloads(rows: DataFrame, column: str, id_column: str | None = None) -> DataFrame:
    """(id, payload, media): only these columns, so that no other one's name matters."""
    payload = F.col(column) if dict(rows.dtypes)[column] == "binary" else F.encode(column, "utf-8")
    return rows.select(*([F.col(id_column).alias("id")] if id_column else []), payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("media"))


def chunk_lists(rows: DataFrame, column: str = "html") -> DataFrame:
    """(media, seq, at, length, digest, owner, owner_at): every distinct payload's ordered chunks and their owners. They are
    joined from a written step, which ``discard`` of the result deletes."""
    own = _payloads(rows, column).where("payload is not null")
    # Equal payloads give equal rows, which meet here; bytes stay where they are.
    cut = own.mapInArrow(_chunked, CHUNKS)
    chunks = C.materialize(cut.dropDuplicates(["media", "seq"]), "chunks", tight=True)
    owners = chunks.groupBy("digest").agg(F.min(F.struct("media", "at")).alias("o"))
    out = chunks.join(owners, "digest").select("media", "seq", "at", "length", "digest", F.col("o.media").alias("owner"), F.col("o.at").alias("owner_at"))
    out._scratch = chunks._scratch
    return out


def by_media(lists: DataFrame) -> DataFrame:
    """(media, chunks, foreign): a row for each payload with its chunks in order; ``foreign`` if any has another owner."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "owner", "owner_at", "length", "digest")))
    return C.materialize(lists.groupBy("media").agg(ordered.alias("chunks"), F.max(F.col("media") != F.col("owner")).alias("foreign")), "chunk-lists", tight=True)


def _joined(media: bytes, parts: list[bytes | None], digests: list[bytes]) -> bytes | None:
    """The parts in one, if each has its digest and all of them the payload's; otherwise None."""
    if any(p is None or hashlib.sha256(p).digest() != d for p, d in zip(parts, digests)):
        return None
    whole = b"".join(parts)
    return whole if hashlib.sha256(whole).digest() == media else None


def _few(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads as compressed blocks with their sizes."""
    codec = pa.Codec("zstd")
    for b in _few(batches):
        payloads = [p.as_buffer() for p in b.column("payload")]
        yield pa.RecordBatch.from_arrays([b.column("media"), pa.array([p.size for p in payloads], pa.int64()), pa.array([codec.compress(p, asbytes=True) for p in payloads], pa.binary())], names=["media", "size", "packed"])


def _cut_out(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    """Payloads that own all their chunks, rebuilt in place (``at`` is null), and the pieces that others need."""
    codec = pa.Codec("zstd")
    for b in _few(batches):
        out: tuple[list, ...] = ([], [], [], [], [])
        for media, size, packed, chunks, cuts in zip(*(b.column(c).to_pylist() for c in ("media", "size", "packed", "chunks", "cuts"))):
            payload = codec.decompress(packed, size, asbytes=True)
            if chunks is not None:
                whole = _joined(media, [payload[c["owner_at"] : c["owner_at"] + c["length"]] for c in chunks], [c["digest"] for c in chunks])
                for x, v in zip(out, (media, None, None, whole if keep else None, whole is not None)):
                    x.append(v)
            for c in cuts or ():
                for x, v in zip(out, (media, c["owner_at"], c["length"], payload[c["owner_at"] : c["owner_at"] + c["length"]], None)):
                    x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()))], names=["media", "at", "length", "bytes", "verified"])


def _put_together(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    for b in _few(batches):
        media = b.column("media").to_pylist()
        whole = [_joined(m, [p["bytes"] for p in ps], [p["digest"] for p in ps]) for m, ps in zip(media, b.column("parts").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("media"), pa.array(whole if keep else [None] * len(whole), pa.binary()), pa.array([w is not None for w in whole], pa.bool_())], names=["media", "payload", "verified"])


def _rebuilt(rows: DataFrame, each: DataFrame, column: str, keep: bool) -> DataFrame:
    own = each.where("not foreign").select("media", "chunks")
    wanted = each.where("foreign").select("media", F.inline("chunks"))
    cuts = wanted.groupBy(F.col("owner").alias("media")).agg(F.collect_set(F.struct("owner_at", "length")).alias("cuts"))
    payloads = _payloads(rows, column).where("payload is not null").mapInArrow(_packed, "media binary, size long, packed binary")
    # The only step that moves payloads: each meets its own list and what others need of it.
    met = payloads.join(own.join(cuts, "media", "full"), "media").select("media", "size", "packed", "chunks", "cuts")
    got = C.materialize(met.mapInArrow(lambda it: _cut_out(it, keep), "media binary, at long, length int, bytes binary, verified boolean"), "cut", tight=True)
    mine = got.where("at is null").dropDuplicates(["media"]).select("media", F.col("bytes").alias("payload"), "verified")
    pieces = got.where("at is not null").select(F.col("media").alias("owner"), F.col("at").alias("owner_at"), "length", "bytes").dropDuplicates(["owner", "owner_at", "length"])
    parts = wanted.join(pieces, ["owner", "owner_at", "length"], "left").groupBy("media").agg(F.array_sort(F.collect_list(F.struct("seq", "digest", "bytes"))).alias("parts"))
    return mine.unionAll(parts.mapInArrow(lambda it: _put_together(it, keep), "media binary, payload binary, verified boolean"))


def rebuilt(rows: DataFrame, lists: DataFrame, column: str = "html") -> DataFrame:
    """(media, payload, verified) of every distinct payload that has chunks, put together from its list in the list's order."""
    return _rebuilt(rows, by_media(lists), column, True)


def deduplicated(rows: DataFrame, id_column: str = "page_id", column: str = "html") -> DataFrame:
    """One row a payload: its digest, size, ordered chunk list (digest, length, owner's digest), own chunks, verification."""
    lists = chunk_lists(rows, column)
    each = by_media(lists)
    C.discard(lists)
    ok = _rebuilt(rows, each, column, False).select("media", "verified")
    media = each.join(ok, "media", "left").select("media", F.col("chunks").alias("c"), "verified")
    mine = _payloads(rows, column, id_column).select("id", "media", F.length("payload").cast("long").alias("n_bytes"))
    out = mine.join(media, "media", "left")
    none = F.when(F.col("media").isNotNull(), 0)
    chunks = F.transform("c", lambda x: F.struct(F.lower(F.hex(x["digest"])).alias("digest"), x["length"].alias("length"), F.lower(F.hex(x["owner"])).alias("owner")))
    own_chunks = F.size(F.filter("c", lambda x: x["owner"] == F.col("media")))
    return out.select(
        F.col("id").alias(id_column), F.lower(F.hex("media")).alias("media"), "n_bytes",
        F.coalesce(F.size("c"), none).alias("n_chunks"), F.coalesce(own_chunks, none).alias("own_chunks"), chunks.alias("chunks"),
        F.when(F.col("n_bytes") == 0, True).when(F.col("media").isNotNull(), F.coalesce("verified", F.lit(False))).alias("verified"),
    )
