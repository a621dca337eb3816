"""WARC archives with a Merkle fixity audit.

``records`` turns pages into WARC/1.1 records, ordered by id and cut into volumes of consecutive ids; a record's
offset is the sum of the lengths before it in its volume. ``write`` stores the records as .warc files, ``read``
parses such files. ``tree`` hashes every record (SHA-256) and then ordered ranges: those of FAN consecutive ids, of FAN such
ranges, and so on up to a volume, and the root over all volumes. A range's hash takes its children's hashes, lengths and offsets from
its own begin, and belongs to a range of ids, so a lost or added record changes its own branch alone. ``audit`` compares two
replicas' roots and descends only branches that differ: a level's nodes are joined only under differing parents,
down to the records that are corrupt, missing or extra.

Ids of over CROWD rows, and rows without an id if there are so many, leave their volume for sections by digest, so that no
volume grows with the table; equal records count as one with copies.

Defined results: a page with a null or empty body is a record with an empty body; null url counts as empty. Rows with a null id
form volume -1 in sections below 0. Rows of one id are ordered by url and digest; equal rows are equal records, each with
its own place. Very long bodies are hashed, written and read whole. Extra columns are ignored. An empty table has no nodes, and two
empty replicas agree. A record with another digest for the same id is corrupt; one of several of an id is told by its digest; if
only copies are lost or added, the record is missing or extra.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm import common as C

#: Ids of a volume, children of a node, and rows of an id that stay in their volume.
VOLUME, FAN, CROWD = 4096, 16, 64
LEVELS = 3
RECORDS = "page_id long, length long, digest string, url string"


def record_column() -> F.Column:
    """The bytes of a page's record, from columns page_id, url and html."""
    body = F.coalesce(F.encode("html", "utf-8"), F.lit(b""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.regexp_replace("url", "[\r\n]", " "), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "utf-8"), body, F.lit(b"\r\n\r\n"))


def hashed(pages: DataFrame) -> DataFrame:
    """(page_id, url, length, digest) of every record: the bodies are hashed where they are read, and not moved."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), record_column().alias("r"))
    return own.select("page_id", F.length("r").cast("long").alias("length"), F.sha2("r", 256).alias("digest"), "url")


def crowds(records: DataFrame) -> DataFrame:
    """(page_id, sections) of the ids, null among them, that have over CROWD rows."""
    n = records.groupBy("page_id").agg(F.count("*").alias("n")).where(F.col("n") > CROWD)
    return C.materialize(n.select("page_id", F.pow(F.lit(2), F.ceil(F.log2(F.col("n") / CROWD))).cast("int").alias("sections")), "warc-crowds")


def sectioned(records: DataFrame, crowd: DataFrame) -> DataFrame:
    """(volume, section, slot, page_id, url, length, digest, copies): every distinct record and its place in the tree."""
    own = records.groupBy("page_id", "url", "length", "digest").agg(F.count("*").alias("copies"))
    c = crowd.select(F.col("page_id").alias("_id"), "sections")
    own = own.join(c, F.col("page_id").eqNullSafe(F.col("_id")), "left")
    at = F.pmod(F.xxhash64("digest"), F.col("sections"))
    section = F.when(F.col("page_id").isNull(), -1 - F.coalesce(at, F.lit(0))).otherwise(F.coalesce(at + 1, F.lit(0))).cast("int")
    slot = F.when(section == 0, F.floor(F.pmod("page_id", F.lit(VOLUME)) / FAN)).otherwise(F.conv(F.substring("digest", 1, 2), 16, 10)).cast("int")
    return own.select(F.coalesce(F.floor(F.col("page_id") / VOLUME), F.lit(-1)).cast("long").alias("volume"), section.alias("section"), slot.alias("slot"), "page_id", "url", "length", "digest", "copies")


def placed(sections: DataFrame) -> DataFrame:
    """Adds seq (place of the first copy in the section) and offset. Sections bound every window's rows, whatever the table's size."""
    w = Window.partitionBy("volume", "section").orderBy("slot", "page_id", "url", "digest", "length")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    return sections.withColumn("seq", so_far(F.col("copies"))).withColumn("offset", so_far(F.col("copies") * F.col("length")))


def tree(places: DataFrame) -> DataFrame:
    """(volume, section, level, node, page_id, url, copies, offset, length, digest): level 0 the records, level LEVELS a whole volume's
    section. A record's node is its slot; a range's is its place among those of its level."""
    leaf = places.select("volume", "section", F.lit(0).alias("level"), F.col("slot").alias("node"), "page_id", "url", "copies", "offset", (F.col("length") * F.col("copies")).alias("length"), "digest")
    levels, below = [leaf], leaf.withColumn("up", F.col("node"))
    for k in range(1, LEVELS + 1):
        c = F.array_sort(F.collect_list(F.struct("offset", "page_id", "url", "digest", "length", "copies")))
        up = below.groupBy("volume", "section", "up").agg(c.alias("c"), F.min("offset").alias("offset"), F.sum("length").alias("length"))
        line = lambda x: F.concat_ws(":", (x["offset"] - F.col("offset")).cast("string"), x["length"].cast("string"), x["copies"].cast("string"), x["digest"])
        none = F.lit(None)
        up = up.select("volume", "section", F.lit(k).alias("level"), F.col("up").alias("node"), none.cast("long").alias("page_id"), none.cast("string").alias("url"), F.lit(1).cast("long").alias("copies"), "offset", "length", F.sha2(F.array_join(F.transform("c", line), "\n"), 256).alias("digest"))
        levels.append(up)
        below = up.withColumn("up", F.floor(F.col("node") / FAN).cast("int") if k + 1 < LEVELS else F.lit(0))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def root(nodes: DataFrame) -> str:
    """The digest over all volumes in order, by way of VOLUME volumes each: few rows reach one task, and one digest the driver."""
    hashed_ = lambda c, line: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), line), "\n"), 256)
    top = nodes.where(F.col("level") == LEVELS).groupBy(F.floor(F.col("volume") / VOLUME).alias("v"))
    some = top.agg(hashed_(F.struct("volume", "section", "length", "digest"), lambda x: F.concat_ws(":", x["volume"].cast("string"), x["section"].cast("string"), x["length"].cast("string"), x["digest"])).alias("digest"))
    return some.agg(hashed_(F.struct("v", "digest"), lambda x: F.concat_ws(":", x["v"].cast("string"), x["digest"]))).first()[0]


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """(volume, section, page_id, digest_a, digest_b, status) of the records at which the replicas' trees differ.

    ``a`` and ``b`` are written trees. Equal roots end the audit; else one level after the other is compared, only under
    parents that differ.
    """
    kind = "volume long, section int, page_id long, digest_a string, digest_b string, status string"
    if root(a) == root(b):
        return a.sparkSession.createDataFrame([], kind)
    differ = None
    key = ["volume", "section"]
    for level in range(LEVELS, 0, -1):
        x, y = (t.where(F.col("level") == level) for t in (a, b))
        if differ is not None:
            up = F.floor(F.col("node") / FAN).cast("int") if level < LEVELS - 1 else F.lit(0)
            x, y = (t.withColumn("up", up).join(differ, [*key, "up"], "left_semi") for t in (x, y))
        both = x.select(*key, "node", F.col("digest").alias("p")).join(y.select(*key, "node", F.col("digest").alias("q")), [*key, "node"], "full")
        differ = C.materialize(both.where(~F.col("p").eqNullSafe(F.col("q"))).select(*key, F.col("node").alias("up")), "audit")
    under = lambda t: t.where("level = 0").join(differ.withColumnRenamed("up", "node"), [*key, "node"], "left_semi")
    x = under(a).select(*key, "node", F.col("page_id").alias("id"), F.col("url").alias("u"), F.col("digest").alias("d"), F.col("copies").alias("n"))
    y = under(b).select(*key, "node", F.col("page_id").alias("id"), F.col("url").alias("u"), F.col("digest").alias("d"), F.col("copies").alias("m"))
    side = x.withColumn("m", F.lit(0).cast("long")).unionByName(y.withColumn("n", F.lit(0).cast("long")))
    uneven = side.groupBy(*key, "node", "id", "u", "d").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where("n <> m")
    # What one replica alone has of an id is paired, one by one: such records are corrupt.
    alone = F.when(F.col("m") == 0, 1).when(F.col("n") == 0, 2).otherwise(3)
    w = Window.partitionBy(*key, "node", "id", "side").orderBy("d", "u")
    told = uneven.withColumn("side", alone).withColumn("k", F.row_number().over(w))
    one = told.where("side = 1 AND id IS NOT NULL").select(*key, "id", "k", F.col("d").alias("digest_a"))
    two = told.where("side = 2 AND id IS NOT NULL").select(*key, "id", "k", F.col("d").alias("digest_b"))
    pairs = one.join(two, [*key, "id", "k"], "full").select(*key, "id", "digest_a", "digest_b", F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("corrupt").alias("status"))
    has = lambda c, m: F.when(F.col(m) > 0, F.col(c))
    rest = told.where("side = 3 OR id IS NULL").select(*key, "id", has("d", "n").alias("digest_a"), has("d", "m").alias("digest_b"), F.when(F.col("n") > F.col("m"), "missing").otherwise("extra").alias("status"))
    return C.materialize(pairs.unionAll(rest).withColumnRenamed("id", "page_id"), "audit")


def _store(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    fs, base = pafs.FileSystem.from_uri(path)
    part = TaskContext.get().partitionId()
    own, name = f"{base}/.{part:06d}-{uuid.uuid4().hex}", f"part-{part:06d}.warc"
    n = size = 0
    with fs.open_output_stream(own) as out:
        for b in batches:
            for r in b.column("r"):
                raw = r.as_buffer()
                out.write(raw)
                n += 1
                size += raw.size
    fs.move(own, f"{base}/{name}")
    yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])


def write(pages: DataFrame, path: str) -> DataFrame:
    """Writes every task's records to one .warc file, renamed when whole; returns (file, records, bytes)."""
    fs, base = pafs.FileSystem.from_uri(path)
    fs.create_dir(base, recursive=True)
    return C.materialize(pages.select(record_column().alias("r")).mapInArrow(lambda it: _store(it, path), "file string, records long, bytes long"), "warc-files")


_ID = re.compile(rb"WARC-Record-ID: <urn:page:(none|-?\d+)>")
_URI = re.compile(rb"WARC-Target-URI: ([^\r\n]*)")
_LENGTH = re.compile(rb"Content-Length: (\d+)")


class _Reader:
    """A stream with some bytes ahead, to find the end of a head in."""

    def __init__(self, stream, size: int = 1 << 20) -> None:
        self.stream, self.size, self.held = stream, size, b""

    def upto(self, mark: bytes) -> bytes:
        """The bytes through the next ``mark``; what is left if there is none."""
        looked = 0
        while (k := self.held.find(mark, max(0, looked - len(mark)))) < 0:
            looked = len(self.held)
            more = self.stream.read(self.size)
            if not more:
                out, self.held = self.held, b""
                return out
            self.held += more
        out, self.held = self.held[: k + len(mark)], self.held[k + len(mark) :]
        return out

    def exactly(self, n: int) -> bytes:
        out = self.held[:n]
        self.held = self.held[n:]
        return out if len(out) == n else out + self.stream.read(n - len(out))


def _parse(batches: Iterator[pa.RecordBatch], bodies: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name in b.column("file").to_pylist():
            fs, p = pafs.FileSystem.from_uri(name)
            rows: list[tuple] = []
            held = 0
            with fs.open_input_stream(p) as f:
                reader = _Reader(f)
                while head := reader.upto(b"\r\n\r\n"):
                    size, own, uri = _LENGTH.search(head), _ID.search(head), _URI.search(head)
                    if not head.startswith(b"WARC/1.1") or size is None or own is None or uri is None:
                        raise ValueError(f"{name}: not a record: {head[:80]!r}")
                    raw = reader.exactly(int(size[1]) + 4)
                    full = head + raw
                    rows.append((None if own[1] == b"none" else int(own[1]), len(full), hashlib.sha256(full).hexdigest(), uri[1].decode("utf-8", "replace"), raw[:-4].decode("utf-8", "replace") if bodies else None))
                    held += len(raw)
                    if held > 8 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, d, e = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c), pa.array(d), pa.array(e, pa.string())], names=["page_id", "length", "digest", "url", "html"])


def read(files: DataFrame, bodies: bool = True) -> DataFrame:
    """(page_id, length, digest, url, html) of the records in the files named by the column ``file``, one task a file."""
    n = max(1, files.count())
    own = files.select("file").repartition(n).mapInArrow(lambda it: _parse(it, bodies), RECORDS + ", html string")
    return own if bodies else own.drop("html")


def written_tree(records: DataFrame, crowd: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed records, their tree), both written."""
    places = C.materialize(placed(sectioned(records, crowd)), "warc-places")
    return places, C.materialize(tree(places), "warc-tree")


def verify_archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archives ``pages``, parses the files again and audits them against the source: every record's place and status."""
    files = write(pages, C.scratch(spark, "warc"))
    source = C.materialize(hashed(pages), "warc-source")
    crowd = crowds(source)
    places, a = written_tree(source, crowd)
    bad = audit(a, written_tree(read(files, bodies=False), crowd)[1])
    tops = a.where(F.col("level") == LEVELS).select("volume", "section", F.col("digest").alias("volume_digest"))
    found = bad.where("digest_a is not null").groupBy("volume", "section", F.col("digest_a").alias("digest")).agg(F.min("status").alias("status"))
    out = places.join(tops, ["volume", "section"]).join(found, ["volume", "section", "digest"], "left")
    # Copies come apart in blocks, so that no row holds them all.
    out = out.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / VOLUME))))
    last = F.least((F.col("block") + 1) * VOLUME, F.col("copies")) - 1
    out = out.withColumn("copy", F.explode(F.sequence(F.col("block") * VOLUME, last)))
    return out.select(
        "page_id", "volume", "section", (F.col("seq") + F.col("copy")).alias("seq"), (F.col("offset") + F.col("copy") * F.col("length")).alias("offset"),
        "length", "digest", "volume_digest", F.coalesce("status", F.lit("ok")).alias("status"),
    )


def drill(pages: DataFrame) -> DataFrame:
    """(page_id, status): what an audit finds in a replica in which records are spoilt on purpose: of ids that are 3 modulo 10 one
    letter more, of 5 lost, of 7 a second record."""
    source = C.materialize(hashed(pages), "warc-source")
    k = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10))
    more = F.concat(F.coalesce("html", F.lit("")), F.lit("q"))
    own = pages.select("page_id", "url", "html")
    spoilt = own.where(k != 5).withColumn("html", F.when(k == 3, more).otherwise(F.col("html"))).unionByName(own.where(k == 7).withColumn("html", more))
    crowd = crowds(source)
    bad = audit(written_tree(source, crowd)[1], written_tree(hashed(spoilt), crowd)[1])
    return bad.select("page_id", "status")
