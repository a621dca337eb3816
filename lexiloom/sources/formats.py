"""Text formats: annotated sentences, examples, kernel and log-linear models, converted corpora, manifests."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.sources.corpus import LAYOUTS, SENTENCE, FieldLayout

_KEY = SENTENCE


def read_sentences(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(doc_id, line_no, content): the sentences of every file, in order; each ends with a line EOS, and what
    follows the last one is dropped. Files come whole, as a sentence's end can't be told from a split's middle."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.decode("content", encoding)
    own = raw.select(F.xxhash64("path").alias("doc_id"), F.split(text, r"(?m)^EOS(?:\r?\n|\z)", -1).alias("s"))
    return own.select("doc_id", F.posexplode(F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0)))).alias("line_no", "content"))


def sniff_charset(content: bytes) -> str | None:
    """The first of the usual charsets in which the bytes decode."""
    for name in ("shift_jis", "utf-8", "euc_jp", "iso2022_jp"):
        try:
            content.decode(name)
            return name
        except UnicodeDecodeError:
            pass
    return None


def charsets(files: DataFrame) -> DataFrame:
    """Adds ``charset`` to binary files (path, content)."""

    @F.pandas_udf("string")
    def of(content: pd.Series) -> pd.Series:
        return content.map(sniff_charset)

    return files.withColumn("charset", of("content"))


def _lines(sentences: DataFrame) -> DataFrame:
    own = sentences.select(*_KEY, F.posexplode(F.split("content", "\n", -1)).alias("pos", "line"))
    return own.where((F.length("line") > 0) & (F.col("line") != "EOS"))


def _fields(line: Column, layout: FieldLayout) -> dict[str, Column]:
    """surface and the layout's fields; missing ones are empty."""
    parts = F.split(line, f"[{layout.surface_sep}]", 2)
    rest = F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), f"[{layout.feature_sep}]", -1)
    return {"surface": F.get(parts, F.lit(0))} | {f: F.coalesce(F.get(rest, F.lit(k)), F.lit("")) for k, f in enumerate(layout.fields)}


def parse_pos(sentences: DataFrame, layout: FieldLayout = LAYOUTS["dictionary"]) -> DataFrame:
    """Tokens of POS-tagged sentences: every line is a token."""
    w = Window.partitionBy(*_KEY).orderBy("pos")
    own = _lines(sentences)
    return own.select(*_KEY, (F.row_number().over(w) - 1).alias("idx"), *(c.alias(k) for k, c in _fields(F.col("line"), layout).items()))


def parse_chunked(sentences: DataFrame, layout: FieldLayout = LAYOUTS["dictionary"]) -> DataFrame:
    """Tokens of chunk-annotated sentences; ``chunk_ref`` marks tokens after a line that begins with ``*``."""
    w = Window.partitionBy(*_KEY).orderBy("pos")
    own = _lines(sentences).where(~F.col("line").startswith("#"))
    own = own.withColumn("chunk_ref", F.coalesce(F.lag("line").over(w).startswith("*"), F.lit(False))).where(~F.col("line").startswith("*"))
    return own.select(*_KEY, (F.row_number().over(w) - 1).alias("idx"), *(c.alias(k) for k, c in _fields(F.col("line"), layout).items()), "chunk_ref")


def parse_dependencies(sentences: DataFrame, layout: FieldLayout = LAYOUTS["dictionary"]) -> tuple[DataFrame, DataFrame]:
    """(tokens with their phrase ``bun``, phrases (sentence, id, did, label)) of dependency-annotated sentences."""
    w = Window.partitionBy(*_KEY).orderBy("pos")
    star = r"^\* (\d+) (-?\d+)(.?)"
    own = _lines(sentences).withColumn("star", F.col("line").rlike(star))
    own = own.withColumn("bun", (F.sum(F.col("star").cast("int")).over(w) - 1).cast("int"))
    # Comments stand before the first phrase; after it, a line that begins with # is a token's.
    own = own.where((F.col("bun") >= 0) | ~F.col("line").startswith("#"))
    heads = own.where("star").select(*_KEY, F.col("bun").alias("id"), F.regexp_extract("line", star, 2).cast("int").alias("did"), F.regexp_extract("line", star, 3).alias("label"))
    toks = own.where("not star")
    toks = toks.select(*_KEY, (F.row_number().over(w) - 1).alias("idx"), *(c.alias(k) for k, c in _fields(F.col("line"), layout).items()), "bun")
    return toks, heads


def _probability(c: Column) -> Column:
    """``@`` and six digits, as the C library prints them: a true half, which only odd 128ths are, goes to the even digit."""
    c = c.cast("double")
    return F.format_string("@%f", F.when(F.abs(c * 128) % 2 == 1, F.bround(c, 6)).otherwise(c))


def format_sentences(tokens: DataFrame, phrases: DataFrame, head: str = "did", prob: str | None = None, kind: str = "raw", headers: DataFrame | None = None) -> DataFrame:
    """(doc_id, line_no, content): ``* id headD`` before each phrase's tokens, then EOS.

    ``kind`` is what the sentences were read as: ``depnd`` adds ``@prob`` (0 without ``prob``), the gold ``did`` and its ``label``
    (D if there is none); ``chunk`` ends token lines with the predicted border ``chunk``, its ``chunk_prob`` and the gold ``chunk_ref``.
    ``headers`` (sentence, header) puts each sentence's first comment before it. Sentences without a token give no row.
    """
    if kind not in ("raw", "chunk", "depnd"):
        raise ValueError(f"unknown kind {kind!r}")
    mark = F.concat(F.lit("* "), F.col("id").cast("string"), F.lit(" "), F.col(head).cast("string"), F.lit("D"))
    if prob or kind == "depnd":
        mark = F.concat(mark, _probability(F.col(prob) if prob else F.lit(0.0)))
    if kind == "depnd":
        label = F.coalesce("label", F.lit("D")) if "label" in phrases.columns else F.lit("D")
        mark = F.concat(mark, F.lit(" "), F.col("did").cast("string"), label)
    line = F.concat(F.col("surface"), F.lit("\t"), F.concat_ws(",", "pos1", "pos2", F.lit("*"), "infl", "surface", F.lit("*")))
    if kind == "chunk":
        border = lambda c: F.when(F.col(c), "B").otherwise("I")
        sure = F.col("chunk_prob") if "chunk_prob" in tokens.columns else F.lit(0.0)
        line = F.concat(line, F.lit("\t"), border("chunk"), _probability(sure), F.lit(" "), border("chunk_ref"))
    rows = tokens.select(*_KEY, F.col("bun").alias("b"), F.col("idx").alias("i"), line.alias("l")).unionByName(phrases.select(*_KEY, F.col("id").alias("b"), F.lit(-1).alias("i"), mark.alias("l")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "i", "l"))), lambda x: x["l"]), "\n")
    out = rows.groupBy(*_KEY).agg(F.concat(body, F.lit("\nEOS\n")).alias("content"))
    if headers is None:
        return out
    first = F.concat(F.split("header", "\n")[0], F.lit("\n"))
    return out.join(headers.select(*_KEY, "header"), _KEY, "left").select(*_KEY, F.concat(F.coalesce(first, F.lit("")), "content").alias("content"))


def headers(sentences: DataFrame) -> DataFrame:
    """(sentence, header): the first line of each sentence that is a comment."""
    own = _lines(sentences).where(F.col("line").startswith("#"))
    return own.groupBy(*_KEY).agg(F.min_by("line", "pos").alias("header"))


def format_example(y: Column, fv: Column) -> Column:
    """``+1 3:1 17:1``; features ascend."""
    return F.concat_ws(" ", F.when(y > 0, "+1").otherwise("-1"), F.transform(F.array_sort(fv), lambda f: F.concat(f.cast("string"), F.lit(":1"))))


def parse_example(line: Column) -> tuple[Column, Column]:
    """(y, fv) of an example line; the values after the colons are ignored."""
    parts = F.split(F.trim(line), " +", -1)
    fv = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.split(x, ":", 2)[0].cast("long"))
    return F.when(parts[0].cast("double") > 0, 1).otherwise(-1), fv


def read_examples(spark: SparkSession, path: str, skip: str = "") -> DataFrame:
    """(y, fv) of every line that doesn't hold ``skip``."""
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    y, fv = parse_example(F.col("value"))
    return (rows.where(~F.col("value").contains(skip)) if skip else rows).select(y.alias("y"), fv.alias("fv"))


def sniff_model(head: bytes) -> str:
    """The kind of a model from its first byte."""
    first = head[:1]
    if first in (b"\0", b"#"):
        return "linear"
    if first in (b"o", b"T"):
        return "kernel"
    if first in (b"+", b"-"):
        return "loglinear"
    raise ValueError("not a model")


def read_linear_model(spark: SparkSession, path: str) -> DataFrame:
    """(fid, w) of raw little-endian doubles."""

    def rows(batches):
        for b in batches:
            for c in b["content"]:
                n = len(c) // 8
                yield pd.DataFrame({"fid": range(n), "w": struct.unpack(f"<{n}d", c[: 8 * n])})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "fid long, w double")


def write_linear_model(weights: DataFrame, path: str) -> None:
    """A dense file of raw little-endian doubles, by feature number from 0; as long as the largest number, so written by the driver
    from sorted partitions, one after the other."""
    import pyarrow.fs as pafs

    fs, where = pafs.FileSystem.from_uri(path)
    n = 0
    with fs.open_output_stream(where) as out:
        for r in weights.groupBy("fid").agg(F.sum("w").alias("w")).orderBy("fid").toLocalIterator():
            while n < r["fid"]:
                gap = min(r["fid"] - n, 1 << 16)
                out.write(bytes(8 * gap))
                n += gap
            out.write(struct.pack("<d", r["w"]))
            n += 1


def parse_kernel_model(lines: DataFrame, column: str = "value") -> tuple[dict[str, float], DataFrame]:
    """(parameters d, s, r, b; support vectors (alpha, fv)) of a text model. Its header is a few lines."""
    head = lines.where(F.col(column).contains("#"))
    names = {r[0]: r[1] for r in head.select(F.regexp_extract(column, r"# (kernel parameter -[dsr]|threshold b)", 1), F.regexp_extract(column, r"^(\S+)", 1)).collect() if r[0]}
    params = {k: float(names.get(f"kernel parameter -{k}", 1)) for k in "dsr"} | {"b": float(names.get("threshold b", 0))}
    body = lines.where(~F.col(column).contains("#") & (F.length(F.trim(column)) > 0))
    parts = F.split(F.trim(column), " +", -1)
    fv = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.split(x, ":", 2)[0].cast("long"))
    return params, body.select(parts[0].cast("double").alias("alpha"), fv.alias("fv"))


def format_kernel_model(svs: DataFrame, degree: int, s: int = 1, r: int = 1) -> DataFrame:
    """(value): the lines of a text model, the header's first."""
    spark = svs.sparkSession
    head = ["o # model", "1 # kernel type", f"{degree} # kernel parameter -d", f"{s} # kernel parameter -s", f"{r} # kernel parameter -r", "0 # threshold b"]
    line = F.concat_ws(" ", F.format_string("%.16g", F.col("alpha")), F.transform(F.array_sort("fv"), lambda f: F.concat(f.cast("string"), F.lit(":1"))))
    return spark.createDataFrame([(h,) for h in head], "value string").unionByName(svs.select(line.alias("value")))


def parse_loglinear_model(lines: DataFrame, column: str = "value") -> DataFrame:
    """(label, combo, w) of lines ``label<TAB>fn[:fn...]<TAB>weight``."""
    parts = F.split(column, "\t", -1)
    return lines.select(parts[0].alias("label"), F.array_sort(F.transform(F.split(parts[1], ":"), lambda x: x.cast("long"))).alias("combo"), parts[2].cast("double").alias("w"))


def convert_units(sentences: DataFrame, fields: tuple[int, ...] = (3, 5, 7, 9, 2, 1)) -> DataFrame:
    """(doc_id, line_no, content): sentences whose phrases (``*``) hold units (``+``) with heads among the units, with
    the units merged and heads among the phrases; a phrase's head is its last unit's. Sentences with a head that no
    unit has are dropped. ``fields`` picks a token's columns, with ``*`` as the last."""
    w = Window.partitionBy(*_KEY).orderBy("pos")
    kind = F.substring("line", 1, 1)
    own = _lines(sentences).where(~F.col("line").startswith("#")).withColumn("k", kind)
    own = own.withColumn("id", F.sum((F.col("k") == "*").cast("int")).over(w) - 1).withColumn("mark", F.col("k").isin("*", "+"))
    marks = own.where("mark").withColumn("unit", F.row_number().over(w) - 1).withColumn("h", F.split("line", " ")[1])
    units = marks.select(*_KEY, F.col("unit").cast("string").alias("unit"), F.col("id").alias("to"))
    heads = marks.groupBy(*_KEY, "id").agg(F.max_by("h", "pos").alias("h"))
    heads = heads.withColumn("unit", F.regexp_extract("h", r"^\d+", 0)).withColumn("rest", F.regexp_replace("h", r"^\d+", ""))
    linked = heads.join(units, [*_KEY, "unit"], "left")
    lost = linked.where((F.col("unit") != "") & F.col("to").isNull()).select(*_KEY).distinct()
    head = F.concat(F.lit("* "), F.col("id").cast("string"), F.lit(" "), F.coalesce(F.col("to").cast("string"), F.lit("")), "rest")
    f = F.split("line", r"\s+", -1)
    token = F.concat(f[0], F.lit("\t"), F.concat_ws(",", *(F.get(f, F.lit(k)) for k in fields), F.lit("*")))
    rows = linked.select(*_KEY, "id", F.lit(-1).alias("pos"), head.alias("l")).unionByName(own.where("not mark").select(*_KEY, "id", "pos", token.alias("l")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "pos", "l"))), lambda x: x["l"]), "\n")
    return rows.join(lost, _KEY, "left_anti").groupBy(*_KEY).agg(F.concat(text, F.lit("\nEOS\n")).alias("content"))


def tab_layout(line: Column) -> Column:
    """A space-separated token line in the TAB and comma layout; a base form ``*`` becomes the surface."""
    f = F.split(line, " ", -1)
    fin = F.when(f[2] == "*", f[0]).otherwise(f[2])
    return F.concat(f[0], F.lit("\t"), F.concat_ws(",", f[3], f[5], f[7], f[9], fin, f[1], F.lit("*")))


def align(new: DataFrame, gold: DataFrame) -> DataFrame:
    """(sentence, bun, chars, idx): each gold phrase's character offset and the new token that begins there, null where
    none does. Both are tokens (sentence, idx, surface), gold with ``bun``."""
    w = Window.partitionBy(*_KEY).orderBy("idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    place = lambda df: df.withColumn("chars", F.coalesce(F.sum(F.length("surface")).over(before), F.lit(0)))
    starts = place(gold).groupBy(*_KEY, "bun").agg(F.min("chars").alias("chars"))
    return starts.join(place(new).where(F.length("surface") > 0).select(*_KEY, "chars", "idx"), [*_KEY, "chars"], "left").select(*_KEY, "bun", "chars", "idx")


def realign(starts: list[int], heads: list[int], lengths: list[int]) -> tuple[list[int], list[int]] | None:
    """(phrase of each new token, heads of the phrases that are left) for phrases given by the offsets at which they begin and
    new tokens by their lengths; None where they can't be reconciled.

    A border inside a new token is given up if the phrase before it hangs on the phrase behind it: the two become one,
    with the latter's head, and heads beyond are renumbered. Texts of different lengths, or a border that a token runs over otherwise, fail.
    """
    at, head, which, offset, i = [*starts], [*heads], [], 0, 0
    at.append(sum(lengths))
    head.append(-1)
    if starts and (starts[0] or starts[-1] >= at[-1]) or not starts:
        return None
    for size in [*lengths, 0]:
        if i < len(at) and at[i] == offset:
            i += 1
        elif i + 1 < len(at):
            if at[i + 1] == offset and head[i - 1] == i:
                head[i - 1] = head[i]
                del at[i], head[i]
                head = [h - 1 if h >= i else h for h in head]
                i += 1
            elif at[i + 1] <= offset:
                return None
        elif i < len(at) and offset > at[i]:
            return None
        if size:
            which.append(i - 1)
            offset += size
    return (which, head[:-1]) if i == len(at) else None


def realigned(new: DataFrame, gold: DataFrame, phrases: DataFrame) -> DataFrame:
    """(sentence, ok, bun, heads) for every sentence of ``gold``: the phrase of each of its new tokens, and the heads of the phrases
    that are left; both null where it fails. Tokens are (sentence, idx, surface), gold ones with ``bun``; phrases (sentence, id, did).

    Re-tagged sentences are tokens joined with ``bun`` by place; successes and failures are counted by ``ok``. A sentence lies in one row.
    """
    rows = lambda df, order, *what: df.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct(order, *what))).alias("r"))
    sized = lambda df: df.where(F.length("surface") > 0).withColumn("size", F.length("surface"))
    g = rows(sized(gold), "idx", "bun", "size").select(*_KEY, F.col("r.bun").alias("gb"), F.col("r.size").alias("gs"))
    p = rows(phrases, "id", "did").select(*_KEY, F.col("r.did").alias("did"))
    n = rows(sized(new), "idx", "size").select(*_KEY, F.col("r.size").alias("ns"))
    both = g.join(p, _KEY, "left").join(n, _KEY, "left")

    def run(batches):
        for b in batches:
            out = []
            for doc, line, gb, gs, did, ns in b.itertuples(index=False):
                starts, offset, last = [], 0, None
                for k, size in zip(gb, gs):
                    if k != last:
                        starts.append(offset)
                    offset, last = offset + int(size), k
                lengths = [int(x) for x in ns] if ns is not None else []
                got = realign(starts, [int(x) for x in did], lengths) if did is not None and len(did) == len(starts) and sum(lengths) == offset else None
                out.append((doc, line, got is not None, *(got or (None, None))))
            yield pd.DataFrame(out, columns=["doc_id", "line_no", "ok", "bun", "heads"])

    return both.mapInPandas(run, "doc_id long, line_no int, ok boolean, bun array<int>, heads array<int>")


def run_manifest(manifest: DataFrame, process) -> DataFrame:
    """(in, out, meta, status) for rows (in, out, meta): ``process(in, out)`` is run for each, and its end, OK or ERROR,
    is the status. Every row is a Spark job of its own, so the list is walked from the driver."""
    done = []
    for r in manifest.select("in", "out", "meta").toLocalIterator():
        try:
            process(r["in"], r["out"])
            done.append((*r, "OK"))
        except Exception as e:  # noqa: BLE001 - a job's failure is its row's status
            done.append((*r, f"ERROR {type(e).__name__}"))
    return manifest.sparkSession.createDataFrame(done, "in string, out string, meta string, status string")
