"""Dictionaries: strings, features and labels to dense ids, look-ups with a default, prefix search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.ranking import bucketed_rank
from lexiloom.sources.corpus import SENTENCE

FIELDS = ("surface", "pos1", "pos2", "infl")
MANDATORY = (",", ".", "PARTICLE", "(", ")", "SPECIAL")
#: Documents of one bucket of first occurrences.
BLOCK = 4096


def first_seen(morphs: DataFrame) -> DataFrame:
    """(str, at, field, is_ctx) of every string of any field; (at, field) orders first occurrences over the whole corpus.

    Tokens are reduced to distinct ones first. ``at`` packs document, line and place into one number, which
    aggregates in place, where a struct's least would sort all tokens.
    """
    at = F.col("doc_id").cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)") + (F.col("line_no").cast("long") * (1 << 31) + F.col("idx")).cast("decimal(19,0)")
    kinds = morphs.groupBy(*FIELDS).agg(F.min(at.cast("decimal(38,0)")).alias("at"))
    values = F.array(*(F.struct(F.lit(k).alias("field"), F.col(c).alias("str")) for k, c in enumerate(FIELDS)))
    each = kinds.select("at", "pos1", F.explode(values).alias("f")).where("f.str is not null")
    ctx = (F.col("pos1") == "PARTICLE") & (F.col("f.field") == 0)
    first = each.groupBy(F.col("f.str").alias("str")).agg(F.min(F.struct("at", "f.field")).alias("p"), F.max(F.coalesce(ctx, F.lit(False))).alias("is_ctx"))
    return first.select("str", "p.at", "p.field", "is_ctx")


def build(morphs: DataFrame, mandatory: tuple[str, ...] = MANDATORY) -> DataFrame:
    """(str, id, is_ctx): context strings first, then all others, both in order of first occurrence.

    Strings that must exist are appended last where the corpus lacks them.
    """
    return numbered(first_seen(morphs), F.floor(F.expr(f"at div {1 << 62}") / BLOCK), mandatory)


def numbered(seen: DataFrame, block: Column, mandatory: tuple[str, ...] = MANDATORY) -> DataFrame:
    """(str, id, is_ctx) from first occurrences (str, at, field, is_ctx); ``block`` is a coarse prefix of ``at``."""
    spark = seen.sparkSession
    must = spark.createDataFrame([(s, k) for k, s in enumerate(mandatory)], "str string, field int")
    lacking = must.join(seen.select("str"), "str", "left_anti").select("str", F.lit(0).cast(seen.schema["at"].dataType).alias("at"), "field", F.lit(False).alias("is_ctx"), F.lit(1).alias("late"))
    flat = seen.withColumn("late", F.lit(0)).unionByName(lacking)
    rest = F.when(F.col("is_ctx"), 0).otherwise(1)
    ranked = bucketed_rank(flat, [rest, F.col("late"), block], [F.col("at"), F.col("field")], "id")
    return ranked.select("str", "id", "is_ctx")


def check(dictionary: DataFrame) -> None:
    """Raises if the corpus had no particle."""
    if dictionary.where("is_ctx").isEmpty():
        raise ValueError("no particle found: is the corpus annotated as its layout says?")


def look_up(df: DataFrame, dictionary: DataFrame, column: str, name: str, unseen: int) -> DataFrame:
    """Adds ``name``: the id of ``column``, ``unseen`` where the dictionary lacks it. Spark broadcasts small dictionaries."""
    d = dictionary.select(F.col("str").alias(column), F.col("id").alias("_id"))
    return df.join(d, column, "left").withColumn(name, F.coalesce("_id", F.lit(unseen)).cast("int")).drop("_id")


def frequency_rank(features: DataFrame) -> DataFrame:
    """(fn, cnt, fi): feature numbers ranked by falling frequency from 1, ties by the larger number first."""
    counts = features.groupBy("fn").agg(F.count("*").alias("cnt"))
    # A prefix of the order: exact small counts, split by number, then ever wider ranges of counts.
    small = F.col("cnt") <= 64
    bucket = [F.when(small, -F.col("cnt")).otherwise(-64 - F.floor(16 * F.log2("cnt"))), F.when(small, -F.floor(F.col("fn") / (1 << 16))).otherwise(0)]
    ranked = bucketed_rank(counts, bucket, [F.desc("cnt"), F.desc("fn")], "_r")
    return ranked.select("fn", "cnt", (F.col("_r") + 1).cast("int").alias("fi"))


def apply_map(examples: DataFrame, ranks: DataFrame, key: str = "ex_id") -> DataFrame:
    """(key, fv): every example's features as sorted ranks; unmapped features drop."""
    own = examples.select(key, F.explode("fv").alias("fn")).join(ranks.select("fn", "fi"), "fn")
    return own.groupBy(key).agg(F.array_sort(F.collect_list("fi")).alias("fv"))


def revert_map(examples: DataFrame, ranks: DataFrame, key: str = "ex_id") -> DataFrame:
    own = examples.select(key, F.explode("fv").alias("fi")).join(ranks.select("fn", "fi"), "fi")
    return own.groupBy(key).agg(F.array_sort(F.collect_list("fn")).alias("fv"))


def label_map(df: DataFrame, column: str) -> DataFrame:
    """(label, id) in order of the labels, ranked within their first characters."""
    labels = df.select(F.col(column).cast("string").alias("label")).where("label is not null").distinct()
    return bucketed_rank(labels, [F.substring("label", 1, 2)], [F.col("label")], "id")


def strings_of(ids: DataFrame, dictionary: DataFrame, column: str = "id") -> DataFrame:
    """``ids`` with ``str``: the string of each id, null where the dictionary has none."""
    return ids.join(dictionary.select(F.col("id").alias(column), "str"), column, "left")


def steps_from(prefixes: DataFrame, dictionary: DataFrame, column: str = "prefix") -> DataFrame:
    """(column, next, strings, ends): every character that leads on from each prefix in the dictionary, how many strings
    lie behind it, and whether one ends there; a walk through the dictionary is repeated steps."""
    p = prefixes.select(column).distinct().withColumn("_n", F.length(column))
    sizes = [r[0] for r in p.select("_n").distinct().orderBy("_n").collect()]
    heads = dictionary.select("str", F.explode(F.array(*(F.lit(n) for n in sizes)) if sizes else F.array().cast("array<int>")).alias("_n")).where(F.length("str") > F.col("_n"))
    heads = heads.withColumn(column, F.substring(F.col("str"), F.lit(1), F.col("_n")))
    met = heads.join(p, [column, "_n"]).withColumn("next", F.substring(F.col("str"), F.col("_n") + 1, F.lit(1)))
    return met.groupBy(column, "next").agg(F.count("*").alias("strings"), F.max(F.length("str") == F.col("_n") + 1).alias("ends"))


def prefixes_of(queries: DataFrame, dictionary: DataFrame, column: str) -> DataFrame:
    """(column, str, id, length): all dictionary strings that begin each distinct query string."""
    q = queries.select(column).where(F.length(column) > 0).distinct()
    parts = q.select(column, F.explode(F.transform(F.sequence(F.lit(1), F.length(column)), lambda n: F.substring(F.col(column), F.lit(1), n))).alias("str"))
    return parts.join(dictionary.select("str", "id"), "str").select(column, "str", "id", F.length("str").alias("length"))


def upsert(base: DataFrame, more: DataFrame) -> DataFrame:
    """(str, n): counts of both tables added by key, as inserting into a trie adds values."""
    return base.select("str", "n").unionByName(more.select("str", "n")).groupBy("str").agg(F.sum("n").alias("n"))
