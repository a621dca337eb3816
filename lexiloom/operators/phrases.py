"""Phrases: groups of tokens, their heads, tails, brackets and context ids, and gold attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.sources.corpus import SENTENCE


def number(morphs: DataFrame, flag: str = "chunk_ref") -> DataFrame:
    """Adds ``bun``: the phrase number of every token; the first token of a sentence always begins one."""
    w = Window.partitionBy(*SENTENCE).orderBy("idx")
    begins = F.when((F.row_number().over(w) == 1) | F.col(flag), 1).otherwise(0)
    return morphs.withColumn("_begins", begins).withColumn("bun", (F.sum("_begins").over(w) - 1).cast("int")).drop("_begins")


def phrases(numbered: DataFrame) -> DataFrame:
    """One row a phrase: its tokens' place, the last token that is neither special nor particle (head) and the last that
    isn't special (tail), -1 where there is none, signed brackets, comma, period and its particles."""
    special, particle = F.col("pos1") == "SPECIAL", F.col("pos1") == "PARTICLE"
    off = F.col("idx") - F.col("mpos")
    w = Window.partitionBy(*SENTENCE, "bun")
    own = numbered.withColumn("mpos", F.min("idx").over(w))
    return own.groupBy(*SENTENCE, F.col("bun").alias("id")).agg(
        F.min("idx").alias("mpos"), F.count("*").cast("int").alias("mlen"),
        F.coalesce(F.max(F.when(~special & ~particle, off)), F.lit(-1)).alias("head"),
        F.coalesce(F.max(F.when(~special, off)), F.lit(-1)).alias("tail"),
        F.sum(F.when(F.col("pos2") == "BR_OPEN", 1).when(F.col("pos2") == "BR_CLOSE", -1).otherwise(0)).cast("int").alias("bracket"),
        F.max(F.col("pos2") == "COMMA").alias("comma"), F.max(F.col("pos2") == "PERIOD").alias("period"),
        F.array_sort(F.collect_set(F.when(particle, F.col("surface")))).alias("particles"),
    )


def with_heads(bun: DataFrame) -> DataFrame:
    """Adds ``n`` and the gold attachment ``did``: to the last phrase after a comma, else to the next; -1 for the last."""
    n = F.count("*").over(Window.partitionBy(*SENTENCE)).cast("int")
    own = bun.withColumn("n", n)
    last = F.col("id") == F.col("n") - 1
    return own.withColumn("did", F.when(last, -1).when(F.col("comma"), F.col("n") - 1).otherwise(F.col("id") + 1).cast("int"))


def context_ids(numbered: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(sentence, id, ctx): the sorted dictionary ids of each phrase's particles that are context ids."""
    ctx = dictionary.where("is_ctx").select(F.col("str").alias("surface"), F.col("id").alias("fid"))
    hit = numbered.where("pos1 = 'PARTICLE'").join(ctx, "surface")
    return hit.groupBy(*SENTENCE, F.col("bun").alias("id")).agg(F.array_sort(F.collect_set("fid")).alias("ctx"))


def broken(bun: DataFrame) -> DataFrame:
    """Phrases whose head isn't to their right; -1 is the root's."""
    return bun.where((F.col("did") >= 0) & (F.col("did") <= F.col("id")))


def lexical_bag(numbered: DataFrame) -> DataFrame:
    """(sentence, id, bag): the sorted distinct surfaces of every phrase."""
    return numbered.groupBy(*SENTENCE, F.col("bun").alias("id")).agg(F.array_sort(F.collect_set("surface")).alias("bag"))
