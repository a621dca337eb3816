"""Sentences and annotated tokens from plain document tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENTENCE = ["doc_id", "line_no"]
#: Function words of four languages that play the part of particles.
PARTICLES = tuple("the of and to a in is that for it on de la le les des et un une du der die das und ein von zu den el los las que en y".split())
SPECIALS = {",": "COMMA", ".": "PERIOD", "(": "BR_OPEN", ")": "BR_CLOSE"}


@dataclass(frozen=True)
class FieldLayout:
    """Names of a token line's fields after the surface, and the separators."""

    fields: tuple[str, ...]
    surface_sep: str = "\t"
    feature_sep: str = ","


LAYOUTS = {
    "dictionary": FieldLayout(("pos1", "pos2", "type", "infl", "fin", "yomi")),
    "juman": FieldLayout(("yomi", "fin", "pos1", "pos_id1", "pos2", "pos_id2", "type", "type_id", "infl", "infl_id"), " ", " "),
    "ipa": FieldLayout(("pos1", "pos2", "pos3", "pos4", "type", "infl", "fin", "yomi", "pron")),
}


def annotate(surface: Column) -> dict[str, Column]:
    special = F.create_map(*(F.lit(x) for kv in SPECIALS.items() for x in kv))
    return {
        "pos1": F.when(surface.isin(*SPECIALS), "SPECIAL").when(surface.isin(*PARTICLES), "PARTICLE").otherwise("CONTENT"),
        "pos2": F.coalesce(special[surface], F.lit("*")),
        "infl": F.substring(surface, -2, 2),
    }


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, idx, surface, pos1, pos2, infl, chunk_ref) of every line of every text; lines without a token give none.

    Nothing moves: lines and words are taken apart where the text is read, and ``chunk_ref``, whether a token begins a
    phrase (first, or after a particle or special), looks at the word before it in the line's own array.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    words = F.filter(F.split(F.regexp_replace("line", "([,.()])", " $1 "), " ", -1), lambda x: x != "")
    own = lines.select("doc_id", "line_no", words.alias("w"))
    pairs = F.arrays_zip(F.col("w"), F.concat(F.array(F.lit(",")), F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0)))).alias("before"))
    own = own.where(F.size("w") > 0).select("doc_id", "line_no", F.posexplode(pairs).alias("idx", "t"))
    own = own.select("doc_id", "line_no", "idx", F.col("t.w").alias("surface"), F.col("t.before").alias("_before"))
    return own.select("doc_id", "line_no", "idx", "surface", *(c.alias(k) for k, c in annotate(F.col("surface")).items()), F.col("_before").isin(*SPECIALS, *PARTICLES).alias("chunk_ref"))


def gold_chunks(morphs: DataFrame) -> DataFrame:
    """Sets ``chunk_ref`` from ``pos1`` alone: a token begins a phrase first and after particles and specials."""
    w = Window.partitionBy(*SENTENCE).orderBy("idx")
    return morphs.withColumn("chunk_ref", F.coalesce(F.lag("pos1").over(w).isin("PARTICLE", "SPECIAL"), F.lit(True)))


def split_of(doc_id: Column) -> Column:
    """The documents' split by number modulo 6: 0-3 train, 4 dev, 5 test."""
    k = F.pmod(doc_id, F.lit(6))
    return F.when(k < 4, "train").when(k == 4, "dev").otherwise("test")


def first_sentences(sentences: DataFrame, n: int) -> DataFrame:
    """The first n sentences in order, the reader's own limit."""
    return sentences.orderBy(*SENTENCE).limit(n)
