"""The whole recipe over annotated text files: train a chunker and a parser, keep them in a folder, parse, and cache vectors.

A model folder has Parquet tables (``dictionary``, ``chunk``, ``parse``) and ``model.json`` with sizes, strategy and
the hash of what the model was made from, by which a later call tells whether it is still fresh.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import dictionary as D
from lexiloom.operators import evaluation, features, models, parsing, phrases, scoring, training
from lexiloom.sources import corpus, formats
from lexiloom.sources.store import written

S = corpus.SENTENCE
KINDS = ("raw", "chunk", "depnd")
#: Names that tag sets give to the classes which the rules look at.
TAGS = {
    "pos1": {"助詞": "PARTICLE", "特殊": "SPECIAL", "記号": "SPECIAL"},
    "pos2": {"読点": "COMMA", "句点": "PERIOD", "括弧始": "BR_OPEN", "括弧終": "BR_CLOSE", "括弧開": "BR_OPEN", "括弧閉": "BR_CLOSE"},
}


def _named(tokens: DataFrame) -> DataFrame:
    for c, names in TAGS.items():
        known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
        tokens = tokens.withColumn(c, F.coalesce(known[F.col(c)], F.col(c)))
    return tokens


def load(spark: SparkSession, path: str, kind: str, layout: str = "dictionary", encoding: str = "utf-8", most: int = 0) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(tokens with ``chunk_ref`` where the input has it, gold heads or None, headers) of a file of annotated sentences; the first
    ``most`` sentences of each file if that isn't 0."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    s = formats.read_sentences(spark, path, encoding)
    s = s.where(F.col("line_no") < most) if most else s
    how = corpus.LAYOUTS[layout]
    heads = None
    if kind == "depnd":
        tokens, heads = formats.parse_dependencies(s, how)
        first = tokens.groupBy(*S, "bun").agg(F.min("idx").alias("idx"))
        tokens = tokens.join(first.withColumn("chunk_ref", F.lit(True)), [*S, "bun", "idx"], "left").withColumn("chunk_ref", F.coalesce("chunk_ref", F.lit(False)))
    else:
        tokens = formats.parse_chunked(s, how) if kind == "chunk" else formats.parse_pos(s.withColumn("content", F.regexp_replace("content", r"(?m)^#.*\n?", "")), how).withColumn("chunk_ref", F.lit(False))
    names = [*S, "idx", "surface", "pos1", "pos2", "infl", "chunk_ref"]
    return _named(tokens).select(*names), heads, formats.headers(s)


class Model:
    """A trained chunker and parser, and the dictionary that they share."""

    def __init__(self, dictionary: DataFrame, chunk: DataFrame, parse: DataFrame, strategy: str) -> None:
        self.dictionary, self.chunk, self.parse, self.strategy = dictionary, chunk, parse, strategy
        strings, context = dictionary.agg(F.count("*"), F.count_if("is_ctx")).first()
        self.size, self.width, self.unseen = strings + 1, 64 * -(-context // 64), strings

    def kinds(self, tokens: DataFrame) -> DataFrame:
        return features.kinds(tokens, self.dictionary, self.unseen)

    def phrases(self, numbered: DataFrame, bun: DataFrame) -> DataFrame:
        template = parsing.template_of(self.strategy)
        return features.phrase_features(numbered, bun, phrases.context_ids(numbered, self.dictionary), self.size, self.width, template)

    def save(self, path: str, source: str) -> None:
        for name in ("dictionary", "chunk", "parse"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.dictionary.sparkSession
        row = json.dumps({"strategy": self.strategy, "size": self.size, "width": self.width, "source": source})
        spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model.json")

    @staticmethod
    def facts(spark: SparkSession, path: str) -> dict | None:
        try:
            return json.loads(spark.read.text(f"{path}/model.json").first()[0])
        except Exception as e:  # noqa: BLE001 - a folder that isn't there yet
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        facts = Model.facts(spark, path)
        if facts is None:
            raise FileNotFoundError(path)
        return Model(*(spark.read.parquet(f"{path}/{n}") for n in ("dictionary", "chunk", "parse")), facts["strategy"])


def source_hash(tokens: DataFrame, heads: DataFrame, settings: str) -> str:
    """A hash of a corpus's tokens and heads and of the settings, whatever the files' order."""
    total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return ":".join(str(x) for x in (*total(tokens), *total(heads), settings))


def _learn(examples: DataFrame, variant: str, c: float, epochs: int, shards: int) -> DataFrame:
    """Exact, sequential training, or with ``shards`` over 1 the parallel kind."""
    return training.train_linear(examples, variant, c, epochs) if shards <= 1 else training.train_mixed(examples, shards, variant, c, epochs)


def train(tokens: DataFrame, heads: DataFrame, strategy: str = "linear", variant: str = "PA-I", c: float = 0.05, epochs: int = 10, shards: int = 1) -> Model:
    """Learns borders from ``chunk_ref`` and attachments from gold heads (sentence, id, did)."""
    dictionary = written(D.build(tokens), "dictionary")
    D.check(dictionary)
    none = dictionary.sparkSession.createDataFrame([], "fid long, w double")
    model = Model(dictionary, none, none, strategy)
    ids = written(features.of_kind(tokens, model.kinds(tokens)), "tokens")
    borders = features.chunk_features(ids, model.size).join(ids.select(*S, "idx", "chunk_ref"), [*S, "idx"]).where("idx > 0")
    borders = borders.select(F.struct(*S, "idx").alias("pos"), F.when(F.col("chunk_ref"), 1).otherwise(-1).alias("y"), "fv")
    model.chunk = written(_learn(borders, variant, c, epochs, shards), "chunk")
    numbered = phrases.number(ids)
    bun = phrases.phrases(numbered).join(heads.select(*S, "id", "did"), [*S, "id"])
    bun = bun.join(bun.groupBy(*S).agg(F.count("*").cast("int").alias("n")), S)
    if not phrases.broken(bun).isEmpty():
        raise ValueError("a head isn't to the right of its phrase")
    examples = parsing.training_examples(written(model.phrases(numbered, bun), "phrases"), strategy, model.size, model.width)
    model.parse = written(_learn(examples.select(F.struct(*S, "event_no").alias("pos"), "y", "fv"), variant, c, epochs, shards), "parse")
    return model


def chunk(model: Model, tokens: DataFrame) -> DataFrame:
    """Tokens with ``chunk`` and ``chunk_prob``."""
    wide = features.wide_weights(model.chunk, model.size)
    own = features.chunked(features.chunk_margins(tokens, model.kinds(tokens), wide))
    return own.withColumn("chunk_prob", 1 / (1 + F.exp(-F.col("margin")))).drop("margin")


def parse(model: Model, tokens: DataFrame, heads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(tokens with ``bun``, arcs (sentence, id, did, est_did, prob)) of tokens whose ``chunk`` or, with gold heads, ``chunk_ref`` borders phrases."""
    ids = written(features.of_kind(tokens, model.kinds(tokens)), "tokens")
    numbered = phrases.number(ids, "chunk_ref" if heads is not None else "chunk")
    bun = phrases.phrases(numbered)
    bun = bun.join(heads.select(*S, "id", "did"), [*S, "id"], "left") if heads is not None else bun.withColumn("did", F.lit(-1))
    bun = bun.join(bun.groupBy(*S).agg(F.count("*").cast("int").alias("n")), S)
    template = parsing.template_of(model.strategy)
    margins = parsing.static_margins(written(model.phrases(numbered, bun), "phrases"), model.parse, template)
    return numbered, parsing.parse(margins, model.strategy, parsing.whole_weights(model.parse, model.size, model.width, template))


def visited(model: Model, tokens: DataFrame, heads: DataFrame) -> DataFrame:
    """(sentence, event_no, fv): the vectors that parsing with the model looks at; ``scoring.build_prefixes`` makes the table of
    prefixes that later scoring starts from."""
    ids = written(features.of_kind(tokens, model.kinds(tokens)), "tokens")
    numbered = phrases.number(ids)
    bun = phrases.phrases(numbered).join(heads.select(*S, "id", "did"), [*S, "id"])
    bun = bun.join(bun.groupBy(*S).agg(F.count("*").cast("int").alias("n")), S)
    template = parsing.template_of(model.strategy)
    base = features.global_base(template, model.size, model.width)
    margin = models.classifier("linear", model.parse)
    return parsing.visited(written(model.phrases(numbered, bun), "phrases"), model.strategy, [base, base + features.global_width(model.width)], margin)


def prefix_table(vectors: DataFrame, halvings: int) -> DataFrame:
    return scoring.prune_prefixes(written(scoring.build_prefixes(vectors), "prefixes"), halvings)


def judged(tokens: DataFrame, arcs: DataFrame | None) -> dict:
    """Phrase and attachment figures of chunked tokens and of arcs with gold heads."""
    out = {"chunk": evaluation.chunks(tokens).first().asDict()}
    return out | ({"depnd": evaluation.attachments(arcs).first().asDict()} if arcs is not None else {})
