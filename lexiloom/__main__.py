"""Command line: ``python -m lexiloom learn|parse|both|cache`` over files of annotated sentences, and ``query`` for registered queries."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import parsing
from lexiloom.plans import queries, recipe
from lexiloom.sources import corpus, formats


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser("lexiloom")
    p.add_argument("mode", choices=("learn", "parse", "both", "cache", "query"))
    p.add_argument("name", nargs="?", help="the registered query to run")
    p.add_argument("-c", "--corpus", help="training sentences with gold heads")
    p.add_argument("-i", "--input", help="sentences to parse")
    p.add_argument("-o", "--output", help="folder for parsed sentences, cached vectors or a query's rows")
    p.add_argument("-m", "--model-dir", default="model")
    p.add_argument("-p", "--parser", choices=sorted(parsing.DECODERS), default="linear")
    p.add_argument("-I", "--input-format", choices=recipe.KINDS, default="raw")
    p.add_argument("-e", "--encoding", default="utf-8")
    p.add_argument("-n", "--max-sent", type=int, default=0, help="first sentences of each file; 0 for all")
    p.add_argument("--layout", choices=sorted(corpus.LAYOUTS), default="dictionary")
    p.add_argument("--update", choices=("P", "PA", "PA-I", "PA-II"), default="PA-I")
    p.add_argument("--cost", type=float, default=0.05)
    p.add_argument("--epochs", type=int, default=10)
    p.add_argument("--shards", type=int, default=1, help="over 1: train in parallel and average")
    p.add_argument("--halvings", type=int, default=0, help="keep this power of a half of the cached prefixes")
    p.add_argument("--data", help="folder of Parquet tables, for queries")
    return p.parse_args(given)


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    if a.mode == "query":
        df = queries.queries()[a.name](spark, a.data)
        df.write.mode("overwrite").parquet(a.output)
        return {"rows": spark.read.parquet(a.output).count()}
    said: dict = {}
    if a.mode in ("learn", "both"):
        tokens, heads, _ = recipe.load(spark, a.corpus, "depnd", a.layout, a.encoding, a.max_sent)
        settings = json.dumps([a.parser, a.update, a.cost, a.epochs, a.shards])
        source = recipe.source_hash(tokens, heads, settings)
        facts = recipe.Model.facts(spark, a.model_dir)
        said["fresh"] = facts is not None and facts["source"] == source
        if not said["fresh"]:
            recipe.train(tokens, heads, a.parser, a.update, a.cost, a.epochs, a.shards).save(a.model_dir, source)
    if a.mode == "learn":
        return said
    model = recipe.Model.load(spark, a.model_dir)
    tokens, heads, headers = recipe.load(spark, a.input, "depnd" if a.mode == "cache" else a.input_format, a.layout, a.encoding, a.max_sent)
    if a.mode == "cache":
        vectors = recipe.visited(model, tokens, heads)
        recipe.prefix_table(vectors, a.halvings).write.mode("overwrite").parquet(a.output)
        return {"prefixes": spark.read.parquet(a.output).count()}
    chunked = recipe.written(recipe.chunk(model, tokens), "chunked")
    numbered, arcs = recipe.parse(model, chunked, heads)
    arcs = recipe.written(arcs, "arcs")
    lines = formats.format_sentences(numbered, arcs, "est_did", "prob" if a.input_format == "depnd" else None, a.input_format, headers)
    lines.orderBy(*corpus.SENTENCE).select(F.regexp_replace("content", r"\n$", "")).write.mode("overwrite").text(a.output)
    return said | (recipe.judged(chunked, arcs if heads is not None else None) if a.input_format != "raw" else {})


def main(given: list[str] | None = None) -> int:
    spark = SparkSession.builder.appName("lexiloom").getOrCreate()
    print(json.dumps(run(spark, arguments(given)), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
