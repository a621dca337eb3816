"""The command line over annotated files: learn, parse, judge, cache."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom import __main__ as cli
from lexiloom.operators import dictionary
from lexiloom.plans import recipe
from lexiloom.sources import corpus, formats

NOUNS, VERBS = [f"noun{k}" for k in range(12)], [f"verb{k}" for k in range(6)]


def sentence(rng, number):
    """Noun phrases with a particle hang on the next verb, verbs and what a comma follows on the last phrase."""
    phrases = []
    for _ in range(int(rng.integers(1, 3))):
        phrases += [[(str(rng.choice(NOUNS)), "N", "*"), (str(rng.choice(["wa", "wo"])), "PARTICLE", "*")] for _ in range(int(rng.integers(1, 3)))]
        phrases.append([(str(rng.choice(VERBS)), "V", "*")])
    heads = []
    for i, p in enumerate(phrases):
        verbs = [j for j in range(i + 1, len(phrases)) if phrases[j][0][1] == "V"]
        heads.append(-1 if i == len(phrases) - 1 else len(phrases) - 1 if p[0][1] == "V" else verbs[0])
    lines = [f"# S-ID:{number}"]
    for i, p in enumerate(phrases):
        lines += [f"* {i} {heads[i]}D", *(f"{w}\t{a},{b},*,x,{w},*" for w, a, b in p)]
    return "\n".join([*lines, "EOS", ""]), heads


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d, rng = tmp_path_factory.mktemp("recipe"), np.random.default_rng(83)
    for name, n in (("train", 120), ("test", 40)):
        (d / f"{name}.txt").write_text("".join(sentence(rng, k)[0] for k in range(n)))
    return d


@pytest.mark.parametrize("strategy", ["linear", "tournament"])
def test_learn_parse_and_judge(spark, files, strategy):
    given = ["both", "-c", f"{files}/train.txt", "-i", f"{files}/test.txt", "-o", f"{files}/out-{strategy}", "-m", f"{files}/model-{strategy}", "-p", strategy, "-I", "depnd", "--epochs", "6"]
    said = cli.run(spark, cli.arguments(given))
    assert not said["fresh"] and said["chunk"]["f1"] > 0.95 and said["depnd"]["accuracy"] > 0.9
    text = "".join(r.value for r in spark.read.option("wholetext", True).text(f"{files}/out-{strategy}").collect())
    assert text.count("EOS") == text.count("# S-ID") == 40 and "D@" in text
    if strategy == "linear":
        assert cli.run(spark, cli.arguments([*given, "-n", "0"]))["fresh"]
        again = cli.run(spark, cli.arguments(["parse", *given[3:5], "-o", f"{files}/raw", "-m", f"{files}/model-linear"]))
        assert again == {}
        assert cli.run(spark, cli.arguments(["cache", *given[3:5], "-o", f"{files}/cache", "-m", f"{files}/model-linear", "--halvings", "1"]))["prefixes"] > 10


def test_chunk_annotated_input_and_limits(spark, files):
    tokens, heads, headers = recipe.load(spark, f"{files}/test.txt", "depnd", most=3)
    assert headers.count() == 3 and heads.select("line_no").distinct().count() == 3
    same, none, _ = recipe.load(spark, f"{files}/test.txt", "chunk", most=3)
    key = [*corpus.SENTENCE, "idx"]
    assert none is None and tokens.select(*key, "chunk_ref").exceptAll(same.select(*key, "chunk_ref")).isEmpty()
    assert [r.line_no for r in corpus.first_sentences(headers, 2).orderBy("line_no").collect()] == [0, 1]


def test_named_tags_and_broken_heads(spark, tmp_path, files):
    (tmp_path / "a.txt").write_text("* 0 1D\nA\t名詞,*\nwa\t助詞,*\n* 1 0D\nB\t特殊,句点\nEOS\n")
    tokens, heads, _ = recipe.load(spark, str(tmp_path / "a.txt"), "depnd")
    assert [(r.pos1, r.pos2) for r in tokens.orderBy("idx").collect()] == [("名詞", "*"), ("PARTICLE", "*"), ("SPECIAL", "PERIOD")]
    with pytest.raises(ValueError):
        recipe.train(tokens, heads, epochs=1)
    with pytest.raises(FileNotFoundError):
        recipe.Model.load(spark, str(tmp_path / "nowhere"))


def test_query_mode(spark, tmp_path):
    spark.createDataFrame([("the cat",), ("a dog",)], "text string").withColumn("doc_id", F.monotonically_increasing_id()).write.parquet(str(tmp_path / "documents.parquet"))
    said = cli.run(spark, cli.arguments(["query", "morphs", "--data", str(tmp_path), "-o", str(tmp_path / "rows")]))
    assert said == {"rows": 4} and json.dumps(said)


def test_walks_through_a_dictionary(spark):
    dic = spark.createDataFrame([("cat", 0), ("car", 1), ("ca", 2), ("dog", 3)], "str string, id int")
    p = spark.createDataFrame([("",), ("c",), ("ca",), ("x",)], "prefix string")
    got = sorted(map(tuple, dictionary.steps_from(p, dic).collect()))
    assert got == [("", "c", 3, False), ("", "d", 1, False), ("c", "a", 3, True), ("ca", "r", 1, True), ("ca", "t", 1, True)]
    assert dictionary.steps_from(p.where("false"), dic).isEmpty()
    back = dictionary.strings_of(spark.createDataFrame([(1,), (9,)], "id int"), dic).orderBy("id").collect()
    assert [r.str for r in back] == ["car", None]


def test_linear_model_files(spark, tmp_path):
    w = spark.createDataFrame([(0, 0.5), (3, -2.0), (1, 1e-300)], "fid long, w double")
    formats.write_linear_model(w, str(tmp_path / "model"))
    assert {r.fid: r.w for r in formats.read_linear_model(spark, str(tmp_path / "model")).collect()} == {0: 0.5, 1: 1e-300, 2: 0.0, 3: -2.0}
    assert formats.sniff_model((tmp_path / "model").read_bytes()) == "linear"
    lines = spark.createDataFrame([("+1\t3:1\t0.5",), ("-1\t2\t-1.5",)], "value string")
    assert sorted((r.label, list(r.combo), r.w) for r in formats.parse_loglinear_model(lines).collect()) == [("+1", [1, 3], 0.5), ("-1", [2], -1.5)]
