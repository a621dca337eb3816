"""What keeps queries in proportion to their input: no token moves by itself, and a question costs the same however long its sentence is."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql.readwriter import DataFrameWriter

from lexiloom.operators import decoding, parsing, scoring, training
from lexiloom.operators import texts as chunks
from lexiloom.plans import queries as plans

#: Queries that go over texts where they lie, or over chunks of them.
IN_PLACE = [
    "feat_pair_static",
    "feat_triple_static",
    "parse_examples_linear",
    "parse_linear",
    "parse_backward",
    "parse_chunking",
    "parse_tournament",
    "chunk_linear",
    "feat_chunk",
    "eval_chunk",
    "parse_gold_chunking_events",
    "parse_gold_backward_events",
    "jdp_roundtrip",
    "jdp_text",
    "jdp_depnd_text",
    "jdp_chunk_text",
    "align_offsets",
    "align_merge",
    "bun_ctx",
    "trie_reverse",
    "fmap_rank",
    "fmap_apply",
    "score_linear",
    "eval_binary",
    "pa_step",
]


@pytest.fixture(scope="module")
def texts(tmp_path_factory):
    d = tmp_path_factory.mktemp("texts")
    docs = [f"the fox {k}, of a hill (x) and\nit is late {k % 3}." for k in range(40)]
    pq.write_table(pa.table({"doc_id": pa.array(range(40), pa.int64()), "text": docs}), d / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(range(0, 40, 3), pa.int64()), "quality": pa.array([1, 0] * 7, pa.int32())}), d / "labels.parquet")
    return str(d)


@pytest.mark.parametrize("name", IN_PLACE)
def test_no_token_is_shuffled_by_sentence(spark, texts, monkeypatch, name):
    plans_seen, write = [], DataFrameWriter.parquet
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (plans_seen.append(plan(self._df)), write(self, *a, **k))[1])
    plans_seen.append(plan(plans.queries()[name](spark, texts)))
    assert not [p for p in plans_seen if re.search(r"hashpartitioning\(doc_id#\d+L?, (line_no|y#\d+L?, surface|surface)", p)]


def _sentences(rng, sizes):
    n = sum(sizes)
    sides = [np.array([rng.randint(-9, 9) for _ in range(n)], float) for _ in range(3)]
    bracket = np.array([rng.choice([0, 0, 1, -1]) for _ in range(n)])
    ctx = [tuple(sorted(rng.sample(range(8), rng.choice([0, 1, 2, 3])))) for _ in range(n)]
    at = np.cumsum([0, *sizes])
    return sides, bracket, np.concatenate([np.cumsum(bracket[a:b]) for a, b in zip(at, at[1:])]), ctx, list(zip(at, at[1:]))


@pytest.mark.parametrize("strategy", parsing.DECODERS)
def test_flat_decoders_equal_the_plain_ones(strategy):
    rng = random.Random(5)
    for _ in range(40):
        sizes = [rng.randint(1, 25) for _ in range(4)]
        sides, bracket, inner, ctx, parts = _sentences(rng, sizes)
        whole = [[float(rng.randint(-6, 6)) for _ in range(14)] for _ in range(2)]
        heads, probs = decoding.decoded(strategy, np.array(sizes), sides, inner, inner - bracket, ctx, whole)
        for a, b in parts:
            own = sides if strategy == "tournament" else sides[:2]
            h, p = parsing.DECODERS[strategy](b - a, parsing.LinearScorer([x[a:b] for x in own], parsing.Whole(inner[a:b], bracket[a:b], ctx[a:b]), whole))
            assert h == heads[a:b].tolist() and np.allclose(p, probs[a:b], atol=1e-12)


@pytest.mark.parametrize("strategy", ["linear", "chunking", "backward"])
def test_flat_gold_decisions_equal_the_plain_ones(strategy):
    rng = random.Random(7)
    for _ in range(40):
        sizes = [rng.randint(1, 25) for _ in range(4)]
        ctx, parts = _sentences(rng, sizes)[3:]
        gold = np.array([rng.randint(-1, b - a) for a, b in parts for _ in range(a, b)])
        count, i, j, y, bits = decoding.gold(strategy, np.array(sizes), gold, ctx)
        got = list(zip(i.tolist(), j.tolist(), y.tolist(), bits))
        want = []
        for a, b in parts:
            own: list = []
            parsing.follow_gold(gold[a:b].tolist(), strategy, lambda i, j, k, y, h: own.append((i + a, j + a, y, tuple(sorted(parsing.competitors(i, j, h, ctx[a:b])) if j - i > 1 else ()))))  # noqa: B023
            want.append(own)
        assert [len(x) for x in want] == count.tolist() and sum(want, []) == got


def test_a_long_sentence_is_parsed():
    """A chain of heads through all of 3,000 phrases: millions of questions, each of which would look at thousands of phrases."""
    n = 3000
    zero, ctx = np.zeros(n), [(k % 8,) for k in range(n)]
    heads, _ = decoding.decoded("backward", np.array([n]), [zero, zero], zero.astype(int), zero.astype(int), ctx, [[9.0, 0, 0, 0, 0, 0] + [0.0] * 8])
    assert heads.tolist() == [*range(1, n), -1]


def _vectors(spark, count, width, share):
    rng = np.random.default_rng(2)
    rows = [(k, k, int(rng.choice([-1, 1])), (np.flatnonzero(rng.random(width) < share) + 1).tolist()) for k in range(count)]
    return spark.createDataFrame(rows, "ex_id long, sv_id long, alpha int, fv array<long>")


@pytest.mark.parametrize("name", ["inverted_index", "split"])
@pytest.mark.parametrize(("count", "width", "share", "pairs"), [(300, 8, 0.5, False), (20, 400, 0.1, True)])
def test_vectors_that_share_much_are_not_paired(spark, name, count, width, share, pairs):
    v = _vectors(spark, count, width, share)
    own = scoring.inverted_index(v, v, 2) if name == "inverted_index" else scoring.split(v, v, scoring.common_features(v, share), 2)
    assert ("Join Inner, (fid" in own._jdf.queryExecution().optimizedPlan().toString()) == pairs
    rows = {r.ex_id: (set(r.fv), r.alpha) for r in v.collect()}
    want = {k: sum(a * (len(fv & other) + 1) ** 2 for other, a in rows.values()) for k, (fv, _) in rows.items()}
    assert {r.ex_id: r.score for r in own.collect()} == want


def test_shards_are_spark_s_hash(spark):
    rng = np.random.default_rng(3)
    doc, line, event = rng.integers(-(1 << 60), 1 << 60, 200), rng.integers(0, 1 << 20, 200), rng.integers(0, 1 << 20, 200)
    df = spark.createDataFrame(list(zip(doc.tolist(), line.tolist(), event.tolist())), "a long, b int, c int")
    want = [r[0] for r in df.selectExpr("pmod(xxhash64(struct(a, b, c)), 8)").collect()]
    assert chunks.shard_of(doc, line, event, 8).tolist() == want


def test_mixed_training_streams_blocks_of_its_shards(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, int(rng.choice([-1, 1])), sorted(rng.choice(30, 5, replace=False).tolist())) for k in range(200)]
    ex = spark.createDataFrame(rows, "pos long, y int, fv array<long>")
    shard = {r.pos: r.s for r in ex.selectExpr("pos", "pmod(xxhash64(pos), 3) AS s").collect()}
    want: dict[int, float] = {}
    for _ in range(2):
        total: dict[int, float] = {}
        for s in range(3):
            own = [(y, np.array(fv)) for k, y, fv in rows if shard[k] == s]
            used = {f for _, fv in own for f in fv.tolist()}
            for f, w in training.fit_linear(own, "PA-I", 0.1, 1, False, {f: w for f, w in want.items() if f in used}).items():
                total[f] = total.get(f, 0.0) + w
        want = {f: w / 3 for f, w in total.items()}
    monkeypatch.setattr(training, "fit_linear", None)  # no task holds its shard
    got = {r.fid: r.w for r in training.train_mixed(ex, 3, "PA-I", 0.1, 2).collect()}
    assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 1e-12 for f in want)


@pytest.mark.parametrize("average", [True, False])
def test_exact_training_streams_blocks(spark, monkeypatch, average):
    rng = np.random.default_rng(6)
    rows = [(k, int(rng.choice([-1, 1])), sorted(rng.choice(30, 5, replace=False).tolist())) for k in range(200)]
    want = training.fit_linear([(y, np.array(fv)) for _, y, fv in rows], "PA-I", 0.1, 3, average)
    monkeypatch.setattr(training, "fit_linear", None)  # the task doesn't hold all examples
    ex = spark.createDataFrame(rng.permutation(np.array(rows, dtype=object)).tolist(), "pos long, y int, fv array<long>")
    got = {r.fid: r.w for r in training.train_linear(ex, "PA-I", 0.1, 3, average).collect()}
    assert got == want
