import os
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions.expressions import kernel_coefficients
from lexiloom.operators import dictionary, features, models, parsing, scoring, training, views
from lexiloom.sources import formats

GOLD = [1, 3, 3, -1]


@pytest.mark.parametrize(
    ("strategy", "events"),
    [
        ("linear", [(0, 1, -1, 1), (1, 2, -1, -1)]),
        ("chunking", [(1, 2, -1, -1), (0, 1, -1, 1)]),
        ("backward", [(2, 3, -1, 1), (1, 2, -1, -1), (1, 3, -1, 1), (0, 1, -1, 1), (0, 3, -1, -1)]),
        ("tournament", [(0, 1, 2, -1), (0, 1, 3, -1), (1, 2, 3, 1)]),
    ],
)
def test_gold_events(strategy, events):
    assert parsing.gold_events(GOLD, strategy) == events


def test_constant_answers():
    assert parsing.shift_reduce(4, lambda *_: 1.0)[0] == [1, 2, 3, -1]
    assert parsing.shift_reduce(4, lambda *_: 0.0)[0] == [3, 3, 3, -1]


def test_gold_decoding_gives_the_tree_back():
    for strategy in ("linear", "backward"):
        assert parsing.DECODERS[strategy](4, lambda i, j, _: float(GOLD[i] == j))[0] == GOLD


def test_fold_equals_shift_reduce(spark):
    rows = spark.createDataFrame([(1, n, n) for n in (1, 2, 5, 9)], "doc_id long, line_no int, n int")
    got = parsing.fold_shift_reduce(rows, lambda i, j: F.pmod(i * 3 + j, F.lit(4)) > 1).collect()
    for r in got:
        assert list(r.heads) == parsing.shift_reduce(r.line_no, lambda i, j, _: float((i * 3 + j) % 4 > 1))[0]


@pytest.mark.parametrize(("degree", "want"), [(1, [1, 1]), (2, [1, 3, 2]), (3, [1, 7, 12, 6]), (4, [1, 15, 50, 60, 24])])
def test_kernel_coefficients(degree, want):
    assert kernel_coefficients(degree) == want


def _sentence(rng, n):
    """A made-up sentence's phrases: gold heads, brackets, context bits and sides of a few features each."""
    heads = [int(rng.integers(i + 1, n)) for i in range(n - 1)] + [-1]
    bracket = rng.integers(-1, 2, size=n)
    ctx = [sorted(rng.choice(8, size=int(rng.integers(0, 3)), replace=False).tolist()) for _ in range(n)]
    sides = [[sorted(rng.choice(np.arange(at, at + 20), size=4, replace=False).tolist()) for _ in range(n)] for at in (1, 30, 60)]
    return heads, bracket, np.cumsum(bracket), ctx, sides


def _competitors(i, j, heads, ctx):
    """By the definition: from each phrase after i, its chain's first phrase whose head is j or unknown; a chain that
    leads to j or beyond ends the search."""
    found, k = set(), i + 1
    while k < j:
        chain = k
        while heads[chain] != -1 and heads[chain] != j:
            chain = heads[chain]
        if chain >= j:
            return found
        found |= set(ctx[chain])
        k = chain + 1
    return found


@pytest.mark.parametrize("strategy", ["linear", "chunking", "backward", "tournament"])
def test_scorers_equal_whole_vectors(strategy):
    """The sums that drive a decoder are those of the whole vectors' weights, decision by decision."""
    rng = np.random.default_rng(6)
    w = {f: float(x) for f, x in enumerate(rng.normal(size=300))}
    for n in (1, 2, 3, 9, 17):
        heads, bracket, inner, ctx, sides = _sentence(rng, n)
        pairs = parsing.Whole(inner, bracket, ctx)
        bases = [100, 150]
        of = parsing.VectorScorer(sides, pairs, bases, models.Linear(w))
        sums = [np.array([sum(w[f] for f in x) for x in side]) for side in sides]
        fast = parsing.LinearScorer(sums, pairs, [[w[b + p] for p in range(14)] for b in bases])
        asked = []

        def ask(i, j, found, k=None):
            fv = of.vector(i, j, found, k)
            want = [*sides[0][i], *sides[1][j]]
            for base, to in zip(bases, (j, k)):
                if to is not None:
                    inside = int(bracket[i + 1 : to].sum())
                    want += [base + (0 if to - i == 1 else 1 if to - i < 6 else 2), base + 3 + (0 if inside > 0 else 1 if inside < 0 else 2)]
                    want += [base + 6 + c for c in _competitors(i, to, found, ctx)]
            assert fv == sorted(want + (sides[2][k] if k is not None else []))
            assert fast.margin(i, j, found, k) == pytest.approx(sum(w[f] for f in fv))
            asked.append((i, j, k))
            return fast(i, j, found, k)

        if n > 1:
            (got, p), (want, q) = parsing.DECODERS[strategy](n, ask), parsing.DECODERS[strategy](n, of)
            assert got == want and p == pytest.approx(q)
            assert asked or n < 3


def test_every_kind_of_model_drives_a_parser(spark):
    rng = np.random.default_rng(8)
    rows = []
    for line in range(6):
        n = int(rng.integers(2, 8))
        heads, bracket, inner, ctx, sides = _sentence(rng, n)
        rows += [(1, line, i, heads[i], int(bracket[i]), int(inner[i]), ctx[i], sides[0][i], sides[1][i], sides[2][i]) for i in range(n)]
    phrases = spark.createDataFrame(rows, "doc_id long, line_no int, id int, did int, bracket int, inner int, ctx array<int>, lft array<long>, rgt array<long>, far array<long>").cache()
    w = {f: float(x) for f, x in enumerate(rng.normal(size=300))}
    weights = spark.createDataFrame(list(w.items()), "fid long, w double")
    base = 100
    for strategy in parsing.DECODERS:
        template = parsing.template_of(strategy)
        whole = [[w[b + p] for p in range(14)] for b in (base, 150)]
        want = sorted(map(tuple, parsing.parse(parsing.static_margins(phrases, weights, template), strategy, whole).select("line_no", "id", "est_did").collect()))
        by = parsing.parse_with(phrases, strategy, [base, 150], models.classifier("linear", weights))
        assert sorted(map(tuple, by.select("line_no", "id", "est_did").collect())) == want
        # A kernel of degree 1 with one support vector a feature, and two labels' weights, are that linear model again.
        svs = spark.createDataFrame([(x, [f]) for f, x in w.items()] + [(-sum(w.values()), [999])], "alpha double, fv array<long>")
        logs = spark.createDataFrame([("+1" if f % 2 else "-1", [f], x if f % 2 else -x) for f, x in w.items()], "label string, combo array<long>, w double")
        for kind, table in (("kernel", svs), ("loglinear", logs)):
            got = parsing.parse_with(phrases, strategy, [base, 150], models.classifier(kind, table, degree=1))
            assert sorted(map(tuple, got.select("line_no", "id", "est_did").collect())) == want
    for degree in (2, 3):
        some = [(float(a), sorted(rng.choice(12, size=5, replace=False).tolist())) for a in rng.normal(size=9)]
        margin = models.from_kernel(some, degree)
        x = sorted(rng.choice(12, size=6, replace=False).tolist())
        assert margin(x) == pytest.approx(sum(a * (len(set(x) & set(v)) + 1) ** degree for a, v in some))


def test_training_examples_hold_every_decision(spark):
    rng = np.random.default_rng(9)
    heads, bracket, inner, ctx, sides = _sentence(rng, 7)
    rows = [(1, 0, i, heads[i], int(bracket[i]), int(inner[i]), ctx[i], sides[0][i], sides[1][i], sides[2][i]) for i in range(7)]
    phrases = spark.createDataFrame(rows, "doc_id long, line_no int, id int, did int, bracket int, inner int, ctx array<int>, lft array<long>, rgt array<long>, far array<long>")
    for strategy in parsing.DECODERS:
        got = parsing.training_examples(phrases, strategy, 4, 8).orderBy("event_no").collect()
        assert [(r.i, r.j, r.k, r.y) for r in got] == parsing.gold_events(heads, strategy)
        first = features.global_base(parsing.template_of(strategy), 4, 8)
        for r in got:
            assert list(r.fv) == sorted(r.fv) and set(sides[0][r.i]) | set(sides[1][r.j]) <= set(r.fv)
            if strategy == "tournament":
                bits = {c for k in range(r.i + 1, r.j) for c in ctx[k]}
                assert {f - first - 6 for f in r.fv if first + 6 <= f < first + 14} == bits and set(sides[2][r.k]) <= set(r.fv)


def test_update_steps():
    assert training.step("PA-I", 0.0, 4) == 0.25
    assert training.step("PA-II", 0.0, 4) == pytest.approx(1 / 4.5)
    assert training.step("P", 0.1, 4) is None and training.step("PA", 1.0, 4) == 0.0


def test_scorers_agree_beyond_degree_two(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i, int(rng.choice([-1, 1])), sorted(rng.choice(9, size=int(rng.integers(0, 7)), replace=False).tolist())) for i in range(20)]
    v = spark.createDataFrame(rows, "ex_id long, sv_id long, alpha int, fv array<long>").cache()
    want = {a: sum(s * (2 * len(set(x) & set(y)) + 1) ** 3 for _, _, s, y in rows) for a, _, _, x in rows}
    combos = scoring.expand(v, 3, s=2)
    for got in (scoring.inverted_index(v, v, 3, s=2), scoring.expanded(v, combos, scoring.constant(v, 3), 3), scoring.split(v, v, scoring.common_features(v, 0.4), 3, s=2)):
        assert {r.ex_id: round(r.score) for r in got.collect()} == want


def test_trained_models(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):
        fv = sorted(rng.choice(20, size=6, replace=False).tolist())
        rows.append((i, 1 if 3 in fv or 4 in fv else -1, [*fv, 20]))
    ex = spark.createDataFrame(rows, "pos long, y int, fv array<long>")
    for w in (training.train_linear(ex, "PA-I", 1.0, 10), training.train_mixed(ex, 3, "PA-I", 1.0, 4)):
        w = {r.fid: r.w for r in w.collect()}
        assert np.mean([(sum(w.get(f, 0) for f in fv) >= 0) == (y > 0) for _, y, fv in rows]) > 0.9
    svs = training.train_kernel(ex, "PA-I", 1.0, 3)
    score = {r.ex_id: r.score for r in scoring.inverted_index(ex.withColumn("ex_id", F.col("pos")), svs, 2).collect()}
    assert np.mean([(score[p] >= 0) == (y > 0) for p, y, _ in rows]) > 0.9


def test_files_and_models(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# S\n* 0 1D\nA\tN,x\n* 1 -1D\nB\tV,y\nEOS\nXEOS\tN,x\nEOS\nlost\n")
    s = formats.read_sentences(spark, str(tmp_path / "a.txt"))
    assert s.count() == 2
    tokens, heads = formats.parse_dependencies(s.where("line_no = 0"))
    assert [(r.surface, r.pos1, r.infl, r.bun) for r in tokens.orderBy("idx").collect()] == [("A", "N", "", 0), ("B", "V", "", 1)]
    assert [r.did for r in heads.orderBy("id").collect()] == [1, -1]
    assert [r.surface for r in formats.parse_pos(s.where("line_no = 1")).collect()] == ["XEOS"]
    svs = spark.createDataFrame([(0.5, [3, 1]), (-2.0, [2])], "alpha double, fv array<long>")
    params, back = formats.parse_kernel_model(formats.format_kernel_model(svs, 2))
    assert params == {"d": 2.0, "s": 1.0, "r": 1.0, "b": 0.0}
    assert sorted((r.alpha, list(r.fv)) for r in back.collect()) == [(-2.0, [2]), (0.5, [1, 3])]
    assert formats.sniff_charset("日本".encode("euc_jp")) == "euc_jp" or formats.sniff_charset("日本".encode()) == "utf-8"


def test_units_become_phrases(spark):
    text = "# S\n* 1D\n+ 1D\na x b c 0 d 0 e 0 f 0\n+ 4D\nb x b c 0 d 0 e 0 f 0\n* -1D\n+ -1D\nc x b c 0 d 0 e 0 f 0"
    got = formats.convert_units(spark.createDataFrame([(1, 0, text)], "doc_id long, line_no int, content string")).first().content.split("\n")
    assert got[0] == "* 0 1D" and got[3] == "* 1 -1D" and got[-2] == "EOS"
    assert formats.convert_units(spark.createDataFrame([(1, 0, text.replace("+ 4D", "+ 9D"))], "doc_id long, line_no int, content string")).count() == 0


def test_frequency_ranks_beyond_small_counts_and_numbers(spark):
    """Counts on both sides of 64 and 256, numbers on both sides of 65,536, and ties."""
    counts = {1: 300, 70_000: 260, 65_535: 260, 65_536: 64, 3: 64, 9: 63, 140_000: 63, 2: 7, 9_000_000_000: 7, 5: 1000}
    rows = spark.createDataFrame([(f, n) for f, n in counts.items()], "fn long, n int").selectExpr("fn", "explode(sequence(1, n)) AS x").select("fn")
    got = [(r.fn, r.cnt) for r in dictionary.frequency_rank(rows).orderBy("fi").collect()]
    assert got == sorted(counts.items(), key=lambda x: (-x[1], -x[0]))


def test_dictionary_order_and_checks(spark):
    rows = [(7, 0, 0, "b", "CONTENT", "*", "b"), (2, 1, 0, "the", "PARTICLE", "*", "he"), (2, 0, 1, "a", "PARTICLE", "x", "a"), (5000, 0, 0, None, "CONTENT", "*", "z"), (-3, 0, 0, "neg", "CONTENT", "*", "eg")]
    m = spark.createDataFrame(rows, "doc_id long, line_no int, idx int, surface string, pos1 string, pos2 string, infl string")
    d = dictionary.build(m)
    assert [r.str for r in d.orderBy("id").collect()] == ["a", "the", "neg", "CONTENT", "*", "eg", "PARTICLE", "x", "he", "b", "z", ",", ".", "(", ")", "SPECIAL"]
    dictionary.check(d)
    with pytest.raises(ValueError):
        dictionary.check(dictionary.build(m.where("pos1 <> 'PARTICLE'")))
    ids = features.with_ids(m, d, d.count()).orderBy("doc_id", "line_no").collect()
    assert [r.surface_id for r in ids] == [2, 0, 1, 9, 16] and [r.infl_id for r in ids] == [5, 0, 8, 9, 10]


def _realign_by_offsets(starts, heads, lengths):
    """By offsets alone: a gold border is kept where a new token begins; each that isn't is merged if the phrase before it hangs on the
    one behind it, from left to right, and no token covers two borders."""
    begins = np.r_[0, np.cumsum(lengths)].tolist()
    merged, head = list(range(len(starts))), list(heads)
    groups = [[0]]
    for k in range(1, len(starts)):
        if starts[k] in begins:
            groups.append([k])
            continue
        token = max(x for x in begins if x < starts[k])
        end = min(x for x in begins if x > starts[k])
        if any(j != k and token < starts[j] < end for j in range(1, len(starts))):
            return None
        if (starts[k + 1] if k + 1 < len(starts) else begins[-1]) != end and (starts[k + 1] if k + 1 < len(starts) else begins[-1]) not in begins:
            return None
        if heads[groups[-1][-1]] != k:
            return None
        groups[-1].append(k)
    of = {k: g for g, own in enumerate(groups) for k in own}
    return [of[max(k for k in range(len(starts)) if starts[k] <= b)] for b in begins[:-1]], [of.get(head[own[-1]], -1) for own in groups]


def test_realign():
    # A B|C D|E with the border before C inside a token, and B's phrase hanging on C's.
    assert formats.realign([0, 2, 4], [1, 2, -1], [1, 2, 1, 1]) == ([0, 0, 0, 1], [1, -1])
    assert formats.realign([0, 2, 4], [2, 2, -1], [1, 2, 1, 1]) is None
    assert formats.realign([0, 2, 4], [1, 2, -1], [2, 2, 1]) == ([0, 1, 2], [1, 2, -1])
    assert formats.realign([0, 2, 4], [1, 2, -1], [5]) is None
    assert formats.realign([0, 1, 3], [1, 2, -1], [2, 1, 1]) == ([0, 0, 1], [1, -1])
    assert formats.realign([], [], []) is None
    rng = np.random.default_rng(12)
    both = 0
    for _ in range(3000):
        total = int(rng.integers(2, 14))
        starts = [0, *sorted(rng.choice(np.arange(1, total), size=int(rng.integers(0, min(5, total))), replace=False).tolist())]
        cuts = sorted(rng.choice(np.arange(1, total), size=int(rng.integers(0, total)), replace=False).tolist())
        lengths = np.diff([0, *cuts, total]).tolist()
        heads = [int(rng.integers(i + 1, len(starts))) for i in range(len(starts) - 1)] + [-1]
        got = formats.realign(starts, heads, lengths)
        if all(s in np.cumsum([0, *lengths]) for s in starts):
            assert got is not None and got[1] == heads
        if got is not None:
            want = _realign_by_offsets(starts, heads, lengths)
            if want is not None:
                assert got == want
                both += len(got[1]) < len(heads)
            assert len(got[0]) == len(lengths) and sorted(set(got[0])) == list(range(len(got[1]))) and got[1][-1] == -1
            assert all(h > i for i, h in enumerate(got[1][:-1]))
    assert both > 50


def test_realigned_sentences(spark):
    gold = spark.createDataFrame([(1, 0, 0, "ab", 0), (1, 0, 1, "cd", 1), (1, 0, 2, "e", 2), (1, 1, 0, "xy", 0), (1, 1, 1, "z", 1), (1, 2, 0, "q", 0)], "doc_id long, line_no int, idx int, surface string, bun int")
    heads = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, 2), (1, 0, 2, -1), (1, 1, 0, 1), (1, 1, 1, -1), (1, 2, 0, -1)], "doc_id long, line_no int, id int, did int")
    new = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "bc"), (1, 0, 2, "d"), (1, 0, 3, "e"), (1, 1, 0, "xy"), (1, 1, 1, "z")], "doc_id long, line_no int, idx int, surface string")
    got = {r.line_no: r for r in formats.realigned(new, gold, heads).collect()}
    assert [got[k].ok for k in range(3)] == [True, True, False]
    assert got[0].bun == [0, 0, 0, 1] and got[0].heads == [1, -1] and got[1].heads == [1, -1] and got[2].heads is None


def test_headers_are_kept(spark):
    s = spark.createDataFrame([(1, 0, "# S-ID:1 x\n# more\n* 0 -1D\nA\tN,x\nEOS"), (1, 1, "* 0 -1D\nB\tN,x")], "doc_id long, line_no int, content string")
    tokens, heads = formats.parse_dependencies(s)
    out = formats.format_sentences(tokens, heads.withColumn("est_did", F.col("did")), "est_did", kind="depnd", headers=formats.headers(s)).orderBy("line_no").collect()
    assert out[0].content == "# S-ID:1 x\n* 0 -1D@0.000000 -1D\nA\tN,x,*,,A,*\nEOS\n" and out[1].content.startswith("* 0 -1D@")
    chunked = formats.parse_chunked(spark.createDataFrame([(1, 0, "#c\n*\nA\tN,x\nB\tV,y\n*\nC\tN,z\nEOS")], "doc_id long, line_no int, content string"))
    assert [(r.surface, r.chunk_ref) for r in chunked.orderBy("idx").collect()] == [("A", True), ("B", False), ("C", True)]


def test_training_options(spark):
    rng = np.random.default_rng(5)
    data = [(1 if rng.random() < 0.5 else -1, np.unique(rng.integers(0, 15, size=5))) for _ in range(60)]
    # Averages against sums of all steps' weights.
    for epochs in (1, 3):
        w, total, seen = {}, {}, 1
        a, atotal = {}, {}
        for _ in range(epochs):
            for y, fv in data:
                tau = training.step("PA-I", y * sum(w.get(f, 0.0) for f in fv.tolist()), len(fv), 0.1)
                for f in fv.tolist() if tau is not None else []:
                    w[f] = w.get(f, 0.0) + y * tau
                fs = tuple(fv.tolist())
                tau = training.step("PA-I", y * sum(x * (len(set(fs) & set(v)) + 1) ** 2 for v, x in a.items()), len(fs), 0.1)
                if tau is not None:
                    a[fs] = a.get(fs, 0.0) + y * tau
                for f, x in w.items():
                    total[f] = total.get(f, 0.0) + x
                for v, x in a.items():
                    atotal[v] = atotal.get(v, 0.0) + x
                seen += 1
        got = training.fit_linear(data, "PA-I", 0.1, epochs)
        assert {f: pytest.approx(x / seen) for f, x in total.items()} == got
        kernel = training.fit_kernel(data, "PA-I", 0.1, epochs, average=True)
        assert {v: pytest.approx(x / seen) for v, x in atotal.items()} == kernel
    ex = spark.createDataFrame([(i, y, fv.tolist()) for i, (y, fv) in enumerate(data)], "pos long, y int, fv array<long>")
    once = training.train_linear(ex, "PA-I", 0.1, 2, average=False)
    again = {r.fid: r.w for r in training.train_linear(ex, "PA-I", 0.1, 1, average=False, start=training.train_linear(ex, "PA-I", 0.1, 1, average=False)).collect()}
    assert {r.fid: pytest.approx(r.w) for r in once.collect()} == again
    mixed = training.fit_linear(data, shuffle=3)
    assert mixed == training.fit_linear(data, shuffle=3) != training.fit_linear(data)
    curve = training.learning_curve(ex, ex, "PA-I", 0.1, 4).orderBy("epoch").collect()
    assert [r.epoch for r in curve] == [1, 2, 3, 4] and all(r.n == 60 for r in curve)
    last = training.fit_linear(data, "PA-I", 0.1, 4)
    assert curve[-1].correct == sum((sum(last.get(f, 0) for f in fv.tolist()) >= 0) == (y > 0) for y, fv in data)
    numbered, numbers = training.number_features(data)
    assert sorted(numbers.values()) == list(range(1, len(numbers) + 1)) and list(numbers)[: len(data[0][1])] == data[0][1].tolist()
    assert training.number_features([(1, [77, 5])], {5: 1})[1] == {5: 1, 77: 2}
    model = training.fit_log_linear(ex, 15)
    assert model.coefficients.size == 15


def test_views():
    assert views.draw(["a", "b"], [1, -1], [1, -1]).count("\n") == 1


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",), ("lexiloom/llm/__pycache__/queries.pyc", "corpus_pipeline.py")])
def test_rest_works_without_training_data_operators(tmp_path, left):
    """Also where the pipeline's file or a folder of compiled code stays behind."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "lexiloom"), tmp_path / "lexiloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    for name in left:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("from lexiloom.llm import quality\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'eval_chunk' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
