"""The ten operators against brute force, round trips and held-out accuracy, and in every odd case they define."""

import hashlib
import itertools
import os
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lexiloom.llm import bpe, chat, common, embedding_dedup, media, ngram_join, packing, quality, token_files, tokens, toxicity, warc

DOCS = "doc_id long, text string, tokens string, quality_score string, toxicity_score int, decoded string"
ODD = ["Hello world, it's 3 o'clock.", None, "", "  \n\t ", "ein Haus für Müller\n\nund 東京", "x" * 5000, "Hello world, it's 3 o'clock.", " 😀 it's  two   blanks \r\n", "word " * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([*((i, t, "a", "b", 1, "c") for i, t in enumerate(ODD)), (0, ODD[0], "a", "b", 1, "c"), (None, "no id", "a", "b", 1, "c")], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def gold():
    return tokens.encoder(common.tokenizer_path(tokens.VOCABULARY))


def test_packing(odd, none, gold):
    by = {}
    for r in packing.pack(odd, most=64).collect():
        assert r.length == len(r.tokens) == 1 << r.bucket <= 64
        by.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(ODD):
        rows = sorted(by.get(i, []), key=lambda r: (r.start, r.piece))
        want = gold.encode_ordinary(t or "")
        if i == 0:  # a repeated row gives its pieces again
            rows = rows[::2]
        assert sum((list(r.tokens) for r in rows), []) == want
        assert [r.length for r in rows] == sorted((r.length for r in rows), reverse=True)
        assert len([r for r in rows if r.length < 64]) == bin(len(want) % 64).count("1")
    assert None in by and packing.pack(none).count() == 0


def test_token_files(spark, odd, none, gold):
    path = common.scratch(spark, "files")
    rows = token_files.write(odd, path).orderBy("start", "part", "row").collect()
    files = token_files.TokenFiles(path)
    assert len(files) == len(rows) == len(ODD) + 2
    got = sorted(tuple(files[i].tolist()) for i in range(len(files)))
    assert got == sorted(tuple(gold.encode_ordinary(t or "")) for t in [*ODD, ODD[0], "no id"])
    assert rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in itertools.pairwise(rows))
    assert token_files.write(none, common.scratch(spark, "files")).count() == 0


def test_bpe(odd, none, gold):
    rows = bpe.encode(odd, check=True).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        if r.doc_id is not None:
            t = ODD[r.doc_id]
            assert (r.tokens is None) == (t is None)
            assert t is None or list(r.tokens) == gold.encode_ordinary(t) and r.decoded
    back = bpe.decode(bpe.encode(odd)).collect()
    assert all(r.doc_id is None or r.text == ODD[r.doc_id] for r in back)
    assert bpe.encode(none).count() == 0


def test_texts_beyond_a_slice(spark, gold):
    long = "many words, it's\n\n long " * 400_000
    assert len(long) > tokens.SLICE
    df = spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string")
    want = gold.encode_ordinary(long)
    got = packing.pack(df).where("doc_id = 1").orderBy("piece").collect()
    assert sum((list(r.tokens) for r in got), []) == want and all(len(r.tokens) == r.length for r in got)
    r = bpe.encode(df, check=True).where("doc_id = 1").first()
    assert list(r.tokens) == want and r.decoded
    path = common.scratch(spark, "files")
    rows = token_files.write(df, path).orderBy("doc_id").collect()
    assert rows[0].n_tokens == len(want) and max(len(token_files.TokenFiles(path)[i]) for i in range(2)) == len(want)


def test_bpe_random_words(gold):
    rng = np.random.default_rng(5)
    m = bpe.merges(common.tokenizer_path(tokens.VOCABULARY))
    words = [bytes(rng.choice(list(b"aetinsrho"), size=int(rng.integers(1, 24))).astype(np.uint8)) for _ in range(800)] + [b"a" * k for k in range(1, 40)]
    ids, bounds = bpe.encode_words(words, m)
    for w, s, e in zip(words, bounds[:-1], bounds[1:]):
        assert ids[s:e].tolist() == gold._encode_single_piece(w)


WORDS = "lamen rivet solano dorin pelka mora tinse varo kelis unta brado simel ocar fenta luri".split()


def _corpus(rng, n, bad=0.3):
    rows, labels = [], []
    for i in range(n):
        t = rng.choice(WORDS, size=int(rng.integers(15, 40))).tolist()
        toxic, poor = rng.random() < bad, rng.random() < bad
        if toxic:
            w = "grobfuk" if rng.random() < 0.7 else "zarkwit"
            k = rng.integers(0, 3)
            w = w if k == 0 else "-".join(w) if k == 1 else w[:3] + "*" + w[3:]
            t.insert(int(rng.integers(0, len(t))), w)
        if poor:
            t = ["buy !!! $$$ now click"] * 8
        rows.append((i, " ".join(t)))
        labels.append((i, int(not poor), int(toxic and not poor)))
    return rows, labels


def test_classifiers(spark, odd, none):
    rows, labels = _corpus(np.random.default_rng(7), 700)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels[:500], (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    w = quality.train(spark, docs, known)
    good = {r.doc_id: r.quality_keep for r in quality.score(docs, w).collect()}
    assert np.mean([good[i] == bool(q) for i, q, _ in labels[500:]]) > 0.95
    model = toxicity.train(spark, docs, known)
    bad = {r.doc_id: r.toxicity_reject for r in toxicity.score(docs, model).collect()}
    assert np.mean([bad[i] for i, _, t in labels[500:] if t]) > 0.9
    assert np.mean([bad[i] for i, _, t in labels[500:] if not t]) < 0.02
    kept = quality.score(odd, w)
    assert kept.columns[-2:] == ["quality_score_", "quality_keep"] and kept.count() == len(ODD) + 2
    assert all(r.quality_keep for r in kept.where("doc_id in (1, 2, 3)").collect())
    scored = toxicity.score(odd, model)
    assert scored.columns[-2:] == ["toxicity_score_", "toxicity_reject"]
    assert {r.toxicity_score_ for r in scored.where("doc_id in (1, 2, 3)").collect()} == {-1.0}
    assert quality.score(none, w).count() == toxicity.score(none, model).count() == 0
    nobody = known.where("false")
    assert quality.keep_good(spark, docs, nobody).count() == toxicity.keep_clean(spark, docs, nobody).count() == 700
    assert quality.keep_good(spark, odd, known).columns == odd.columns


def _subsequences(f):
    """Brute force: the summed weights of every triple of symbols of a fragment, gaps allowed, by code."""
    out = {}
    for i, j, k in itertools.combinations(range(len(f)), 3):
        if k - i < toxicity.SPAN:
            code = f[i] << 12 | f[j] << 6 | f[k]
            out[code] = out.get(code, 0.0) + toxicity.DECAY ** (k - i + 1)
    return out


def test_string_kernel_counts_gapped_subsequences():
    rng = np.random.default_rng(59)
    items = [b"\x01" + bytes(rng.integers(2, 8, size=int(rng.integers(0, 14))).astype(np.uint8)) for _ in range(40)]
    norm = toxicity.length_norm(np.array([len(x) for x in items]))
    own = [_subsequences(x) for x in items]
    got = toxicity.kernel(items, items[:15])
    for a in range(40):
        for b in range(15):
            assert got[a, b] == pytest.approx(sum(w * own[b].get(c, 0.0) for c, w in own[a].items()) / (norm[a] * norm[b]))
    weights = rng.normal(size=1 << 18)
    want = [sum(w * weights[c] for c, w in x.items()) / n + 0.25 for x, n in zip(own, norm)]
    assert toxicity._score_list(items, weights, 0.25) == pytest.approx(want)


def test_collapsed_machine_equals_its_landmarks():
    """Weights a subsequence give the same decisions as features by landmarks and the machine over them."""
    rng = np.random.default_rng(61)
    items = [b"\x01" + bytes(rng.integers(2, 9, size=int(rng.integers(3, 12))).astype(np.uint8)) for _ in range(60)]
    marks = items[:20]
    base = toxicity.kernel(marks, marks)
    lam, vec = np.linalg.eigh((base + base.T) / 2)
    keep = lam > lam.max() * 1e-6
    whiten = vec[:, keep] / np.sqrt(lam[keep])
    x = toxicity.kernel(items, marks) @ whiten
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    w, bias = toxicity.hinge(x, y)
    # The machine is at its optimum: no direction lowers ridge and squared hinge.
    loss = lambda v, b: v @ v / 2 + b * b / 2 + 10.0 * (np.maximum(0, 1 - y * (x @ v + b)) ** 2).sum()
    for _ in range(50):
        d, e = rng.normal(size=len(w)) * 1e-3, rng.normal() * 1e-3
        assert loss(w + d, bias + e) >= loss(w, bias) - 1e-6
    r, c, v = toxicity._map(marks)
    weights = np.bincount(c, v * (whiten @ w)[r], minlength=1 << 18)
    assert toxicity._score_list(items, weights, bias) == pytest.approx(x @ w + bias)


def test_toxicity_ties_and_slices():
    texts = ["clean words here", "x " * 700_000 + "grobfuk", "", "grobfuk"]
    weights = np.zeros(1 << 18)
    for c, w in _subsequences(bytes(toxicity.SYMBOL[list(b" grobfuk")])).items():
        weights[c] = w
    got = toxicity.text_scores(pa.array(texts), weights, 0.0)
    assert len(texts[1]) > common.SLICE_BYTES and got[1] == got[3] > got[0] and got[2] == -1
    model = (weights.astype(np.float32), 0.0, float(got[3]))
    assert not (toxicity.text_scores(pa.array(texts[3:]), model[0], 0.0) > model[2]).any()


def test_ftrl_equals_its_formula():
    rng = np.random.default_rng(67)
    examples = []
    for _ in range(120):
        i, x = quality.example(rng.integers(0, 40, size=int(rng.integers(1, 30))))
        examples.append((i, x, int(rng.random() < 0.4)))
    z, n = {}, {}
    alpha, beta, l1, l2 = 0.5, 0.1, 0.02, 0.1
    sizes = [sum(1 for e in examples if e[2] == k) for k in (0, 1)]

    def weight(f):
        if abs(z.get(f, 0.0)) <= l1:
            return 0.0
        return -(z[f] - np.sign(z[f]) * l1) / ((beta + n[f] ** 0.5) / alpha + l2)

    for _ in range(3):
        for i, x, y in examples:
            w = {f: weight(f) for f in i.tolist()}
            p = 1 / (1 + np.exp(-sum(w[f] * v for f, v in zip(i.tolist(), x))))
            for f, v in zip(i.tolist(), x):
                g = (p - y) * v * len(examples) / (2 * sizes[y])
                z[f] = z.get(f, 0.0) + g - ((n.get(f, 0.0) + g * g) ** 0.5 - n.get(f, 0.0) ** 0.5) / alpha * w[f]
                n[f] = n.get(f, 0.0) + g * g
    got = quality.ftrl(examples)
    assert {f: pytest.approx(weight(f), abs=1e-5) for f in z} == {f: float(got[f]) for f in z}
    assert np.count_nonzero(got) <= len(z)


def test_quality_score_is_a_sparse_dot_product():
    rng = np.random.default_rng(71)
    texts = [" ".join(rng.choice([*WORDS, "!!!", "a,b"], size=int(rng.integers(0, 60)))) for _ in range(50)] + [None, " ", "go go go", "w " * 600_000]
    w = rng.normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    got = quality.probabilities(pa.array(texts), w)
    for t, p in zip(texts, got):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        f, _ = quality.features(raw, np.array([0, len(raw)]))
        if not len(f):
            assert p == 1.0
            continue
        i, x = quality.example(f)
        assert p == pytest.approx(1 / (1 + np.exp(-float(w[i].astype(float) @ x))), abs=2e-6)
    # Each word gives itself and its pair; a word equal to one of the two before it becomes a shared mark.
    one, two = (quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in (b"go go on", b"up up on"))
    assert one[2] == two[2] and one[0] != two[0] and one[4] == two[4] and len(one) == 6


def test_rare_insults_become_witnesses():
    rng = np.random.default_rng(37)
    rare = ["".join(str(rng.choice(list(c))) for c in ("bdfgkwz", "aeiou", "bdfgkwz", "bdfgkwz", "aeiou", "bdfgkwz", "bdfgkwz")) for _ in range(15)]
    texts, toxic = [], []
    for i in range(600):
        t = rng.choice(WORDS, size=int(rng.integers(15, 40))).tolist()
        if i < 300:
            t.insert(int(rng.integers(0, len(t))), rare[i % 15] if 270 <= i else "grobfuk")
        texts.append(" ".join(t))
        toxic.append(i < 300)
    weights, bias, threshold = toxicity.fit(toxicity.cut(pa.array(texts)), toxic)
    got = toxicity.text_scores(pa.array(texts), weights, bias) > threshold
    assert got[:270].all() and got[270:300].all() and not got[300:].any()


def _vector_classes(rows, threshold=0.95):
    """Brute force: (vec_id, class_id, n_links) of rows (id, vector)."""
    rows = [(i, v) for i, v in rows if i is not None]
    parent, links = {i: i for i, _ in rows}, [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    unit = [np.array(v, float) / np.linalg.norm(v) if v and None not in v and np.isfinite(v).all() and any(v) else None for _, v in rows]
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = unit[a], unit[b]
        if x is not None and y is not None and len(x) == len(y) and x @ y >= threshold - 1e-9:
            links[a] += 1
            links[b] += 1
            p, q = sorted((find(rows[a][0]), find(rows[b][0])))
            parent[q] = p
    return sorted((i, find(i), n) for (i, _), n in zip(rows, links))


VECTORS = "vec_id long, embedding array<float>, node int, ball int"


def test_embedding_classes(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(300, 64))
    near = base[:60] + rng.normal(size=(60, 64)) * 0.12
    loose = base[9] + rng.normal(size=(40, 64)) * 0.25
    group = base[5] + rng.normal(size=(70, 64)) * 0.05
    x = np.r_[base, near, loose, group].astype(np.float32).astype(float)
    odd = [(900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] * 64), (904, [1.0] * 3), (None, [1.0] * 64), (0, x[0].tolist()), (905, [None] * 64), (906, (x[5] * 1e-30).tolist()), (907, (x[5] * 1e30).tolist())]
    # A cosine equal to the threshold.
    tie = [(910, [1.0, 0.0, 0.0, 0.0]), (911, [0.6, 0.8, 0.0, 0.0])]
    y = rng.normal(size=(10, 8))
    other = [*((1000 + i, v) for i, v in enumerate(y.tolist())), (1050, y[2].tolist())]
    rows = [*((i, v.tolist()) for i, v in enumerate(x)), *odd, *other]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], VECTORS)
    want = {(i, n): c for i, c, n in _vector_classes([(i, [float(np.float32(k)) if k is not None else None for k in v] if v else v) for i, v in rows])}
    got = {(r.vec_id, r.n_links): r.class_id for r in embedding_dedup.classes(df).collect()}
    assert sum(c for c in [n for _, n in got]) >= 0.99 * sum(n for _, n in want)
    assert len(set(want) & set(got)) >= 0.98 * len(want) and len(got) == len(want)
    assert [c for k, c in got.items() if k[0] in range(430, 470)] == [5] * 40
    assert embedding_dedup.classes(df.where("false")).count() == 0
    tied = spark.createDataFrame([(*r, 1, 2) for r in tie], VECTORS)
    assert {r.n_links for r in embedding_dedup.classes(tied, 0.6).collect()} == {1}
    assert {r.n_links for r in embedding_dedup.classes(tied, 0.61).collect()} == {0}


def test_embedding_groups_are_linked_without_their_pairs(spark, monkeypatch):
    rng = np.random.default_rng(43)
    centre = rng.normal(size=64)
    x = [centre, *(centre + rng.normal(size=(400, 64)) * 0.1)]
    rows = [(i, [float(k) for k in np.float32(v)]) for i, v in enumerate(x)] + [(500, rng.normal(size=64).tolist())]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], VECTORS)
    join = embedding_dedup.Join(df)
    assert join.balls.agg(F.max("held")).first()[0] >= 390
    assert join._met().count() < 400
    monkeypatch.setattr(embedding_dedup, "CELL", 3)
    monkeypatch.setattr(embedding_dedup, "PAIRED", 40)
    got = sorted(tuple(r) for r in embedding_dedup.classes(df).collect())
    assert got == _vector_classes(rows)


def test_estimates_are_unbiased_within_bounds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 64))
    x[200:] = x[:200] + rng.normal(size=(200, 64)) * 0.4
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    bits, factor, small, scale = embedding_dedup.codes(x.astype(np.float32), embedding_dedup.rotation(64, 0))
    sign = np.unpackbits(bits, axis=1, count=64).astype(float) * 2 - 1
    a, b = np.meshgrid(np.arange(400), np.arange(400))
    a, b = a.ravel(), b.ravel()
    high = embedding_dedup.upper_bounds(sign[a], factor[a], small[b], scale[b])
    exact = (x[a] * x[b]).sum(1)
    assert (high >= exact - 1e-6).mean() > 0.999
    f = factor[a].astype(float)
    estimate = (sign[a] * small[b]).sum(1) * scale[b] / (8 * f)
    assert abs((estimate - exact).mean()) < 0.003
    differ = np.unpackbits(bits[a] ^ bits[b], axis=1).sum(1)
    assert (differ <= embedding_dedup.most_bits(np.arccos(np.clip(exact, -1, 1)), 64)).mean() > 0.999


def _near(rng):
    texts = {}
    for i in range(80):
        texts[i] = " ".join(rng.choice(WORDS, size=int(rng.integers(1, 90))).tolist())
    for i in range(80, 160):
        w = texts[int(rng.integers(0, 80))].split()
        for _ in range(max(1, len(w) // 12)):
            w[int(rng.integers(0, len(w)))] = str(rng.choice(WORDS))
        texts[i] = " ".join(w)
    for i in range(160, 200):
        texts[i] = texts[3] + f" tail{i}"
    return texts


def _pairs(texts, threshold=ngram_join.THRESHOLD):
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set()
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def _classes(rows, threshold=ngram_join.THRESHOLD):
    """Brute force: (doc_id, class_id, n_links) of rows (doc_id, text)."""
    rows = [(i, t) for i, t in rows if i is not None]
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set())
    links, parent = [0] * len(rows), {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(rows[a][0]), find(rows[b][0])))
            parent[y] = x
    return sorted((i, find(i), n) for (i, _), n in zip(rows, links))


def _tied():
    """Pairs of texts whose similarity is 11 / 20, the threshold, and just below it."""
    out = []
    for at, (n, m) in enumerate(((11, 20), (10, 20), (22, 40), (21, 40))):
        own = [f"t{at}x{k}" for k in range(m + 1)]
        out += [(2000 + 2 * at, " ".join(own)), (2001 + 2 * at, " ".join(own[: n + 1]))]
    return out


def test_ngram_join(spark):
    texts = _near(np.random.default_rng(13))
    odd = [(500, None), (501, ""), (502, " \n"), (503, "single"), (504, "SINGLE"), (3, texts[3]), (None, texts[3]), (505, texts[7]), (505, texts[9]), (2, "an id of two texts")]
    rows = [*texts.items(), *odd, *_tied()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("component", "node", "Class_ID")})
    want = _classes(rows)
    assert sorted(tuple(r) for r in ngram_join.classes(df).collect()) == want
    assert len({c for _, c, n in want if n}) > 20 and max(n for _, _, n in want) >= 40
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None)
    gone = {i for i, c, _ in want if i != c}
    assert ids == sorted(i for i, _ in rows if i is not None and i not in gone) and kept.where("doc_id is null").count() == 1
    assert ngram_join.classes(df.where("false")).count() == ngram_join.one_of_each(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        ngram_join.classes(df, threshold=0.5)


@pytest.mark.parametrize(("frequent", "threshold"), [(2, 0.55), (4, 0.7)])
def test_ngram_classes_blocks_and_stars_lose_no_pair(spark, monkeypatch, frequent, threshold):
    """All tokens frequent, some, or none; small blocks, stars, ranges and chunks."""
    texts = _near(np.random.default_rng(17 + frequent % 7))
    for name, value in (("BLOCK", 300), ("STAR", 7), ("RANGE", 500), ("PACKED", 400), ("COUNTED", 900), ("CHUNK", 50)):
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "ORDERED", 2)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in ngram_join.classes(df, threshold=threshold).collect()) == _classes(texts.items(), threshold)


def test_ngram_index_never_misses_a_joining_pair():
    """Without Spark: every joining pair of random sets has the meetings that the filter asks for."""
    rng = np.random.default_rng(3)
    for trial in range(30):
        rows = []
        for _ in range(12):
            base = rng.integers(0, 1 << 63, size=int(rng.integers(2, 400))).astype(np.uint64)
            for share in (1.0, 0.97, 0.8, 0.7):
                keep = base[rng.random(len(base)) < share]
                rows.append(np.unique(np.r_[keep, rng.integers(0, 1 << 63, size=int(len(base) * (1 - share) / 2) + 1).astype(np.uint64)]))
        g, bounds = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
        seen = np.unique(g >> np.uint64(64 - ngram_join.COUNTED_BITS)).astype(np.int64)
        second = np.sort(rng.choice(seen, size=int(len(seen) * rng.choice([0, 0.3, 0.9, 1.0])), replace=False))
        keys, of, place = ngram_join.index_entries(g, bounds, second, rng.integers(1, 9, size=len(second)).astype(np.uint8), 0.55, int(rng.integers(1, 5)))
        own = [dict(zip(keys[of == i].tolist(), place[of == i].tolist())) for i in range(len(rows))]
        for a, b in itertools.combinations(range(len(rows)), 2):
            over = len(np.intersect1d(rows[a], rows[b]))
            if over >= 0.55 * (len(rows[a]) + len(rows[b]) - over):
                n, m = np.array([len(rows[a])]), np.array([len(rows[b])])
                met = [k for k in own[a].keys() & own[b].keys() if ngram_join.within(np.array([own[a][k]]), n, m, 0.55)[0] and ngram_join.within(np.array([own[b][k]]), m, n, 0.55)[0]]
                assert len(met) >= ngram_join.least_shared(np.minimum(n, m))[0]


def test_ngram_counts(spark):
    rng = np.random.default_rng(47)
    t = np.sort(rng.integers(0, 1 << 40, size=500))
    t = np.sort(np.r_[t, t[:3], 5, 4 + (1 << 24), 3 + (2 << 24), 1 << 39])
    for x in (t, t[:1], t[-2:], np.array([0, 0])):
        assert ngram_join.unpacked_tokens(ngram_join.packed_tokens(x)).tolist() == x.tolist()
    texts = [" ".join(rng.choice(WORDS, size=20)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = {}
    for x in texts:
        for g in next(ngram_join.token_sets(pa.array([x])))[1].tolist():
            want[g >> 24] = want.get(g >> 24, 0) + 1
    tokens, classes = ngram_join.counted_tokens(df, sum(want.values()), least=3)
    assert dict(zip(tokens.tolist(), classes.tolist())) == {g: int(np.log2(k)) + 1 for g, k in want.items() if k >= 3}


def test_ngram_join_of_texts_beyond_a_slice(spark):
    long = " ".join(f"w{k}" for k in range(200_000))
    assert len(long) > common.SLICE_BYTES
    rows = [(1, long), (2, long + " more"), (3, long[: len(long) // 3]), (4, "w1 w2 w3")]
    got = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0)]


def test_near_copies_are_linked_without_their_pairs(spark):
    """A group of near copies is one ball: counted, and no pair of it is made."""
    rng = np.random.default_rng(29)
    base = [f"word{k}" for k in range(200)]
    rows = []
    for i in range(300):
        w = list(base)
        for k in rng.choice(200, size=3, replace=False):
            w[k] = f"own{i}x{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    join = ngram_join.Join(df)
    assert join.balls.count() > 285
    assert join.meetings().count() < 300 * 15
    assert {tuple(r)[1:] for r in ngram_join.classes(df).collect()} == {(0, 299)}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (3, 3), (None, 4), (5, 6), (6, 5)], "a long, b long")
    assert {(r.id, r.component) for r in common.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7), (5, 5), (6, 5)}


PAGES = "page_id long, url string, html string, digest string"


def _pages(spark):
    rng = np.random.default_rng(19)
    big = "".join(rng.choice(list("abcdefgh <>"), size=40_000))
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 7), "d") for i in range(300)]
    return spark.createDataFrame([*rows, (300, None, None, "d"), (301, "u", "", "d"), (None, "v", "né", "d"), (5, "http://x/5", "<p>5</p>" * 5, "d"), (9000, "w", big, "d"), (9001, "w", big[:20_000] + "inserted" + big[20_000:], "d"), (9002, "w", big, "d")], PAGES)


def _tree(pages, crowd=None):
    records = common.materialize(warc.hashed(pages))
    return warc.written_tree(records, crowd if crowd is not None else warc.crowds(records))[1]


def test_warc(spark):
    pages = _pages(spark)
    got = warc.verify_archive(spark, pages).collect()
    assert len(got) == pages.count() and {r.status for r in got} == {"ok"}
    # Places follow each other without a gap.
    by = {}
    for r in sorted(got, key=lambda r: (r.volume, r.section, r.seq)):
        n, size = by.get((r.volume, r.section), (0, 0))
        assert (r.seq, r.offset) == (n, size)
        by[r.volume, r.section] = n + 1, size + r.length
    x = _tree(pages)
    assert warc.audit(x, x).count() == 0
    assert warc.verify_archive(spark, pages.where("false")).count() == 0 and warc.audit(_tree(pages.where("false")), _tree(pages.where("false"))).count() == 0


def test_warc_audit_finds_each_fault_and_no_other(spark):
    pages = _pages(spark)
    x = _tree(pages)
    found = lambda df: sorted(((r.page_id, r.status) for r in warc.audit(x, _tree(df)).collect()), key=str)
    assert found(pages.withColumn("html", F.when(F.col("page_id") == 78, F.overlay("html", F.lit("q"), F.lit(2))).otherwise(F.col("html")))) == [(78, "corrupt")]
    for lost in (0, 17, 299, 9002):
        assert found(pages.where(F.coalesce(F.col("page_id") != lost, F.lit(True)))) == [(lost, "missing")]
    new = spark.createDataFrame([(350, "n", "new", "d")], PAGES)
    assert found(pages.union(new)) == [(350, "extra")]
    assert found(pages.where("page_id is not null")) == [(None, "missing")]
    assert found(pages.dropDuplicates(["page_id", "html"])) == [(5, "missing")]
    assert found(pages.union(pages.where("page_id = 7"))) == [(7, "extra")]
    assert sorted((r.page_id, r.status) for r in warc.drill(pages.where("page_id is not null")).collect()) == sorted((i, {3: "corrupt", 5: "missing", 7: "extra"}[i % 10]) for i in [*range(302), 9000, 9001, 9002] if i % 10 in (3, 5, 7))


def test_warc_crowded_ids_leave_their_volume(spark):
    rows = [(3, "u", f"body {k}", "d") for k in range(600)] + [(None, "u", f"none {k}", "d") for k in range(300)] + [(3, "u", "same", "d")] * 200 + [(k, "u", "x", "d") for k in (-4096, -1, 1, 2)]
    pages = spark.createDataFrame(rows, PAGES)
    got = warc.verify_archive(spark, pages).collect()
    assert len(got) == len(rows) and {r.status for r in got} == {"ok"}
    assert {r.section for r in got if r.page_id is None} < set(range(-9, 0)) and len({r.section for r in got if r.page_id == 3}) > 8
    assert {(r.volume, r.section) for r in got if r.page_id in (-4096, -1)} == {(-1, 0)}
    assert len({(r.volume, r.section, r.seq) for r in got}) == len(rows)
    records = common.materialize(warc.hashed(pages))
    crowd = warc.crowds(records)
    fewer = common.materialize(warc.hashed(pages.where("html not in ('body 5', 'none 9')")))
    bad = warc.audit(warc.written_tree(records, crowd)[1], warc.written_tree(fewer, crowd)[1]).collect()
    assert sorted(((r.page_id, r.status) for r in bad), key=str) == [(3, "missing"), (None, "missing")]


def test_warc_files_are_read_whole(spark):
    body = "line\r\n\r\nWARC/1.1\r\n" * 300_000
    rows = [(1, "http://x/\r\n1", body, "d"), (2, None, None, "d"), (3, "u", "é", "d")]
    files = warc.write(spark.createDataFrame(rows, PAGES), common.scratch(spark, "warc"))
    got = {r.page_id: r for r in warc.read(files).collect()}
    assert got[1].html == body and got[2].html == "" and got[3].html == "é" and got[1].url == "http://x/  1"
    want = {r.page_id: (r.length, r.digest) for r in warc.hashed(spark.createDataFrame(rows, PAGES)).collect()}
    assert want == {i: (r.length, r.digest) for i, r in got.items()}


def _rolled(payload):
    """Byte by byte: the hash doubles and takes the next byte's number; a chunk ends where its top bits are zero."""
    ends, h, at = [], 0, 0
    for k, b in enumerate(payload, 1):
        h = (2 * h + int(media._GEAR[b])) & 0xFFFFFFFF
        if k - at >= media.LEAST and h >> (32 - media.AVERAGE_BITS) == 0 or k - at == media.MOST:
            ends.append(k)
            at = k
    return ends if not payload or ends and ends[-1] == len(payload) else [*ends, len(payload)]


def test_chunks_equal_a_rolling_hash():
    rng = np.random.default_rng(73)
    payloads = [bytes(rng.integers(0, 256, size=n).astype(np.uint8)) for n in (0, 1, 31, 255, 256, 257, 5000, 40_000)] + [b"a" * 30_000, b"ab" * 9000]
    for p in payloads:
        assert [e for _, e in media.chunks_of(p)] == _rolled(p)
    # Several payloads of one slice don't change each other's chunks.
    t = pa.RecordBatch.from_arrays([pa.array(payloads, pa.binary()), pa.array([hashlib.sha256(p).digest() for p in payloads], pa.binary())], names=["payload", "media"])
    got = {}
    for b in media._chunked(iter([t])):
        for r in b.to_pylist():
            got.setdefault(r["media"], []).append(r["at"] + r["length"])
    assert {hashlib.sha256(p).digest(): _rolled(p) for p in payloads if p} == got


def test_media(spark):
    pages = _pages(spark)
    rows = {(r.page_id, r.media): r for r in media.deduplicated(pages).collect()}
    assert len(rows) == 306 and all(r.verified or r.media is None for r in rows.values())
    text = {r.page_id: r.html for r in pages.collect()}
    for r in rows.values():
        if r.media is None:
            assert r.page_id == 300 and r.n_chunks is None
            continue
        raw = text[r.page_id].encode()
        assert r.media == hashlib.sha256(raw).hexdigest()
        assert [(c.digest, c.length) for c in (r.chunks or [])] == [(hashlib.sha256(raw[s:e]).hexdigest(), e - s) for s, e in media.chunks_of(raw)]
    big = [r for r in rows.values() if r.page_id in (9000, 9001)]
    shared = set(c.digest for c in big[0].chunks) & set(c.digest for c in big[1].chunks)
    assert len(shared) >= 0.7 * big[0].n_chunks
    assert media.deduplicated(pages.where("false")).count() == 0
    taken = pages.withColumns({c: F.lit("x") for c in ("_media", "_payload", "media", "payload", "id", "chunks")})
    assert media.deduplicated(taken).where("verified").count() == 306
    long = spark.createDataFrame([(1, None, "<p>long</p>" * 200_000, None)], PAGES)
    got = media.deduplicated(long).first()
    assert got.n_bytes > common.SLICE_BYTES and got.verified and got.n_bytes == sum(c.length for c in got.chunks)


def test_media_rebuilds_payloads_that_share_nothing(spark, monkeypatch):
    rng = np.random.default_rng(31)
    texts = ["".join(rng.choice(list("abcdefgh <>"), size=9000)) for _ in range(6)]
    texts += [texts[4] + texts[5]]  # has foreign chunks
    pages = spark.createDataFrame([(i, None, t, None) for i, t in enumerate(texts)] + [(7, None, texts[0], None)], PAGES)
    lists = common.materialize(media.chunk_lists(pages), "lists")
    names = [hashlib.sha256(t.encode()).digest() for t in texts]
    got = {bytes(r.media): r for r in media.rebuilt(pages, lists).collect()}
    assert {m: (bytes(r.payload), r.verified) for m, r in got.items()} == {m: (t.encode(), True) for m, t in zip(names, texts)}
    own = F.col("media") == F.col("owner")
    at = lambda k, seq: (F.col("media") == F.lit(names[k])) & F.col("seq").isin(seq) & own
    bad = lists.select(
        "media", F.when(at(0, [0, 1]), 1 - F.col("seq")).otherwise(F.col("seq")).alias("seq"), "at", "length",
        F.when(at(1, [2]), F.unhex(F.sha2("digest", 256))).otherwise(F.col("digest")).alias("digest"), "owner",
        F.when(at(2, [1]), F.col("owner_at") + 1).otherwise(F.col("owner_at")).alias("owner_at"),
    )
    monkeypatch.setattr(media, "chunk_lists", lambda rows, column="html": bad)
    assert {r.page_id: r.verified for r in media.deduplicated(pages).collect()} == {0: False, 1: False, 2: False, 3: True, 4: True, 5: True, 6: True, 7: False}


def test_media_moves_payloads_packed(spark, monkeypatch):
    # Base-16 digits: an entropy coder halves them, a search for repeats finds nothing.
    rng = np.random.default_rng(67)
    payloads = [bytes(rng.integers(0, 256, size=25_000).astype(np.uint8)).hex().encode() for _ in range(60)]
    pages = common.materialize(spark.createDataFrame([(i, None, p) for i, p in enumerate(payloads)], "page_id long, url string, html binary"), "pages")
    made = []
    monkeypatch.setattr(common, "scratch", lambda spark, what, old=common.scratch: made.append((what, old(spark, what))) or made[-1][1])
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        return sum(e.totalShuffleWrite() for e in (lambda x: [x.apply(i) for i in range(x.size())])(sc.statusStore().executorList(False)))

    before, broadcast = written(), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(broadcast, -1)  # as if the lists were large
    try:
        assert media.deduplicated(pages).where("verified").count() == len(payloads)
    finally:
        spark.conf.unset(broadcast)
    assert written() - before < sum(map(len, payloads))
    # Once lists are written, chunks are read no more.
    left = {what: os.path.exists(common.local_path(path)) for what, path in made}
    assert left == {"chunks": False, "chunk-lists": True, "cut": True}
    # Bytes that can't be packed, none and null.
    odd = [bytes(rng.integers(0, 256, size=30_000).astype(np.uint8)), b"", None, b"\0" * 100_000, b"\xff", payloads[0][:20_000] + payloads[1]]
    more = pages.unionAll(spark.createDataFrame([(100 + i, None, p) for i, p in enumerate(odd)], pages.schema))
    whole = {bytes(r.media): (bytes(r.payload), r.verified) for r in media.rebuilt(more, media.chunk_lists(more)).collect()}
    assert whole == {hashlib.sha256(p).digest(): (p, True) for p in payloads + odd if p}
    assert {r.page_id: r.verified for r in media.deduplicated(more).collect()} == {i: i != 102 or None for i in [*range(60), *range(100, 106)]}


def test_tight_steps_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {f.split("_")[1] for f in (x.getName() for x in (lambda x: [x.apply(i) for i in range(x.size())])(disk.getAllFiles())) if f.startswith("shuffle_")}

    before = shuffles()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(key)
    step = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.collect_list("id").alias("ids"))
    got = common.materialize(step, tight=True)
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before and spark.conf.get(key) == kept
    assert sorted((r.k, sorted(r.ids)) for r in got.collect()) == [(k, list(range(k, 1000, 7))) for k in range(7)]
    common.materialize(step)  # the other kind does leave some, else this test sees nothing
    assert shuffles() - before


def test_chat(spark):
    turns = [(1, 0, "user", "Hi <|end|> there"), (1, 1, "assistant", "Grüße 😀"), (1, 2, None, None), (1, 3, "assistant", ""), (2, None, "assistant", "a"), (2, 1, "user", "b"), (2, 1, "user", "b"), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, mask string")
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert set(got) == {1, 2} and got[2].n_turns == 3
    t = Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    raw, spans = chat.render([(r, x) for _, _, r, x in turns[:4]])
    text = raw.decode()
    e = t.encode(text, add_special_tokens=False)
    assert list(got[1].tokens) == e.ids
    byte = np.cumsum([0, *(len(c.encode()) for c in text)])
    assert list(got[1].mask) == [int(any(s <= byte[a] and byte[b] <= f for s, f in spans)) for a, b in e.offsets]
    assert got[1].n_trained == sum(got[1].mask) > 0
    assert chat.format_chats(df.where("false")).count() == 0
    # Many random conversations, and one beyond a slice.
    rng = np.random.default_rng(53)
    signs = list("ab é😀\n'<|>") + ["<|end|>", "<|assistant|>\n", "東", "it's"]
    rows = [(k, j, str(rng.choice(["user", "assistant", "system"])), "".join(rng.choice(signs, size=int(rng.integers(0, 60))))) for k in range(40) for j in range(3)]
    rows += [(99, 0, "user", "long words " * 900_000), (99, 1, "assistant", "short")]
    for r in chat.format_chats(spark.createDataFrame([(*x, "z") for x in rows], df.schema)).collect():
        raw, spans = chat.render([x[2:4] for x in rows if x[0] == r.conv_id])
        if r.conv_id == 99:
            assert len(raw) > tokens.SLICE and r.n_trained == sum(r.mask) > 0
            continue
        text = raw.decode()
        e = t.encode(text, add_special_tokens=False)
        byte = np.cumsum([0, *(len(c.encode()) for c in text)])
        assert list(r.tokens) == e.ids and list(r.mask) == [int(any(s <= byte[a] and byte[b] <= f for s, f in spans)) for a, b in e.offsets]


def test_pipeline(spark, tmp_path, gold):
    rows, labels = _corpus(np.random.default_rng(23), 400)
    rows += [(1000, rows[0][1] + " end"), (1001, rows[0][1]), (1002, None)]
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows]), "lang": ["en"] * len(rows), "source": ["s"] * len(rows), "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([x[1] for x in labels]), "toxic": pa.array([x[2] for x in labels])}), tmp_path / "labels.parquet")
    docs = common.table(spark, str(tmp_path), "documents")
    known = common.table(spark, str(tmp_path), "labels")
    good = {r.doc_id for r in quality.score(docs, quality.train(spark, docs, known)).where("quality_keep").collect()}
    left = docs.where(F.col("doc_id").isin(*good))
    clean = {r.doc_id for r in toxicity.score(left, toxicity.train(spark, left, known)).where("not toxicity_reject").collect()}
    parent = {i: i for i in clean}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for a, b in sorted(_pairs({i: t for i, t in rows if i in clean and t})):
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = sorted((i, tuple(gold.encode_ordinary(t))) for i, t in rows if i in clean and find(i) == i and t)
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).extend(r.tokens)
    assert sorted((i, tuple(t)) for i, t in got.items()) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]
