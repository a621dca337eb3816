"""Attachment parsing: four decoders over one scorer, in gold mode, with constant answers or driven by a linear model.

Decoding is sequential within a sentence, as a decision's features look at earlier ones, and parallel across sentences:
one row a sentence, in Arrow batches. All static parts of a linear score are summed before, as two numbers a phrase,
so a worker adds only distance, brackets and competitors' particles to them.

A scorer is called as ``scorer(i, j, heads)`` or, by the tournament, ``scorer(i, j, heads, k)``, and gives a probability;
``heads`` are the estimated heads so far, -1 where there is none.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.features import global_base, global_width
from lexiloom.sources.corpus import SENTENCE

Scorer = Callable[..., float]
EVENTS = "doc_id long, line_no int, event_no int, i int, j int, k int, y int"
ARCS = "doc_id long, line_no int, id int, did int, est_did int, prob double"


def shift_reduce(n: int, ask: Scorer) -> tuple[list[int], list[float]]:
    """Attaches to the next word or keeps waiting; what waits at the last phrase goes to it without being asked."""
    heads, probs, stack = [-1] * n, [0.0] * n, []
    for j in range(1, n):
        stack.append(j - 1)
        while stack:
            i = stack[-1]
            if j < n - 1:
                probs[i] = ask(i, j, heads)
                if probs[i] <= 0.5:
                    break
            heads[i] = j
            stack.pop()
    return heads, probs


def cascade(n: int, ask: Scorer) -> tuple[list[int], list[float]]:
    """Passes from right to left over what is left; phrases that nothing waits for any more leave once attached."""
    heads, probs = [-1] * n, [0.0] * n
    left = list(range(n - 1))
    while left:
        j = left[-1]
        heads[j], probs[j] = n - 1, 0.0
        gone, following = set(), True
        i = j
        for i in reversed(left[:-1]):
            p = probs[i] = ask(i, j, heads)
            if p > 0.5:
                heads[i] = j
            if heads[i] == -1 and following:
                gone.add(j)
            following = heads[i] != -1
            j = i
        if heads[left[0]] != -1:
            gone.add(left[0])
        left = [x for x in left if x not in gone]
    return heads, probs


def backward(n: int, ask: Scorer) -> tuple[list[int], list[float]]:
    """From right to left, the likeliest of the next phrase and its chain of heads; the nearest if several are."""
    heads, probs = [-1] * n, [0.0] * n
    for i in range(n - 2, -1, -1):
        j = i + 1
        while True:
            p = ask(i, j, heads)
            if p > probs[i]:
                heads[i], probs[i] = j, p
            if heads[j] == -1:
                break
            j = heads[j]
    return heads, probs


def tournament(n: int, ask: Scorer) -> tuple[list[int], list[float]]:
    """From right to left, the champion of pairwise matches along the next phrase's chain of heads."""
    heads, probs = [-1] * n, [0.0] * n
    for i in range(n - 2, -1, -1):
        best = j = i + 1
        while heads[j] != -1:
            j = heads[j]
            probs[i] = ask(i, best, heads, j)
            if probs[i] > 0.5:
                best = j
        heads[i] = best
    return heads, probs


DECODERS = {"linear": shift_reduce, "chunking": cascade, "backward": backward, "tournament": tournament}


def follow_gold(heads: list[int], strategy: str, tell: Callable[[int, int, int, int, list[int]], None]) -> None:
    """Tells the training decisions (i, j, k, y, heads found before) that gold heads lead to; k is -1 but for the
    tournament, whose matches are made before any head is known."""
    n = len(heads)
    if strategy == "tournament":
        none = [-1] * n
        for i in range(n - 2):
            h = heads[i]
            for j in range(i + 1, n):
                if j != h:
                    tell(i, min(j, h), max(j, h), 1 if j < h else -1, none)
        return

    def ask(i: int, j: int, found: list[int]) -> float:
        y = j == heads[i]
        tell(i, j, -1, 1 if y else -1, found)
        return float(y)

    DECODERS[strategy](n, ask)


def gold_events(heads: list[int], strategy: str) -> list[tuple[int, int, int, int]]:
    """The training decisions (i, j, k, y) that gold heads lead to."""
    out: list[tuple[int, int, int, int]] = []
    follow_gold(heads, strategy, lambda i, j, k, y, _: out.append((i, j, k, y)))
    return out


def _sentences(arcs: DataFrame, *columns: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("id", *columns)))
    own = arcs.groupBy(*SENTENCE).agg(rows.alias("r"))
    return own.select(*SENTENCE, *(F.col(f"r.{c}").alias(c) for c in columns))


def training_events(arcs: DataFrame, strategy: str) -> DataFrame:
    """(sentence, event_no, i, j, k, y): the decisions in order, from arcs (sentence, id, did)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, l, e, *x) for d, l, heads in zip(b["doc_id"], b["line_no"], b["did"]) for e, x in enumerate(gold_events(list(heads), strategy))]
            yield pd.DataFrame(rows, columns=["doc_id", "line_no", "event_no", "i", "j", "k", "y"])

    return _sentences(arcs, "did").mapInPandas(run, EVENTS)


def tournament_pairs(arcs: DataFrame) -> DataFrame:
    """(sentence, i, j, k, y): the tournament's training matches, in place from each sentence's own array of heads."""
    rows = _sentences(arcs, "did").withColumn("n", F.size("did"))
    firsts = rows.where("n > 2").select(*SENTENCE, "n", F.posexplode(F.slice("did", F.lit(1), F.col("n") - 2)).alias("i", "h"))
    each = firsts.select(*SENTENCE, "i", "h", F.explode(F.sequence(F.col("i") + 1, F.col("n") - 1)).alias("o")).where("o <> h")
    return each.select(*SENTENCE, "i", F.least("o", "h").alias("j"), F.greatest("o", "h").alias("k"), F.when(F.col("o") < F.col("h"), 1).otherwise(-1).alias("y"))


def constant_answers(arcs: DataFrame, attach: bool) -> DataFrame:
    """(sentence, id, est_did): shift-reduce when every question has one answer; a column expression each."""
    own = arcs.select(*SENTENCE, "id", "n")
    target = F.col("id") + 1 if attach else F.col("n") - 1
    return own.withColumn("est_did", F.when(F.col("id") == F.col("n") - 1, -1).otherwise(target).cast("int")).drop("n")


def fold_shift_reduce(sentences: DataFrame, accept: Callable) -> DataFrame:
    """(sentence, heads): shift-reduce as a fold over each sentence's ``n`` phrases within Catalyst, for static answers:
    ``accept(i, j)`` is a boolean column. The state is the waiting phrases, last first, and the arcs made."""
    kind = "struct<s:array<int>,a:array<struct<i:int,j:int>>>"
    start = F.struct(F.array().cast("array<int>").alias("s"), F.array().cast("array<struct<i:int,j:int>>").alias("a")).cast(kind)

    def step(state, j):
        s = F.concat(F.array(j - 1), state["s"])
        # The number of phrases that attach: those before the first that is turned down.
        kept = F.aggregate(s, F.struct(F.lit(0).alias("m"), F.lit(True).alias("go")), lambda c, i: F.struct((c["m"] + F.when(c["go"] & ((j == F.col("n") - 1) | accept(i, j)), 1).otherwise(0)).alias("m"), (c["go"] & ((j == F.col("n") - 1) | accept(i, j))).alias("go")))["m"]
        return F.struct(F.slice(s, kept + 1, F.greatest(F.size(s) - kept, F.lit(0))).alias("s"), F.concat(state["a"], F.transform(F.slice(s, F.lit(1), kept), lambda i: F.struct(i.alias("i"), j.alias("j")))).alias("a")).cast(kind)

    steps = F.when(F.col("n") > 1, F.sequence(F.lit(1), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    arcs = F.aggregate(steps, start, step)["a"]
    return sentences.select(*SENTENCE, F.array_append(F.transform(F.array_sort(arcs), lambda a: a["j"]), F.lit(-1)).alias("heads"))


def competitors(i: int, j: int, heads: list[int], ctx: list) -> set[int]:
    """Context bits of the phrases between i and j that compete for i: chains of heads are followed up to j."""
    found: set[int] = set()
    k = i + 1
    while k < j:
        while heads[k] not in (-1, j):
            k = heads[k]
        if k >= j:
            break
        found.update(ctx[k])
        k += 1
    return found


class Whole:
    """The features that pairs of phrases of one sentence have as a whole: distance, brackets between, competitors' bits."""

    def __init__(self, inner: np.ndarray, bracket: np.ndarray, ctx: list) -> None:
        # Python numbers and tuples: they are looked at one by one.
        self.before = [int(x) for x in inner]
        self.opens = [int(x) - int(y) for x, y in zip(inner, bracket)]
        self.ctx = [tuple(int(c) for c in x) for x in ctx]

    def places(self, i: int, j: int, heads: list[int]) -> list[int]:
        """Places within the features of a whole pair."""
        inside, far = self.opens[j] - self.before[i], j - i
        own = [0 if far == 1 else 1 if far < 6 else 2, 3 if inside > 0 else 4 if inside < 0 else 5]
        return own + [6 + c for c in competitors(i, j, heads, self.ctx)] if far > 1 else own


class LinearScorer:
    """Probabilities from a linear model: static sums of the phrases' sides, and weights of the pairs as a whole.

    ``sides`` has the sums of lft and rgt, and for a triple of far; ``whole`` the weights of a pair's features, or of both pairs'.
    """

    def __init__(self, sides: list[np.ndarray], pairs: Whole, whole: list[list[float]]) -> None:
        self.sides, self.pairs, self.whole = [x.tolist() for x in sides], pairs, whole

    def margin(self, i: int, j: int, heads: list[int], k: int | None = None) -> float:
        m = self.sides[0][i] + self.sides[1][j] + sum(self.whole[0][p] for p in self.pairs.places(i, j, heads))
        return m if k is None else m + self.sides[2][k] + sum(self.whole[1][p] for p in self.pairs.places(i, k, heads))

    def __call__(self, i: int, j: int, heads: list[int], k: int | None = None) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.margin(i, j, heads, k)))))


class VectorScorer:
    """Probabilities from any model over whole feature vectors: ``margin`` takes a sorted list of ids."""

    def __init__(self, sides: list[list], pairs: Whole, bases: list[int], margin: Callable[[list[int]], float]) -> None:
        self.sides, self.pairs, self.bases, self.of = sides, pairs, bases, margin

    def vector(self, i: int, j: int, heads: list[int], k: int | None = None) -> list[int]:
        fv = [*self.sides[0][i], *self.sides[1][j], *(self.bases[0] + p for p in self.pairs.places(i, j, heads))]
        if k is not None and k >= 0:
            fv += [*self.sides[2][k], *(self.bases[1] + p for p in self.pairs.places(i, k, heads))]
        return sorted(map(int, fv))

    def __call__(self, i: int, j: int, heads: list[int], k: int | None = None) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.of(self.vector(i, j, heads, k))))))


def template_of(strategy: str) -> str:
    if strategy not in DECODERS:
        raise ValueError(f"unknown strategy {strategy!r}")
    return "triple" if strategy == "tournament" else "pair"


def sides_of(template: str) -> tuple[str, ...]:
    return ("lft", "rgt") if template == "pair" else ("lft", "rgt", "far")


def static_margins(phrases: DataFrame, weights: DataFrame, template: str = "pair") -> DataFrame:
    """(sentence, id, did, bracket, inner, ctx, and the sides): the phrases with the sums of their sides' weights."""
    names = sides_of(template)
    sides = F.array(*(F.col(c) for c in names))
    side = phrases.select(*SENTENCE, "id", F.posexplode(sides).alias("side", "own")).select(*SENTENCE, "id", "side", F.explode("own").alias("fid")).join(weights, "fid")
    sums = side.groupBy(*SENTENCE, "id").agg(*(F.coalesce(F.sum(F.when(F.col("side") == k, F.col("w"))), F.lit(0)).cast("double").alias(c) for k, c in enumerate(names)))
    own = phrases.select(*SENTENCE, "id", "did", "bracket", "inner", "ctx").join(sums, [*SENTENCE, "id"], "left")
    return own.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in names})


def _arcs(batches: Iterator[pd.DataFrame], strategy: str, scorer: Callable) -> Iterator[pd.DataFrame]:
    for b in batches:
        doc, line, size, did, heads, probs = [], [], [], [], [], []
        for r in b.itertuples(index=False):
            h, p = DECODERS[strategy](len(r.did), scorer(r))
            heads += h
            probs += p
            did.append(np.asarray(r.did))
            doc.append(r.doc_id)
            line.append(r.line_no)
            size.append(len(h))
        if size:
            n = np.array(size)
            number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pd.DataFrame({"doc_id": np.repeat(doc, n), "line_no": np.repeat(line, n), "id": number, "did": np.concatenate(did), "est_did": heads, "prob": probs})


def parse(margins: DataFrame, strategy: str, whole: list[list[float]]) -> DataFrame:
    """(sentence, id, did, est_did, prob): heads by a linear model. ``whole`` holds the weights of the pair's own features:
    3 for distance, 3 for brackets, then one a context bit; a few dozen numbers. The tournament's has those of both pairs."""
    names = sides_of(template_of(strategy))

    def scorer(r) -> LinearScorer:
        return LinearScorer([getattr(r, c) for c in names], Whole(r.inner, r.bracket, list(r.ctx)), whole)

    return _sentences(margins, "did", "bracket", "inner", "ctx", *names).mapInPandas(lambda it: _arcs(it, strategy, scorer), ARCS)


def parse_with(phrases: DataFrame, strategy: str, bases: list[int], margin: Callable[[list[int]], float]) -> DataFrame:
    """(sentence, id, did, est_did, prob): heads by any model, which is sent to the workers as ``margin``."""
    names = sides_of(template_of(strategy))

    def scorer(r) -> VectorScorer:
        return VectorScorer([list(getattr(r, c)) for c in names], Whole(r.inner, r.bracket, list(r.ctx)), bases, margin)

    return _sentences(phrases, "did", "bracket", "inner", "ctx", *names).mapInPandas(lambda it: _arcs(it, strategy, scorer), ARCS)


def visited(phrases: DataFrame, strategy: str, bases: list[int], margin: Callable[[list[int]], float]) -> DataFrame:
    """(sentence, event_no, fv): the vectors that parsing with a model looks at, in order."""
    names = sides_of(template_of(strategy))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for r in b.itertuples(index=False):
                seen: list[list[int]] = []
                of = VectorScorer([list(getattr(r, c)) for c in names], Whole(r.inner, r.bracket, list(r.ctx)), bases, lambda fv: seen.append(fv) or margin(fv))  # noqa: B023
                DECODERS[strategy](len(r.did), of)
                rows += [(r.doc_id, r.line_no, e, fv) for e, fv in enumerate(seen)]
            yield pd.DataFrame(rows, columns=["doc_id", "line_no", "event_no", "fv"])

    return _sentences(phrases, "did", "bracket", "inner", "ctx", *names).mapInPandas(run, "doc_id long, line_no int, event_no int, fv array<long>")


def whole_weights(weights: DataFrame, size: int, context: int, template: str = "pair") -> list[list[float]]:
    """The weights of the features that belong to a pair as a whole, by their place in the template; for a triple both pairs'."""
    base, width, k = global_base(template, size, context), global_width(context), 1 if template == "pair" else 2
    own = {r["fid"]: float(r["w"]) for r in weights.where((F.col("fid") >= base) & (F.col("fid") < base + k * width)).collect()}
    return [[own.get(base + j * width + p, 0.0) for p in range(width)] for j in range(k)]


EXAMPLES = "doc_id long, line_no int, event_no int, i int, j int, k int, y int, fv array<long>"


def training_examples(phrases: DataFrame, strategy: str, size: int, context: int) -> DataFrame:
    """(sentence, event_no, i, j, k, y, fv): the decisions that gold heads lead to, each with its whole feature vector: the sides'
    static features, distance, brackets and competitors' bits, as the heads found so far make them."""
    template = template_of(strategy)
    names, base = sides_of(template), global_base(template, size, context)
    bases = [base, base + global_width(context)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                gold = [int(x) for x in r.did]
                of = VectorScorer([list(getattr(r, c)) for c in names], Whole(r.inner, r.bracket, list(r.ctx)), bases, lambda fv: 0.0)
                own: list[tuple] = []
                follow_gold(gold, strategy, lambda i, j, k, y, heads: own.append((i, j, k, y, of.vector(i, j, heads, k))))  # noqa: B023
                rows += [(r.doc_id, r.line_no, e, *x) for e, x in enumerate(own)]
            yield pd.DataFrame(rows, columns=["doc_id", "line_no", "event_no", "i", "j", "k", "y", "fv"])

    return _sentences(phrases, "did", "bracket", "inner", "ctx", *names).mapInPandas(run, EXAMPLES)
