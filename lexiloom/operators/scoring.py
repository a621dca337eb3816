"""Scoring of sparse binary vectors, and the compiling of kernel models: linear, inverted index, expansion, split, prefixes, log-linear.

Examples are (ex_id, fv), support vectors (sv_id, alpha, fv), weights (fid, w) or (combo, w); features of a vector are distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.expressions import conjunction_cost, kernel_coefficients
from lexiloom.functions.ranking import bucketed_rank
from lexiloom.operators.features import combinations


def linear(examples: DataFrame, weights: DataFrame, key: str = "ex_id") -> DataFrame:
    """(key, score): sums of the features' weights; features without one count 0."""
    hit = examples.select(key, F.explode_outer("fv").alias("fid")).join(weights.select("fid", "w"), "fid", "left")
    return hit.groupBy(key).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("score"))


def _shared(examples: DataFrame, svs: DataFrame) -> DataFrame:
    a = examples.select("ex_id", F.explode("fv").alias("fid"))
    b = svs.select("sv_id", "alpha", F.explode("fv").alias("fid"))
    return a.join(b, "fid")


def _cheaper_by_combinations(examples: DataFrame, svs: DataFrame, degree: int) -> bool:
    """Whether all vectors have fewer combinations of up to ``degree`` features than examples and support vectors meet in features."""
    n, made = F.size("fv").cast("double"), F.lit(0.0)
    part = F.lit(1.0)
    for k in range(degree):
        part = part * F.greatest(n - k, F.lit(0.0)) / (k + 1)
        made = made + part
    held = lambda df, name: df.select(F.explode("fv").alias("fid")).groupBy("fid").agg(F.count("*").cast("double").alias(name))
    total = sum(df.agg(F.coalesce(F.sum(made), F.lit(0.0))).first()[0] for df in (examples, svs))
    return total < (held(examples, "x").join(held(svs, "v"), "fid").agg(F.sum(F.col("x") * F.col("v"))).first()[0] or 0.0)


def inverted_index(examples: DataFrame, svs: DataFrame, degree: int, s: int = 1, r: int = 1, b: float = 0) -> DataFrame:
    """(ex_id, score): the kernel over shared features. Vectors that share none give alpha * r ** d, one constant.

    Where vectors share so much that nearly all pairs meet, the same sum is taken over their combinations of features, whose number
    grows with the vectors', not with their square; where features are rare and vectors long, pairs that meet are fewer.
    """
    if _cheaper_by_combinations(examples, svs, degree):
        return expanded(examples, expand(svs, degree, s, r), constant(svs, degree, r, b), degree).select("ex_id", F.col("score").cast("double").alias("score"))
    return by_pairs(examples, svs, degree, s, r, b)


def by_pairs(examples: DataFrame, svs: DataFrame, degree: int, s: int = 1, r: int = 1, b: float = 0) -> DataFrame:
    """(ex_id, score) from all pairs that share a feature."""
    dots = _shared(examples, svs).groupBy("ex_id", "sv_id").agg(F.count("*").alias("k"), F.first("alpha").alias("alpha"))
    part = F.col("alpha") * (F.pow(F.lit(s) * F.col("k") + r, F.lit(degree)) - r**degree)
    near = dots.groupBy("ex_id").agg(F.sum(part).alias("part"))
    total = svs.agg(F.coalesce(F.sum("alpha"), F.lit(0)).alias("total"))
    return examples.select("ex_id").join(near, "ex_id", "left").crossJoin(F.broadcast(total)).select("ex_id", (F.coalesce("part", F.lit(0)) + r**degree * F.col("total") - b).alias("score"))


def _made(fv: str, degree: int, held: list | None) -> Column:
    """All combinations, or those with a feature that isn't ``held``."""
    every = combinations(F.array_sort(fv), degree)
    if held is None:
        return every
    common = F.array(*(F.lit(f).cast("long") for f in held)) if held else F.array().cast("array<long>")
    return F.filter(every, lambda c: F.exists(c, lambda f: ~F.array_contains(common, f.cast("long"))))


def expand(svs: DataFrame, degree: int, s: int = 1, r: int = 1, sigma: float = 0.0, beyond: list | None = None) -> DataFrame:
    """(combo, w): the kernel as weights of feature combinations. Combinations are made within each vector, so that
    partial sums are all that is shuffled. With ``sigma``, weights between the signed thresholds drop; those scale
    with the share of vectors of their sign. With ``beyond``, only combinations with a feature other than these."""
    coefficient = kernel_coefficients(degree, s, r)
    all_ = svs.select("alpha", F.explode(_made("fv", degree, beyond)).alias("combo"))
    weight = F.element_at(F.array(*(F.lit(c) for c in coefficient[1:])), F.size("combo"))
    out = all_.groupBy("combo").agg(F.sum("alpha").alias("a")).select("combo", (F.col("a") * weight).alias("w"))
    if sigma:
        n = svs.agg(F.count_if(F.col("alpha") > 0).alias("p"), F.count_if(F.col("alpha") <= 0).alias("m"), F.count("*").alias("n"))
        out = out.crossJoin(F.broadcast(n)).where((F.col("w") <= -sigma * F.col("m") / F.col("n")) | (F.col("w") >= sigma * F.col("p") / F.col("n"))).select("combo", "w")
    return out.where("w <> 0")


def constant(svs: DataFrame, degree: int, r: int = 1, b: float = 0) -> DataFrame:
    """One row: the score of an empty vector."""
    return svs.agg((F.coalesce(F.sum("alpha"), F.lit(0)) * r**degree - b).alias("c0"))


def expanded(examples: DataFrame, combos: DataFrame, c0: DataFrame, degree: int) -> DataFrame:
    """(ex_id, score) by joining the examples' combinations with their weights."""
    own = examples.select("ex_id", F.explode_outer(combinations(F.array_sort("fv"), degree)).alias("combo")).join(combos, "combo", "left")
    return own.groupBy("ex_id").agg(F.coalesce(F.sum("w"), F.lit(0)).alias("part")).crossJoin(F.broadcast(c0)).select("ex_id", (F.col("part") + F.col("c0")).alias("score"))


def common_features(svs: DataFrame, ratio: float) -> DataFrame:
    """(fid) of the features that at least this share of the vectors hold."""
    n = svs.agg(F.count("*").alias("n"))
    counts = svs.select(F.explode("fv").alias("fid")).groupBy("fid").agg(F.count("*").alias("k"))
    return counts.crossJoin(F.broadcast(n)).where(F.col("k") >= ratio * F.col("n")).select("fid")


def split(examples: DataFrame, svs: DataFrame, common: DataFrame, degree: int, s: int = 1, r: int = 1, b: float = 0) -> DataFrame:
    """(ex_id, score): the expansion over common features, and for the rest the kernel's increase over them."""
    keep = lambda df, key, *more: df.select(key, *more, F.explode_outer("fv").alias("fid")).join(common.withColumn("_c", F.lit(True)), "fid", "left").groupBy(key, *more).agg(F.array_sort(F.collect_list(F.when(F.col("_c"), F.col("fid")))).alias("fv"))
    first = expanded(keep(examples, "ex_id"), expand(keep(svs, "sv_id", "alpha"), degree, s, r), constant(svs, degree, r, b), degree)
    if _cheaper_by_combinations(examples, svs, degree):
        # At most the vectors' mean number of features over the ratio by which these are common.
        held = [x[0] for x in common.collect()]
        own = examples.select("ex_id", F.explode(_made("fv", degree, held)).alias("combo")).join(expand(svs, degree, s, r, beyond=held), "combo")
        more = own.groupBy("ex_id").agg(F.sum("w").cast("double").alias("more"))
        return first.join(more, "ex_id", "left").select("ex_id", (F.col("score") + F.coalesce("more", F.lit(0))).alias("score"))
    met = _shared(examples, svs).join(common.withColumn("_c", F.lit(1)), "fid", "left")
    dots = met.groupBy("ex_id", "sv_id").agg(F.count("*").alias("k"), F.count("_c").alias("c"), F.first("alpha").alias("alpha")).where("k > c")
    power = lambda c: F.pow(F.lit(s) * F.col(c) + r, F.lit(degree))
    more = dots.groupBy("ex_id").agg(F.sum(F.col("alpha") * (power("k") - power("c"))).alias("more"))
    return first.join(more, "ex_id", "left").select("ex_id", (F.col("score") + F.coalesce("more", F.lit(0))).alias("score"))


def prefixes(fv: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(fv)), lambda n: F.slice(fv, F.lit(1), n))


def build_prefixes(events: DataFrame, degree: int = 2) -> DataFrame:
    """(prefix, cnt, cost): every prefix of the sorted vectors, how many events have it and its combinations' number."""
    own = events.where(F.size("fv") > 0).select(F.explode(prefixes(F.array_sort("fv"))).alias("prefix"))
    return own.groupBy("prefix").agg(F.count("*").alias("cnt")).withColumn("cost", conjunction_cost(degree, F.lit(0), F.size("prefix")))


def prune_prefixes(table: DataFrame, halvings: int) -> DataFrame:
    """The ``1 / 2 ** halvings`` of the prefixes that save most, closed under prefixes: a prefix is worth at least what its
    best extension is, and the shorter one comes first, so a prefix never stays without those that lead to it."""
    each = table.select("prefix", "cnt", "cost", (F.col("cnt") * F.col("cost")).alias("_v"))
    up = each.select(F.explode(prefixes(F.col("prefix"))).alias("prefix"), "_v").groupBy("prefix").agg(F.max("_v").alias("_best"))
    # Ranked within ranges of worth, so that no task sorts the whole table.
    ranked = bucketed_rank(each.join(up, "prefix"), [-F.floor(16 * F.log2(F.col("_best") + 1))], [F.desc("_best"), F.size("prefix"), F.col("prefix")], "_rank")
    return ranked.where(F.col("_rank") < (table.count() >> halvings)).select("prefix", "cnt", "cost")


def prefix_scores(table: DataFrame, combos: DataFrame, degree: int) -> DataFrame:
    """(prefix, partial): every stored prefix's own sum of weights."""
    own = table.select("prefix", F.explode(combinations(F.col("prefix"), degree)).alias("combo")).join(combos, "combo", "left")
    return own.groupBy("prefix").agg(F.coalesce(F.sum("w"), F.lit(0)).alias("partial"))


def by_prefix(examples: DataFrame, stored: DataFrame, combos: DataFrame, c0: DataFrame, degree: int) -> DataFrame:
    """(ex_id, score): the longest stored prefix's sum and the weights of combinations that reach beyond it."""
    own = examples.select("ex_id", F.array_sort("fv").alias("fv"))
    met = own.where(F.size("fv") > 0).select("ex_id", F.explode(prefixes(F.col("fv"))).alias("prefix")).join(stored, "prefix")
    best = met.groupBy("ex_id").agg(F.max_by(F.struct(F.col("prefix").alias("p"), "partial"), F.size("prefix")).alias("b"))
    rest = own.join(best, "ex_id", "left").select("ex_id", "fv", F.coalesce("b.partial", F.lit(0)).alias("partial"), F.coalesce(F.element_at("b.p", -1), F.lit(-(1 << 62))).alias("upto"))
    beyond = rest.select("ex_id", "partial", F.explode_outer(F.filter(combinations(F.col("fv"), degree), lambda c: F.element_at(c, -1) > F.col("upto"))).alias("combo")).join(combos, "combo", "left")
    return beyond.groupBy("ex_id").agg((F.first("partial") + F.coalesce(F.sum("w"), F.lit(0))).alias("part")).crossJoin(F.broadcast(c0)).select("ex_id", (F.col("part") + F.col("c0")).alias("score"))


def log_linear(examples: DataFrame, weights: DataFrame, degree: int = 1) -> DataFrame:
    """(ex_id, label, prob): softmax of the labels' sums over combinations; weights are (label, combo, w)."""
    labels = weights.select("label").distinct()
    hit = examples.select("ex_id", F.explode(combinations(F.array_sort("fv"), degree)).alias("combo")).join(weights, "combo").groupBy("ex_id", "label").agg(F.sum("w").alias("z"))
    z = examples.select("ex_id").crossJoin(labels).join(hit, ["ex_id", "label"], "left").withColumn("z", F.coalesce("z", F.lit(0.0)))
    w = Window.partitionBy("ex_id")
    e = F.exp(F.col("z") - F.max("z").over(w))
    return z.withColumn("e", e).select("ex_id", "label", (F.col("e") / F.sum("e").over(w)).alias("prob"))


def best_label(probs: DataFrame) -> DataFrame:
    """(ex_id, label): the likeliest, by name where probabilities tie."""
    top = probs.groupBy("ex_id").agg(F.min_by("label", F.struct(-F.col("prob"), "label")).alias("label"))
    return top


def dedupe_weights(weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((combo, wid), (wid, w)): equal weights share one entry; distinct weights get their ids in order of value."""
    distinct = weights.select("w").distinct().withColumn("wid", F.xxhash64("w"))
    return weights.join(distinct, "w").select("combo", "wid"), distinct.select("wid", "w")
