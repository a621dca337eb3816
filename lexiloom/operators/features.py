"""Feature templates with named slots: a slot has a fixed range of ids whether or not its element exists.

Ids begin at 1; slot k of a template takes L ids, L being the number of strings plus one for unseen ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.expressions import one_hot
from lexiloom.operators.dictionary import look_up
from lexiloom.sources.corpus import SENTENCE

FIELDS = ("surface", "pos1", "pos2", "infl")
#: (offset to the token, field) of each slot of a token's template.
CHUNK_SLOTS = [(-2, "surface"), (-2, "pos2"), (-2, "infl"), *((k, f) for k in (-1, 0) for f in FIELDS), (1, "surface"), (2, "surface")]
PAIR_SLOTS, TRIPLE_SLOTS = 20, 33


def kinds(morphs: DataFrame, dictionary: DataFrame, unseen: int) -> DataFrame:
    """The distinct tokens (their four fields) with ``<field>_id``: look-ups are made once a kind, not once a token."""
    own = morphs.select(*FIELDS).distinct()
    for f in FIELDS:
        own = look_up(own, dictionary, f, f"{f}_id", unseen)
    return own


def of_kind(morphs: DataFrame, known: DataFrame) -> DataFrame:
    """Tokens with their kind's columns: one join, on all four fields, so that none of them alone makes a hot key."""
    k = known.select(*(F.col(f).alias(f"_k_{f}") for f in FIELDS), *(c for c in known.columns if c not in FIELDS))
    same = [F.col(f).eqNullSafe(F.col(f"_k_{f}")) for f in FIELDS]
    return morphs.join(k, same, "left").drop(*(f"_k_{f}" for f in FIELDS))


def with_ids(morphs: DataFrame, dictionary: DataFrame, unseen: int) -> DataFrame:
    """Adds ``<field>_id`` for the four fields."""
    return of_kind(morphs, kinds(morphs, dictionary, unseen))


def _ids(slots: list[tuple[int, Column]], size: int) -> Column:
    """The ids of the slots whose element isn't null, in order."""
    return F.array_compact(F.array(*(F.lit(1 + k * size).cast("long") + c for k, c in slots)))


def chunk_features(ids: DataFrame, size: int) -> DataFrame:
    """(sentence, idx, fv) of every token; all neighbours come from one sort of the sentence."""
    w = Window.partitionBy(*SENTENCE).orderBy("idx")
    at = lambda off, f: F.col(f"{f}_id") if off == 0 else (F.lag(f"{f}_id", -off) if off < 0 else F.lead(f"{f}_id", off)).over(w)
    return ids.select(*SENTENCE, "idx", _ids([(k, at(o, f)) for k, (o, f) in enumerate(CHUNK_SLOTS)], size).alias("fv"))


def wide_weights(weights: DataFrame, size: int) -> DataFrame:
    """(id, w0 .. w12): a token template's weights (fid, w), one row a string."""
    fid = F.col("fid") - 1
    own = weights.where((fid >= 0) & (fid < len(CHUNK_SLOTS) * size)).select((fid % size).cast("int").alias("id"), F.floor(fid / size).cast("int").alias("slot"), "w")
    return own.groupBy("id").agg(*(F.sum(F.when(F.col("slot") == k, F.col("w"))).alias(f"w{k}") for k in range(len(CHUNK_SLOTS))))


def chunk_margins(morphs: DataFrame, known: DataFrame, wide: DataFrame) -> DataFrame:
    """Adds ``margin``, equal to joining every feature with its weight: a linear score is a sum over tokens, so each
    kind of token (``known``, as ``kinds`` gives it) takes its strings' weights once, as sums for five offsets; tokens join
    their kind, and the sums are shifted along the sentence."""
    own = known
    for f in FIELDS:
        slots = [k for k, (_, g) in enumerate(CHUNK_SLOTS) if g == f]
        own = own.join(wide.select(F.col("id").alias(f"{f}_id"), *(F.coalesce(f"w{k}", F.lit(0.0)).alias(f"_w{k}") for k in slots)), f"{f}_id", "left")
    w = Window.partitionBy(*SENTENCE).orderBy("idx")
    part = {o: sum((F.coalesce(f"_w{k}", F.lit(0.0)) for k, (p, _) in enumerate(CHUNK_SLOTS) if p == o), F.lit(0.0)) for o in range(-2, 3)}
    own = own.select(*FIELDS, *(c.alias(f"_p{o + 2}") for o, c in part.items()))
    shifted = [F.col("_p2"), *(F.coalesce((F.lag(f"_p{o + 2}", -o) if o < 0 else F.lead(f"_p{o + 2}", o)).over(w), F.lit(0.0)) for o in (-2, -1, 1, 2))]
    return of_kind(morphs, own).withColumn("margin", sum(shifted[1:], shifted[0])).select(*morphs.columns, "margin")


def chunked(margins: DataFrame) -> DataFrame:
    """Adds ``chunk``: the first token begins a phrase, any other if its probability is above a half."""
    return margins.withColumn("chunk", (F.col("idx") == 0) | (F.col("margin") > 0))


#: Slots of a phrase's first token (surface, pos2), its head and tail (four fields each), its right neighbour's first, head and
#: last surface, by its part in a template; (head surface, head pos2), tail and left neighbour's last surface of a dependent.
_HEAD_SLOTS = {"pair": (6, 8, 12, 16), "near": (6, 8, 12, 26), "far": (16, 18, 22, 29)}
_LEFT_NEIGHBOUR = {"pair": 19, "triple": 32}


def local_width(context: int) -> int:
    return 9 + context


def global_base(template: str, size: int, context: int) -> int:
    """The first id of a template's features of a phrase pair as a whole; those of a triple's other pair follow."""
    slots, phrases = (PAIR_SLOTS, 2) if template == "pair" else (TRIPLE_SLOTS, 3)
    return 1 + slots * size + phrases * local_width(context)


def global_width(context: int) -> int:
    """Distance (3), brackets (3) and the competitors' context bits."""
    return 6 + context


def template_ids(template: str, size: int, context: int) -> int:
    return global_base(template, size, context) + (1 if template == "pair" else 2) * global_width(context) - 1


def phrase_features(ids: DataFrame, bun: DataFrame, ctx: DataFrame, size: int, context: int, template: str = "pair") -> DataFrame:
    """(sentence, id, n, did, bracket, inner, ctx, and the sides): each phrase's static features in each of its parts, so that
    a pair's or triple's are their union and a table has one row a phrase, not one a pair. ``ids`` has ``bun``.

    The sides are ``lft`` as dependent and ``rgt`` as head, and for a triple ``lft``, ``rgt`` as the nearer candidate and ``far`` as the
    farther one. ``inner`` sums brackets up to the phrase; ``context`` is the width of a set of context bits.
    """
    special, particle = F.col("pos1") == "SPECIAL", F.col("pos1") == "PARTICLE"
    rec = F.struct(*(F.col(f"{f}_id").alias(f) for f in FIELDS))
    got = ids.groupBy(*SENTENCE, F.col("bun").alias("id")).agg(
        F.min_by(rec, "idx").alias("first"), F.max_by(rec, "idx").alias("last"), F.max_by(rec, F.when(~special, F.col("idx"))).alias("tl"),
        F.max_by(rec, F.when(~special & ~particle, F.col("idx"))).alias("hd"),
    )
    own = bun.join(got, [*SENTENCE, "id"]).join(ctx, [*SENTENCE, "id"], "left").withColumn("ctx", F.coalesce("ctx", F.array().cast("array<int>")))
    w = Window.partitionBy(*SENTENCE).orderBy("id")
    own = own.withColumns({"_nf": F.lead("first").over(w), "_nh": F.lead("hd").over(w), "_nl": F.lead("last").over(w), "_pl": F.lag("last").over(w), "inner": F.sum("bracket").over(w).cast("int")})
    four = lambda at, c: [(at + k, F.col(f"{c}.{f}")) for k, f in enumerate(FIELDS)]

    def head(part: str, place: int) -> Column:
        first, hd, tl, after = _HEAD_SLOTS[part]
        slots = [(first, F.col("first.surface")), (first + 1, F.col("first.pos2")), *four(hd, "hd"), *four(tl, "tl")]
        slots += [(after + k, F.col(f"{c}.surface")) for k, c in enumerate(("_nf", "_nh", "_nl"))]
        return F.concat(_ids(slots, size), local_features(base + place * local_width(context), F.col("id") == F.col("n") - 1, context))

    base = 1 + (PAIR_SLOTS if template == "pair" else TRIPLE_SLOTS) * size
    left = [(0, F.col("hd.surface")), (1, F.col("hd.pos2")), *four(2, "tl"), (_LEFT_NEIGHBOUR[template], F.col("_pl.surface"))]
    sides = {"lft": F.concat(_ids(left, size), local_features(base, F.col("id") == 0, context))}
    sides |= {"rgt": head("pair", 1)} if template == "pair" else {"rgt": head("near", 1), "far": head("far", 2)}
    return own.select(*SENTENCE, "id", "n", "did", "bracket", "inner", "ctx", *(c.alias(k) for k, c in sides.items()))


def local_features(base: int, edge: Column, context: int) -> Column:
    """Border of the sentence (2), brackets (3), period (2), comma (2) and the phrase's own context bits."""
    flags = [one_hot(base, edge), one_hot(base + 2, F.col("bracket") > 0, F.col("bracket") < 0), one_hot(base + 5, F.col("period")), one_hot(base + 7, F.col("comma"))]
    return F.concat(F.array(*(f.cast("long") for f in flags)), F.transform("ctx", lambda c: F.lit(base + 9).cast("long") + c))


def _whole(base: int, i: str, j: str, ci: str, cj: str) -> Column:
    """Distance and brackets strictly between two phrases; decoders add the competitors' bits."""
    inside, far = F.col(cj) - F.col(ci), F.col(j) - F.col(i)
    return F.array(one_hot(base, far == 1, far < 6).cast("long"), one_hot(base + 3, inside > 0, inside < 0).cast("long"))


def pair_features(phrases: DataFrame, pairs: DataFrame, size: int, context: int) -> DataFrame:
    """(sentence, i, j, fv): the static features of phrase pairs (sentence, i, j)."""
    a = phrases.select(*SENTENCE, F.col("id").alias("i"), "lft", F.col("inner").alias("_ci"))
    b = phrases.select(*SENTENCE, F.col("id").alias("j"), "rgt", (F.col("inner") - F.col("bracket")).alias("_cj"))
    own = pairs.join(a, [*SENTENCE, "i"]).join(b, [*SENTENCE, "j"])
    return own.select(*SENTENCE, "i", "j", F.array_sort(F.concat("lft", "rgt", _whole(global_base("pair", size, context), "i", "j", "_ci", "_cj"))).alias("fv"))


def triple_features(phrases: DataFrame, triples: DataFrame, size: int, context: int) -> DataFrame:
    """(sentence, i, j, k, fv): the static features of triples (sentence, i, j, k), from phrases of the triple template."""
    a = phrases.select(*SENTENCE, F.col("id").alias("i"), "lft", F.col("inner").alias("_ci"))
    b = phrases.select(*SENTENCE, F.col("id").alias("j"), "rgt", (F.col("inner") - F.col("bracket")).alias("_cj"))
    c = phrases.select(*SENTENCE, F.col("id").alias("k"), "far", (F.col("inner") - F.col("bracket")).alias("_ck"))
    own = triples.join(a, [*SENTENCE, "i"]).join(b, [*SENTENCE, "j"]).join(c, [*SENTENCE, "k"])
    base = global_base("triple", size, context)
    near, far = _whole(base, "i", "j", "_ci", "_cj"), _whole(base + global_width(context), "i", "k", "_ci", "_ck")
    return own.select(*SENTENCE, "i", "j", "k", F.array_sort(F.concat("lft", "rgt", "far", near, far)).alias("fv"))


def combinations(fv: Column, degree: int, least: int = 1) -> Column:
    """All ascending combinations of ``least`` to ``degree`` of a sorted array's elements, made in place."""
    level = F.transform(fv, lambda x: F.array(x))
    out = [level]
    for _ in range(degree - 1):
        level = F.flatten(F.transform(level, lambda c: F.transform(F.filter(fv, lambda y: y > F.element_at(c, -1)), lambda y: F.concat(c, F.array(y)))))
        out.append(level)
    return F.flatten(F.array(*out[least - 1 :])) if len(out) > least else out[-1]
