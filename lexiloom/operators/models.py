"""Classifiers over sorted feature vectors behind one face, so that any kind of model can drive a parser.

``classifier(kind, ...)`` gives a function from a vector (ascending ids) to a margin, small enough to be sent to workers:
``linear`` from weights (fid, w), ``kernel`` from support vectors (alpha, fv), whose polynomial is expanded once into weights
of feature combinations, and ``loglinear`` from weights (label, combo, w) of two labels, as the difference of their sums.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame

from lexiloom.functions.expressions import kernel_coefficients

Margin = Callable[[list[int]], float]
#: Rows of a model that may be sent to workers.
MOST_ROWS = 5_000_000


class Linear:
    def __init__(self, weights: dict[int, float], bias: float = 0.0) -> None:
        self.weights, self.bias = weights, bias

    def __call__(self, fv: list[int]) -> float:
        return sum(self.weights.get(f, 0.0) for f in fv) + self.bias


class Combined:
    """Weights of combinations of up to ``degree`` features."""

    def __init__(self, weights: dict[tuple[int, ...], float], degree: int, bias: float = 0.0) -> None:
        self.weights, self.degree, self.bias = weights, degree, bias

    def __call__(self, fv: list[int]) -> float:
        return self.bias + sum(self.weights.get(c, 0.0) for k in range(1, self.degree + 1) for c in combinations(fv, k))


def from_kernel(svs: list[tuple[float, list[int]]], degree: int, s: int = 1, r: int = 1) -> Combined:
    weight = kernel_coefficients(degree, s, r)
    out: dict[tuple[int, ...], float] = {}
    for alpha, fv in svs:
        own = sorted(fv)
        for k in range(1, degree + 1):
            for c in combinations(own, k):
                out[c] = out.get(c, 0.0) + alpha * weight[k]
    return Combined(out, degree, sum(a for a, _ in svs) * weight[0])


def from_log_linear(weights: list[tuple[str, tuple[int, ...], float]], positive: str = "+1") -> Combined:
    """The log odds of ``positive`` against the other of two labels."""
    if len({x[0] for x in weights} | {positive}) > 2:
        raise ValueError("a parser's model has two labels")
    out: dict[tuple[int, ...], float] = {}
    for label, combo, w in weights:
        out[tuple(combo)] = out.get(tuple(combo), 0.0) + (w if label == positive else -w)
    return Combined(out, max(map(len, out), default=1))


def classifier(kind: str, model: DataFrame, degree: int = 2, s: int = 1, r: int = 1) -> Margin:
    """The margin function of a model's table; a table of over MOST_ROWS rows is refused, not cut."""
    rows = model.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError("the model is too large to be sent to workers")
    if kind == "linear":
        return Linear({x["fid"]: float(x["w"]) for x in rows})
    if kind == "kernel":
        return from_kernel([(float(x["alpha"]), list(x["fv"])) for x in rows], degree, s, r)
    if kind == "loglinear":
        return from_log_linear([(x["label"], tuple(x["combo"]), float(x["w"])) for x in rows])
    raise ValueError(f"unknown kind {kind!r}")
