"""Column expressions: margins, kernels, update steps and costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(margin: Column) -> Column:
    """Probability of the positive class; no calibration."""
    return 1 / (1 + F.exp(-margin))


def label_of(score: Column) -> Column:
    """+1 for scores from 0 up, else -1."""
    return F.when(score >= 0, 1).otherwise(-1)


def is_positive(score: Column) -> Column:
    """Strictly positive scores; differs from ``label_of`` at 0."""
    return score > 0


def kernel_coefficients(degree: int, s: int = 1, r: int = 1) -> list[int]:
    """Weights of conjunctions of 0..degree features such that sum_k c_k C(n, k) = (s n + r) ** degree."""
    if not 1 <= degree <= 4:
        raise ValueError("degree must be from 1 to 4")
    # Forward differences at 0 of the polynomial in the number of shared features.
    row = [(s * n + r) ** degree for n in range(degree + 1)]
    out = []
    while row:
        out.append(row[0])
        row = [b - a for a, b in zip(row, row[1:])]
    return out


def step_size(variant: str, margin: Column, active: Column, c: float = 1.0) -> Column:
    """The online update's step: P 1, PA (1 - m) / n, PA-I at most C, PA-II (1 - m) / (n + 1 / 2C); 0 where no update is due."""
    loss = 1 - margin
    steps = {"P": F.lit(1.0), "PA": loss / active, "PA-I": F.least(F.lit(float(c)), loss / active), "PA-II": loss / (active + 1 / (2 * c))}
    if variant not in steps:
        raise ValueError(f"unknown update {variant!r}")
    return F.when(margin <= (0 if variant == "P" else 1), steps[variant]).otherwise(0.0)


def conjunction_cost(degree: int, m: Column, n: Column) -> Column:
    """Conjunctions of 2..degree features that a vector of n has beyond its prefix of m."""
    count = {
        2: lambda x: x * (x - 1) / 2,
        3: lambda x: (x * x * x - x) / 6,
        4: lambda x: (x * x * x * x - 2 * x * x * x + 11 * x * x - 10 * x) / 24,
    }[degree]
    return (count(n) - count(m)).cast("long")


def one_hot(base: int, *cases: Column) -> Column:
    """base + the number of the first true case; one more than the last if none is."""
    out = F.lit(base + len(cases))
    for k in range(len(cases) - 1, -1, -1):
        out = F.when(cases[k], base + k).otherwise(out)
    return out
