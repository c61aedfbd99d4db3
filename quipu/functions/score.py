"""Scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Weights of the signals of the hybrid score.
WEIGHTS = {"bm25": 0.25, "dim": 0.14, "concepto": 0.08, "sinonimos": 0.08, "peso": 0.10, "latente": 0.10, "grupo": 0.10, "tema": 0.08, "temporal": 0.04, "asociaciones": 0.02, "predicado": 0.20, "hub": 0.20}
VECTOR_WEIGHT = 0.15


def unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def bm25_unit(x: Column) -> Column:
    return F.abs(x) / (F.abs(x) + 3)


def logit(p: Column) -> Column:
    q = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.lit(500.0), F.greatest(F.lit(-500.0), x))))


def hybrid(signals: dict[str, Column], exact: Column | None = None, vector: Column | None = None, jsd: Column | None = None, jsd_weight: float = 0.0) -> Column:
    """The weighted signals (those left out count 0) by the sum of all weights; an exact match adds 2.94
    to the logit, otherwise a synonym signal of 0.95 or more adds logit(0.70 + 0.10 * vector)."""
    vector = F.lit(0.0) if vector is None else vector
    total = sum(WEIGHTS.values()) + VECTOR_WEIGHT
    base = sum((F.lit(w) * signals[k] for k, w in WEIGHTS.items() if k in signals), F.lit(0.0)) + F.lit(VECTOR_WEIGHT) * vector
    score = F.lit((1 - jsd_weight) / total) * base + (F.lit(jsd_weight) * jsd if jsd is not None else F.lit(0.0))
    near = signals.get("sinonimos", F.lit(0.0)) >= 0.95
    lifted = F.when(near, sigmoid(logit(score) + logit(F.lit(0.70) + 0.10 * vector))).otherwise(score)
    if exact is not None:
        lifted = F.when(exact, sigmoid(logit(score) + 2.94)).otherwise(lifted)
    return unit(lifted)


def inhibited(score: Column, group: list[str]) -> Column:
    """Where the best of the group has 0.80 or more, scores below 0.70 of it lose 40 %."""
    top = F.max(score).over(Window.partitionBy(*group))
    return F.when((top >= 0.80) & (score < 0.70 * top), score * 0.60).otherwise(score)


def reciprocal_rank(rank: Column, weight: float = 1.0, k: int = 60) -> Column:
    return F.lit(weight) / (rank + k)


def bayesian_bm25(x: Column, median: Column, alpha: float = 1.0) -> Column:
    """Sigmoid of alpha * (x - 0.7 * median); x must grow with relevance."""
    return sigmoid(alpha * (x - 0.7 * median))


def dunning(c_xy: Column, c_x: Column, c_y: Column, n: Column) -> Column:
    """Log-likelihood ratio of a 2x2 table; 0 if a cell is negative."""
    cells = [c_xy, c_x - c_xy, c_y - c_xy, n - c_x - c_y + c_xy]
    h = lambda v: F.when(v > 0, v * F.log(v.cast("double"))).otherwise(0.0)
    value = 2 * (sum(map(h, cells), F.lit(0.0)) - h(c_x) - h(n - c_x) - h(c_y) - h(n - c_y) + h(n))
    return F.when(F.least(*cells) < 0, 0.0).otherwise(F.greatest(F.lit(0.0), value))


def npmi(c_xy: Column, c_x: Column, c_y: Column, n: Column) -> Column:
    """Normalised pointwise mutual information in [-1, 1]; 1 where every record has the pair."""
    p = c_xy.cast("double") / n
    value = F.log2(p / ((c_x.cast("double") / n) * (c_y.cast("double") / n))) / -F.log2(p)
    return F.when(p >= 1, 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is all zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)
