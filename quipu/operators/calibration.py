"""Calibration of scores: conformal thresholds, Platt, isotonic steps, AUC."""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quipu.operators.running import running_before

#: Scores are counted in this many steps of their range, so what the driver fits is bounded.
STEPS = 2000


def conformal_threshold(scores: DataFrame, alpha: float = 0.1) -> DataFrame:
    """scores: score of negatives. One row: umbral, n. The k-th smallest, k = ceil((n + 1) * (1 - alpha)),
    n at most; alpha is at least 1 / (n + 1). No rows without scores."""
    n = scores.count()
    if not n:
        return scores.sparkSession.createDataFrame([], "umbral double, n bigint")
    a = max(alpha, 1 / (n + 1))
    k = min(n, math.ceil((n + 1) * (1 - a) - 1e-9))
    per = scores.groupBy("score").agg(F.count(F.lit(1)).alias("c"))
    ranked = running_before(per, [], [F.asc("score")], F.col("c"), "antes")
    return ranked.where((F.col("antes") < k) & (F.col("antes") + F.col("c") >= k)).select(F.col("score").alias("umbral"), F.lit(n).cast("bigint").alias("n"))


def auc(rows: DataFrame) -> DataFrame:
    """rows: score, positivo. One row: auc by ranks with ties halved, over counts per score; null if one
    of the two kinds is missing."""
    per = rows.groupBy("score").agg(F.count_if("positivo").alias("p"), F.count_if(~F.col("positivo")).alias("n"))
    return running_before(per, [], [F.asc("score")], F.col("n"), "below").agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + 0.5 * F.col("n"))), (F.sum("p") * F.sum("n")).cast("double")).alias("auc"))


def _binned(rows: DataFrame) -> np.ndarray:
    """(score, positives, all) per step; STEPS + 1 rows at most come to the driver."""
    b = rows.where("score is not null").groupBy(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")) * STEPS).alias("b"))
    got = b.agg(F.count_if("positivo").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    return np.array(sorted((r["b"] / STEPS, r["p"], r["n"]) for r in got), dtype=float).reshape(-1, 3)


def platt(rows: DataFrame, rounds: int = 500, rate: float = 0.1) -> tuple[float, float]:
    """a, b of sigmoid(a * score + b) by gradient descent on the counts per step of scores in [0, 1]."""
    d = _binned(rows)
    a, b = 1.0, 0.0
    if not len(d):
        return a, b
    x, p, n = d.T
    for _ in range(rounds):
        e = n / (1 + np.exp(-(a * x + b))) - p
        a, b = a - rate * float((e * x).sum() / n.sum()), b - rate * float(e.sum() / n.sum())
    return a, b


def isotonic_steps(rows: DataFrame) -> list[tuple[float, float]]:
    """(least score, probability) of each step of the non-decreasing fit, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for x, p, n in _binned(rows):
        pools.append([x, p, n])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            x2, p2, n2 = pools.pop()
            pools[-1] = [pools[-1][0], pools[-1][1] + p2, pools[-1][2] + n2]
    return [(x, p / n) for x, p, n in pools]


def step_value(steps: list[tuple[float, float]], score: float) -> float:
    at = bisect_right([s for s, _ in steps], score) - 1
    return steps[max(0, at)][1] if steps else 0.0
