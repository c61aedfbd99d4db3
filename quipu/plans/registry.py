"""All registered queries outside the optional subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quipu.plans import core_problems, flagship, graphs, latent, lifecycle, meaning, memory, recall, relational, search, signature, streams, upkeep, vectors

_PLANS = [core_problems, relational, search, graphs, lifecycle, vectors, streams, memory, signature, recall, latent, meaning, upkeep, flagship]
QUERIES = {k: f for p in _PLANS for k, f in p.QUERIES.items()}
SQL = {k: s for p in _PLANS for k, s in p.SQL.items()}


def first(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["se6_hybrid_search"](spark, d)
