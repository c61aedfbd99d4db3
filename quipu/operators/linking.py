"""Automatic links between nodes by contents, names and synonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quipu.functions import text as T
from quipu.operators.overlap import sharing
from quipu.operators.similar import jaccard_join
from quipu.operators.unpack import unpack


def _shared(rows: DataFrame, least: float) -> DataFrame:
    """rows: k, s (sets of distinct strings). Pairs a < b whose sets share `least` or more of the smaller one: a, b, s.

    Exact: with elements in order of their frequency, rarest first, the larger set holds one of the
    first size - ceil(least * size) + 1 elements of the smaller, so only those look for partners. Equal
    sets are one row while they meet.
    """
    keyed = rows.where(F.size("s") > 0).withColumn("c", F.array_sort("s")).select("k", "c")
    one = keyed.groupBy("c").agg(F.min("k").alias("rep"))
    items = one.select("rep", F.size("c").alias("n"), F.explode("c").alias("t"))
    df = items.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    ranked = items.join(df, "t").withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("df", "t")))
    x = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).select("t", F.col("rep").alias("x"), F.col("n").alias("nx"))
    y = items.select("t", F.col("rep").alias("y"), F.col("n").alias("ny"))
    cand = x.join(y, "t").where("nx < ny or (nx = ny and x < y)").select("x", "y").distinct()
    full = one.select("rep", "c")
    both = cand.join(full.select(F.col("rep").alias("x"), F.col("c").alias("cx")), "x").join(full.select(F.col("rep").alias("y"), F.col("c").alias("cy")), "y")
    scored = both.select("x", "y", (F.size(F.array_intersect("cx", "cy")) / F.size("cx")).alias("s")).where(F.col("s") >= least)
    scored = scored.unionByName(one.select(F.col("rep").alias("x"), F.col("rep").alias("y"), F.lit(1.0).alias("s")))
    member = keyed.join(one, "c").select("rep", "k")
    pairs = scored.join(member.select(F.col("rep").alias("x"), F.col("k").alias("p")), "x").join(member.select(F.col("rep").alias("y"), F.col("k").alias("q")), "y")
    # a pair of different sets comes once, one of equal sets both ways round
    return pairs.where("p < q or (x <> y and p > q)").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "s")


def link_by_tokens(nodes: DataFrame, least: float = 0.8) -> DataFrame:
    """co_ocurrencia: origen < destino whose contents' token sets have a Jaccard of `least` or more."""
    pairs = jaccard_join(nodes.select(F.col("concepto").alias("k"), T.graph_tokens("contenido").alias("s")), least)
    return pairs.select(F.col("a").alias("origen"), F.col("b").alias("destino"), F.col("jaccard").alias("peso"), F.lit("co_ocurrencia").alias("tipo"))


def link_by_name(nodes: DataFrame, least: float = 0.3, digits: int | None = None) -> DataFrame:
    """co_nombre: names that share that part of the smaller name's words of four or more characters, rounded to `digits`."""
    parts = F.array_distinct(F.filter(F.split("concepto", "_"), lambda x: F.length(x) >= 4))
    return sharing(nodes.select(F.col("concepto").alias("k"), parts.alias("s")), least, digits).select(F.col("a").alias("origen"), F.col("b").alias("destino"), F.col("s").alias("peso"))


def link_by_synonyms(nodes: DataFrame, least: float = 0.4) -> DataFrame:
    """co_semantica: synonym sets that overlap by `least`: 0.6 * overlap + 0.4 * the mean node weight."""
    values = unpack(nodes, "sinonimos", ["concepto"]).groupBy("concepto").agg(F.collect_set(F.lower("valor")).alias("s"))
    pairs = _shared(values.withColumnRenamed("concepto", "k"), least)
    w = lambda c, p: nodes.select(F.col("concepto").alias(c), F.col("peso").alias(p))
    both = pairs.join(w("a", "pa"), "a").join(w("b", "pb"), "b")
    return both.select(F.col("a").alias("origen"), F.col("b").alias("destino"), (0.6 * F.col("s") + 0.2 * (F.col("pa") + F.col("pb"))).alias("peso"), F.lit("co_semantica").alias("tipo"))
