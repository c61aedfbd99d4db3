"""Operators over weighted edges (origen, destino, peso): neighbourhoods, spreading, inference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quipu.operators.cut import cut
from quipu.operators.skew import join_checked


def undirected(edges: DataFrame) -> DataFrame:
    """a, b, peso: both directions of every edge, the greater weight where both exist."""
    ab = edges.select(F.col("origen").alias("a"), F.col("destino").alias("b"), "peso")
    return ab.unionByName(ab.select(F.col("b").alias("a"), F.col("a").alias("b"), "peso")).groupBy("a", "b").agg(F.max("peso").alias("peso"))


def first_per(rows: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rango") -> DataFrame:
    """The first n rows of every group, with their rank; ranks are limited before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def degree(edges: DataFrame) -> DataFrame:
    """concepto, grado: edges that leave or reach it; counted before the shuffle."""
    ends = edges.select(F.explode(F.array("origen", "destino")).alias("concepto"))
    return ends.groupBy("concepto").agg(F.count(F.lit(1)).alias("grado"))


def neighbour_counts(und: DataFrame) -> DataFrame:
    return und.groupBy("a").agg(F.count(F.lit(1)).alias("n"))


def triangles(und: DataFrame) -> DataFrame:
    """For each linked pair a < b and common neighbour c: one row a, b, c.

    Every pair probes the neighbours of its end of fewer neighbours only, so a hub's list is
    never joined with itself.
    """
    n = neighbour_counts(und)
    pairs = und.where("a < b").select("a", "b")
    sized = pairs.join(n.select("a", F.col("n").alias("na")), "a").join(n.select(F.col("a").alias("b"), F.col("n").alias("nb")), "b")
    probe = sized.select("a", "b", F.when(F.col("na") <= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("few"), F.when(F.col("na") <= F.col("nb"), F.col("b")).otherwise(F.col("a")).alias("many"))
    near = und.select(F.col("a").alias("few"), F.col("b").alias("c"))
    closes = und.select(F.col("a").alias("many"), F.col("b").alias("c"))
    return probe.join(near, "few").join(closes, ["many", "c"], "left_semi").select("a", "b", "c")


def common_neighbours(und: DataFrame) -> DataFrame:
    """comunes of each linked pair a < b that has any."""
    return triangles(und).groupBy("a", "b").agg(F.count(F.lit(1)).alias("comunes"))


def neighbour_jaccard(und: DataFrame) -> DataFrame:
    n = neighbour_counts(und)
    na, nb = n.select("a", F.col("n").alias("na")), n.select(F.col("a").alias("b"), F.col("n").alias("nb"))
    return common_neighbours(und).join(na, "a").join(nb, "b").withColumn("jaccard", F.col("comunes") / (F.col("na") + F.col("nb") - F.col("comunes")))


def adamic_adar(und: DataFrame) -> DataFrame:
    """Sum over common neighbours c of 1 / ln(degree of c), for linked pairs a < b. Names are numbered in their order before they meet."""
    names = cut(und.select("a").distinct().sort("a").withColumn("i", F.monotonically_increasing_id()))
    of = lambda c: names.select(F.col("a").alias(c), F.col("i").alias(f"i{c}"))
    coded = cut(join_checked(join_checked(und.select("a", "b"), of("a"), "a", "inner"), of("b"), "b", "inner").select(F.col("ia").alias("a"), F.col("ib").alias("b")))
    back = lambda c: names.select(F.col("i").alias(c), F.col("a").alias(f"n{c}"))
    scored = _adamic_adar(coded)
    return join_checked(join_checked(scored, back("a"), "a", "inner"), back("b"), "b", "inner").select(F.col("na").alias("a"), F.col("nb").alias("b"), "adamic_adar")


def _adamic_adar(und: DataFrame) -> DataFrame:
    n = neighbour_counts(und).select(F.col("a").alias("c"), F.when(F.col("n") > 1, 1 / F.log("n")).alias("w"))
    return triangles(und).join(n, "c").groupBy("a", "b").agg(F.sum("w").alias("adamic_adar"))


def spread_activation(und: DataFrame, seeds: DataFrame, hops: int = 3, least: float = 0.05, fan: int = 10) -> DataFrame:
    """seeds: semilla, concepto, activacion. Out: semilla, concepto, activacion, salto, padre.

    Each hop carries activation * weight * 2^-hop over the `fan` heaviest edges of every
    concept, keeps what is above `least`, and enters concepts not yet visited from that seed,
    each from its strongest parent (ties: least name).
    """
    heavy = cut(first_per(und, ["a"], [F.desc("peso"), F.asc("b")], fan).select("a", "b", "peso"))
    seen = seeds.select("semilla", "concepto", "activacion", F.lit(0).alias("salto"), F.lit(None).cast("string").alias("padre"))
    front = seen
    for hop in range(1, hops + 1):
        step = front.select("semilla", F.col("concepto").alias("a"), "activacion").join(heavy, "a")
        moved = step.select("semilla", F.col("b").alias("concepto"), (F.col("activacion") * F.col("peso") * 2.0**-hop).alias("activacion"), F.col("a").alias("padre")).where(F.col("activacion") > least)
        best = moved.groupBy("semilla", "concepto").agg(F.max(F.struct("activacion", "padre")).alias("m")).select("semilla", "concepto", "m.activacion", F.lit(hop).alias("salto"), "m.padre")
        front = cut(best.join(seen.select("semilla", "concepto"), ["semilla", "concepto"], "left_anti"))
        seen = seen.unionByName(front)
    return seen


def expand_context(und: DataFrame, hits: DataFrame, depth: int = 1, per_parent: int = 3) -> DataFrame:
    """hits: consulta, concepto, score. Neighbours of hits, `per_parent` heaviest per parent and hop:
    score * 0.6 + weight * 0.2, at most 1; concepts already there stay as they are."""
    seen = hits.select("consulta", "concepto", "score", F.lit(0).alias("nivel"))
    front = seen
    heavy = first_per(und, ["a"], [F.desc("peso"), F.asc("b")], per_parent).select("a", "b", "peso")
    for level in range(1, depth + 1):
        step = front.select("consulta", F.col("concepto").alias("a"), "score").join(heavy, "a")
        moved = step.select("consulta", F.col("b").alias("concepto"), F.least(F.lit(1.0), F.col("score") * 0.6 + F.col("peso") * 0.2).alias("score"))
        front = moved.groupBy("consulta", "concepto").agg(F.max("score").alias("score")).join(seen, ["consulta", "concepto"], "left_anti").withColumn("nivel", F.lit(level))
        seen = seen.unionByName(front)
    return seen.where("nivel > 0")


def inferred_edges(edges: DataFrame, decay: float = 0.7, floor: float = 0.25, least: float = 0.05, keep: int = 20, origins: DataFrame | None = None) -> DataFrame:
    """Inferred edges over all paths of two steps (from given origins: origen, distinct): origen, destino, peso. Edges of `floor` or more are walked; a path
    weighs the product of its edges times decay per edge, `least` at least. Of a pair the heaviest path counts, pairs with a
    direct edge are left out, and each origin keeps the `keep` heaviest (ties to the least name).

    Exact without walking every path through a hub: of the edges out of a middle node, in the order of the
    result, an origin of g direct edges needs the first keep + g + 1 only, since at most g + 1 of them are left out. The edges of
    a node are laid in boxes by the logarithm of their rank, and an origin meets the boxes that it needs.
    """
    strong = edges.where(F.col("peso") >= floor).select("origen", "destino", "peso")
    rank = F.row_number().over(Window.partitionBy("origen").orderBy(F.desc("peso"), F.asc("destino")))
    box = lambda n: F.floor(F.log2(n)).cast("int")
    out = strong.withColumn("_r", rank).select(F.col("origen").alias("medio"), F.col("destino").alias("sigue"), F.col("peso").alias("w"), box("_r").alias("_box"))
    if origins is not None:
        edges = cut(join_checked(edges.select("origen", "destino", "peso"), origins, "origen", "left_semi"))
        strong = edges.where(F.col("peso") >= floor)
    grade = edges.groupBy("origen").agg(F.count(F.lit(1)).alias("_g"))
    needs = F.explode(F.sequence(F.lit(0), box(F.col("_g") + keep + 1))).alias("_box")
    first = strong.join(grade, "origen").select("origen", F.col("destino").alias("medio"), "peso", needs)
    paths = first.join(out, ["medio", "_box"]).where("origen <> sigue").select("origen", F.col("sigue").alias("destino"), (F.col("peso") * decay * F.col("w") * decay).alias("peso"))
    best = paths.where(F.col("peso") >= least).groupBy("origen", "destino").agg(F.max("peso").alias("peso"))
    new = best.join(edges.select("origen", "destino"), ["origen", "destino"], "left_anti")
    return first_per(new, ["origen"], [F.round("peso", 9).desc(), F.asc("destino")], keep).drop("rango")


def transitive_edges(edges: DataFrame, hops: int = 2, decay: float = 0.7, floor: float = 0.25, least: float = 0.05, fan: int = 20) -> DataFrame:
    """Inferred edges over paths of 2 to `hops` steps: origen, destino, peso, saltos.

    Only edges of `floor` or more are walked, and of each concept the `fan` heaviest: that bounds
    the paths through a hub by fan**2 per end (inferred_edges has no such bound, for two steps). A path weighs the product of its edges times decay per
    edge; paths below `least` end. Concepts don't repeat on a path. Of a pair the heaviest path and the
    least number of steps count, pairs with a direct edge are left out, and each origin keeps 20.
    """
    strong = first_per(edges.where(F.col("peso") >= floor), ["origen"], [F.desc("peso"), F.asc("destino")], fan).select("origen", "destino", "peso")
    step = strong.select(F.col("origen").alias("destino"), F.col("destino").alias("sigue"), F.col("peso").alias("w"))
    paths = strong.select("origen", "destino", (F.col("peso") * decay).alias("peso"), F.array("origen", "destino").alias("ruta"))
    found = []
    for n in range(2, hops + 1):
        longer = paths.join(step, "destino").where(~F.array_contains("ruta", F.col("sigue")))
        paths = longer.select("origen", F.col("sigue").alias("destino"), (F.col("peso") * F.col("w") * decay).alias("peso"), F.array_append("ruta", F.col("sigue")).alias("ruta")).where(F.col("peso") >= least)
        found.append(paths.select("origen", "destino", "peso", F.lit(n).alias("saltos")))
    every = reduce(DataFrame.unionByName, found).groupBy("origen", "destino").agg(F.max("peso").alias("peso"), F.min("saltos").alias("saltos"))
    new = every.join(edges.select("origen", "destino"), ["origen", "destino"], "left_anti")
    return first_per(new, ["origen"], [F.round("peso", 9).desc(), F.asc("destino")], 20).drop("rango")


def propagate(scores: DataFrame, und: DataFrame, seeds: int = 10) -> DataFrame:
    """scores: consulta, concepto, score. 0.75 * score + 0.25 * what the best `seeds` send:
    the sum of weight / degree^0.3 of the receiver, by 2.5, at most 1."""
    top = first_per(scores, ["consulta"], [F.desc("score"), F.asc("concepto")], seeds).select("consulta", F.col("concepto").alias("a"))
    n = neighbour_counts(und).select(F.col("a").alias("b"), F.col("n").alias("grado"))
    sent = top.join(und, "a").join(n, "b").groupBy("consulta", F.col("b").alias("concepto")).agg(F.sum(F.col("peso") / F.pow("grado", F.lit(0.3))).alias("s"))
    back = F.least(F.lit(1.0), F.coalesce("s", F.lit(0.0)) / 2.5)
    return scores.join(sent, ["consulta", "concepto"], "left").withColumn("score", F.col("score") * 0.75 + back * 0.25).drop("s")


def label_propagation(und: DataFrame, rounds: int = 50) -> DataFrame:
    """concepto, grupo by synchronous propagation: every round a concept takes the label of greatest
    summed weight among its neighbours and itself (weight 1), ties to the least label. It ends when a round
    changes no label, or gives those of the round before the last again, and after `rounds` rounds at the latest."""
    und = cut(und)
    labels = und.select(F.col("a").alias("concepto")).distinct().withColumn("grupo", F.col("concepto"))
    marks: list = []
    for _ in range(rounds):
        votes = und.join(labels.withColumnRenamed("concepto", "b"), "b").groupBy(F.col("a").alias("concepto"), "grupo").agg(F.sum("peso").alias("w"))
        votes = votes.unionByName(labels.withColumn("w", F.lit(1.0))).groupBy("concepto", "grupo").agg(F.round(F.sum("w"), 6).alias("w"))
        labels = cut(first_per(votes, ["concepto"], [F.desc("w"), F.asc("grupo")], 1).select("concepto", "grupo"))
        marks.append(labels.agg(F.sum(F.xxhash64("concepto", "grupo").cast("decimal(38,0)"))).first()[0])
        if marks[-1] in marks[-3:-1]:
            break
    return labels


def communities(und: DataFrame, labels: DataFrame, least: int = 5, density: float = 0.3) -> DataFrame:
    """grupo, miembros, densidad of groups of at least `least` members: inner weight by k(k-1)/2."""
    size = labels.groupBy("grupo").agg(F.count(F.lit(1)).alias("miembros"))
    a, b = labels.select(F.col("concepto").alias("a"), F.col("grupo").alias("grupo")), labels.select(F.col("concepto").alias("b"), F.col("grupo").alias("gb"))
    inner = und.where("a < b").join(a, "a").join(b, "b").where("grupo = gb").groupBy("grupo").agg(F.sum("peso").alias("w"))
    k = F.col("miembros").cast("double")
    dense = size.where(F.col("miembros") >= least).join(inner, "grupo", "left").withColumn("densidad", F.coalesce("w", F.lit(0.0)) / (k * (k - 1) / 2)).drop("w")
    return dense.where(F.col("densidad") >= density)


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges after new ones are merged in: greatest weight and its type, but an old synonym edge
    keeps its type; first creation, last use or else the new creation."""
    protected = F.col("tipo") == "sinonimo_explicito"
    rank = lambda own: F.struct((protected & F.lit(own)).alias("p"), "peso", "tipo")
    both = old.withColumn("_k", rank(True)).unionByName(new.withColumn("_k", rank(False)))
    merged = both.groupBy("origen", "destino").agg(F.max("peso").alias("peso"), F.max("_k").alias("k"), F.min("creado").alias("creado"), F.max("uso").alias("uso"))
    return merged.select("origen", "destino", "peso", F.col("k.tipo").alias("tipo"), "creado", F.coalesce("uso", "creado").alias("uso"))


def merge_nodes(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges re-pointed by mapping (viejo, nuevo; one row per viejo): loops go, doubles keep the greatest weight."""
    a = mapping.select(F.col("viejo").alias("origen"), F.col("nuevo").alias("_o"))
    b = mapping.select(F.col("viejo").alias("destino"), F.col("nuevo").alias("_d"))
    moved = edges.join(a, "origen", "left").join(b, "destino", "left").select(F.coalesce("_o", "origen").alias("origen"), F.coalesce("_d", "destino").alias("destino"), "peso")
    return moved.where("origen <> destino").groupBy("origen", "destino").agg(F.max("peso").alias("peso"))
