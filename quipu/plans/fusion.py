"""The flagship: candidates united from the layers, gated as they are in the cascade, and the signals that score them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quipu.functions import score as S
from quipu.functions import text as T
from quipu.operators.cut import cut
from quipu.operators.distribution import normalised
from quipu.operators.graph import first_per, neighbour_counts
from quipu.operators.search import bm25, nearest
from quipu.plans.search import asked, index, top
from quipu.plans.vectors import query_vectors, usable
from quipu.plans.views import Views

#: Hits below which the fallback layers are asked.
FEW = 3


def typo_hits(v: Views, typos: DataFrame) -> DataFrame:
    words = lambda c, n: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(f"[a-z0-9]{{{n},}}"), F.lit(0))))
    q = v.table("casos_qa").select(F.col("item_id").alias("consulta"), words(F.lower("consulta"), 6).alias("palabra"))
    names = v.active.select("concepto", words(F.translate("concepto", "_", " "), 4).alias("parecida"))
    return names.join(q.join(typos, "palabra").select("consulta", "parecida").distinct(), "parecida").select("consulta", "concepto")


def candidates(v: Views, best: DataFrame, hubs: DataFrame, chain: DataFrame, meant: DataFrame) -> DataFrame:
    """consulta, concepto, capas (names of the layers, sorted).

    Always: the 50 best by BM25, near words, members of the hubs that are meant, the 50 of greatest cosine, evocation, and the 20
    heaviest latent edges of the five best. Where BM25 finds fewer than FEW: prefixes and typos.
    """
    from quipu.plans import memory, search

    named = lambda name: (search.C.of | memory.C.of)[name](v)
    found = best.groupBy("consulta").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FEW).select("consulta")
    without = lambda rows: rows.join(found, "consulta", "left_anti")
    latent = v.und.where("peso < 0.5").select(F.col("a").alias("de"), F.col("b").alias("concepto"), "peso")
    five = best.where("rango <= 5").select("consulta", F.col("concepto").alias("de"))
    reached = five.join(latent, "de").groupBy("consulta", "concepto").agg(F.max("peso").alias("peso"))
    nodes = usable(v.table("nodos"), "concepto").select(F.col("k").alias("concepto"), "vector")
    layers = {
        "bm25": best,
        "cerca": named("se6e_near"),
        "hub": hubs,
        "vector": nearest(nodes, "concepto", meant, 50),
        "cadena": chain,
        "latente": first_per(reached, ["consulta"], [F.desc("peso"), F.asc("concepto")], 20),
        "prefijo": memory.prefix_hits(v, without(asked(v))),
        "errata": without(typo_hits(v, named("se6i_typo_fallback"))),
    }
    rows = [x.select(F.col("consulta").cast("bigint").alias("consulta"), "concepto", F.lit(name).alias("capa")) for name, x in layers.items()]
    return reduce(DataFrame.unionByName, rows).groupBy("consulta", "concepto").agg(F.array_sort(F.collect_set("capa")).alias("capas"))


def _tags(v: Views) -> tuple[DataFrame, DataFrame]:
    n = float(v.active.count())
    idf = v.dims.groupBy("dim").agg(F.log(F.lit(n) / F.count(F.lit(1))).alias("idf"))
    tagged = cut(v.dims.join(idf, "dim"))
    return tagged, tagged.groupBy("concepto").agg(F.count(F.lit(1)).alias("n"), F.sum("idf").alias("w"))


def themes(v: Views, pairs: DataFrame | None = None, best: DataFrame | None = None) -> DataFrame:
    """consulta, concepto, tema: 3 * the mean similarity above 0.1 to the 50 best of the query, at most 1; of given pairs, or
    of all that share a tag with one of the 50 best."""
    best = top(v) if best is None else best
    tagged, size = _tags(v)
    sized = lambda k: size.select(F.col("concepto").alias(k), F.col("n").alias(f"n_{k}"), F.col("w").alias(f"w_{k}"))
    near = best.select("consulta", F.col("concepto").alias("a")).join(tagged.select(F.col("concepto").alias("a"), "dim", "idf"), "a")
    if pairs is None:
        met = near.join(tagged.select("concepto", "dim"), "dim")
    else:
        met = near.join(pairs.select("consulta", "concepto").join(tagged.select("concepto", "dim"), "concepto"), ["consulta", "dim"])
    shared = met.where("a <> concepto").groupBy("consulta", "concepto", "a").agg(F.count(F.lit(1)).alias("c"), F.sum("idf").alias("w"))
    both = shared.join(sized("a"), "a").join(sized("concepto"), "concepto")
    tema = F.round(0.4 * F.col("c") / (F.col("n_a") + F.col("n_concepto") - F.col("c")) + 0.6 * T.ratio(F.col("w"), F.col("w_a") + F.col("w_concepto") - F.col("w")), 6)
    scored = both.select("consulta", "concepto", tema.alias("t")).where("t > 0.1")
    return scored.groupBy("consulta", "concepto").agg(F.least(F.lit(1.0), 3 * F.avg("t")).alias("tema"))


def hybrid_hits(v: Views) -> DataFrame:
    """consulta, concepto, capas, score: every candidate with the hybrid score of the ten signals that have data."""
    from quipu.plans import memory, search

    v = v.written()
    best = cut(top(v))
    hubs = cut(v.dims.withColumnRenamed("dim", "hub_id").join(search.C.of["se6b_hub_expansion"](v).where("confianza >= 0.25"), "hub_id").groupBy("consulta", "concepto").agg(F.max("confianza").alias("c")))
    chain = cut(memory.evocation(v, best.where("rango <= 5")).select(F.col("consulta").cast("bigint").alias("consulta"), "concepto", "activacion"))
    vectors = cut(query_vectors(v))
    found = cut(candidates(v, best, hubs, chain, vectors))
    pair = ["consulta", "concepto"]

    # BM25 of candidates that other layers brought: their postings only
    postings, lengths = index(v)
    scores = bm25(postings, lengths, asked(v), "concepto", found.select(*pair)).select(*pair, "bm25")
    meant = best.where("rango <= 5").join(v.dims, "concepto").select("consulta", "dim").distinct()
    total = meant.groupBy("consulta").agg(F.count(F.lit(1)).alias("k"))
    tags = found.select(*pair).join(v.dims, "concepto").join(meant, ["consulta", "dim"]).groupBy(*pair).agg(F.count(F.lit(1)).alias("c")).join(total, "consulta")
    tags = tags.select(*pair, F.round(F.sqrt("c") / F.sqrt("k"), 6).alias("dim"))
    latent = v.und.where("peso < 0.5").groupBy(F.col("a").alias("concepto")).agg(F.max("peso").alias("latente"))
    grade = neighbour_counts(v.und).select(F.col("a").alias("concepto"), F.col("n").alias("grado"))
    own = v.active.select("concepto", "peso", T.words(F.translate("concepto", "_", " "), 3).alias("c"), T.words("sinonimos", 3).alias("s"))
    of_node = found.select("concepto").distinct().join(own, "concepto").join(grade, "concepto", "left").join(latent, "concepto", "left")
    of_node = of_node.join(usable(v.table("nodos"), "concepto").select(F.col("k").alias("concepto"), normalised(F.col("vector")).alias("vector")), "concepto", "left")
    of_query = v.table("casos_qa").select(F.col("item_id").alias("consulta"), F.array_distinct(T.words("consulta", 3)).alias("q")).join(vectors.select("consulta", normalised(F.col("vector")).alias("vq")), "consulta", "left")
    rows = found.join(scores, pair, "left").join(tags, pair, "left").join(hubs.withColumnRenamed("c", "hub"), pair, "left").join(chain, pair, "left")
    rows = rows.join(themes(v, found, best).withColumn("tema", F.round(F.col("tema") + 1e-9, 6)), pair, "left").join(of_node, "concepto").join(of_query, "consulta")
    or_0 = lambda c: F.coalesce(c, F.lit(0.0))
    signals = {
        "bm25": S.bm25_unit(or_0("bm25")),
        "dim": or_0("dim"),
        "concepto": T.coverage(F.col("q"), F.col("c")),
        "sinonimos": T.coverage(F.col("q"), F.col("s")),
        "peso": S.unit(F.col("peso")),
        "latente": F.greatest(or_0("latente"), or_0("activacion")),
        "tema": or_0("tema"),
        "asociaciones": F.least(F.lit(1.0), F.coalesce("grado", F.lit(0)) / 20.0),
        "hub": or_0(F.least(F.lit(1.0), 2 * F.col("hub"))),
    }
    exact = F.size(F.array_except("q", "c")) + F.size(F.array_except("c", "q")) == 0
    cos = F.when(F.col("vector").isNotNull() & F.col("vq").isNotNull(), F.greatest(F.lit(0.0), S.dot(F.col("vq"), F.col("vector")))).otherwise(0.0)
    return rows.select(*pair, "capas", F.round(S.hybrid(signals, exact, cos), 6).alias("score"))
