"""Searches and signals that rest on vectors: by meaning, by essence, and the vector and theme signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quipu.functions import score as S
from quipu.functions import text as T
from quipu.operators import distribution as D
from quipu.operators.cut import cut
from quipu.operators.graph import first_per
from quipu.operators.skew import join_checked
from quipu.operators.search import nearest
from quipu.plans import memory, vectors
from quipu.plans.relational import W
from quipu.plans.search import _TOP, hits, top
from quipu.plans.vectors import _AFF, _QV, _VEC, SIZE, query_vectors, signatures, token_vectors, usable
from quipu.plans.views import Catalogue, Views

C = Catalogue()
QUERIES, SQL = C.queries, C.sql


def node_vectors(v: Views) -> DataFrame:
    return usable(v.table("nodos"), "concepto").select(F.col("k").alias("concepto"), "vector")


@C.add("se9_vector_search", "WITH " + _VEC + ", " + _QV + """, m AS (SELECT consulta, k AS concepto, round(list_cosine_similarity(qv.v, CAST(vec.v AS DOUBLE[])), 6) AS coseno FROM qv, vec)
SELECT consulta, concepto, coseno FROM (SELECT *, row_number() OVER (PARTITION BY consulta ORDER BY coseno DESC, concepto) AS r FROM m WHERE coseno > 0) WHERE r <= 10""", "nodes")
def _(v: Views) -> DataFrame:
    """The ten nodes of greatest cosine with each query of the batch; every node is compared."""
    return nearest(node_vectors(v), "concepto", query_vectors(v), 10)


@C.add("jn21_token_neighbours", "WITH " + _VEC + ", " + vectors._TOK + f""", u AS (SELECT DISTINCT unnest({W('consulta', 3)}) AS k FROM casos_qa), m AS (SELECT tk.k AS token, vec.k AS concepto, round(list_cosine_similarity(CAST(tk.v AS DOUBLE[]), CAST(vec.v AS DOUBLE[])), 6) AS coseno FROM tk JOIN u USING (k), vec)
SELECT token, concepto, coseno FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY coseno DESC, concepto) AS r FROM m WHERE coseno > 0) WHERE r <= 32""", "nodes")
def _(v: Views) -> DataFrame:
    """For the tokens of the batch of queries the 32 nodes of greatest cosine above 0."""
    used = v.table("casos_qa").select(F.explode(T.words("consulta", 3)).alias("k")).distinct()
    asked = token_vectors(v).join(used, "k", "left_semi").select(F.col("k").alias("consulta"), "vector")
    return nearest(node_vectors(v), "concepto", asked, 32).withColumnRenamed("consulta", "token")


@C.add("sf1g_vector_signal", "WITH " + _TOP + ", " + _VEC + ", " + _QV + " SELECT top.consulta, concepto, round(least(1.0, greatest(0.0, list_cosine_similarity(qv.v, CAST(vec.v AS DOUBLE[])))), 6) AS senal FROM top JOIN qv ON qv.consulta = top.consulta JOIN vec ON k = concepto", "nodes")
def _(v: Views) -> DataFrame:
    rows = top(v).select("consulta", "concepto").join(query_vectors(v).withColumnRenamed("vector", "q"), "consulta").join(node_vectors(v), "concepto")
    return rows.select("consulta", "concepto", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), S.cosine(F.col("q"), F.col("vector")))), 6).alias("senal"))


@C.add(
    "se12_essence_search",
    "WITH " + _AFF + ", " + _QV + """, qa AS (SELECT consulta, categoria FROM (SELECT consulta, categoria, row_number() OVER (PARTITION BY consulta ORDER BY round(greatest(0.0, list_cosine_similarity(qv.v, cen.v)), 6) DESC, categoria) AS r FROM qv, cen) WHERE r <= 2),
nb AS (SELECT k, categoria FROM (SELECT *, row_number() OVER (PARTITION BY categoria ORDER BY afinidad DESC, k) AS r FROM aff) WHERE r <= 160),
m AS (SELECT DISTINCT qa.consulta, nb.k AS concepto, round(list_cosine_similarity(qv.v, CAST(vec.v AS DOUBLE[])), 6) AS coseno FROM qa JOIN nb USING (categoria) JOIN qv ON qv.consulta = qa.consulta JOIN vec ON vec.k = nb.k)
SELECT consulta, concepto, coseno FROM (SELECT *, row_number() OVER (PARTITION BY consulta ORDER BY coseno DESC, concepto) AS r FROM m) WHERE r <= 10""",
    "nodes",
)
def _(v: Views) -> DataFrame:
    """Among the 160 nodes nearest to each of a query's two dominant categories the ten of greatest cosine."""
    rows = usable(v.table("nodos"), "concepto")
    centre = D.weighted_mean(rows.join(v.nodes.select(F.col("concepto").alias("k"), "categoria"), "k").where("categoria between 1 and 11"), ["categoria"], "vector", F.lit(1.0), SIZE)
    q = cut(query_vectors(v).withColumnRenamed("vector", "q"))
    every = q.withColumn("categoria", F.explode(F.sequence(F.lit(1), F.lit(11))))
    near = every.join(F.broadcast(centre), "categoria").select("consulta", "categoria", F.round(F.greatest(F.lit(0.0), S.cosine(F.col("q"), F.col("vector"))), 6).alias("s"))
    two = first_per(near, ["consulta"], [F.desc("s"), F.asc("categoria")], 2).select("consulta", "categoria")
    most = first_per(signatures(v), ["categoria"], [F.desc("afinidad"), F.asc("k")], 160).select("categoria", F.col("k").alias("concepto"))
    met = two.join(most, "categoria").select("consulta", "concepto").distinct().join(q, "consulta").join(node_vectors(v), "concepto")
    scored = met.select("consulta", "concepto", F.round(S.cosine(F.col("q"), F.col("vector")), 6).alias("coseno"))
    return first_per(scored, ["consulta"], [F.desc("coseno"), F.asc("concepto")], 10).select("consulta", "concepto", "coseno")


@C.add(
    "se14_reasoning",
    memory.EPISTEME + f""", {{top}}
b0 AS (SELECT t.consulta, t.concepto, round((0.6 * greatest(0.0, coalesce(list_cosine_similarity(qv.v, CAST(vec.v AS DOUBLE[])), 0.0)) + 0.4 * least(1.0, len(list_intersect(list_distinct({W('k.consulta', 3)}), list_distinct({W('a.sinonimos', 3)}))) / 2.0)) * round(ce, 6), 9) AS s
  FROM top t JOIN ep ON ep.consulta = t.consulta AND round(ce, 6) >= 0.2 JOIN casos_qa k ON k.item_id = t.consulta JOIN act a ON a.concepto = t.concepto LEFT JOIN qv ON qv.consulta = t.consulta LEFT JOIN vec ON vec.k = t.concepto),
hv AS (SELECT a, b, peso FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY peso DESC, b) AS r FROM und) WHERE r <= 10),
b1 AS (SELECT consulta, b AS concepto, max(s * peso * 0.4) AS s FROM b0 JOIN hv ON a = concepto GROUP BY 1, 2),
b2 AS (SELECT consulta, b AS concepto, max(s * peso * 0.4) AS s FROM b1 JOIN hv ON a = concepto WHERE s >= 0.05 GROUP BY 1, 2),
z AS (SELECT consulta, concepto, round(max(s), 6) AS score FROM (SELECT * FROM b0 UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM b2) GROUP BY 1, 2 HAVING max(s) >= 0.05)
SELECT consulta, concepto, score FROM (SELECT *, row_number() OVER (PARTITION BY consulta ORDER BY score DESC, concepto) AS r FROM z) WHERE r <= 10""".replace("{top}", "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY consulta ORDER BY bm25 DESC, concepto) AS rango FROM hits) WHERE rango <= 50),"),
    "nodes edges und",
)
def _(v: Views) -> DataFrame:
    """Cosine and synonyms of the 50 best, times what is known of the query, carried two hops (a factor 0.4 each, over the ten
    heaviest edges of a node); what falls below 0.05 goes, and a query of which too little is known gives nothing."""
    known = memory.QUERIES["se13_epistemic_evaluation"](v.spark, v.dir).where("episteme >= 0.2").select("consulta", "episteme")
    asked = v.table("casos_qa").select(F.col("item_id").alias("consulta"), F.array_distinct(T.words("consulta", 3)).alias("w"))
    best = cut(top(v).select("consulta", "concepto").join(known, "consulta"))
    names = cut(best.select("concepto").distinct())
    held = join_checked(v.active, names, "concepto", "left_semi").select("concepto", F.array_distinct(T.words("sinonimos", 3)).alias("sn"))
    rows = best.join(asked, "consulta").join(held, "concepto")
    rows = rows.join(query_vectors(v).withColumnRenamed("vector", "q"), "consulta", "left").join(join_checked(node_vectors(v), names, "concepto", "left_semi"), "concepto", "left")
    cos = F.when(F.col("q").isNotNull() & F.col("vector").isNotNull(), F.greatest(F.lit(0.0), S.cosine(F.col("q"), F.col("vector")))).otherwise(0.0)
    own = (0.6 * cos + 0.4 * F.least(F.lit(1.0), F.size(F.array_intersect("w", "sn")) / 2.0)) * F.col("episteme")
    b0 = cut(rows.select("consulta", "concepto", F.round(own, 9).alias("s")))

    def hop(b: DataFrame) -> DataFrame:
        """Over the edges of the nodes that are there; the others are not shuffled."""
        ends = cut(b.select(F.col("concepto").alias("a")).distinct())
        heavy = first_per(join_checked(v.und, ends, "a", "left_semi"), ["a"], [F.desc("peso"), F.asc("b")], 10).select("a", "b", "peso")
        return b.join(heavy, F.col("concepto") == F.col("a")).groupBy("consulta", F.col("b").alias("concepto")).agg(F.max(F.col("s") * F.col("peso") * 0.4).alias("s"))

    b1 = cut(hop(b0))
    every = b0.unionByName(b1).unionByName(hop(b1.where("s >= 0.05"))).groupBy("consulta", "concepto").agg(F.max("s").alias("s")).where("s >= 0.05")
    return first_per(every.select("consulta", "concepto", F.round("s", 6).alias("score")), ["consulta"], [F.desc("score"), F.asc("concepto")], 10).select("consulta", "concepto", "score")


@C.add(
    "sf1e_theme_signal",
    f"WITH {_TOP}, te AS (SELECT a, b, tema FROM ({vectors.SQL['sf4_thematic_similarity']}) WHERE tema > 0.1), bo AS (SELECT a, b, tema FROM te UNION ALL SELECT b, a, tema FROM te) SELECT consulta, b AS concepto, round(least(1.0, 3 * avg(tema)) + 1e-9, 6) AS tema FROM top JOIN bo ON a = concepto GROUP BY 1, 2",
    "nodes",
)
def _(v: Views) -> DataFrame:
    """Three times the mean thematic similarity above 0.1 to the 50 best of a query, at most 1."""
    from quipu.plans.fusion import themes

    return themes(v).withColumn("tema", F.round(F.col("tema") + 1e-9, 6))
