"""Graph queries: spreading, inference, structure, linking and edge maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quipu.functions import text as T
from quipu.operators import graph as G
from quipu.operators.linking import link_by_name, link_by_synonyms, link_by_tokens
from quipu.plans.relational import W
from quipu.plans.views import Catalogue, Views

C = Catalogue()
QUERIES, SQL = C.queries, C.sql

_HEAVY = "hv AS (SELECT a, b, peso FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY peso DESC, b) AS r FROM und) WHERE r <= 10)"


def seeds(v: Views) -> DataFrame:
    return v.nodes.where("categoria = 7 and peso > 0.6").select(F.col("concepto").alias("semilla"), "concepto", F.col("peso").alias("activacion"))


@C.add(
    "gr2_spread_activation",
    f"""WITH {_HEAVY},
h0 AS (SELECT concepto AS semilla, concepto, peso AS s FROM nodes WHERE categoria = 7 AND peso > 0.6),
h1 AS (SELECT semilla, b AS concepto, max(s * hv.peso * 0.5) AS s FROM h0 JOIN hv ON a = concepto WHERE s * hv.peso * 0.5 > 0.05 AND b <> semilla GROUP BY 1, 2),
v1 AS (SELECT semilla, concepto FROM h0 UNION SELECT semilla, concepto FROM h1),
h2 AS (SELECT h1.semilla, b AS concepto, max(s * hv.peso * 0.25) AS s FROM h1 JOIN hv ON a = h1.concepto ANTI JOIN v1 ON v1.semilla = h1.semilla AND v1.concepto = hv.b WHERE s * hv.peso * 0.25 > 0.05 GROUP BY 1, 2),
v2 AS (SELECT * FROM v1 UNION SELECT semilla, concepto FROM h2),
h3 AS (SELECT h2.semilla, b AS concepto, max(s * hv.peso * 0.125) AS s FROM h2 JOIN hv ON a = h2.concepto ANTI JOIN v2 ON v2.semilla = h2.semilla AND v2.concepto = hv.b WHERE s * hv.peso * 0.125 > 0.05 GROUP BY 1, 2)
SELECT semilla, concepto, round(s + 1e-9, 6) AS activacion, salto FROM (SELECT *, 1 AS salto FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3)""",
    "nodes edges und",
)
def _(v: Views) -> DataFrame:
    return G.spread_activation(v.und, seeds(v)).where("salto > 0").select("semilla", "concepto", F.round(F.col("activacion") + 1e-9, 6).alias("activacion"), "salto")


@C.add(
    "gr12_activation_path",
)
def _(v: Views) -> DataFrame:
    """The way from each seed to what it reached, by the parents of the spreading."""
    reached = G.spread_activation(v.und, seeds(v))
    path = reached.where("salto > 0").select("semilla", "concepto", F.array("concepto").alias("camino"), "padre")
    up = reached.select("semilla", F.col("concepto").alias("padre"), F.col("padre").alias("abuelo"))
    for _ in range(3):
        path = path.join(up, ["semilla", "padre"], "left").select("semilla", "concepto", F.when(F.col("padre").isNotNull(), F.concat(F.array("padre"), "camino")).otherwise(F.col("camino")).alias("camino"), F.col("abuelo").alias("padre"))
    return path.select("semilla", "concepto", F.array_join("camino", ">").alias("camino"))


_TRANSITIVE = """fu AS (SELECT origen, destino, peso FROM edges WHERE peso >= 0.25),
p2 AS (SELECT x.origen, y.destino, x.peso * 0.7 * y.peso * 0.7 AS peso FROM fu x JOIN fu y ON y.origen = x.destino AND y.destino <> x.origen WHERE x.peso * 0.7 * y.peso * 0.7 >= 0.05),
lat AS (SELECT origen, destino, max(peso) AS peso FROM p2 ANTI JOIN edges USING (origen, destino) GROUP BY 1, 2),
inf AS (SELECT origen, destino, peso FROM (SELECT *, row_number() OVER (PARTITION BY origen ORDER BY round(peso, 9) DESC, destino) AS r FROM lat) WHERE r <= 20)"""


@C.add("gr4_transitive_edges", "WITH " + _TRANSITIVE + " SELECT origen, destino, round(peso + 1e-9, 6) AS peso, 2 AS saltos FROM inf", "edges")
def _(v: Views) -> DataFrame:
    return G.inferred_edges(v.edges).select("origen", "destino", F.round(F.col("peso") + 1e-9, 6).alias("peso"), F.lit(2).alias("saltos"))


@C.add(
    "gr5_latent_neighbours",
    "WITH " + _TRANSITIVE + " SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY peso DESC, b) AS r FROM (SELECT a, b, max(peso) AS peso FROM (SELECT origen AS a, destino AS b, peso FROM inf UNION ALL SELECT destino, origen, peso FROM inf) GROUP BY 1, 2)) WHERE r <= 5",
    "edges",
)
def _(v: Views) -> DataFrame:
    return G.first_per(G.undirected(G.inferred_edges(v.edges)), ["a"], [F.desc("peso"), F.asc("b")], 5).select("a", "b")


@C.add(
    "gr4_maturity",
    "WITH " + _TRANSITIVE + """, pd AS (SELECT DISTINCT x.concepto AS a, y.concepto AS b FROM dims x JOIN dims y USING (dim) WHERE x.concepto <> y.concepto)
SELECT origen, destino, round(least(1.0, peso * 0.15 * 1.1) + 1e-9, 6) AS peso FROM inf JOIN pd ON pd.a = origen AND pd.b = destino""",
    "edges dims",
)
def _(v: Views) -> DataFrame:
    """Inferred edges whose ends share a dimension, at the weight of that evidence alone."""
    inferred = G.inferred_edges(v.edges).select("origen", "destino", "peso")
    x = inferred.join(v.dims.select(F.col("concepto").alias("origen"), "dim"), "origen").join(v.dims.select(F.col("concepto").alias("destino"), "dim"), ["destino", "dim"]).select("origen", "destino", "peso").distinct()
    return x.select("origen", "destino", F.round(F.least(F.lit(1.0), F.col("peso") * 0.15 * 1.1) + 1e-9, 6).alias("peso"))


@C.add("gr6_label_propagation")
def _(v: Views) -> DataFrame:
    return G.label_propagation(v.und)


@C.add("ag21_communities")
def _(v: Views) -> DataFrame:
    labels = G.label_propagation(v.und)
    return G.communities(v.und, labels, 5, 0.01).withColumn("densidad", F.round("densidad", 6))


@C.add("ag22_community_names")
def _(v: Views) -> DataFrame:
    """The three most common words of each group's contents make its name."""
    labels = G.label_propagation(v.und)
    words = labels.join(v.nodes.select("concepto", F.explode(T.cluster_tokens("contenido")).alias("w")), "concepto").groupBy("grupo", "w").agg(F.count(F.lit(1)).alias("n"))
    top = G.first_per(words, ["grupo"], [F.desc("n"), F.asc("w")], 3)
    return top.groupBy("grupo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rango", "w"))), lambda x: x["w"]), "_").alias("nombre"))


@C.add(
    "gr8_links_both_ways",
    "SELECT a AS origen, b AS destino, 0.5 AS peso FROM (SELECT x.concepto AS a, y.concepto AS b FROM dims x JOIN dims y USING (dim) WHERE x.concepto <> y.concepto) t ANTI JOIN und ON und.a = t.a AND und.b = t.b GROUP BY 1, 2",
    "edges und dims",
)
def _(v: Views) -> DataFrame:
    x, y = v.dims.withColumnRenamed("concepto", "a"), v.dims.withColumnRenamed("concepto", "b")
    new = x.join(y, "dim").where("a <> b").select("a", "b").distinct().join(v.und, ["a", "b"], "left_anti")
    return new.select(F.col("a").alias("origen"), F.col("b").alias("destino"), F.lit(0.5).alias("peso"))


@C.add(
    "gr9_neighbour_previews",
    "SELECT v.a, v.b, v.peso, CASE WHEN length(n.contenido) > 40 THEN left(n.contenido, 40) || '...' ELSE coalesce(n.contenido, '') END AS vista FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY peso DESC, b) AS r FROM und) v JOIN nodes n ON n.concepto = v.b WHERE r <= 5",
    "nodes edges und",
)
def _(v: Views) -> DataFrame:
    top = G.first_per(v.und, ["a"], [F.desc("peso"), F.asc("b")], 5)
    return top.join(v.nodes.select(F.col("concepto").alias("b"), T.preview("contenido", 40).alias("vista")), "b").select("a", "b", "peso", "vista")


@C.add(
    "gr10_directed_paths",
    """WITH s AS (SELECT origen, destino FROM (SELECT *, row_number() OVER (PARTITION BY origen ORDER BY peso DESC, destino) AS r FROM edges WHERE peso >= 0.1) WHERE r <= 3)
SELECT x.origen, y.destino, min(x.destino) AS medio FROM s x JOIN s y ON y.origen = x.destino AND y.destino <> x.origen ANTI JOIN s d ON d.origen = x.origen AND d.destino = y.destino GROUP BY 1, 2""",
    "edges",
)
def _(v: Views) -> DataFrame:
    s = G.first_per(v.edges.where("peso >= 0.1"), ["origen"], [F.desc("peso"), F.asc("destino")], 3).select("origen", "destino")
    two = s.withColumnRenamed("destino", "medio").join(s.select(F.col("origen").alias("medio"), "destino"), "medio").where("destino <> origen")
    return two.join(s, ["origen", "destino"], "left_anti").groupBy("origen", "destino").agg(F.min("medio").alias("medio"))


@C.add("gr13_confirm_latent", "WITH " + _TRANSITIVE + " SELECT origen, destino, round(peso + 1e-9, 6) AS peso, 'latente_confirmada' AS tipo FROM inf WHERE peso >= 0.4", "edges")
def _(v: Views) -> DataFrame:
    return G.inferred_edges(v.edges).where("peso >= 0.4").select("origen", "destino", F.round(F.col("peso") + 1e-9, 6).alias("peso"), F.lit("latente_confirmada").alias("tipo"))


@C.add(
    "gr14_quarantine",
    "SELECT origen, destino, peso, CASE WHEN peso < 0.05 THEN 'debil' ELSE 'sin_extremo' END AS motivo FROM edges WHERE peso < 0.05 OR destino NOT IN (SELECT concepto FROM nodes)",
    "nodes edges",
)
def _(v: Views) -> DataFrame:
    known = v.nodes.select(F.col("concepto").alias("destino"), F.lit(True).alias("hay"))
    rows = v.edges.join(known, "destino", "left").where("peso < 0.05 or hay is null")
    return rows.select("origen", "destino", "peso", F.when(F.col("peso") < 0.05, "debil").otherwise("sin_extremo").alias("motivo"))


@C.add("gr15_heaviest_edges", "SELECT a, b, peso FROM und WHERE a < b ORDER BY peso DESC, a, b LIMIT 300", "edges und")
def _(v: Views) -> DataFrame:
    return v.und.where("a < b").orderBy(F.desc("peso"), "a", "b").limit(300)


@C.add(
    "gr16_stale_edges",
    f"""WITH t AS (SELECT concepto, list_distinct({W('contenido', 4)}) AS w FROM nodes)
SELECT e.origen, e.destino, round(CASE WHEN len(list_distinct(list_concat(x.w, y.w))) > 0 THEN len(list_intersect(x.w, y.w)) / CAST(len(list_distinct(list_concat(x.w, y.w))) AS DOUBLE) ELSE 0 END, 6) AS similitud
FROM edges e JOIN t x ON x.concepto = e.origen JOIN t y ON y.concepto = e.destino WHERE tipo = 'co_ocurrencia'""",
    "nodes edges",
)
def _(v: Views) -> DataFrame:
    t = v.nodes.select("concepto", F.array_distinct(T.words("contenido", 4)).alias("w"))
    of = lambda c, n: t.select(F.col("concepto").alias(c), F.col("w").alias(n))
    rows = v.edges.where("tipo = 'co_ocurrencia'").join(of("origen", "x"), "origen").join(of("destino", "y"), "destino")
    return rows.select("origen", "destino", F.round(T.jaccard(F.col("x"), F.col("y")), 6).alias("similitud"))


@C.add(
    "gr17_adamic_adar",
    "WITH g AS (SELECT a AS x, count(*) AS n FROM und GROUP BY 1) SELECT p.a, p.b, round(sum(1 / ln(g.n)), 6) AS adamic_adar FROM und p JOIN und x ON x.a = p.a JOIN und y ON y.a = p.b AND y.b = x.b JOIN g ON g.x = x.b WHERE p.a < p.b GROUP BY 1, 2",
    "edges und",
)
def _(v: Views) -> DataFrame:
    return G.adamic_adar(v.und).select("a", "b", F.round("adamic_adar", 6).alias("adamic_adar"))


@C.add(
    "gr18_dirichlet_energy",
    "SELECT round(sum(u.peso * (x.peso - y.peso) * (x.peso - y.peso)), 6) AS energia, count(*) AS pares FROM und u JOIN nodes x ON x.concepto = u.a JOIN nodes y ON y.concepto = u.b WHERE u.a < u.b",
    "nodes edges und",
)
def _(v: Views) -> DataFrame:
    x, y = v.nodes.select(F.col("concepto").alias("a"), F.col("peso").alias("p")), v.nodes.select(F.col("concepto").alias("b"), F.col("peso").alias("q"))
    return v.und.where("a < b").join(x, "a").join(y, "b").agg(F.round(F.sum(F.col("peso") * (F.col("p") - F.col("q")) * (F.col("p") - F.col("q"))), 6).alias("energia"), F.count(F.lit(1)).alias("pares"))


@C.add(
    "gr11_frontier",
    "SELECT b AS concepto, max(peso) AS peso FROM und WHERE a IN (SELECT concepto FROM nodes WHERE categoria = 7) AND b NOT IN (SELECT concepto FROM nodes WHERE categoria = 7) AND peso >= 0.5 GROUP BY 1 ORDER BY peso DESC, concepto LIMIT 50",
    "nodes edges und",
)
def _(v: Views) -> DataFrame:
    done = v.nodes.where("categoria = 7").select("concepto")
    out = v.und.where("peso >= 0.5").join(done.withColumnRenamed("concepto", "a"), "a", "left_semi").join(done.withColumnRenamed("concepto", "b"), "b", "left_anti")
    return out.groupBy(F.col("b").alias("concepto")).agg(F.max("peso").alias("peso")).orderBy(F.desc("peso"), "concepto").limit(50)


@C.add(
    "ex8_structural_holes",
    "WITH g AS (SELECT a AS x, count(*) AS n FROM und GROUP BY 1) SELECT x.concepto AS a, y.concepto AS b, count(*) AS comunes FROM dims x JOIN dims y ON x.dim = y.dim AND x.concepto < y.concepto JOIN g ga ON ga.x = x.concepto JOIN g gb ON gb.x = y.concepto ANTI JOIN und ON und.a = x.concepto AND und.b = y.concepto WHERE ga.n <= 30 AND gb.n <= 30 GROUP BY 1, 2",
    "edges und dims",
)
def _(v: Views) -> DataFrame:
    low = G.neighbour_counts(v.und).where("n <= 30").select(F.col("a").alias("concepto"))
    few = v.dims.join(low, "concepto", "left_semi")
    x, y = few.withColumnRenamed("concepto", "a"), few.withColumnRenamed("concepto", "b")
    return x.join(y, "dim").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("comunes")).join(v.und, ["a", "b"], "left_anti")


@C.add("gr1_link_by_tokens")
def _(v: Views) -> DataFrame:
    """Pass 1: contents with a token Jaccard of 0.4 or more."""
    return link_by_tokens(v.active, 0.4).withColumn("peso", F.round("peso", 6))


@C.add(
    "gr1_link_by_name",
    r"""WITH t AS (SELECT concepto, list_distinct(list_filter(string_split(concepto, '_'), lambda x: length(x) >= 4)) AS w FROM nodes WHERE estado = 'activo'),
df AS (SELECT p, count(*) AS n FROM (SELECT unnest(w) AS p FROM t) GROUP BY 1), x AS (SELECT concepto, unnest(w) AS p FROM t)
SELECT a.concepto AS origen, b.concepto AS destino, round(count(*) / CAST(least(len(ta.w), len(tb.w)) AS DOUBLE), 6) AS peso FROM x a JOIN x b ON a.p = b.p AND a.concepto < b.concepto JOIN df ON df.p = a.p JOIN t ta ON ta.concepto = a.concepto JOIN t tb ON tb.concepto = b.concepto
GROUP BY 1, 2, ta.w, tb.w HAVING count(*) / CAST(least(len(ta.w), len(tb.w)) AS DOUBLE) >= 0.3""",
    "nodes",
)
def _(v: Views) -> DataFrame:
    return link_by_name(v.active, 0.3, 6)


@C.add("gr1_link_by_synonyms")
def _(v: Views) -> DataFrame:
    return link_by_synonyms(v.active).withColumn("peso", F.round("peso", 6))


@C.add(
    "merge_nodes",
    "SELECT o AS origen, d AS destino, max(peso) AS peso FROM (SELECT CASE WHEN origen LIKE '%\\_v_' ESCAPE '\\' THEN left(origen, length(origen) - 3) ELSE origen END AS o, CASE WHEN destino LIKE '%\\_v_' ESCAPE '\\' THEN left(destino, length(destino) - 3) ELSE destino END AS d, peso FROM edges) WHERE o <> d GROUP BY 1, 2",
    "edges",
)
def _(v: Views) -> DataFrame:
    names = v.edges.select(F.explode(F.array("origen", "destino")).alias("viejo")).distinct().where(F.col("viejo").rlike("_v.$"))
    return G.merge_nodes(v.edges, names.select("viejo", F.regexp_replace("viejo", "_v.$", "").alias("nuevo")))
