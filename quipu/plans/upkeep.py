"""Upkeep: model state, due rules, samples, guards, context windows, expansions over the index, and document-smoothed PPMI."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quipu.functions import text as T
from quipu.operators import calibration as K
from quipu.operators.cut import shared_folder
from quipu.operators.graph import first_per, neighbour_counts
from quipu.plans import vectors
from quipu.plans.relational import W
from quipu.plans.search import _IDX, asked, index
from quipu.plans.views import Catalogue, Views
from quipu.streaming import jobs as J

C = Catalogue()
QUERIES, SQL = C.queries, C.sql


@C.add("sk4_model_state", vectors.SQL["wn17_conformal_threshold"])
def _(v: Views) -> DataFrame:
    """The calibration as a table of one row: each save replaces the row that was there."""
    path = f"{shared_folder(v.spark)}/state-{uuid.uuid4().hex}"
    v.spark.createDataFrame([(0.5, 0)], "umbral double, n bigint").write.mode("overwrite").parquet(path)
    state = K.conformal_threshold(vectors.top_scores(v).where("not positivo").select("score"), 0.1)
    state.select(F.round("umbral", 6).alias("umbral"), "n").write.mode("overwrite").parquet(path)
    return v.spark.read.schema("umbral double, n bigint").parquet(path)


@C.add(
    "ca3_drift",
    """WITH m AS (SELECT max(creado_en) AS m FROM nodes), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE creado_en > m - INTERVAL 30 DAY) AS nuevos, count(*) FILTER (WHERE estado <> 'activo') AS fuera FROM nodes, m)
SELECT n, nuevos, round((nuevos + fuera) / CAST(n AS DOUBLE), 6) AS cambio, (nuevos + fuera) / CAST(n AS DOUBLE) > 0.2 AS recalibrar FROM n""",
    "nodes",
)
def _(v: Views) -> DataFrame:
    """Part of the nodes that came in the last 30 days or are not active; above a fifth the thresholds are due again."""
    last = v.nodes.agg(F.max("creado_en")).first()[0]
    new = F.col("creado_en") > F.lit(last) - F.expr("interval 30 days")
    n = v.nodes.agg(F.count(F.lit(1)).alias("n"), F.count_if(new).alias("nuevos"), F.count_if(F.col("estado") != "activo").alias("fuera"))
    part = T.ratio(F.col("nuevos") + F.col("fuera"), F.col("n"))
    return n.select("n", "nuevos", F.round(part, 6).alias("cambio"), (part > 0.2).alias("recalibrar"))


@C.add(
    "ve2g_reindex_due",
    """WITH m AS (SELECT max(creado_en) AS m FROM nodes), w AS (SELECT date_trunc('week', creado_en) AS semana, count(*) AS nuevos FROM nodes WHERE creado_en IS NOT NULL GROUP BY 1)
SELECT strftime(semana, '%Y-%m-%d') AS semana, nuevos, nuevos >= 50 AND semana + INTERVAL 7 DAY <= m AS debida FROM w, m""",
    "nodes",
)
def _(v: Views) -> DataFrame:
    """By week, whether a full reindex was due after it: seven days over and fifty new nodes or more."""
    last = v.nodes.agg(F.max("creado_en")).first()[0]
    week = F.date_trunc("week", F.col("creado_en").cast("timestamp_ntz"))
    w = v.nodes.where("creado_en is not null").groupBy(week.alias("s")).agg(F.count(F.lit(1)).alias("nuevos"))
    over = F.col("s").cast("timestamp_ntz") + F.expr("interval 7 days") <= F.lit(last)
    return w.select(F.date_format("s", "yyyy-MM-dd").alias("semana"), "nuevos", ((F.col("nuevos") >= 50) & over).alias("debida"))


@C.add(
    "lc15_metrics_sample",
    """SELECT (SELECT count(*) FROM nodes) AS nodos, (SELECT count(*) FROM edges) AS aristas, (SELECT count(DISTINCT dim) FROM dims) AS dimensiones, (SELECT count(*) FROM events) AS eventos,
(SELECT round(avg(n), 6) FROM (SELECT count(*) AS n FROM und GROUP BY a)) AS grado_medio, (SELECT round(median(peso), 6) FROM edges) AS peso_mediano""",
    "nodes edges und dims",
)
def _(v: Views) -> DataFrame:
    """One row of sizes, to be appended to a table of samples."""
    one = lambda rows, *what: rows.agg(*what).withColumn("_k", F.lit(1))
    parts = [
        one(v.nodes, F.count(F.lit(1)).alias("nodos")),
        one(v.edges, F.count(F.lit(1)).alias("aristas"), F.round(F.median("peso"), 6).alias("peso_mediano")),
        one(v.dims, F.count_distinct("dim").alias("dimensiones")),
        one(v.table("events"), F.count(F.lit(1)).alias("eventos")),
        one(neighbour_counts(v.und), F.round(F.avg("n"), 6).alias("grado_medio")),
    ]
    row = parts[0]
    for p in parts[1:]:
        row = row.join(p, "_k")  # one row each
    return row.drop("_k")


@C.add("str7_context_window", "SELECT user_id, string_agg(event_id, ',' ORDER BY ts, event_id) AS eventos, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10 GROUP BY 1")
def _(v: Views) -> DataFrame:
    """The last ten of every user, kept in the state of a stream."""
    return J.run_to_end(J.working_memory(J.read_log(v.spark, v.dir).select("user_id", "ts", "event_id"), 10), "update", ["user_id"], "n")


@C.add("str8_consolidation_guard", "SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 15000000, true) AS permitido FROM events")
def _(v: Views) -> DataFrame:
    """Whether 15 s have passed since the request before of the same session."""
    us = F.expr("unix_micros(cast(ts as timestamp))")
    gap = us - F.lag(us).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return v.log.select("event_id", F.coalesce(gap >= 15_000_000, F.lit(True)).alias("permitido"))


@C.add(
    "ex2_document_smoothed_ppmi",
    f"""WITH c AS (SELECT concepto AS doc, t AS term, count(*) AS n FROM (SELECT concepto, unnest({W('contenido', 3)}) AS t FROM nodes) GROUP BY 1, 2), tt AS (SELECT sum(n) AS s FROM c),
d AS (SELECT doc, pow(sum(n), 0.75) AS pd FROM c GROUP BY 1), ds AS (SELECT sum(pd) AS s FROM d), t AS (SELECT term, sum(n) / CAST((SELECT s FROM tt) AS DOUBLE) AS pt FROM c GROUP BY 1)
SELECT doc, term, round(ppmi, 4) AS ppmi FROM (SELECT doc, term, ln((n / CAST((SELECT s FROM tt) AS DOUBLE)) / (pt * (pd / (SELECT s FROM ds)))) AS ppmi FROM c JOIN d USING (doc) JOIN t USING (term)) WHERE ppmi > 0""",
    "nodes",
)
def _(v: Views) -> DataFrame:
    """Positive PMI of terms and documents, with the probabilities of the documents smoothed."""
    c = v.nodes.select(F.col("concepto").alias("doc"), F.explode(T.words("contenido", 3)).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("n"))
    total = float(c.agg(F.sum("n")).first()[0] or 1)
    docs = c.groupBy("doc").agg(F.pow(F.sum("n"), F.lit(0.75)).alias("pd"))
    norm = docs.agg(F.sum("pd")).first()[0] or 1.0
    terms = c.groupBy("term").agg((F.sum("n") / total).alias("pt"))
    value = F.log((F.col("n") / total) / (F.col("pt") * (F.col("pd") / norm)))
    return c.join(docs, "doc").join(terms, "term").select("doc", "term", value.alias("v")).where("v > 0").select("doc", "term", F.round("v", 4).alias("ppmi"))


@C.add(
    "ex11_graph_synonyms",
    vectors._BOTH.replace("WITH ", "WITH " + _IDX + ", ", 1) + """, pa AS (SELECT a, b, npmi FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY npmi DESC, b) AS r FROM bo) WHERE r <= 3),
ex AS (SELECT consulta, b AS term, max(npmi) AS w FROM q JOIN pa ON pa.a = q.term WHERE b NOT IN (SELECT term FROM q z WHERE z.consulta = q.consulta) GROUP BY 1, 2),
s AS (SELECT consulta, concepto, sum(w) AS s FROM ex JOIN idx USING (term) GROUP BY 1, 2)
SELECT consulta, concepto, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY consulta ORDER BY round(s, 6) DESC, concepto) AS r FROM s) WHERE r <= 10""",
    "nodes",
)
def _(v: Views) -> DataFrame:
    """Each query word's three strongest partners by NPMI, looked up in the index: the ten nodes of greatest summed weight."""
    near = vectors.partners(v, 3).select(F.col("a").alias("term"), "b", "npmi")
    extra = asked(v).join(near, "term").select("consulta", F.col("b").alias("term"), "npmi").join(asked(v), ["consulta", "term"], "left_anti").groupBy("consulta", "term").agg(F.max("npmi").alias("w"))
    found = index(v)[0].select("concepto", "term").join(extra, "term").groupBy("consulta", "concepto").agg(F.round(F.sum("w"), 6).alias("score"))
    return first_per(found, ["consulta"], [F.desc("score"), F.asc("concepto")], 10).select("consulta", "concepto", "score")


@C.add(
    "se6g_paraphrases",
    vectors._BOTH.replace("WITH ", "WITH " + _IDX + ", ", 1) + """, nq AS (SELECT consulta, count(*) AS nw FROM q GROUP BY 1), full_ AS (SELECT DISTINCT h.consulta FROM hits h JOIN nq USING (consulta) WHERE terminos = nw),
pa AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY npmi DESC, b) AS r FROM bo) WHERE r <= 5), t AS (SELECT consulta, term FROM q UNION SELECT consulta, b FROM q JOIN pa ON pa.a = q.term),
s AS (SELECT consulta, concepto, count(*) AS terminos FROM t JOIN idx USING (term) WHERE consulta NOT IN (SELECT consulta FROM full_) GROUP BY 1, 2)
SELECT consulta, concepto, terminos FROM (SELECT *, row_number() OVER (PARTITION BY consulta ORDER BY terminos DESC, concepto) AS r FROM s) WHERE r <= 10""",
    "nodes",
)
def _(v: Views) -> DataFrame:
    """Where no node holds all words of a query: any of its words or of their five strongest partners, by how many are met."""
    from quipu.plans import recall

    probe = recall.C.of["se6a_expansion_probe"](v).where("ampliar").select("consulta")
    open_ = asked(v).join(probe, "consulta", "left_semi")
    near = vectors.partners(v, 5).select(F.col("a").alias("term"), "b")
    terms = open_.unionByName(open_.join(near, "term").select("consulta", F.col("b").alias("term"))).distinct()
    n = index(v)[0].select("concepto", "term").join(terms, "term").groupBy("consulta", "concepto").agg(F.count(F.lit(1)).alias("terminos"))
    return first_per(n, ["consulta"], [F.desc("terminos"), F.asc("concepto")], 10).select("consulta", "concepto", "terminos")


@C.add(
    "lc9_clear_short_term",
    """WITH m AS (SELECT max(ts) AS m FROM events), r AS (SELECT user_id, event_type, count(*) AS n, max(ts) AS u FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n FROM r, m WHERE u >= m - INTERVAL 1 DAY AND n >= 2""",
)
def _(v: Views) -> DataFrame:
    """What stays of the short-term log after a cycle: repeated entries of the last day; all else is cleared."""
    last = v.log.agg(F.max("ts")).first()[0]
    r = v.log.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("u"))
    return r.where((F.col("u") >= F.lit(last) - F.expr("interval 1 day")) & (F.col("n") >= 2)).select("user_id", "event_type", "n")


@C.add(
    "lc13_autosave",
    f"""WITH d AS (SELECT doc_id, source, text FROM documents WHERE length(text) >= 80), k AS (SELECT DISTINCT doc_id, t FROM (SELECT doc_id, unnest({W('text', 4)}) AS t FROM d)),
x AS (SELECT DISTINCT unnest({W("replace(concepto, '_', ' ')", 4)}) AS t FROM nodes) SELECT k.doc_id, count(*) AS palabras FROM k JOIN x USING (t) GROUP BY 1 HAVING count(*) >= 2""",
    "nodes",
)
def _(v: Views) -> DataFrame:
    """Texts of 80 characters or more that name two or more words of known concepts: those worth keeping."""
    d = v.table("documents").where(F.length("text") >= 80).select("doc_id", F.explode(F.array_distinct(T.words("text", 4))).alias("t"))
    x = v.nodes.select(F.explode(T.words(F.translate("concepto", "_", " "), 4)).alias("t")).distinct()
    return d.join(x, "t").groupBy("doc_id").agg(F.count(F.lit(1)).alias("palabras")).where("palabras >= 2")
