"""Further layers, joins, messages, sinks and maintenance steps."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quipu.functions import score as S
from quipu.functions import text as T
from quipu.operators import graph as G
from quipu.operators.cut import cut, shared_folder
from quipu.operators.graph import first_per
from quipu.operators.overlap import most_alike_before, most_shared
from quipu.operators.skew import heavy_keys, join_checked, join_with_heavy
from quipu.operators.search import greatest_cosine
from quipu.plans.relational import W, now
from quipu.plans.search import _IDX, _TOP, asked, hits, index, top
from quipu.plans.vectors import _QV, _VEC, query_vectors, usable
from quipu.plans.views import Catalogue, Views

C = Catalogue()
QUERIES, SQL = C.queries, C.sql


# ---- sources and sinks


def _place(v: Views) -> str:
    return f"{shared_folder(v.spark)}/sink-{uuid.uuid4().hex}"


@C.add("sk10_json_export", "SELECT categoria, count(*) AS n, round(sum(peso), 6) AS peso FROM nodes WHERE categoria IS NOT NULL GROUP BY 1", "nodes")
def _(v: Views) -> DataFrame:
    """Nodes as JSON lines, a folder per category, read back."""
    path = _place(v)
    v.nodes.where("categoria is not null").select("concepto", "contenido", "peso", "estado", "categoria").write.partitionBy("categoria").json(path)
    back = v.spark.read.schema("concepto string, contenido string, peso double, estado string, categoria int").json(path)
    return back.groupBy("categoria").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("peso"), 6).alias("peso"))


@C.add("sc10_jsonl_cases", "SELECT item_id, categoria, consulta FROM casos_qa")
def _(v: Views) -> DataFrame:
    path = _place(v)
    v.table("casos_qa").write.json(path)
    return v.spark.read.schema("item_id bigint, categoria string, consulta string").json(path)


@C.add("sk12_snapshot", "SELECT origen, destino, peso FROM edges", "edges")
def _(v: Views) -> DataFrame:
    path = _place(v)
    v.edges.select("origen", "destino", "peso").write.parquet(f"{path}/version=1")
    return v.spark.read.parquet(path).select("origen", "destino", "peso")


@C.add(
    "sk1_upsert_nodes",
    """WITH s AS (SELECT lower(trim(concepto, ' ')) AS concepto, string_agg(DISTINCT contenido, ' | ' ORDER BY contenido) AS contenido, count(DISTINCT contenido) AS versiones FROM largo_plazo WHERE trim(concepto, ' ') <> '' AND trim(contenido) <> '' GROUP BY 1)
SELECT concepto, versiones, contenido FROM s WHERE versiones > 1""",
)
def _(v: Views) -> DataFrame:
    """Contents of every version of a concept joined; a concept has a few versions."""
    rows = v.table("largo_plazo").select(F.lower(F.trim("concepto")).alias("concepto"), "contenido").where("concepto <> '' and trim(contenido) <> ''").distinct()
    merged = rows.groupBy("concepto").agg(F.array_sort(F.collect_list("contenido")).alias("c"))
    return merged.where("size(c) > 1").select("concepto", F.size("c").cast("bigint").alias("versiones"), F.array_join("c", " | ").alias("contenido"))


@C.add("sk9_search_telemetry", "WITH " + _TOP + " SELECT consulta, count(*) AS resultados, max(bm25) AS mejor, string_agg(concepto, ',' ORDER BY rango) FILTER (WHERE rango <= 5) AS conceptos FROM top GROUP BY 1", "nodes")
def _(v: Views) -> DataFrame:
    five = F.array_sort(F.collect_list(F.when(F.col("rango") <= 5, F.struct("rango", "concepto"))))
    return top(v).groupBy("consulta").agg(F.count(F.lit(1)).alias("resultados"), F.max("bm25").alias("mejor"), F.array_join(F.transform(five, lambda x: x["concepto"]), ",").alias("conceptos"))


@C.add("sc3_substring_match", "SELECT concepto, (length(c) - length(replace(c, 'umbr', ''))) // 4 AS veces FROM (SELECT concepto, lower(contenido) AS c FROM nodes) WHERE contains(c, 'umbr')", "nodes")
def _(v: Views) -> DataFrame:
    c = F.lower("contenido")
    return v.nodes.where(F.contains(c, F.lit("umbr"))).select("concepto", F.floor((F.length(c) - F.length(F.replace(c, F.lit("umbr"), F.lit("")))) / 4).alias("veces"))


# ---- filters


@C.add("pr12_all_terms", "WITH " + _IDX + ", n AS (SELECT consulta, count(*) AS n FROM q JOIN dfs USING (term) GROUP BY 1) SELECT consulta, concepto FROM hits JOIN n USING (consulta) WHERE terminos = n.n", "nodes")
def _(v: Views) -> DataFrame:
    known = index(v)[0].join(F.broadcast(asked(v).select("term").distinct()), "term", "left_semi").select("term").distinct()
    n = asked(v).join(known, "term").groupBy("consulta").agg(F.count(F.lit(1)).alias("n"))
    return hits(v).join(n, "consulta").where("terminos = n").select("consulta", "concepto")


@C.add("pr14_prefix_postfilter", "WITH " + _TOP + " SELECT DISTINCT t.consulta, t.concepto FROM top t JOIN q USING (consulta) WHERE starts_with(t.concepto, q.term)", "nodes")
def _(v: Views) -> DataFrame:
    return top(v).join(asked(v), "consulta").where(F.col("concepto").startswith(F.col("term"))).select("consulta", "concepto").distinct()


@C.add("pr15_author_filter", "SELECT doc_id, source FROM documents WHERE contains(lower(source), 'agente') OR contains(lower(text), 'agente:')")
def _(v: Views) -> DataFrame:
    hit = F.contains(F.lower("source"), F.lit("agente")) | F.contains(F.lower("text"), F.lit("agente:"))
    return v.table("documents").where(hit).select("doc_id", "source")


@C.add("pr16_date_range", "SELECT doc_id FROM documents WHERE creado_en >= TIMESTAMP '2025-02-01' AND creado_en < TIMESTAMP '2025-06-30' + INTERVAL 1 DAY")
def _(v: Views) -> DataFrame:
    return v.table("documents").where("creado_en >= timestamp_ntz'2025-02-01' and creado_en < timestamp_ntz'2025-06-30' + interval 1 day").select("doc_id")


@C.add("pr20_unread", "SELECT categoria_id, accion, count(DISTINCT id) AS pendientes FROM sync_log WHERE sincronizado = 0 GROUP BY 1, 2")
def _(v: Views) -> DataFrame:
    return v.table("sync_log").where("sincronizado = 0").select("categoria_id", "accion", "id").distinct().groupBy("categoria_id", "accion").agg(F.count("id").alias("pendientes"))


@C.add("pr24_sanitised_queries", rf"SELECT item_id, array_to_string(list_transform({W('left(consulta, 500)', 1)}[1:64], lambda x: left(x, 64)), ' ') AS limpia FROM casos_qa")
def _(v: Views) -> DataFrame:
    ws = F.slice(T.words(F.substring("consulta", 1, 500), 1), 1, 64)
    return v.table("casos_qa").select("item_id", F.array_join(F.transform(ws, lambda x: F.substring(x, 1, 64)), " ").alias("limpia"))


@C.add("pr26_update_window", "SELECT concepto, ultimo_acceso <= creado_en + INTERVAL 45 DAY AS permitido FROM nodes WHERE creado_en IS NOT NULL AND ultimo_acceso IS NOT NULL", "nodes")
def _(v: Views) -> DataFrame:
    return v.nodes.where("creado_en is not null and ultimo_acceso is not null").select("concepto", (F.col("ultimo_acceso") <= F.col("creado_en") + F.expr("interval 45 days")).alias("permitido"))


# ---- joins


@C.add("jn10_orphan_cleanup", "SELECT d.concepto, d.dim FROM dims d WHERE d.concepto IN (SELECT concepto FROM nodes)", "nodes dims")
def _(v: Views) -> DataFrame:
    return v.dims.join(v.nodes.select("concepto"), "concepto", "left_semi").select("concepto", "dim")


@C.add(
    "jn13_three_hop_paths",
    """WITH st AS (SELECT origen, destino, peso FROM (SELECT *, row_number() OVER (PARTITION BY origen ORDER BY peso DESC, destino) AS r FROM edges WHERE peso >= 0.25) WHERE r <= 5),
p2 AS (SELECT x.origen, x.destino AS m, y.destino, x.peso * 0.7 * y.peso * 0.7 AS peso FROM st x JOIN st y ON y.origen = x.destino AND y.destino <> x.origen WHERE x.peso * 0.7 * y.peso * 0.7 >= 0.05),
p3 AS (SELECT p2.origen, z.destino, p2.peso * z.peso * 0.7 AS peso FROM p2 JOIN st z ON z.origen = p2.destino AND z.destino <> p2.origen AND z.destino <> p2.m WHERE p2.peso * z.peso * 0.7 >= 0.05),
u AS (SELECT origen, destino, max(peso) AS peso, min(s) AS saltos FROM (SELECT origen, destino, peso, 2 AS s FROM p2 UNION ALL SELECT origen, destino, peso, 3 FROM p3) GROUP BY 1, 2),
n AS (SELECT * FROM u ANTI JOIN edges USING (origen, destino))
SELECT origen, destino, saltos FROM (SELECT *, row_number() OVER (PARTITION BY origen ORDER BY round(peso, 9) DESC, destino) AS r FROM n) WHERE r <= 20""",
    "edges",
)
def _(v: Views) -> DataFrame:
    return G.transitive_edges(v.edges, hops=3, fan=5).select("origen", "destino", "saltos")


@C.add("jn15_common_dimensions", "SELECT u.a, u.b, count(*) AS comunes FROM und u JOIN dims x ON x.concepto = u.a JOIN dims y ON y.concepto = u.b AND y.dim = x.dim WHERE u.a < u.b GROUP BY 1, 2", "edges und dims")
def _(v: Views) -> DataFrame:
    x, y = v.dims.select(F.col("concepto").alias("a"), "dim"), v.dims.select(F.col("concepto").alias("b"), "dim")
    return v.und.where("a < b").join(x, "a").join(y, ["b", "dim"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("comunes"))


@C.add(
    "jn17_message_nodes",
    rf"""WITH w AS (SELECT concepto, unnest(list_distinct(list_filter(string_split(concepto, '_'), lambda x: length(x) >= 4))) AS t FROM nodes), df AS (SELECT DISTINCT t FROM w),
m AS (SELECT DISTINCT doc_id, unnest({W('text', 4)}) AS t FROM documents), j AS (SELECT doc_id, concepto, count(*) AS n FROM m JOIN w USING (t) JOIN df USING (t) GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT doc_id, concepto, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, concepto) AS r FROM j) WHERE r <= 10""",
    "nodes",
)
def _(v: Views) -> DataFrame:
    w = v.nodes.select("concepto", F.explode(F.array_distinct(F.filter(F.split("concepto", "_"), lambda x: F.length(x) >= 4))).alias("t"))
    # only words of names leave the documents
    m = v.table("documents").select("doc_id", F.explode(F.array_distinct(T.words("text", 4))).alias("t"))
    return most_shared(m, w, "doc_id", "concepto", 10)


@C.add("jn24_latest_match", "SELECT e.event_id, max(s.event_id) AS previa FROM events e JOIN events s ON s.user_id = e.user_id AND s.event_type = e.event_type AND s.ts = (SELECT max(ts) FROM events z WHERE z.user_id = e.user_id AND z.event_type = e.event_type AND z.ts < e.ts) GROUP BY 1")
def _(v: Views) -> DataFrame:
    per = v.log.groupBy("user_id", "event_type", "ts").agg(F.max("event_id").alias("m"), F.collect_list("event_id").alias("ids"))
    before = F.lag("m").over(Window.partitionBy("user_id", "event_type").orderBy("ts"))
    return per.withColumn("previa", before).where("previa is not null").select(F.explode("ids").alias("event_id"), "previa")


@C.add("jn27_resonant_partners", "SELECT semilla, concepto FROM (SELECT x.concepto AS semilla, y.concepto, row_number() OVER (PARTITION BY x.concepto ORDER BY count(*) DESC, y.concepto) AS r FROM dims x JOIN dims y USING (dim) WHERE x.concepto <> y.concepto GROUP BY 1, 2) WHERE r <= 30", "dims")
def _(v: Views) -> DataFrame:
    """The 30 nodes that share most tags with a node. Nodes of the same tags are one class, and classes meet, so the members of a large
    hub are not paired: of a class its first 31 names are enough for anyone."""
    k = 30
    member = cut(v.dims.groupBy("concepto").agg(F.array_join(F.array_sort(F.collect_set("dim")), "|").alias("clase")))
    of_class = member.groupBy("clase").agg(F.min("concepto").alias("uno"))
    tags = of_class.join(v.dims.withColumnRenamed("concepto", "uno"), "uno").select("clase", "dim")
    shared = tags.join(tags.withColumnRenamed("clase", "otra"), "dim").groupBy("clase", "otra").agg(F.count(F.lit(1)).alias("n"))
    names = first_per(member, ["clase"], [F.asc("concepto")], k + 1).select(F.col("clase").alias("otra"), "concepto")
    best = first_per(shared.join(names, "otra"), ["clase"], [F.desc("n"), F.asc("concepto")], k + 1)
    offers = best.groupBy("clase").agg(F.array_sort(F.collect_list(F.struct("rango", "concepto"))).alias("o"))
    mine = F.slice(F.filter("o", lambda x: x["concepto"] != F.col("semilla")), 1, k)
    given = join_with_heavy(member.withColumnRenamed("concepto", "semilla"), cut(offers), "clase", heavy_keys(member, "clase", member.count()))
    return given.select("semilla", F.explode(mine).alias("x")).select("semilla", "x.concepto")


@C.add("jn28_nearest_join", "SELECT a.event_id, min(abs(epoch_us(b.ts) - epoch_us(a.ts))) AS distancia FROM events a JOIN events b ON b.user_id = a.user_id AND b.event_type = 'purchase' WHERE a.event_type = 'view' GROUP BY 1")
def _(v: Views) -> DataFrame:
    us = F.expr("unix_micros(cast(ts as timestamp))")
    rows = v.log.where("event_type in ('view', 'purchase')").select("user_id", us.alias("t"), F.when(F.col("event_type") == "view", F.col("event_id")).alias("event_id"), F.when(F.col("event_type") == "purchase", us).alias("c"))
    # one pass each way: the last cycle before and the first one after
    w = Window.partitionBy("user_id").orderBy("t")
    last = F.last("c", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    nxt = F.first("c", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    near = rows.withColumn("p", last).withColumn("n", nxt).where("event_id is not null and (p is not null or n is not null)")
    return near.select("event_id", F.least(F.col("t") - F.col("p"), F.col("n") - F.col("t")).alias("distancia"))


# ---- layers of the cascade


@C.add(
    "se6e_near",
    rf"""WITH p AS (SELECT concepto, unnest({W('contenido', 3)}) AS t, generate_subscripts({W('contenido', 3)}, 1) AS i FROM nodes), df AS (SELECT DISTINCT t FROM p),
q AS (SELECT item_id, unnest({W('consulta', 3)}) AS t, generate_subscripts({W('consulta', 3)}, 1) AS i FROM casos_qa), d AS (SELECT DISTINCT x.item_id, x.t AS a, y.t AS b FROM q x JOIN q y ON y.item_id = x.item_id AND y.i = x.i + 1 WHERE x.t <> y.t)
SELECT DISTINCT item_id AS consulta, x.concepto FROM d JOIN df ON df.t = a JOIN df e ON e.t = b JOIN p x ON x.t = a JOIN p y ON y.t = b AND y.concepto = x.concepto AND abs(x.i - y.i) <= 15""",
    "nodes",
)
def _(v: Views) -> DataFrame:
    """Two words that follow each other in the query, at most 15 words apart in the content."""
    d = v.table("casos_qa").select(F.col("item_id").alias("consulta"), T.words("consulta", 3).alias("w")).where("size(w) > 1")
    d = d.select("consulta", F.inline(F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("a"), F.expr("slice(w, 2, size(w) - 1)").alias("b")))).where("a <> b").distinct()
    asked_ = d.select(F.explode(F.array("a", "b")).alias("t")).distinct()  # only words that a query asks for leave the contents
    places = v.nodes.select("concepto", F.posexplode(T.words("contenido", 3)).alias("i", "t"))
    p = join_checked(places, asked_, "t", "left_semi").groupBy("t", "concepto").agg(F.collect_list("i").alias("i"))
    # pairs of words meet the contents where these lie, then the queries that ask for them
    ab = F.broadcast(d.select("a", "b").distinct())
    both = p.select(F.col("t").alias("a"), "concepto", F.col("i").alias("x")).join(ab, "a").join(p.select(F.col("t").alias("b"), "concepto", F.col("i").alias("y")), ["b", "concepto"])
    close = F.exists("x", lambda m: F.exists("y", lambda n: F.abs(m - n) <= 15))
    return both.where(close).select("a", "b", "concepto").join(F.broadcast(d), ["a", "b"]).select("consulta", "concepto").distinct()


@C.add("se6h_prefix_layer", "WITH " + _IDX + ", p AS (SELECT DISTINCT consulta, left(term, 5) AS s FROM q WHERE length(term) >= 5), x AS (SELECT left(term, 5) AS s, concepto, term FROM idx WHERE length(term) >= 5), k AS (SELECT DISTINCT s FROM x) SELECT consulta, concepto, count(DISTINCT s) AS prefijos FROM p JOIN k USING (s) JOIN x USING (s) GROUP BY 1, 2", "nodes")
def _(v: Views) -> DataFrame:
    return prefix_hits(v, asked(v))


def prefix_hits(v: Views, asked_: DataFrame) -> DataFrame:
    """consulta, concepto, prefijos: first five characters of words that a query and a node share."""
    postings, _ = index(v)
    s = F.substring("term", 1, 5)
    p = asked_.where(F.length("term") >= 5).select("consulta", s.alias("s")).distinct()
    x = postings.where(F.length("term") >= 5).select(s.alias("s"), "concepto").distinct()
    return x.join(p, "s").groupBy("consulta", "concepto").agg(F.count(F.lit(1)).alias("prefijos"))


@C.add("se6l_recent_hits", "WITH " + _TOP + ", n AS (SELECT max(ultimo_acceso) AS m FROM nodes) SELECT consulta, concepto FROM (SELECT t.consulta, t.concepto, row_number() OVER (PARTITION BY consulta ORDER BY bm25 DESC, concepto) AS r FROM top t JOIN act USING (concepto), n WHERE act.ultimo_acceso >= n.m - INTERVAL 30 DAY) WHERE r <= 5", "nodes")
def _(v: Views) -> DataFrame:
    fresh = v.active.where(F.col("ultimo_acceso") >= F.lit(now(v)) - F.expr("interval 30 days")).select("concepto")
    return first_per(top(v).drop("rango").join(fresh, "concepto", "left_semi"), ["consulta"], [F.desc("bm25"), F.asc("concepto")], 5).select("consulta", "concepto")


@C.add(
    "se6m_chain_evocation",
    "WITH " + _TOP + """, hv AS (SELECT a, b, peso FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY peso DESC, b) AS r FROM und) WHERE r <= 10),
h0 AS (SELECT CAST(consulta AS VARCHAR) AS semilla, concepto, bm25 / (bm25 + 3) AS s FROM top WHERE rango <= 5),
h1 AS (SELECT semilla, b AS concepto, max(s * hv.peso * 0.5) AS s FROM h0 JOIN hv ON a = concepto WHERE s * hv.peso * 0.5 > 0.05 GROUP BY 1, 2), e1 AS (SELECT h1.* FROM h1 ANTI JOIN h0 USING (semilla, concepto)),
v1 AS (SELECT semilla, concepto FROM h0 UNION SELECT semilla, concepto FROM e1),
e2 AS (SELECT e1.semilla, b AS concepto, max(s * hv.peso * 0.25) AS s FROM e1 JOIN hv ON a = e1.concepto ANTI JOIN v1 ON v1.semilla = e1.semilla AND v1.concepto = hv.b WHERE s * hv.peso * 0.25 > 0.05 GROUP BY 1, 2)
SELECT semilla AS consulta, concepto, round(s, 6) AS activacion FROM (SELECT *, row_number() OVER (PARTITION BY semilla ORDER BY s DESC, concepto) AS r FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2)) WHERE r <= 5""",
    "nodes edges und",
)
def _(v: Views) -> DataFrame:
    """Spreading from the five best hits of each query; the five strongest concepts reached."""
    return evocation(v, top(v, 5))


def evocation(v: Views, best: DataFrame) -> DataFrame:
    seeds = cut(best.select(F.col("consulta").cast("string").alias("semilla"), "concepto", S.bm25_unit(F.col("bm25")).alias("activacion")))
    reached = G.spread_activation(v.und, seeds, hops=2).where("salto > 0")
    return first_per(reached, ["semilla"], [F.desc("activacion"), F.asc("concepto")], 5).select(F.col("semilla").alias("consulta"), "concepto", F.round("activacion", 6).alias("activacion"))


@C.add("se6p_relevance_feedback", "WITH " + _TOP + ", k AS (SELECT consulta FROM top GROUP BY 1 HAVING count(*) >= 3) SELECT DISTINCT t.consulta, d.dim FROM top t JOIN k USING (consulta) JOIN dims d ON d.concepto = t.concepto WHERE rango <= 5", "nodes dims")
def _(v: Views) -> DataFrame:
    t = top(v).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("consulta"))).where("n >= 3 and rango <= 5")
    return t.join(v.dims, "concepto").select("consulta", "dim").distinct()


@C.add("sf1i_dimension_cosine", "WITH " + _TOP + ", qd AS (SELECT DISTINCT t.consulta, d.dim FROM top t JOIN dims d ON d.concepto = t.concepto WHERE rango <= 5), n AS (SELECT consulta, count(*) AS n FROM qd GROUP BY 1) SELECT qd.consulta, d.concepto, round(sqrt(count(*)) / sqrt(n.n), 6) AS coseno FROM qd JOIN dims d USING (dim) JOIN n USING (consulta) GROUP BY 1, 2, n.n", "nodes dims")
def _(v: Views) -> DataFrame:
    qd = top(v, 5).join(v.dims, "concepto").select("consulta", "dim").distinct()
    n = qd.groupBy("consulta").agg(F.count(F.lit(1)).alias("n"))
    return qd.join(v.dims, "dim").groupBy("consulta", "concepto").agg(F.count(F.lit(1)).alias("k")).join(n, "consulta").select("consulta", "concepto", F.round(F.sqrt("k") / F.sqrt("n"), 6).alias("coseno"))


@C.add("sf1c_exact_match", r"SELECT k.item_id, n.concepto FROM casos_qa k JOIN nodes n ON n.concepto = lower(trim(k.concepto_esperado, ' ')) WHERE NOT k.deep", "nodes")
def _(v: Views) -> DataFrame:
    return v.table("casos_qa").where("not deep").select("item_id", F.lower(F.trim("concepto_esperado")).alias("concepto")).join(v.nodes.select("concepto"), "concepto", "left_semi").select("item_id", "concepto")


EPISTEME = "WITH " + _IDX + ", " + _VEC + ", " + _QV + """, nq AS (SELECT consulta, count(*) AS n FROM q GROUP BY 1),
ep AS (SELECT h.consulta, 0.7 * greatest(0.0, max(coalesce(list_cosine_similarity(qv.v, CAST(vec.v AS DOUBLE[])), 0.0))) + 0.3 * max(terminos / CAST(n AS DOUBLE)) AS ce FROM hits h JOIN nq ON nq.consulta = h.consulta LEFT JOIN qv ON qv.consulta = h.consulta LEFT JOIN vec ON k = concepto GROUP BY 1)"""


@C.add("se13_epistemic_evaluation", EPISTEME + " SELECT consulta, round(ce, 6) AS episteme, ce >= 0.55 AS sabe FROM ep", "nodes")
def _(v: Views) -> DataFrame:
    """0.7 * the best cosine of a candidate + 0.3 * the best token coverage; known from 0.55 on."""
    n = asked(v).groupBy("consulta").agg(F.count(F.lit(1)).alias("n"))
    met = hits(v)
    # the queries of a node stay in one row with its vector, those of the batch are known to every task
    by_node = met.groupBy("concepto").agg(F.collect_list("consulta").alias("quien")).join(usable(v.table("nodos"), "concepto").withColumnRenamed("k", "concepto"), "concepto")
    c = greatest_cosine(by_node.select("quien", "vector"), query_vectors(v))
    k = met.groupBy("consulta").agg(F.max("terminos").alias("k")).join(n, "consulta").select("consulta", (F.col("k") / F.col("n")).alias("k"))
    best = k.join(c, "consulta", "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
    ce = 0.7 * F.greatest(F.lit(0.0), "c") + 0.3 * F.col("k")
    return best.select("consulta", F.round(ce, 6).alias("episteme"), (ce >= 0.55).alias("sabe"))


@C.add("se11_thematic_search", "WITH i AS (SELECT dim, count(*) AS n FROM dims GROUP BY 1) SELECT x.concepto AS semilla, y.concepto, round(sum(1.0 / i.n), 6) AS tema FROM dims x JOIN dims y USING (dim) JOIN i USING (dim) WHERE x.concepto <> y.concepto GROUP BY 1, 2 HAVING sum(1.0 / i.n) >= 0.1", "dims")
def _(v: Views) -> DataFrame:
    i = v.dims.groupBy("dim").agg((1.0 / F.count(F.lit(1))).alias("w"))
    s = v.dims.withColumnRenamed("concepto", "semilla").join(i, "dim").join(v.dims, "dim").where("semilla <> concepto").groupBy("semilla", "concepto").agg(F.sum("w").alias("t"))
    return s.where("t >= 0.1").select("semilla", "concepto", F.round("t", 6).alias("tema"))


@C.add("se17_quarantine_search", "SELECT concepto, estado FROM nodes WHERE estado NOT IN ('activo', 'dormido') AND (contains(lower(contenido), 'cada') OR contains(lower(contenido), 'each'))", "nodes")
def _(v: Views) -> DataFrame:
    c = F.lower("contenido")
    return v.nodes.where(~F.col("estado").isin("activo", "dormido") & (F.contains(c, F.lit("cada")) | F.contains(c, F.lit("each")))).select("concepto", "estado")


_NAMES = rf"w AS (SELECT concepto, unnest(list_distinct(list_filter(string_split(concepto, '_'), lambda x: length(x) >= 4))) AS t FROM nodes), df AS (SELECT DISTINCT t FROM w)"


@C.add("se18_familiarity", f"WITH {_NAMES} SELECT DISTINCT item_id, concepto FROM (SELECT item_id, unnest({W('consulta', 4)}) AS t FROM casos_qa) q JOIN df USING (t) JOIN w USING (t)", "nodes")
def _(v: Views) -> DataFrame:
    w = v.nodes.select("concepto", F.explode(F.array_distinct(F.filter(F.split("concepto", "_"), lambda x: F.length(x) >= 4))).alias("t"))
    q = v.table("casos_qa").select("item_id", F.explode(T.words("consulta", 4)).alias("t")).distinct()
    return w.join(F.broadcast(q), "t").select("item_id", "concepto").distinct()


@C.add(
    "se19_related_older",
    rf"""WITH t AS (SELECT concepto, creado_en, unnest(list_distinct({W('contenido', 4)})) AS t FROM nodes), n AS (SELECT concepto, count(*) AS n FROM t GROUP BY 1), df AS (SELECT t FROM t GROUP BY 1 HAVING count(*) >= 2),
j AS (SELECT x.concepto, y.concepto AS viejo, count(*) AS c FROM t x JOIN df USING (t) JOIN t y USING (t) WHERE y.creado_en < x.creado_en GROUP BY 1, 2), s AS (SELECT j.*, c / CAST(a.n + b.n - c AS DOUBLE) AS s FROM j JOIN n a USING (concepto) JOIN n b ON b.concepto = viejo)
SELECT concepto, viejo, round(s, 6) AS similitud FROM (SELECT *, row_number() OVER (PARTITION BY concepto ORDER BY s DESC, viejo) AS r FROM s WHERE s >= 0.05) WHERE r <= 3""",
    "nodes",
)
def _(v: Views) -> DataFrame:
    """Older nodes by the Jaccard of the words of their contents."""
    t = v.nodes.where("creado_en is not null").select(F.col("concepto").alias("k"), F.expr("unix_micros(cast(creado_en as timestamp))").alias("at"), F.array_distinct(T.words("contenido", 4)).alias("c"))
    return most_alike_before(t.where("size(c) > 0"), 0.05, 3).select(F.col("x").alias("concepto"), F.col("y").alias("viejo"), F.round("s", 6).alias("similitud"))


# ---- aggregates, windows, lifecycle


@C.add("ag17_token_centrality", f"WITH {_NAMES}, e AS (SELECT t, sum(peso) AS s FROM und JOIN w ON w.concepto = und.a GROUP BY 1), q AS (SELECT DISTINCT item_id, unnest({W('consulta', 4)}) AS t FROM casos_qa), c AS (SELECT item_id, t, greatest(0.1, coalesce(s, 0)) AS s FROM q LEFT JOIN e USING (t)) SELECT item_id, t, round(s / sum(s) OVER (PARTITION BY item_id), 6) AS peso FROM c", "nodes edges und")
def _(v: Views) -> DataFrame:
    w = v.nodes.select(F.col("concepto").alias("a"), F.explode(F.array_distinct(F.filter(F.split("concepto", "_"), lambda x: F.length(x) >= 4))).alias("t"))
    e = v.und.join(w, "a").groupBy("t").agg(F.sum("peso").alias("s"))
    q = v.table("casos_qa").select("item_id", F.explode(T.words("consulta", 4)).alias("t")).distinct()
    c = q.join(e, "t", "left").withColumn("s", F.greatest(F.lit(0.1), F.coalesce("s", F.lit(0.0))))
    return c.select("item_id", "t", F.round(F.col("s") / F.sum("s").over(Window.partitionBy("item_id")), 6).alias("peso"))


@C.add("ag28_answer_ratio", "SELECT event_type, count(*) AS n, round(avg(CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END), 6) AS razon FROM events GROUP BY 1")
def _(v: Views) -> DataFrame:
    return v.log.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("value") >= 50, 1.0).otherwise(0.0)), 6).alias("razon"))


def _diverse(lam: float, k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rango"])
        left, chosen = list(range(len(pdf))), []
        sets, sims = [set(x) for x in pdf["s"]], pdf["sim"].tolist()
        jac = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
        while left and len(chosen) < k:
            best = max(left, key=lambda i: (lam * sims[i] - (1 - lam) * max((jac(i, j) for j in chosen), default=0.0), -i))
            chosen.append(best)
            left.remove(best)
        out = pdf.iloc[chosen]
        return pd.DataFrame({"consulta": out["consulta"], "concepto": out["concepto"], "puesto": range(1, len(out) + 1)})

    return run


@C.add("wn15_maximal_marginal_relevance")
def _(v: Views) -> DataFrame:
    """Five of the twenty best of each query, by relevance and distance to those chosen; twenty rows a group."""
    held = v.active.select("concepto", F.array_distinct(T.words("contenido", 3)).alias("s"))
    rows = top(v, 20).join(held, "concepto").select("consulta", "concepto", "rango", S.bm25_unit(F.col("bm25")).alias("sim"), "s")
    return rows.groupBy("consulta").applyInPandas(_diverse(0.7, 5), "consulta bigint, concepto string, puesto int")


@C.add("wn16_median_beta", "WITH " + _TOP + " SELECT consulta, round(median(bm25) * 0.7, 6) AS beta FROM top GROUP BY 1", "nodes")
def _(v: Views) -> DataFrame:
    return top(v).groupBy("consulta").agg(F.round(F.median("bm25") * 0.7, 6).alias("beta"))


@C.add("wn6_fan_out", "SELECT origen, destino FROM (SELECT *, row_number() OVER (PARTITION BY origen, tipo ORDER BY peso DESC, destino) AS r FROM edges) WHERE r <= 30", "edges")
def _(v: Views) -> DataFrame:
    return first_per(v.edges, ["origen", "tipo"], [F.desc("peso"), F.asc("destino")], 30).select("origen", "destino")


@C.add("so3_weighted_order", "WITH " + _TOP + " SELECT consulta, t.concepto, row_number() OVER (PARTITION BY consulta ORDER BY round(bm25 * (0.5 + 0.5 * act.peso), 9) DESC, t.concepto) AS puesto FROM top t JOIN act USING (concepto)", "nodes")
def _(v: Views) -> DataFrame:
    key = F.round(F.col("bm25") * (0.5 + 0.5 * F.col("peso")), 9)
    rows = top(v).join(v.active.select("concepto", "peso"), "concepto")
    return rows.select("consulta", "concepto", F.row_number().over(Window.partitionBy("consulta").orderBy(key.desc(), "concepto")).cast("bigint").alias("puesto"))


@C.add("so5_weight_then_state", "SELECT concepto, peso, estado FROM nodes ORDER BY peso DESC, estado, concepto LIMIT 200", "nodes")
def _(v: Views) -> DataFrame:
    return v.nodes.orderBy(F.desc("peso"), "estado", "concepto").limit(200).select("concepto", "peso", "estado")


@C.add("st2_union_all", "SELECT concepto, count(*) AS n FROM (SELECT origen AS concepto FROM edges UNION ALL SELECT destino FROM edges UNION ALL SELECT concepto FROM nodes) GROUP BY 1", "nodes edges")
def _(v: Views) -> DataFrame:
    return v.edges.select(F.explode(F.array("origen", "destino")).alias("concepto")).unionByName(v.nodes.select("concepto")).groupBy("concepto").agg(F.count(F.lit(1)).alias("n"))


@C.add("gr19_curiosity", "WITH a AS (SELECT concepto FROM nodes WHERE valencia >= 0.3 OR peso >= 0.5), p AS (SELECT a.concepto AS ancla, y.concepto AS socio, md5(a.concepto || '|' || y.concepto) AS h FROM a JOIN dims x USING (concepto) JOIN dims y ON y.dim = x.dim AND y.concepto <> a.concepto) SELECT ancla, min(socio) AS socio, 0.75 AS peso FROM p WHERE h = (SELECT min(h) FROM p z WHERE z.ancla = p.ancla) GROUP BY 1", "nodes dims")
def _(v: Views) -> DataFrame:
    """Each anchor with one partner of a shared tag, chosen by hash instead of chance."""
    a = v.nodes.where("valencia >= 0.3 or peso >= 0.5").select("concepto")
    p = a.join(v.dims, "concepto").select(F.col("concepto").alias("ancla"), "dim").join(v.dims.withColumnRenamed("concepto", "socio"), "dim").where("ancla <> socio")
    return p.groupBy("ancla").agg(F.min(F.struct(F.md5(F.concat_ws("|", "ancla", "socio")).alias("h"), "socio")).alias("m")).select("ancla", "m.socio", F.lit(0.75).alias("peso"))


@C.add("lc2_propagate_dimensions", "SELECT DISTINCT u.b AS concepto, d.dim FROM und u JOIN dims d ON d.concepto = u.a JOIN nodes n ON n.concepto = u.b WHERE u.peso >= 0.9", "nodes edges und dims")
def _(v: Views) -> DataFrame:
    near = v.und.where("peso >= 0.9").select(F.col("a").alias("concepto"), "b").join(v.dims, "concepto").select(F.col("b").alias("concepto"), "dim").distinct()
    return near.join(v.nodes.select("concepto"), "concepto", "left_semi")


@C.add("sf8_weighted_jaccard", f"WITH t AS (SELECT concepto, unnest(list_distinct({W('contenido', 4)})) AS t FROM nodes), i AS (SELECT t, ln((SELECT count(*) FROM nodes) / CAST(count(*) AS DOUBLE)) AS w FROM t GROUP BY 1), s AS (SELECT concepto, sum(w) AS w FROM t JOIN i USING (t) GROUP BY 1), c AS (SELECT e.origen, e.destino, sum(i.w) AS w FROM edges e JOIN t x ON x.concepto = e.origen JOIN t y ON y.concepto = e.destino AND y.t = x.t JOIN i ON i.t = x.t WHERE e.tipo = 'causal' GROUP BY 1, 2) SELECT origen, destino, round(c.w / (a.w + b.w - c.w), 6) AS similitud FROM c JOIN s a ON a.concepto = origen JOIN s b ON b.concepto = destino WHERE a.w + b.w - c.w > 0", "nodes edges")
def _(v: Views) -> DataFrame:
    n = float(v.nodes.count())
    t = v.nodes.select("concepto", F.explode(F.array_distinct(T.words("contenido", 4))).alias("t"))
    w = t.join(t.groupBy("t").agg(F.log(F.lit(n) / F.count(F.lit(1))).alias("w")), "t")
    s = w.groupBy("concepto").agg(F.sum("w").alias("s"), F.map_from_entries(F.collect_list(F.struct("t", "w"))).alias("m"))
    of = lambda c, k: s.select(F.col("concepto").alias(c), F.col("s").alias(f"s{k}"), F.col("m").alias(f"m{k}"))
    e = v.edges.where("tipo = 'causal'").join(of("origen", "a"), "origen").join(of("destino", "b"), "destino")
    shared = F.aggregate(F.array_intersect(F.map_keys("ma"), F.map_keys("mb")), F.lit(0.0), lambda acc, k: acc + F.element_at(F.col("ma"), k))
    both = e.withColumn("c", shared).where(F.size(F.array_intersect(F.map_keys("ma"), F.map_keys("mb"))) > 0)
    return both.select("origen", "destino", F.round(T.ratio(F.col("c"), F.col("sa") + F.col("sb") - F.col("c")), 6).alias("similitud"))




@C.add("pr8_role_equality", "SELECT DISTINCT origen AS concepto FROM edges WHERE tipo = 'causal' AND destino = 'bitacora_central' UNION SELECT DISTINCT origen FROM edges WHERE tipo = 'manual' AND destino = 'ciclo_de_poda'", "edges")
def _(v: Views) -> DataFrame:
    roles = "(tipo = 'causal' and destino = 'bitacora_central') or (tipo = 'manual' and destino = 'ciclo_de_poda')"
    return v.edges.where(roles).select(F.col("origen").alias("concepto")).distinct()


@C.add(
    "pr9_role_fallback",
    f"WITH {_NAMES}, q AS (SELECT DISTINCT item_id, unnest({W('consulta', 4)}) AS t FROM casos_qa), h AS (SELECT DISTINCT item_id, concepto FROM q JOIN df USING (t) JOIN w USING (t)) SELECT item_id, e.origen, e.destino, round(least(0.85, CASE WHEN e.tipo = 'causal' THEN 0.65 ELSE 0.5 END + e.peso * 0.1) + 1e-9, 4) AS score FROM h JOIN edges e ON e.destino = h.concepto WHERE e.peso >= 0.8",
    "nodes edges",
)
def _(v: Views) -> DataFrame:
    """Edges whose object is named in the query, by type and weight."""
    w = v.nodes.select("concepto", F.explode(F.array_distinct(F.filter(F.split("concepto", "_"), lambda x: F.length(x) >= 4))).alias("t"))
    q = v.table("casos_qa").select("item_id", F.explode(T.words("consulta", 4)).alias("t")).distinct()
    h = w.join(F.broadcast(q), "t").select("item_id", F.col("concepto").alias("destino")).distinct()
    s = F.least(F.lit(0.85), F.when(F.col("tipo") == "causal", 0.65).otherwise(0.5) + F.col("peso") * 0.1)
    return h.join(v.edges.where("peso >= 0.8"), "destino").select("item_id", "origen", "destino", F.round(s + 1e-9, 4).alias("score"))


@C.add("ca9_case_generation", rf"SELECT concepto AS esperado, 'literal' AS clase, array_to_string({W('contenido', 3)}[1:5], ' ') AS consulta FROM nodes WHERE estado = 'activo' AND len({W('contenido', 3)}) >= 5 UNION ALL SELECT concepto, 'nombre', replace(concepto, '_', ' ') FROM nodes WHERE estado = 'activo'", "nodes")
def _(v: Views) -> DataFrame:
    w = T.words("contenido", 3)
    literal = v.active.where(F.size(w) >= 5).select(F.col("concepto").alias("esperado"), F.lit("literal").alias("clase"), F.array_join(F.slice(w, 1, 5), " ").alias("consulta"))
    return literal.unionByName(v.active.select(F.col("concepto").alias("esperado"), F.lit("nombre").alias("clase"), F.translate("concepto", "_", " ").alias("consulta")))


@C.add("ex4_gated_fusion", "WITH " + _TOP + ", g AS (SELECT t.consulta, t.concepto, rango, bm25, act.peso, max(bm25) FILTER (WHERE rango = 1) OVER w - max(bm25) FILTER (WHERE rango = 2) OVER w < 0.5 AS cerca FROM top t JOIN act USING (concepto) WINDOW w AS (PARTITION BY consulta)), f AS (SELECT *, row_number() OVER (PARTITION BY consulta ORDER BY peso DESC, concepto) AS r2 FROM g) SELECT consulta, concepto, round(CASE WHEN cerca THEN 1.0 / (60 + rango) + 1.0 / (60 + r2) ELSE 1.0 / (60 + rango) END, 6) AS score FROM f", "nodes")
def _(v: Views) -> DataFrame:
    w = Window.partitionBy("consulta")
    rows = top(v).join(v.active.select("concepto", "peso"), "concepto")
    at = lambda n: F.max(F.when(F.col("rango") == n, F.col("bm25"))).over(w)
    f = rows.withColumn("cerca", at(1) - at(2) < 0.5).withColumn("r2", F.row_number().over(w.orderBy(F.desc("peso"), "concepto")))
    first = S.reciprocal_rank(F.col("rango"))
    return f.select("consulta", "concepto", F.round(F.when(F.col("cerca"), first + S.reciprocal_rank(F.col("r2"))).otherwise(first), 6).alias("score"))


@C.add("se15_vector_fusion")
def _(v: Views) -> DataFrame:
    """0.85 * the text score + 0.15 * the cosine of query and node, where both have a vector."""
    near = top(v).join(query_vectors(v).withColumnRenamed("vector", "q"), "consulta").join(usable(v.table("nodos"), "concepto").withColumnRenamed("k", "concepto"), "concepto")
    fused = 0.85 * S.bm25_unit(F.col("bm25")) + 0.15 * F.greatest(F.lit(0.0), S.cosine(F.col("q"), F.col("vector")))
    return near.select("consulta", "concepto", F.round(fused, 6).alias("score"))


@C.add("ve2d_fold_in")
def _(v: Views) -> DataFrame:
    """Vectors of nodes that the vector index lacks, from the vectors of their words."""
    from quipu.operators.distribution import weighted_mean
    from quipu.plans.vectors import SIZE, token_vectors

    lack = v.nodes.join(usable(v.table("nodos"), "concepto").withColumnRenamed("k", "concepto"), "concepto", "left_anti")
    words = lack.select("concepto", F.explode(T.words("contenido", 3)).alias("k"))
    return weighted_mean(words.join(token_vectors(v), "k"), ["concepto"], "vector", F.greatest(F.lit(0.01), "idf"), SIZE)


@C.add("gr7_emergent_dimensions")
def _(v: Views) -> DataFrame:
    """Groups of five or more with the tag they overlap most (Jaccard 0.5 or more), else a name of their own."""
    labels = G.label_propagation(v.und)
    size = labels.groupBy("grupo").agg(F.count(F.lit(1)).alias("ng")).where("ng >= 5")
    tag = v.dims.groupBy("dim").agg(F.count(F.lit(1)).alias("nd"))
    both = labels.join(size, "grupo").join(v.dims, "concepto").groupBy("grupo", "ng", "dim").agg(F.count(F.lit(1)).alias("c")).join(tag, "dim")
    best = both.withColumn("j", F.col("c") / (F.col("ng") + F.col("nd") - F.col("c"))).groupBy("grupo").agg(F.max(F.struct("j", "dim")).alias("m"))
    name = F.when(F.col("m.j") >= 0.5, F.col("m.dim")).otherwise(F.concat(F.lit("auto_"), "grupo"))
    return size.join(best, "grupo", "left").select("grupo", F.col("ng").alias("miembros"), F.coalesce(name, F.concat(F.lit("auto_"), "grupo")).alias("dimension"))
