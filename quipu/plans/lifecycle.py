"""Consolidation, decay, inhibition, reinforcement and their measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quipu.functions import text as T
from quipu.operators import lifecycle as L
from quipu.operators.graph import first_per
from quipu.plans.relational import now
from quipu.plans.views import Catalogue, Views

C = Catalogue()
QUERIES, SQL = C.queries, C.sql

_LTD = """ltd AS (SELECT concepto, estado, ultimo_acceso, categoria, prioridad, peso AS antes, CASE WHEN coalesce(prioridad, 9) IN (0, 1) OR valencia >= 0.8 OR coalesce(nombre, '') IN ('Principle', 'Protocol') THEN peso
  ELSE greatest(0.0, floor((peso - 0.05 * coalesce(decay, 1.0) * CASE WHEN prioridad = 2 THEN 0.5 WHEN prioridad = 3 THEN 1.0 WHEN prioridad = 4 THEN 1.5 WHEN prioridad >= 5 THEN 2.5 ELSE 1.5 END) * 1e2 + 0.5) / 1e2) END AS peso
  FROM nodes LEFT JOIN cat ON cid = categoria WHERE estado = 'activo')"""


def decayed(v: Views) -> DataFrame:
    return L.decay_nodes(v.active, v.categories)


@C.add("lc4_decay", "WITH " + _LTD + " SELECT concepto, round(peso, 6) AS peso FROM ltd", "nodes cat")
def _(v: Views) -> DataFrame:
    return decayed(v).select("concepto", F.round("peso", 6).alias("peso"))


@C.add(
    "lc5_edge_decay",
    "SELECT origen, destino, round(p, 6) AS peso FROM (SELECT origen, destino, CASE WHEN coalesce(uso, creado) < (SELECT max(uso) FROM edges) - INTERVAL 7 DAY THEN floor(peso * 0.95 * 1e3 + 0.5) / 1e3 ELSE peso END AS p FROM edges) WHERE p >= 0.05",
    "edges",
)
def _(v: Views) -> DataFrame:
    last = v.edges.agg(F.max("uso")).first()[0]
    return L.decay_edges(v.edges, last).select("origen", "destino", F.round("peso", 6).alias("peso"))


@C.add("lc6_sleep", "WITH " + _LTD + " SELECT concepto, CASE WHEN peso <= 0.05 THEN 'dormido' ELSE estado END AS estado FROM ltd", "nodes cat")
def _(v: Views) -> DataFrame:
    return decayed(v).select("concepto", F.when(F.col("peso") <= 0.05, "dormido").otherwise(F.col("estado")).alias("estado"))


@C.add(
    "lc7_lateral_inhibition",
    """WITH a AS (SELECT concepto, categoria, peso, ultimo_acceso FROM nodes WHERE estado = 'activo'), g AS (SELECT categoria, sum(peso) - greatest(10, 0.8 * count(*)) * 0.5 AS exceso FROM a GROUP BY 1),
r AS (SELECT a.*, exceso, coalesce(sum(peso) OVER (PARTITION BY a.categoria ORDER BY peso, ultimo_acceso NULLS FIRST, concepto ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS antes FROM a JOIN g ON g.categoria IS NOT DISTINCT FROM a.categoria)
SELECT concepto, round(greatest(0.05, floor(peso * 0.9 * 1e2 + 0.5) / 1e2), 6) AS peso FROM r WHERE round(exceso - antes, 6) > 0""",
    "nodes",
)
def _(v: Views) -> DataFrame:
    return L.inhibit(v.active).select("concepto", F.round("peso", 6).alias("peso"))


@C.add(
    "lc8_homeostasis",
    "SELECT concepto, round(CASE WHEN m > 0.5 THEN floor(peso * 0.98 * 1e2 + 0.5) / 1e2 ELSE peso END, 6) AS peso FROM nodes LEFT JOIN (SELECT categoria, avg(peso) AS m FROM nodes WHERE estado = 'activo' GROUP BY 1) g ON g.categoria IS NOT DISTINCT FROM nodes.categoria WHERE estado = 'activo'",
    "nodes",
)
def _(v: Views) -> DataFrame:
    return L.homeostasis(v.active, 0.5).select("concepto", F.round("peso", 6).alias("peso"))


@C.add(
    "lc1_consolidate",
    """WITH c AS (SELECT lower(trim(concepto, ' ')) AS concepto, max(contenido) AS contenido, max(valencia_somatica) AS valencia FROM largo_plazo WHERE trim(concepto, ' ') <> '' AND creado_en >= TIMESTAMP '2025-02-01' GROUP BY 1),
l AS (SELECT concepto, contenido, peso, valencia FROM nodes WHERE creado_en < TIMESTAMP '2025-03-01')
SELECT concepto, round(CASE WHEN l.peso IS NULL THEN 1.0 WHEN c.concepto IS NULL THEN l.peso ELSE least(1.0, l.peso + 0.2) END, 6) AS peso, round(greatest(coalesce(l.valencia, c.valencia), coalesce(c.valencia, l.valencia)), 6) + 0.0 AS valencia,
  CASE WHEN l.contenido IS NULL THEN c.contenido WHEN c.contenido IS NULL OR contains(l.contenido, c.contenido) THEN l.contenido ELSE l.contenido || ' | ' || c.contenido END AS contenido
FROM l FULL JOIN c USING (concepto)""",
    "nodes",
)
def _(v: Views) -> DataFrame:
    fresh = v.table("largo_plazo").withColumn("concepto", F.lower(F.trim("concepto"))).where("concepto <> '' and creado_en >= timestamp_ntz'2025-02-01'")
    fresh = fresh.groupBy("concepto").agg(F.max("contenido").alias("contenido"), F.max("valencia_somatica").alias("valencia"))
    kept = v.nodes.where("creado_en < timestamp_ntz'2025-03-01'").select("concepto", "contenido", "peso", "valencia")
    return L.consolidate(kept, fresh).select("concepto", F.round("peso", 6).alias("peso"), (F.round("valencia", 6) + 0.0).alias("valencia"), "contenido")


@C.add("lc10_cycle_metrics", "SELECT count(*) FILTER (WHERE estado = 'activo') AS activos, count(*) FILTER (WHERE estado = 'dormido') AS dormidos, round(avg(peso) + 1e-9, 6) AS peso_medio, (SELECT count(*) FROM edges) AS aristas FROM nodes", "nodes edges")
def _(v: Views) -> DataFrame:
    n = v.nodes.agg(F.count_if(F.col("estado") == "activo").alias("activos"), F.count_if(F.col("estado") == "dormido").alias("dormidos"), F.round(F.avg("peso") + 1e-9, 6).alias("peso_medio"))
    return n.withColumn("aristas", F.lit(v.edges.count()).cast("bigint"))


@C.add("lc16_toggle_state", "SELECT concepto, CASE estado WHEN 'activo' THEN 'dormido' WHEN 'dormido' THEN 'activo' ELSE estado END AS estado FROM nodes WHERE categoria = 3", "nodes")
def _(v: Views) -> DataFrame:
    flip = F.when(F.col("estado") == "activo", "dormido").when(F.col("estado") == "dormido", "activo").otherwise(F.col("estado"))
    return v.nodes.where("categoria = 3").select("concepto", flip.alias("estado"))


@C.add("lc18_hub_overview", "SELECT h.hub_id, count(DISTINCT d.concepto) AS nodos, min(h.canonical_node) AS canonico FROM concept_hubs h LEFT JOIN dims d ON d.dim = h.hub_id GROUP BY 1", "dims")
def _(v: Views) -> DataFrame:
    n = v.dims.groupBy(F.col("dim").alias("hub_id")).agg(F.count(F.lit(1)).alias("n"))
    return v.table("concept_hubs").select("hub_id", F.col("canonical_node").alias("canonico")).join(n, "hub_id", "left").select("hub_id", F.coalesce("n", F.lit(0)).alias("nodos"), "canonico")


@C.add(
    "lc19_verdict_batch",
    "WITH g AS (SELECT origen, count(*) AS n FROM edges GROUP BY 1) SELECT origen, destino FROM (SELECT e.origen, destino, n, row_number() OVER (PARTITION BY e.origen ORDER BY 1 - peso DESC, destino) AS r FROM edges e JOIN g USING (origen) WHERE peso < 0.3) WHERE r <= n - 5",
    "edges",
)
def _(v: Views) -> DataFrame:
    """Weak edges go, the surest first, as long as an origin keeps five."""
    n = v.edges.groupBy("origen").agg(F.count(F.lit(1)).alias("n"))
    ranked = v.edges.where("peso < 0.3").withColumn("r", F.row_number().over(Window.partitionBy("origen").orderBy(F.desc(1 - F.col("peso")), "destino")))
    return ranked.join(n, "origen").where("r <= n - 5").select("origen", "destino")


@C.add("lc20_node_payload")
def _(v: Views) -> DataFrame:
    """One nested document a node: its fields, heaviest links and tags, as JSON."""
    links = first_per(v.und, ["a"], [F.desc("peso"), F.asc("b")], 10).groupBy(F.col("a").alias("concepto")).agg(F.array_sort(F.collect_list(F.struct("rango", "b", "peso"))).alias("vecinos"))
    tags = v.dims.groupBy("concepto").agg(F.array_sort(F.collect_list("dim")).alias("dimensiones"))
    rows = v.nodes.where("categoria = 7").join(links, "concepto", "left").join(tags, "concepto", "left")
    return rows.select("concepto", F.to_json(F.struct("contenido", "peso", "estado", "vecinos", "dimensiones")).alias("documento"))


@C.add("ca6_reinforcement")
def _(v: Views) -> DataFrame:
    """Weights after the events of each key in order; a fold, so a sequence per key."""
    return L.reinforce(v.log.select(F.col("user_id").cast("string").alias("clave"), "ts", "event_id", (F.col("event_type") == "purchase").alias("exito")))


@C.add(
    "ca5_implicit_feedback",
    """WITH s AS (SELECT event_id, user_id, event_type, ts, lead(event_type) OVER w AS sig, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS dt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN dt > 0 AND dt <= 120000000 AND sig = event_type THEN 0 WHEN dt IS NULL OR dt > 600000000 THEN 1 END AS util, CASE WHEN dt > 0 AND dt <= 120000000 AND sig = event_type THEN 0.9 WHEN dt IS NULL OR dt > 600000000 THEN 0.55 END AS confianza FROM s""",
)
def _(v: Views) -> DataFrame:
    return L.implicit_feedback(v.log.select("event_id", "user_id", "event_type", "ts"))


@C.add("jn16_session_pairs", "SELECT least(x.event_type, y.event_type) AS a, greatest(x.event_type, y.event_type) AS b, count(*) AS sesiones FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS dia, event_type FROM events) x JOIN (SELECT DISTINCT user_id, CAST(ts AS DATE) AS dia, event_type FROM events) y ON x.user_id = y.user_id AND x.dia = y.dia AND x.event_type < y.event_type GROUP BY 1, 2")
def _(v: Views) -> DataFrame:
    # a session holds each kind once, so its pairs are bounded by the number of kinds
    kinds = v.log.select("user_id", F.to_date("ts").alias("dia"), "event_type").distinct().groupBy("user_id", "dia").agg(F.array_sort(F.collect_list("event_type")).alias("k"))
    pairs = F.explode(F.flatten(F.transform("k", lambda x: F.transform(F.filter("k", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b"))))))
    return kinds.select(pairs.alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("sesiones"))


@C.add("category_infer", None)
def _(v: Views) -> DataFrame:
    """Category of each document: words of the categories' texts of a domain, count times the longest hit."""
    terms = {"Lesson": ["error", "fallo", "lección", "lesson"], "Protocol": ["protocolo", "protocol", "permiso"], "Personal": ["diario", "diary"], "Cognition": ["agente", "agent", "identidad"], "Relation": ["canal", "channel", "mensaje"]}
    return L.infer_category(v.table("documents"), "doc_id", "text", terms)


@C.add(
    "str2_idle_sessions",
    """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 3600000000 THEN 0 ELSE 1 END AS nueva FROM events),
s AS (SELECT *, sum(nueva) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sesion FROM g)
SELECT user_id, min(ts) AS inicio, max(ts) AS fin, count(*) AS eventos FROM s GROUP BY user_id, sesion""",
)
def _(v: Views) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.expr("unix_micros(cast(ts as timestamp))")
    new = F.when(us - F.lag(us).over(w) <= 3_600_000_000, 0).otherwise(1)
    return v.log.withColumn("nueva", new).withColumn("sesion", F.sum("nueva").over(w)).groupBy("user_id", "sesion").agg(F.min("ts").alias("inicio"), F.max("ts").alias("fin"), F.count(F.lit(1)).alias("eventos")).drop("sesion")


@C.add("se21_hidden_commands", r"SELECT doc_id, len(regexp_extract_all(text, '(?m)^\d+\. ')) AS pasos, len(regexp_extract_all(text, '(?m)^## ')) AS titulos FROM documents WHERE text IS NOT NULL")
def _(v: Views) -> DataFrame:
    n = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    return v.table("documents").where("text is not null").select("doc_id", n(r"(?m)^\d+\. ").cast("bigint").alias("pasos"), n("(?m)^## ").cast("bigint").alias("titulos"))
