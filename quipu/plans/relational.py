"""Scans, filters, joins, aggregations, rankings and set operations over nodes, edges and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quipu.functions import text as T
from quipu.operators.graph import common_neighbours, degree, expand_context, first_per, neighbour_jaccard
from quipu.plans.views import Catalogue, Views

C = Catalogue()
QUERIES, SQL = C.queries, C.sql
#: Reference instant of a table: its own latest time, never the clock.
NOW = "(SELECT max(ultimo_acceso) FROM nodes)"


def W(c: str, n: int) -> str:
    return rf"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_]{{{n},}}')"


def now(v: Views):
    """Latest access, a single value."""
    return v.nodes.agg(F.max("ultimo_acceso")).first()[0]


# ---- scans and sinks


@C.add("sc1_active_nodes", "SELECT concepto, categoria, peso FROM nodes WHERE estado = 'activo'", "nodes")
def _(v: Views) -> DataFrame:
    return v.active.select("concepto", "categoria", "peso")


@C.add("sc2_point_lookup", "SELECT concepto, contenido, peso, estado FROM nodes WHERE concepto IN ('bitacora_central', 'ciclo_de_poda')", "nodes")
def _(v: Views) -> DataFrame:
    return v.nodes.where(F.col("concepto").isin("bitacora_central", "ciclo_de_poda")).select("concepto", "contenido", "peso", "estado")


@C.add(
    "sc5_inverted_index",
    f"SELECT term, count(DISTINCT concepto) AS df, count(*) AS tf FROM (SELECT concepto, unnest({W('contenido', 3)}) AS term FROM nodes) GROUP BY 1",
    "nodes",
)
def _(v: Views) -> DataFrame:
    per = v.nodes.select("concepto", F.explode(T.words("contenido", 3)).alias("term")).groupBy("term", "concepto").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("tf"))


@C.add(
    "sc4_prefix_terms",
    f"SELECT concepto, count(*) AS aciertos FROM (SELECT concepto, unnest({W('contenido', 3)}) AS term FROM nodes) WHERE starts_with(term, 'lee') OR starts_with(term, 'recu') GROUP BY 1",
    "nodes",
)
def _(v: Views) -> DataFrame:
    hits = F.size(F.filter(T.words("contenido", 3), lambda t: t.startswith("lee") | t.startswith("recu")))
    return v.nodes.select("concepto", hits.cast("bigint").alias("aciertos")).where("aciertos > 0")


@C.add("sc8_adjacency", "SELECT a AS concepto, count(*) AS vecinos, min(b) AS primero, max(b) AS ultimo FROM und GROUP BY 1", "edges und")
def _(v: Views) -> DataFrame:
    return v.und.groupBy(F.col("a").alias("concepto")).agg(F.count(F.lit(1)).alias("vecinos"), F.min("b").alias("primero"), F.max("b").alias("ultimo"))


@C.add(
    "sk5_cdc_diff",
    """SELECT concepto, CASE WHEN a.k IS NULL THEN 'insert' WHEN b.k IS NULL THEN 'delete' ELSE 'update' END AS accion
FROM (SELECT lower(trim(concepto, ' ')) AS concepto, 1 AS k, min(contenido) AS c, min(sinonimos) AS s FROM largo_plazo WHERE trim(concepto, ' ') <> '' AND ultimo_acceso < TIMESTAMP '2025-06-01' GROUP BY 1) a
FULL JOIN (SELECT lower(trim(concepto, ' ')) AS concepto, 1 AS k, max(contenido) AS c, max(sinonimos) AS s FROM largo_plazo WHERE trim(concepto, ' ') <> '' AND ultimo_acceso >= TIMESTAMP '2025-03-01' GROUP BY 1) b USING (concepto)
WHERE a.k IS NULL OR b.k IS NULL OR a.c IS DISTINCT FROM b.c OR a.s IS DISTINCT FROM b.s""",
)
def _(v: Views) -> DataFrame:
    rows = v.table("largo_plazo").withColumn("concepto", F.lower(F.trim("concepto"))).where("concepto <> ''")
    old = rows.where("ultimo_acceso < timestamp_ntz'2025-06-01'").groupBy("concepto").agg(F.lit(1).alias("k"), F.min("contenido").alias("c"), F.min("sinonimos").alias("s"))
    new = rows.where("ultimo_acceso >= timestamp_ntz'2025-03-01'").groupBy("concepto").agg(F.lit(1).alias("k2"), F.max("contenido").alias("c2"), F.max("sinonimos").alias("s2"))
    return snapshot_diff(old, new)


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """insert, delete or update per concept between two snapshots; null-safe, unchanged rows go."""
    both = old.join(new, "concepto", "full")
    action = F.when(F.col("k").isNull(), "insert").when(F.col("k2").isNull(), "delete").otherwise("update")
    changed = F.col("k").isNull() | F.col("k2").isNull() | ~F.col("c").eqNullSafe(F.col("c2")) | ~F.col("s").eqNullSafe(F.col("s2"))
    return both.where(changed).select("concepto", action.alias("accion"))


@C.add("sk6_archive_deleted", "SELECT concepto, estado, peso FROM nodes WHERE estado = 'dormido' AND peso <= 0.3", "nodes")
def _(v: Views) -> DataFrame:
    kept = v.nodes.where("not (estado = 'dormido' and peso <= 0.3)").select("concepto")
    return v.nodes.join(kept, "concepto", "left_anti").select("concepto", "estado", "peso")


@C.add(
    "sk7_cascade",
    "SELECT origen, destino, peso FROM edges WHERE origen IN (SELECT concepto FROM nodes) AND destino IN (SELECT concepto FROM nodes)",
    "nodes edges",
)
def _(v: Views) -> DataFrame:
    keep = v.nodes.select("concepto")
    by = lambda e, c: e.join(keep.withColumnRenamed("concepto", c), c, "left_semi")
    return by(by(v.edges, "origen"), "destino").select("origen", "destino", "peso")


@C.add("sk8_ttl_purge", "SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def _(v: Views) -> DataFrame:
    last = v.log.agg(F.max("ts")).first()[0]
    return v.log.where(F.col("ts") >= F.lit(last) - F.expr("interval 7 days")).select("event_id", "user_id")


@C.add("sk2_upsert_edges", "SELECT origen, destino, max(peso) AS peso FROM er WHERE origen <> destino GROUP BY 1, 2", "edges")
def _(v: Views) -> DataFrame:
    from quipu.operators.graph import upsert_edges

    return upsert_edges(v.edges.where("creado < timestamp_ntz'2026-01-01' or creado is null"), v.edges.where("creado >= timestamp_ntz'2026-01-01'")).select("origen", "destino", "peso")


@C.add("sk3_capped_increment", "SELECT origen, destino, round(least(greatest(0.9, peso), peso + 0.1), 6) AS peso FROM edges WHERE tipo = 'co_ocurrencia'", "edges")
def _(v: Views) -> DataFrame:
    return v.edges.where("tipo = 'co_ocurrencia'").select("origen", "destino", F.round(F.least(F.greatest(F.lit(0.9), "peso"), F.col("peso") + 0.1), 6).alias("peso"))


@C.add("sk13_node_category_view", "SELECT concepto, coalesce(nombre, 'General') AS categoria, peso FROM nodes LEFT JOIN cat ON cid = categoria", "nodes cat")
def _(v: Views) -> DataFrame:
    return v.nodes.join(F.broadcast(v.categories), F.col("categoria") == F.col("cid"), "left").select("concepto", F.coalesce("nombre", F.lit("General")).alias("categoria"), "peso")


# ---- filters


@C.add(
    "pr1_whole_word",
    r"SELECT concepto, list_contains(regexp_extract_all(translate(lower(contenido), '_-', '  '), '[\p{L}\p{N}]+'), 'umbral') AS palabra FROM nodes WHERE contenido IS NOT NULL",
    "nodes",
)
def _(v: Views) -> DataFrame:
    return v.nodes.where("contenido is not null").select("concepto", T.whole_word(F.lit("umbral"), "contenido").alias("palabra"))


@C.add(
    "pr2_word_prefix",
    r"SELECT concepto FROM nodes WHERE len(list_filter(regexp_extract_all(translate(lower(contenido), '_-', '  '), '[\p{L}\p{N}]+'), lambda x: starts_with(x, 'recu'))) > 0",
    "nodes",
)
def _(v: Views) -> DataFrame:
    return v.nodes.where(T.word_prefix(F.lit("recu"), "contenido")).select("concepto")


@C.add(
    "pr3_composite_filter",
    "SELECT concepto, categoria, creado_en FROM nodes WHERE estado = 'activo' AND categoria IN (3, 4, 8) AND creado_en >= TIMESTAMP '2025-02-01' AND creado_en < TIMESTAMP '2025-09-01'",
    "nodes",
)
def _(v: Views) -> DataFrame:
    return v.active.where("categoria in (3, 4, 8) and creado_en >= timestamp_ntz'2025-02-01' and creado_en < timestamp_ntz'2025-09-01'").select("concepto", "categoria", "creado_en")


@C.add(
    "pr4_short_word_guard",
    r"""SELECT concepto FROM nodes WHERE list_has_any(regexp_extract_all(translate(lower(coalesce(contenido, '') || ' ' || concepto || ' ' || coalesce(sinonimos, '')), '_-', '  '), '[\p{L}\p{N}]+'), ['eje', 'red'])""",
    "nodes",
)
def _(v: Views) -> DataFrame:
    every = F.concat_ws(" ", T.text("contenido"), "concepto", T.text("sinonimos"))
    hit = T.whole_word(F.lit("eje"), every) | T.whole_word(F.lit("red"), every)
    return v.nodes.where(hit).select("concepto")


@C.add(
    "pr5_concept_like",
    "SELECT concepto, (contains(concepto, 'leccion')::INT + contains(concepto, 'fu')::INT) / 2.0 AS razon FROM nodes WHERE contains(concepto, 'leccion') OR contains(concepto, 'fu')",
    "nodes",
)
def _(v: Views) -> DataFrame:
    hits = sum((F.contains("concepto", F.lit(w)).cast("int") for w in ("leccion", "fu")), F.lit(0))
    return v.nodes.select("concepto", (hits / 2.0).alias("razon")).where("razon > 0")


@C.add("pr6_synonym_like", "SELECT concepto FROM nodes WHERE contains(lower(sinonimos), 'nodo') OR contains(lower(sinonimos), 'ruta')", "nodes")
def _(v: Views) -> DataFrame:
    s = F.lower("sinonimos")
    return v.nodes.where(F.contains(s, F.lit("nodo")) | F.contains(s, F.lit("ruta"))).select("concepto")


@C.add(
    "pr7_role_filter",
    "SELECT DISTINCT origen, destino, tipo, peso FROM edges WHERE contains(origen, 'leccion') AND contains(tipo, 'co_') ORDER BY peso DESC, origen, destino LIMIT 50",
    "edges",
)
def _(v: Views) -> DataFrame:
    hit = v.edges.where(F.contains("origen", F.lit("leccion")) & F.contains("tipo", F.lit("co_")))
    return hit.select("origen", "destino", "tipo", "peso").orderBy(F.desc("peso"), "origen", "destino").limit(50)


@C.add(
    "pr10_phrase_cleaning",
    rf"SELECT item_id, array_to_string(list_filter({W('consulta', 2)}, lambda x: x NOT IN ('qué', 'si', 'la', 'el', 'una', 'un', 'what', 'if', 'the')), ' ') AS frase FROM casos_qa",
)
def _(v: Views) -> DataFrame:
    stop = ["qué", "si", "la", "el", "una", "un", "what", "if", "the"]
    return v.table("casos_qa").select("item_id", F.array_join(F.filter(T.words("consulta", 2), lambda x: ~x.isin(stop)), " ").alias("frase"))


@C.add("pr11_junk_query", f"SELECT doc_id, (len({W('text', 3)}) = 0 AND length(text) > 0) OR length(text) > 3000 AS basura FROM documents WHERE text IS NOT NULL")
def _(v: Views) -> DataFrame:
    junk = ((F.size(T.words("text", 3)) == 0) & (F.length("text") > 0)) | (F.length("text") > 3000)
    return v.table("documents").where("text is not null").select("doc_id", junk.alias("basura"))


@C.add(
    "pr17_chronological",
    "SELECT concepto, creado_en FROM nodes WHERE categoria = 4 AND estado = 'activo' ORDER BY creado_en DESC NULLS LAST, concepto LIMIT 20",
    "nodes",
)
def _(v: Views) -> DataFrame:
    return v.active.where("categoria = 4").orderBy(F.desc_nulls_last("creado_en"), "concepto").limit(20).select("concepto", "creado_en")


@C.add(
    "pr18_staleness",
    f"SELECT concepto, CAST(date_diff('day', CAST(ultimo_acceso AS DATE), CAST({NOW} AS DATE)) AS BIGINT) AS edad, date_diff('day', CAST(ultimo_acceso AS DATE), CAST({NOW} AS DATE)) > 90 AND coalesce(nombre, '') NOT IN ('Principle', 'Profile', 'Personal', 'Relation') AS rancio FROM nodes LEFT JOIN cat ON cid = categoria WHERE ultimo_acceso IS NOT NULL",
    "nodes cat",
)
def _(v: Views) -> DataFrame:
    age = F.datediff(F.lit(now(v)), "ultimo_acceso").cast("bigint")
    exempt = F.coalesce(F.col("nombre").isin("Principle", "Profile", "Personal", "Relation"), F.lit(False))
    named = v.nodes.where("ultimo_acceso is not null").join(F.broadcast(v.categories), F.col("categoria") == F.col("cid"), "left")
    return named.select("concepto", age.alias("edad"), ((age > 90) & ~exempt).alias("rancio"))


@C.add("pr19_preview", "SELECT concepto, CASE WHEN length(contenido) > 60 THEN left(contenido, 60) || '...' ELSE coalesce(contenido, '') END AS vista FROM nodes", "nodes")
def _(v: Views) -> DataFrame:
    return v.nodes.select("concepto", T.preview("contenido", 60).alias("vista"))


@C.add("pr21_failed_search", "SELECT event_id FROM events WHERE coalesce(value, 0) < 10.0 OR event_type = 'error'")
def _(v: Views) -> DataFrame:
    return v.log.where((F.coalesce("value", F.lit(0.0)) < 10.0) | (F.col("event_type") == "error")).select("event_id")


@C.add(
    "pr22_at_risk",
    f"SELECT concepto, peso, ultimo_acceso FROM nodes WHERE estado = 'activo' AND peso > 0.7 AND ultimo_acceso < {NOW} - INTERVAL 3 DAY ORDER BY peso DESC, ultimo_acceso, concepto LIMIT 50",
    "nodes",
)
def _(v: Views) -> DataFrame:
    idle = F.col("ultimo_acceso") < F.lit(now(v)) - F.expr("interval 3 days")
    return v.active.where((F.col("peso") > 0.7) & idle).orderBy(F.desc("peso"), "ultimo_acceso", "concepto").limit(50).select("concepto", "peso", "ultimo_acceso")


@C.add(
    "pr23_edge_prefilter",
    "SELECT veredicto, count(*) AS n FROM (SELECT CASE WHEN peso >= 0.8 OR tipo = 'sinonimo_explicito' THEN 'mantener' WHEN peso < 0.2 AND tipo = 'pmi_hebbiano' THEN 'cortar' ELSE 'evaluar' END AS veredicto FROM edges) GROUP BY 1",
    "edges",
)
def _(v: Views) -> DataFrame:
    verdict = F.when((F.col("peso") >= 0.8) | (F.col("tipo") == "sinonimo_explicito"), "mantener").when((F.col("peso") < 0.2) & (F.col("tipo") == "pmi_hebbiano"), "cortar").otherwise("evaluar")
    return v.edges.groupBy(verdict.alias("veredicto")).agg(F.count(F.lit(1)).alias("n"))


@C.add(
    "pr25_bridge_validation",
    f"SELECT DISTINCT hub_id, lower(trim(node_concepto, ' ')) AS puente FROM concept_hub_nodes WHERE len(list_filter(regexp_extract_all(replace(lower(node_concepto), '_', ' '), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 2)) >= 2",
)
def _(v: Views) -> DataFrame:
    parts = F.filter(F.regexp_extract_all(F.translate(F.lower("node_concepto"), "_", " "), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda x: F.length(x) > 2)
    return v.table("concept_hub_nodes").where(F.size(parts) >= 2).select("hub_id", F.lower(F.trim("node_concepto")).alias("puente")).distinct()


@C.add("pr27_substring_search", "SELECT concepto, peso FROM nodes WHERE contains(concepto, 'torre') OR contains(lower(contenido), 'torre') ORDER BY peso DESC, concepto LIMIT 100", "nodes")
def _(v: Views) -> DataFrame:
    hit = F.contains("concepto", F.lit("torre")) | F.contains(F.lower("contenido"), F.lit("torre"))
    return v.nodes.where(hit).orderBy(F.desc("peso"), "concepto").limit(100).select("concepto", "peso")


@C.add("pr28_eviction", "SELECT concepto, peso, ultimo_acceso FROM nodes WHERE estado = 'dormido' AND peso <= 0.3 ORDER BY ultimo_acceso NULLS FIRST, concepto LIMIT 40", "nodes")
def _(v: Views) -> DataFrame:
    return v.nodes.where("estado = 'dormido' and peso <= 0.3").orderBy(F.asc_nulls_first("ultimo_acceso"), "concepto").limit(40).select("concepto", "peso", "ultimo_acceso")


# ---- joins


@C.add(
    "jn3_dimension_catalogue",
    "SELECT h.hub_id, coalesce(h.description, '') AS eje, count(DISTINCT d.concepto) AS nodos FROM concept_hubs h JOIN dims d ON d.dim = h.hub_id JOIN nodes USING (concepto) GROUP BY 1, 2",
    "nodes dims",
)
def _(v: Views) -> DataFrame:
    hubs = v.table("concept_hubs").select(F.col("hub_id").alias("dim"), F.coalesce("description", F.lit("")).alias("eje"))
    return v.dims.join(v.nodes.select("concepto"), "concepto", "left_semi").join(hubs, "dim").groupBy(F.col("dim").alias("hub_id"), "eje").agg(F.count(F.lit(1)).alias("nodos"))


@C.add("jn4_shared_dimension_pairs", "SELECT x.concepto AS a, y.concepto AS b, count(*) AS comunes FROM dims x JOIN dims y ON x.dim = y.dim AND x.concepto < y.concepto GROUP BY 1, 2", "dims")
def _(v: Views) -> DataFrame:
    # groups are hubs of a few members; the count per pair is combined before the shuffle
    x, y = v.dims.select("dim", F.col("concepto").alias("a")), v.dims.select("dim", F.col("concepto").alias("b"))
    return x.join(y, "dim").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("comunes"))


@C.add(
    "jn5_neighbour_join",
    "SELECT a, b, und.peso, n.estado FROM und LEFT JOIN nodes n ON n.concepto = und.b WHERE a IN (SELECT concepto FROM nodes WHERE categoria = 7)",
    "nodes edges und",
)
def _(v: Views) -> DataFrame:
    of = v.nodes.where("categoria = 7").select(F.col("concepto").alias("a"))
    return v.und.join(of, "a", "left_semi").join(v.nodes.select(F.col("concepto").alias("b"), "estado"), "b", "left").select("a", "b", "peso", "estado")


@C.add(
    "jn6_interval_join",
    "SELECT a.event_id AS ciclo, count(b.event_id) AS metricas FROM events a LEFT JOIN events b ON b.event_type = 'view' AND abs(epoch_us(b.ts) - epoch_us(a.ts)) < 60000000 WHERE a.event_type = 'purchase' GROUP BY 1",
)
def _(v: Views) -> DataFrame:
    micros = F.expr("unix_micros(cast(ts as timestamp))")
    left = v.log.where("event_type = 'purchase'").select(F.col("event_id").alias("ciclo"), micros.alias("t"))
    right = v.log.where("event_type = 'view'").select("event_id", micros.alias("u"))
    return near_in_time(left, right, 60_000_000).groupBy("ciclo").agg(F.count("event_id").alias("metricas"))


def near_in_time(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """left (…, t) ⟕ right (…, u) where |u - t| < width, as an equi-join on slots of that width."""
    slots = left.withColumn("_s", F.explode(F.sequence(F.floor((F.col("t") - width) / width), F.floor((F.col("t") + width) / width))))
    held = right.withColumn("_s", F.floor(F.col("u") / width))
    hits = slots.join(held, "_s").where(F.abs(F.col("u") - F.col("t")) < width).drop("_s")
    own = [c for c in left.columns]
    return left.join(hits.drop(*[c for c in own if c != own[0]]), own[0], "left")


@C.add(
    "jn7_asof_join",
    "SELECT e.event_id, max(c.ts) AS ciclo FROM events e LEFT JOIN events c ON c.user_id = e.user_id AND c.event_type = 'purchase' AND c.ts <= e.ts + INTERVAL 1 SECOND WHERE e.event_type = 'view' GROUP BY 1",
)
def _(v: Views) -> DataFrame:
    # one pass: both sides in time order per user, the last cycle carried on
    marks = v.log.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("t"), F.col("ts").alias("c"), F.lit(None).cast("bigint").alias("event_id"))
    asks = v.log.where("event_type = 'view'").select("user_id", (F.col("ts") + F.expr("interval 1 second")).alias("t"), F.lit(None).cast("timestamp_ntz").alias("c"), "event_id")
    order = Window.partitionBy("user_id").orderBy("t", F.asc_nulls_last("c")).rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(asks).withColumn("ciclo", F.last("c", ignorenulls=True).over(order)).where("event_id is not null").select("event_id", "ciclo")


@C.add(
    "jn8_anti_direct",
    "SELECT d.a, d.b FROM (SELECT DISTINCT x.concepto AS a, y.concepto AS b FROM dims x JOIN dims y ON x.dim = y.dim AND x.concepto < y.concepto) d ANTI JOIN und ON und.a = d.a AND und.b = d.b",
    "edges und dims",
)
def _(v: Views) -> DataFrame:
    x, y = v.dims.select("dim", F.col("concepto").alias("a")), v.dims.select("dim", F.col("concepto").alias("b"))
    return x.join(y, "dim").where("a < b").select("a", "b").distinct().join(v.und, ["a", "b"], "left_anti")


@C.add(
    "jn9_orphan_audit",
    """SELECT 'origen' AS extremo, count(*) AS n FROM edges ANTI JOIN nodes ON concepto = origen UNION ALL SELECT 'destino', count(*) FROM edges ANTI JOIN nodes ON concepto = destino
UNION ALL SELECT 'dimension', count(*) FROM dims ANTI JOIN nodes USING (concepto)""",
    "nodes edges dims",
)
def _(v: Views) -> DataFrame:
    keep = v.nodes.select("concepto")
    ends = v.edges.select(F.explode(F.array(*(F.struct(F.lit(c).alias("extremo"), F.col(c).alias("concepto")) for c in ("origen", "destino")))).alias("x")).select("x.*")
    tags = v.dims.select(F.lit("dimension").alias("extremo"), "concepto")
    lost = ends.unionByName(tags).groupBy("extremo", "concepto").agg(F.count(F.lit(1)).alias("n")).join(keep, "concepto", "left_anti")
    return lost.groupBy("extremo").agg(F.sum("n").alias("n"))


@C.add("jn11_isolated", "SELECT concepto FROM nodes ANTI JOIN und ON a = concepto", "nodes edges und")
def _(v: Views) -> DataFrame:
    """Nodes without an edge."""
    return v.nodes.join(v.und.select(F.col("a").alias("concepto")), "concepto", "left_anti").select("concepto")


@C.add(
    "jn12_context_expansion",
    """WITH h AS (SELECT concepto, peso AS score FROM nodes WHERE categoria = 7 AND peso > 0.5),
v AS (SELECT a, b, peso, row_number() OVER (PARTITION BY a ORDER BY peso DESC, b) AS r FROM und),
m AS (SELECT b AS concepto, max(least(1.0, h.score * 0.6 + v.peso * 0.2)) AS score FROM h JOIN v ON v.a = h.concepto AND r <= 3 GROUP BY 1)
SELECT concepto, round(score, 6) AS score, 1 AS nivel FROM m ANTI JOIN h USING (concepto)""",
    "nodes edges und",
)
def _(v: Views) -> DataFrame:
    hits = v.nodes.where("categoria = 7 and peso > 0.5").select(F.lit(1).alias("consulta"), "concepto", F.col("peso").alias("score"))
    return expand_context(v.und, hits).select("concepto", F.round("score", 6).alias("score"), "nivel")


@C.add(
    "jn14_common_neighbours",
    "SELECT p.a, p.b, count(*) AS comunes FROM und p JOIN und x ON x.a = p.a JOIN und y ON y.a = p.b AND y.b = x.b WHERE p.a < p.b GROUP BY 1, 2",
    "edges und",
)
def _(v: Views) -> DataFrame:
    return common_neighbours(v.und)


@C.add(
    "jn18_two_hop_candidates",
    "SELECT DISTINCT s.concepto AS semilla, y.b AS concepto FROM (SELECT concepto FROM nodes WHERE categoria = 10 AND peso > 0.8) s JOIN und x ON x.a = s.concepto JOIN und y ON y.a = x.b WHERE x.peso >= 0.7 AND y.peso >= 0.9 AND y.b <> s.concepto",
    "nodes edges und",
)
def _(v: Views) -> DataFrame:
    s = v.nodes.where("categoria = 10 and peso > 0.8").select(F.col("concepto").alias("semilla"))
    x = v.und.where("peso >= 0.7").select(F.col("a").alias("semilla"), F.col("b").alias("m"))
    y = v.und.where("peso >= 0.9").select(F.col("a").alias("m"), F.col("b").alias("concepto"))
    return s.join(x, "semilla").join(y, "m").where("concepto <> semilla").select("semilla", "concepto").distinct()


@C.add("jn22_log_adjacency", "SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sigue FROM events")
def _(v: Views) -> DataFrame:
    return v.log.select("event_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("sigue"))


@C.add(
    "jn23_learned_after",
    "SELECT f.event_id, min(n.ts) AS aprendido FROM events f JOIN events n ON n.user_id = f.user_id AND n.event_type = 'signup' AND n.ts > f.ts AND n.ts <= f.ts + INTERVAL 3 HOUR WHERE f.event_type = 'error' GROUP BY 1",
)
def _(v: Views) -> DataFrame:
    f = v.log.where("event_type = 'error'").select("event_id", "user_id", "ts")
    n = v.log.where("event_type = 'signup'").select("user_id", F.col("ts").alias("t"))
    return f.join(n, "user_id").where("t > ts and t <= ts + interval 3 hours").groupBy("event_id").agg(F.min("t").alias("aprendido"))


@C.add(
    "jn25_ego_graph",
    "SELECT vecino, max(peso) AS peso, count(DISTINCT sentido) = 2 AS bidireccional FROM (SELECT destino AS vecino, peso, 'sale' AS sentido FROM edges WHERE origen = 'bitacora_central' UNION ALL SELECT origen, peso, 'entra' FROM edges WHERE destino = 'bitacora_central') GROUP BY 1",
    "edges",
)
def _(v: Views) -> DataFrame:
    out = v.edges.where("origen = 'bitacora_central'").select(F.col("destino").alias("vecino"), "peso", F.lit(1).alias("s"))
    into = v.edges.where("destino = 'bitacora_central'").select(F.col("origen").alias("vecino"), "peso", F.lit(2).alias("s"))
    return out.unionByName(into).groupBy("vecino").agg(F.max("peso").alias("peso"), (F.max("s") != F.min("s")).alias("bidireccional"))


@C.add(
    "jn26_lightest_link",
    "SELECT b AS indirecto, min(peso) AS peso FROM und WHERE a IN (SELECT concepto FROM nodes WHERE categoria = 7) AND b NOT IN (SELECT concepto FROM nodes WHERE categoria = 7) GROUP BY 1",
    "nodes edges und",
)
def _(v: Views) -> DataFrame:
    direct = v.nodes.where("categoria = 7").select("concepto")
    out = v.und.join(direct.withColumnRenamed("concepto", "a"), "a", "left_semi").join(direct.withColumnRenamed("concepto", "b"), "b", "left_anti")
    return out.groupBy(F.col("b").alias("indirecto")).agg(F.min("peso").alias("peso"))


# ---- aggregations


@C.add("ag1_totals", "SELECT count(*) FILTER (WHERE estado = 'activo') AS activos, count(*) FILTER (WHERE estado = 'dormido') AS dormidos, round(sum(peso), 6) AS energia FROM nodes", "nodes")
def _(v: Views) -> DataFrame:
    return v.nodes.agg(F.count_if(F.col("estado") == "activo").alias("activos"), F.count_if(F.col("estado") == "dormido").alias("dormidos"), F.round(F.sum("peso"), 6).alias("energia"))


@C.add(
    "ag2_state_pivot",
    "SELECT categoria, CAST(sum((estado = 'activo')::INT) AS BIGINT) AS activos, CAST(sum((estado = 'dormido')::INT) AS BIGINT) AS dormidos, round(avg(peso), 6) AS peso FROM nodes GROUP BY 1",
    "nodes",
)
def _(v: Views) -> DataFrame:
    return v.nodes.groupBy("categoria").agg(F.sum((F.col("estado") == "activo").cast("int")).alias("activos"), F.sum((F.col("estado") == "dormido").cast("int")).alias("dormidos"), F.round(F.avg("peso"), 6).alias("peso"))


@C.add("ag3_top_dimensions", "SELECT dim, count(*) AS n FROM dims GROUP BY 1 ORDER BY n DESC, dim LIMIT 10", "dims")
def _(v: Views) -> DataFrame:
    return v.dims.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(10)


@C.add("ag4_pending_sync", "SELECT categoria_id, count(DISTINCT id) AS pendientes FROM sync_log WHERE sincronizado = 0 GROUP BY 1")
def _(v: Views) -> DataFrame:
    return v.table("sync_log").where("sincronizado = 0").select("categoria_id", "id").distinct().groupBy("categoria_id").agg(F.count("id").alias("pendientes"))


@C.add("ag5_failed_groups", "SELECT user_id, count(*) AS veces, max(ts) AS ultima, max(value) AS mejor, arg_max(event_id, (ts, event_id)) AS ultimo FROM events WHERE value < 50 GROUP BY 1")
def _(v: Views) -> DataFrame:
    return v.log.where("value < 50").groupBy("user_id").agg(F.count(F.lit(1)).alias("veces"), F.max("ts").alias("ultima"), F.max("value").alias("mejor"), F.max_by("event_id", F.struct("ts", "event_id")).alias("ultimo"))


@C.add(
    "ag6_corpus_idf",
    f"SELECT term, round(least(1.0, ln((SELECT count(*) FROM nodes) / CAST(count(*) AS DOUBLE)) / ln((SELECT count(*) FROM nodes))), 6) AS idf FROM (SELECT DISTINCT concepto, unnest({W('contenido', 3)}) AS term FROM nodes) GROUP BY 1",
    "nodes",
)
def _(v: Views) -> DataFrame:
    n = v.nodes.count()
    df = v.nodes.select(F.explode(F.array_distinct(T.words("contenido", 3))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.select("term", F.round(F.least(F.lit(1.0), F.log(F.lit(float(n)) / F.col("df")) / F.log(F.lit(float(max(n, 2))))), 6).alias("idf"))


@C.add("ag7_dimension_idf", "SELECT dim, round(ln((SELECT count(*) FROM nodes WHERE estado = 'activo') / CAST(count(*) AS DOUBLE)), 6) AS idf FROM dims GROUP BY 1", "nodes dims")
def _(v: Views) -> DataFrame:
    n = float(v.active.count())
    return v.dims.groupBy("dim").agg(F.round(F.log(F.lit(n) / F.count(F.lit(1))), 6).alias("idf"))


@C.add("ag11_degree", "SELECT concepto, count(*) AS grado FROM (SELECT origen AS concepto FROM edges UNION ALL SELECT destino FROM edges) GROUP BY 1", "edges")
def _(v: Views) -> DataFrame:
    return degree(v.edges)


@C.add("ag12_association_csv", "SELECT a AS concepto, string_agg(b, ',' ORDER BY b) AS asociaciones FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY peso DESC, b) AS r FROM und) WHERE r <= 12 GROUP BY 1", "edges und")
def _(v: Views) -> DataFrame:
    top = first_per(v.und, ["a"], [F.desc("peso"), F.asc("b")], 12)
    return top.groupBy(F.col("a").alias("concepto")).agg(F.array_join(F.array_sort(F.collect_list("b")), ",").alias("asociaciones"))


@C.add("ag13_hub_nodes", "SELECT dim AS hub_id, string_agg(concepto, '|' ORDER BY concepto) AS nodos FROM dims GROUP BY 1", "dims")
def _(v: Views) -> DataFrame:
    return v.dims.groupBy(F.col("dim").alias("hub_id")).agg(F.array_join(F.array_sort(F.collect_list("concepto")), "|").alias("nodos"))


@C.add("ag15_many_pmi_edges", "SELECT origen, count(*) AS n FROM edges WHERE tipo = 'co_ocurrencia' GROUP BY 1 HAVING count(*) > 5", "edges")
def _(v: Views) -> DataFrame:
    return v.edges.where("tipo = 'co_ocurrencia'").groupBy("origen").agg(F.count(F.lit(1)).alias("n")).where("n > 5")


@C.add(
    "ag18_content_matches",
    "SELECT concepto, n, peso FROM (SELECT concepto, peso, contains(lower(contenido), 'umbral')::INT + contains(lower(contenido), 'firme')::INT + contains(lower(contenido), 'mide')::INT AS n FROM nodes) WHERE n >= 2 ORDER BY n DESC, peso DESC, concepto LIMIT 20",
    "nodes",
)
def _(v: Views) -> DataFrame:
    hits = sum((F.contains(F.lower("contenido"), F.lit(w)).cast("int") for w in ("umbral", "firme", "mide")), F.lit(0))
    return v.nodes.select("concepto", hits.alias("n"), "peso").where("n >= 2").orderBy(F.desc("n"), F.desc("peso"), "concepto").limit(20)


@C.add("ag19_dominant_category", "SELECT estado, categoria FROM (SELECT estado, categoria, row_number() OVER (PARTITION BY estado ORDER BY count(*) DESC, categoria NULLS LAST) AS r FROM nodes GROUP BY 1, 2) WHERE r = 1", "nodes")
def _(v: Views) -> DataFrame:
    n = v.nodes.groupBy("estado", "categoria").agg(F.count(F.lit(1)).alias("n"))
    return first_per(n, ["estado"], [F.desc("n"), F.asc_nulls_last("categoria")], 1).select("estado", "categoria")


@C.add(
    "ag20_trend",
    """WITH t AS (SELECT user_id, value, ntile(2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS mitad FROM events WHERE value IS NOT NULL),
m AS (SELECT user_id, avg(value) FILTER (WHERE mitad = 1) AS a, avg(value) FILTER (WHERE mitad = 2) AS b FROM t GROUP BY 1)
SELECT user_id, round(a, 6) AS antes, round(b, 6) AS ahora, CASE WHEN b > a * 1.1 THEN 'sube' WHEN b < a * 0.9 THEN 'baja' ELSE 'estable' END AS tendencia FROM m""",
)
def _(v: Views) -> DataFrame:
    t = v.log.where("value is not null").withColumn("m", F.ntile(2).over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    m = t.groupBy("user_id").agg(F.avg(F.when(F.col("m") == 1, F.col("value"))).alias("a"), F.avg(F.when(F.col("m") == 2, F.col("value"))).alias("b"))
    trend = F.when(F.col("b") > F.col("a") * 1.1, "sube").when(F.col("b") < F.col("a") * 0.9, "baja").otherwise("estable")
    return m.select("user_id", F.round("a", 6).alias("antes"), F.round("b", 6).alias("ahora"), trend.alias("tendencia"))


@C.add(
    "ag25_column_stats",
    "SELECT 'peso_sinaptico' AS columna, count(*) - count(peso_sinaptico) AS nulos, count(DISTINCT peso_sinaptico) AS distintos FROM largo_plazo UNION ALL SELECT 'estado', count(*) - count(estado), count(DISTINCT estado) FROM largo_plazo UNION ALL SELECT 'categoria', count(*) - count(categoria), count(DISTINCT categoria) FROM largo_plazo",
)
def _(v: Views) -> DataFrame:
    cols = ["peso_sinaptico", "estado", "categoria"]
    one = v.table("largo_plazo").agg(*(F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in cols), *(F.count_distinct(c).alias(f"d_{c}") for c in cols))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("columna"), F.col(f"n_{c}").alias("nulos"), F.col(f"d_{c}").alias("distintos")) for c in cols))))


# ---- windows, sorting, sets


@C.add("wn2_top_neighbours", "SELECT a, b, peso, r AS rango FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY peso DESC, b) AS r FROM und) WHERE r <= 10", "edges und")
def _(v: Views) -> DataFrame:
    return first_per(v.und, ["a"], [F.desc("peso"), F.asc("b")], 10).select("a", "b", "peso", F.col("rango").cast("bigint").alias("rango"))


@C.add(
    "wn4_enriched_associations",
    """WITH p AS (SELECT e.*, CASE tipo WHEN 'sinonimo_explicito' THEN 1 WHEN 'manual' THEN 2 WHEN 'causal' THEN 3 ELSE 4 END AS prio FROM edges e WHERE peso >= 0.5 AND destino IN (SELECT concepto FROM nodes WHERE estado = 'activo')),
c AS (SELECT *, row_number() OVER (PARTITION BY origen, tipo = 'sinonimo_explicito' ORDER BY prio, peso DESC, destino) AS k FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY origen ORDER BY prio, peso DESC, destino) AS r FROM c WHERE tipo <> 'sinonimo_explicito' OR k <= 2)
SELECT origen, destino, tipo, peso, r AS rango FROM f WHERE r <= 5""",
    "nodes edges",
)
def _(v: Views) -> DataFrame:
    prio = F.when(F.col("tipo") == "sinonimo_explicito", 1).when(F.col("tipo") == "manual", 2).when(F.col("tipo") == "causal", 3).otherwise(4)
    live = v.active.select(F.col("concepto").alias("destino"))
    rows = v.edges.where("peso >= 0.5").join(live, "destino", "left_semi").withColumn("prio", prio).withColumn("sin", F.col("tipo") == "sinonimo_explicito")
    order = [F.asc("prio"), F.desc("peso"), F.asc("destino")]
    # the best five of each kind are enough for the best five of both
    capped = first_per(rows, ["origen", "sin"], order, 5, "k").where(~F.col("sin") | (F.col("k") <= 2))
    return first_per(capped, ["origen"], order, 5).select("origen", "destino", "tipo", "peso", F.col("rango").cast("bigint").alias("rango"))


@C.add(
    "wn7_bursts",
    "SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) < 2000000, false) AS rafaga, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) // 1000 AS espera_ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
def _(v: Views) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = v.log.withColumn("t", F.expr("unix_micros(cast(ts as timestamp))"))
    return t.select("event_id", F.coalesce(F.col("t") - F.lag("t").over(w) < 2_000_000, F.lit(False)).alias("rafaga"), F.floor((F.lead("t").over(w) - F.col("t")) / 1000).alias("espera_ms"))


@C.add("wn8_latest_per_key", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(v: Views) -> DataFrame:
    return first_per(v.log, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")], 1).select("user_id", "event_id")


@C.add("so2_recency", "SELECT concepto, creado_en FROM nodes WHERE estado = 'activo' ORDER BY creado_en DESC NULLS LAST, concepto LIMIT 100", "nodes")
def _(v: Views) -> DataFrame:
    return v.active.orderBy(F.desc_nulls_last("creado_en"), "concepto").limit(100).select("concepto", "creado_en")


@C.add("so4_page", "SELECT concepto, peso FROM nodes ORDER BY peso DESC, concepto LIMIT 10 OFFSET 20", "nodes")
def _(v: Views) -> DataFrame:
    return v.nodes.orderBy(F.desc("peso"), "concepto").offset(20).limit(10).select("concepto", "peso")


@C.add("so6_edge_sorting", "SELECT origen, destino, peso, uso FROM edges WHERE tipo = 'causal' ORDER BY peso DESC, uso DESC NULLS LAST, origen, destino LIMIT 200", "edges")
def _(v: Views) -> DataFrame:
    return v.edges.where("tipo = 'causal'").orderBy(F.desc("peso"), F.desc_nulls_last("uso"), "origen", "destino").limit(200).select("origen", "destino", "peso", "uso")


@C.add("st1_union_directions", "SELECT origen AS a, destino AS b FROM edges UNION SELECT destino, origen FROM edges", "edges")
def _(v: Views) -> DataFrame:
    return v.und.select("a", "b")


@C.add("st3_intersect", "SELECT concepto FROM nodes INTERSECT SELECT destino FROM edges", "nodes edges")
def _(v: Views) -> DataFrame:
    return v.nodes.select("concepto").intersect(v.edges.select("destino"))


@C.add("st4_except", "SELECT concepto FROM nodes WHERE estado = 'activo' EXCEPT SELECT origen FROM edges", "nodes edges")
def _(v: Views) -> DataFrame:
    return v.active.select("concepto").subtract(v.edges.select("origen"))


@C.add(
    "st5_ordered_merge",
    "SELECT concepto, fuente FROM (SELECT concepto, fuente, row_number() OVER (PARTITION BY concepto ORDER BY fuente) AS r FROM (SELECT concepto, 1 AS fuente FROM nodes WHERE peso > 0.8 UNION ALL SELECT concepto, 2 FROM dims)) WHERE r = 1",
    "nodes dims",
)
def _(v: Views) -> DataFrame:
    return v.nodes.where("peso > 0.8").select("concepto", F.lit(1).alias("fuente")).unionByName(v.dims.select("concepto", F.lit(2).alias("fuente"))).groupBy("concepto").agg(F.min("fuente").alias("fuente"))


@C.add(
    "sf2a_neighbour_jaccard",
    """WITH n AS (SELECT a, count(*) AS n FROM und GROUP BY 1), c AS (SELECT p.a, p.b, count(*) AS comunes FROM und p JOIN und x ON x.a = p.a JOIN und y ON y.a = p.b AND y.b = x.b WHERE p.a < p.b GROUP BY 1, 2)
SELECT c.a, c.b, round(comunes / CAST(na.n + nb.n - comunes AS DOUBLE), 6) AS jaccard FROM c JOIN n na ON na.a = c.a JOIN n nb ON nb.a = c.b""",
    "edges und",
)
def _(v: Views) -> DataFrame:
    return neighbour_jaccard(v.und).select("a", "b", F.round("jaccard", 6).alias("jaccard"))
