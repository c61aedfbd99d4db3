"""Segmented binary signatures: index, similarity, search and selective reindexing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quipu.functions import text as T
from quipu.operators import sdm
from quipu.plans.relational import W
from quipu.plans.views import Catalogue, Views
from quipu.streaming import jobs as J

C = Catalogue()
QUERIES, SQL = C.queries, C.sql


def _p(text: str, segment: tuple[int, int]) -> str:
    return f"(CAST('0x' || right(md5({text}), 4) AS INT) % {segment[1]} + {segment[0]})"


def _many(tokens: str, segment: tuple[int, int], hashes: int, rows: str) -> str:
    return f"SELECT concepto, {_p('CASE WHEN k = 0 THEN t ELSE k || chr(58) || t END', segment)} AS p FROM (SELECT concepto, unnest({tokens}) AS t FROM {rows}), range({hashes}) ks(k)"


_NAME = W("replace(concepto, '_', ' ')", 2)
_H = "CAST('0x' || right(md5(c), 8) AS BIGINT)"
_SG = f"""nc AS (SELECT nodes.*, lower(nombre) AS c FROM nodes LEFT JOIN cat ON cid = categoria),
c0 AS ({_many(f"list_distinct({W('contenido', 3)})", sdm.CONTENT, 4, 'nc')}),
ix AS (SELECT dim, ln((SELECT count(*) FROM nodes) / CAST(count(*) AS DOUBLE)) AS idf FROM dims GROUP BY 1),
sb AS (SELECT concepto, CASE WHEN c IS NOT NULL AND ({_H} >> (p % 32)) & 1 = 1 THEN CAST((p + {_H} % 64) % 512 AS INT) ELSE p END AS p FROM c0 JOIN (SELECT concepto, c FROM nc) USING (concepto)
  UNION {_many(f"list_distinct({_NAME})", sdm.CONCEPT, 4, 'nc')}
  UNION {_many("[c]", sdm.CATEGORY, 8, '(SELECT * FROM nc WHERE c IS NOT NULL)')}
  UNION SELECT concepto, ({_p('dim', (0, 1024))} + i) % 1024 + 768 FROM dims JOIN ix USING (dim), range(16) r(i) WHERE i < CASE WHEN idf > 3 THEN 16 WHEN idf > 1.5 THEN 12 WHEN idf > 0.5 THEN 8 ELSE 4 END AND concepto IN (SELECT concepto FROM nodes)
  UNION SELECT * FROM ({_many("[b]", sdm.NEIGHBOURS, 4, '(SELECT a AS concepto, b FROM und)')}) WHERE concepto IN (SELECT concepto FROM nodes)),
sg AS (SELECT concepto, list_sort(list(p)) AS b FROM sb GROUP BY 1)"""
_ALL = "nodes edges und dims cat"


def parts(v: Views, nodes: DataFrame, und: DataFrame | None = None) -> DataFrame:
    """und: the undirected edges of these nodes, if they are there already."""
    named = nodes.join(F.broadcast(v.categories), F.col("categoria") == F.col("cid"), "left")
    words = named.select("concepto", T.words("contenido", 3).alias("palabras"), T.words(F.translate("concepto", "_", " "), 2).alias("nombre"), F.col("nombre").alias("categoria"))
    n = float(v.nodes.count())
    idf = v.dims.groupBy("dim").agg(F.log(F.lit(n) / F.count(F.lit(1))).alias("idf"))
    return sdm.signatures(words, v.dims.join(F.broadcast(idf), "dim"), v.und if und is None else und)


@C.add("ve5_segmented_signature", f"WITH {_SG} SELECT concepto, len(b) AS bits, md5(array_to_string(b, ',')) AS huella FROM sg", _ALL)
def _(v: Views) -> DataFrame:
    return parts(v, v.nodes).select("concepto", F.size("b").cast("bigint").alias("bits"), F.md5(F.array_join(F.transform("b", lambda x: x.cast("string")), ",")).alias("huella"))


def _w(bits: str) -> str:
    return f"coalesce(list_sum(list_transform({bits}, lambda x: CASE WHEN x < 768 THEN 1.0 WHEN x < 1792 THEN 2.5 WHEN x < 1920 THEN 1.5 ELSE 1.2 END)), 0)"


@C.add(
    "ve6_weighted_similarity",
    f"""WITH {_SG}, e AS (SELECT u.a, u.b, x.b AS x, y.b AS y, list_intersect(x.b, y.b) AS z FROM und u JOIN sg x ON x.concepto = u.a JOIN sg y ON y.concepto = u.b WHERE u.a < u.b)
SELECT a, b, round({_w('z')} / ({_w('x')} + {_w('y')} - {_w('z')}), 4) AS similitud, CAST(len(x) + len(y) - 2 * len(z) AS INT) AS distancia, round(len(z) / CAST(len(x) + len(y) - len(z) AS DOUBLE), 4) AS simple FROM e""",
    _ALL,
)
def _(v: Views) -> DataFrame:
    """Weighted Jaccard, distance in bits and plain Jaccard of the two ends of every edge."""
    s = parts(v, v.nodes)
    x, y = s.select(F.col("concepto").alias("a"), F.col("b").alias("x")), s.select(F.col("concepto").alias("_b"), F.col("b").alias("y"))
    e = v.und.where("a < b").join(x, "a").join(y, F.col("b") == F.col("_b"))
    return e.select("a", "b", sdm.weighted_jaccard(F.col("x"), F.col("y")).alias("similitud"), sdm.hamming(F.col("x"), F.col("y")).alias("distancia"), F.round(T.jaccard(F.col("x"), F.col("y")), 4).alias("simple"))


@C.add(
    "se10_signature_search",
    f"""WITH {_SG}, qs AS (SELECT concepto, list_sort(list(p)) AS q FROM (SELECT * FROM ({_many(f"list_distinct({W('consulta', 3)})", sdm.CONTENT, 4, '(SELECT item_id AS concepto, consulta FROM casos_qa)')})
  UNION {_many(f"list_distinct({W('consulta', 2)})", sdm.CONCEPT, 4, '(SELECT item_id AS concepto, consulta FROM casos_qa)')}) GROUP BY 1),
m AS (SELECT qs.concepto AS consulta, sg.concepto, CAST(len(q) + len(b) - 2 * len(list_intersect(q, b)) AS INT) AS distancia, round({_w('list_intersect(q, b)')} / ({_w('q')} + {_w('b')} - {_w('list_intersect(q, b)')}), 4) AS s FROM qs, sg)
SELECT consulta, concepto, distancia, s FROM (SELECT *, row_number() OVER (PARTITION BY consulta ORDER BY s DESC, concepto) AS r FROM m WHERE distancia <= 400) WHERE r <= 10""",
    _ALL,
)
def _(v: Views) -> DataFrame:
    """The ten nearest nodes of each query's text within 400 bits."""
    k = v.table("casos_qa").select(F.col("item_id").alias("concepto"), T.words("consulta", 3).alias("palabras"), T.words("consulta", 2).alias("nombre"), F.lit(None).cast("string").alias("categoria"))
    none = v.spark.createDataFrame([], "concepto bigint, dim string, idf double"), v.spark.createDataFrame([], "a bigint, b string")
    asked = sdm.signatures(k, *none).select(F.col("concepto").alias("consulta"), "b")
    return sdm.search(parts(v, v.nodes), asked, 400, 10)


_DIRTY = "dirty AS (SELECT DISTINCT lower(trim(concepto, ' ')) AS concepto FROM sync_log WHERE sincronizado = 0 AND trim(concepto, ' ') <> '')"


def dirty(v: Views) -> DataFrame:
    return v.table("sync_log").where("sincronizado = 0").select(F.lower(F.trim("concepto")).alias("concepto")).where("concepto <> ''").distinct()


@C.add("ve8_selective_reindex", f"WITH {_SG}, {_DIRTY} SELECT sg.concepto, len(b) AS bits, d.concepto IS NOT NULL AS nuevo FROM sg LEFT JOIN dirty d ON d.concepto = sg.concepto", _ALL)
def _(v: Views) -> DataFrame:
    """The index after changed nodes alone were signed again: what a full reindex gives."""
    changed = dirty(v)
    fresh = parts(v, v.nodes.join(changed, "concepto", "left_semi")).withColumn("nuevo", F.lit(True))
    kept = parts(v, v.nodes.join(changed, "concepto", "left_anti")).withColumn("nuevo", F.lit(False))
    return fresh.unionByName(kept).select("concepto", F.size("b").cast("bigint").alias("bits"), "nuevo")


@C.add("str6_dirty_stream", f"WITH {_SG}, {_DIRTY} SELECT sg.concepto, len(b) AS bits FROM sg JOIN dirty USING (concepto)", _ALL)
def _(v: Views) -> DataFrame:
    """The change log as a stream: each micro-batch signs the nodes it names again, the last one stands."""
    changes = J.read_table(v.spark, v.dir, "sync_log").where("sincronizado = 0").select(F.lower(F.trim("concepto")).alias("concepto")).where("concepto <> ''")

    def sign(batch: DataFrame) -> DataFrame:
        return parts(v, v.nodes.join(batch.distinct(), "concepto", "left_semi")).select("concepto", F.size("b").cast("bigint").alias("bits"))

    return J.each_batch(changes, sign, ["concepto"])
