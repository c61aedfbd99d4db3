"""Registered queries of the general data-quality operators, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quipu.operators.references import broken_references, reference_report
from quipu.operators.unpack import unpack
from quipu.sources import key, table


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    parents = table(spark, d, "largo_plazo").select(key("concepto").alias("clave"), F.col("creado_en").cast("timestamp_ntz").alias("creado"))
    edges = table(spark, d, "sinapsis")
    times = table(spark, d, "concept_hubs").select("hub_id", "created_at")
    members = table(spark, d, "concept_hub_nodes")
    hubs = members.join(times, "hub_id", "left").select(
        F.lit("concept_hub_nodes").alias("tabla"), F.lit("node_concepto").alias("campo"), "fila", key("node_concepto").alias("clave"), F.col("created_at").cast("timestamp_ntz").alias("momento")
    )
    # both ends of an edge from one scan
    ends = edges.select("fila", F.col("creado_en").cast("timestamp_ntz").alias("momento"), F.inline(F.array(*(F.struct(F.lit(c).alias("campo"), key(c).alias("clave")) for c in ("origen", "destino")))))
    children = ends.select(F.lit("sinapsis").alias("tabla"), "campo", "fila", "clave", "momento").unionByName(hubs)
    return parents, children, 2 * edges.count() + members.count()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return broken_references(*_references(spark, d)).select("tabla", "campo", "fila")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    deleted = table(spark, d, "sync_log").where(F.lower(F.trim("accion")) == "delete").select(key("concepto").alias("clave"))
    return reference_report(broken_references(*_references(spark, d)), deleted)


_P3_BROKEN = r"""
WITH p AS (SELECT lower(trim(concepto, ' ')) AS clave, min(creado_en) AS creado FROM largo_plazo GROUP BY 1),
r AS (
  SELECT 'sinapsis' AS tabla, 'origen' AS campo, fila, lower(trim(origen, ' ')) AS clave, creado_en AS momento FROM sinapsis
  UNION SELECT 'sinapsis', 'destino', fila, lower(trim(destino, ' ')), creado_en FROM sinapsis
  UNION SELECT 'concept_hub_nodes', 'node_concepto', fila, lower(trim(node_concepto, ' ')), created_at
  FROM concept_hub_nodes LEFT JOIN concept_hubs USING (hub_id)),
roto AS (
  SELECT tabla, campo, fila, r.clave, momento, p.clave IS NOT NULL AS tardia
  FROM r LEFT JOIN p ON r.clave = p.clave
  WHERE r.clave <> '' AND (p.clave IS NULL OR momento < creado))
"""

_PACKED = [("largo_plazo", "id", "sinonimos"), ("largo_plazo", "id", "asociaciones"), ("concept_hub_domain_dict", "term", "synonyms")]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, owner, field in _PACKED:
        rows = table(spark, d, name).select(F.col(owner).cast("string").alias("clave"), field)
        parts.append(unpack(rows, field, ["clave"]).select(F.lit(name).alias("tabla"), "clave", F.lit(field).alias("campo"), "posicion", "valor"))
    return reduce(DataFrame.unionByName, parts).distinct()


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p5_found": p5_found}

SQL = {
    "p3_found": _P3_BROKEN + "SELECT DISTINCT tabla, campo, fila FROM roto",
    "p3_report": _P3_BROKEN
    + """, del AS (SELECT DISTINCT lower(trim(concepto, ' ')) AS clave FROM sync_log WHERE lower(trim(accion, ' ')) = 'delete')
SELECT tabla, campo, coalesce(strftime(momento, '%Y-%m'), 'sin_fecha') AS periodo,
  CAST(count(*) FILTER (WHERE NOT tardia AND del.clave IS NULL) AS BIGINT) AS nunca,
  CAST(count(*) FILTER (WHERE NOT tardia AND del.clave IS NOT NULL) AS BIGINT) AS borradas,
  CAST(count(*) FILTER (WHERE tardia) AS BIGINT) AS tardias
FROM roto LEFT JOIN del USING (clave) GROUP BY 1, 2, 3""",
}
