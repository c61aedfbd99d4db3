"""Normalised views of the tables, as DataFrames and as SQL with the same meaning."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quipu.operators.cut import cut
from quipu.sources import key, table

#: Categories by id, with their decay rates.
CATEGORIES = [
    (1, "System", 1.0),
    (2, "Architecture", 1.0),
    (3, "Project", 1.5),
    (4, "Lesson", 1.0),
    (5, "Profile", 0.05),
    (6, "Personal", 1.0),
    (7, "Principle", 0.2),
    (8, "Protocol", 0.5),
    (9, "Cognition", 1.0),
    (10, "Relation", 1.0),
    (11, "General", 2.0),
]

_NODE_ORDER = "ultimo_acceso contenido id categoria peso_sinaptico estado asociaciones sinonimos creado_en valencia_somatica exitos_dopamina fallos_dopamina prioridad".split()


class Views:
    """The tables of one folder. Every view is built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def written(self) -> Views:
        """The same views with the nodes and the undirected edges written once, for plans that read them often."""
        other = Views(self.spark, self.dir)
        other.__dict__.update(nodes=cut(self.nodes), und=cut(self.und))
        return other

    @cached_property
    def nodes(self) -> DataFrame:
        """One row per concept: its latest version. Weights outside [0, 1] count as 0, no state as activo."""
        rows = self.table("largo_plazo").withColumn("concepto", key("concepto")).where("concepto is not null")
        last = rows.groupBy("concepto").agg(F.max(F.struct(*_NODE_ORDER)).alias("r")).select("concepto", "r.*")
        w = F.col("peso_sinaptico")
        return last.select(
            "concepto",
            "id",
            "categoria",
            "contenido",
            F.when((w >= 0) & (w <= 1), w).otherwise(0.0).alias("peso"),
            F.coalesce(key("estado"), F.lit("activo")).alias("estado"),
            "asociaciones",
            "sinonimos",
            "ultimo_acceso",
            "creado_en",
            F.coalesce("valencia_somatica", F.lit(0.0)).alias("valencia"),
            F.coalesce("exitos_dopamina", F.lit(0)).alias("exitos"),
            F.coalesce("fallos_dopamina", F.lit(0)).alias("fallos"),
            "prioridad",
        )

    @cached_property
    def active(self) -> DataFrame:
        return self.nodes.where("estado = 'activo'")

    @cached_property
    def edges(self) -> DataFrame:
        """One row per origin and target: greatest valid weight, its type, first creation, last use."""
        rows = self.table("sinapsis").select(key("origen").alias("origen"), key("destino").alias("destino"), "peso", F.coalesce(key("tipo"), F.lit("manual")).alias("tipo"), "creado_en", "ultimo_uso")
        good = rows.where("origen is not null and destino is not null and origen <> destino and peso >= 0 and peso <= 1 and not isnan(peso)")
        merged = good.groupBy("origen", "destino").agg(F.max(F.struct("peso", "tipo")).alias("m"), F.min("creado_en").alias("creado"), F.max("ultimo_uso").alias("uso"))
        return merged.select("origen", "destino", "m.peso", "m.tipo", "creado", "uso")

    @cached_property
    def weights(self) -> DataFrame:
        """origen, destino, peso of the edges: for plans that need no more of them."""
        rows = self.table("sinapsis").where("peso >= 0 and peso <= 1 and not isnan(peso)").select(key("origen").alias("origen"), key("destino").alias("destino"), "peso")
        return rows.where("origen is not null and destino is not null and origen <> destino").groupBy("origen", "destino").agg(F.max("peso").alias("peso"))

    @cached_property
    def und(self) -> DataFrame:
        """a, b, peso: both directions of every edge, the greatest weight; from the rows at once, so they are shuffled once."""
        rows = self.table("sinapsis").where("peso >= 0 and peso <= 1 and not isnan(peso)").select(key("origen").alias("o"), key("destino").alias("d"), "peso").where("o is not null and d is not null and o <> d")
        ends = F.inline(F.array(F.struct(F.col("o").alias("a"), F.col("d").alias("b")), F.struct(F.col("d").alias("a"), F.col("o").alias("b"))))
        return rows.select("peso", ends).groupBy("a", "b").agg(F.max("peso").alias("peso"))

    @cached_property
    def dims(self) -> DataFrame:
        """Ontology tags: concept, hub."""
        return self.table("concept_hub_nodes").select(key("node_concepto").alias("concepto"), F.col("hub_id").alias("dim")).where("concepto is not null and dim is not null").distinct()

    @cached_property
    def categories(self) -> DataFrame:
        return self.spark.createDataFrame(CATEGORIES, "cid int, nombre string, decay double")

    @cached_property
    def log(self) -> DataFrame:
        """The event stream as a search log, one session per user."""
        return self.table("events").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "value")


SQL_NODES = """nodes AS (
  SELECT concepto, id, categoria, contenido, CASE WHEN peso_sinaptico >= 0 AND peso_sinaptico <= 1 THEN peso_sinaptico ELSE 0.0 END AS peso,
    coalesce(nullif(lower(trim(estado, ' ')), ''), 'activo') AS estado, asociaciones, sinonimos, ultimo_acceso, creado_en,
    coalesce(valencia_somatica, 0.0) AS valencia, coalesce(exitos_dopamina, 0) AS exitos, coalesce(fallos_dopamina, 0) AS fallos, prioridad
  FROM (SELECT * REPLACE (lower(trim(concepto, ' ')) AS concepto), row_number() OVER (PARTITION BY lower(trim(concepto, ' ')) ORDER BY
    """ + ", ".join(f"{c} DESC NULLS LAST" for c in _NODE_ORDER) + """) AS rn FROM largo_plazo WHERE trim(concepto, ' ') <> '') WHERE rn = 1)"""
SQL_EDGES = """er AS (
  SELECT lower(trim(origen, ' ')) AS origen, lower(trim(destino, ' ')) AS destino, peso, coalesce(nullif(lower(trim(tipo, ' ')), ''), 'manual') AS tipo, creado_en, ultimo_uso
  FROM sinapsis WHERE trim(origen, ' ') <> '' AND trim(destino, ' ') <> '' AND peso >= 0 AND peso <= 1 AND NOT isnan(peso)),
eg AS (SELECT origen, destino, max(peso) AS peso, min(creado_en) AS creado, max(ultimo_uso) AS uso FROM er WHERE origen <> destino GROUP BY 1, 2),
edges AS (SELECT eg.origen, eg.destino, eg.peso, max(er.tipo) AS tipo, any_value(creado) AS creado, any_value(uso) AS uso FROM eg JOIN er ON er.origen = eg.origen AND er.destino = eg.destino AND er.peso = eg.peso GROUP BY 1, 2, 3)"""
SQL_UND = "und AS (SELECT a, b, max(peso) AS peso FROM (SELECT origen AS a, destino AS b, peso FROM edges UNION ALL SELECT destino, origen, peso FROM edges) GROUP BY 1, 2)"
SQL_DIMS = "dims AS (SELECT DISTINCT lower(trim(node_concepto, ' ')) AS concepto, hub_id AS dim FROM concept_hub_nodes WHERE trim(node_concepto, ' ') <> '' AND hub_id IS NOT NULL)"
SQL_CAT = "cat(cid, nombre, decay) AS (VALUES " + ", ".join(f"({i}, '{n}', CAST({d} AS DOUBLE))" for i, n, d in CATEGORIES) + ")"
_PARTS = {"nodes": SQL_NODES, "edges": SQL_EDGES, "und": SQL_UND, "dims": SQL_DIMS, "cat": SQL_CAT}


def with_views(sql: str, *names: str) -> str:
    """sql behind the common table expressions of the views it names."""
    parts = [_PARTS[n] for n in names]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


class Catalogue:
    """Queries by name, with their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}
        self.of: dict[str, Callable[[Views], DataFrame]] = {}  # the same on views that are there already

    def add(self, name: str, sql: str | None = None, views: str = "") -> Callable:
        def keep(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
            self.queries[name] = lambda spark, d: f(Views(spark, d))
            self.of[name] = f
            if sql:
                self.sql[name] = with_views(sql, *views.split()) if views else sql.strip()
            return f

        return keep
