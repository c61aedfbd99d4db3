"""Registered queries of this subpackage, with their SQL where SQL can say them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quipu.llm.encode import decode, encode
from quipu.llm.leaks import leaks
from quipu.llm.neighbours import most_similar
from quipu.llm.spans import shared_spans
from quipu.llm.together import pairs_of_scope
from quipu.llm.topn import top_n
from quipu.sources import key, table

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, owner in (("nodos", "concepto"), ("tokens", "token")):
        rows = table(spark, d, name).select(F.col(owner).alias("_k"), F.col("vector").alias("_v"))
        pairs = most_similar(rows, 10, 100, 0.90)
        parts.append(pairs.select(F.lit(name).alias("tabla"), F.least("_k", "_b").alias("clave_a"), F.greatest("_k", "_b").alias("clave_b")).distinct())
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "sinapsis")
    good = edges.where("peso >= 0 and peso <= 1 and not isnan(peso)").select(key("origen").alias("origen"), key("destino").alias("destino"), "peso")
    return top_n(good, "origen", "destino", "peso", 5).select("origen", "destino")


def _words_and_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "largo_plazo").where("id is not null")
    last = rows.groupBy("id").agg(F.max(F.struct(F.col("ultimo_acceso").isNotNull(), "ultimo_acceso", "contenido")).alias("_r"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("_r.contenido"), F.lit(r"[\p{L}\p{N}_]{4,}"), F.lit(0)))
    contents = last.select(F.lit("contenido").alias("_scope"), F.col("id").cast("string").alias("_rec"), F.explode(words).alias("_item"))
    kinds = table(spark, d, "sinapsis").select(F.lit("tipo").alias("_scope"), key("origen").alias("_rec"), key("tipo").alias("_item")).where("_rec is not null and _item is not null").distinct()
    return contents.unionByName(kinds)


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = _words_and_kinds(spark, d)
    return pairs_of_scope(pairs, "contenido", 9, 6).unionByName(pairs_of_scope(pairs, "tipo", 9, 2))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pairs(spark, d).select("ambito", "item_a", "item_b")


def _vocabulary() -> str:
    return os.path.join(TOKENIZERS, VOCABULARY)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), "doc_id", "text", _vocabulary())


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose decoded ids differ from the text: none."""
    texts = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("_original"))
    back = decode(p6_ids(spark, d), "doc_id", "ids", _vocabulary())
    return texts.join(back, "doc_id").where(F.col("_original") != F.col("text")).select("doc_id")


def p7_coverage(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    items = table(spark, d, "casos_qa").select(F.col("item_id").alias("_item"), F.col("pasaje").alias("_passage"))
    return leaks(documents, items).withColumnsRenamed({"_id": "doc_id", "_item": "item_id"})


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_coverage(spark, d).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """The leaked items, with the documents that carry them and the most of one that one holds."""
    return p7_coverage(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documentos"), F.max("mas_larga").alias("mas_larga"), F.round(F.max("cobertura"), 6).alias("cobertura"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    return shared_spans(documents, 300).withColumnRenamed("_id", "doc_id")


def p8_share(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document is shared: stretches, characters, and their part of the text."""
    spans = p8_found(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("tramos"), F.sum(F.col("fin") - F.col("inicio")).alias("compartidos"))
    sizes = table(spark, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("largo"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    part = F.when(F.col("largo") > 0, F.coalesce(F.col("compartidos"), F.lit(0)) / F.col("largo")).otherwise(0.0)
    return sizes.join(spans, "doc_id", "left").select("doc_id", "largo", zero("tramos"), zero("compartidos"), F.round(part, 6).alias("parte"))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_pairs": p4_pairs,
    "p6_ids": p6_ids,
    "p6_round_trip": p6_round_trip,
    "p7_found": p7_found,
    "p7_coverage": p7_coverage,
    "p7_items": p7_items,
    "p8_found": p8_found,
    "p8_share": p8_share,
}

_P4 = r"""
WITH last AS (SELECT id, contenido, row_number() OVER (PARTITION BY id ORDER BY ultimo_acceso DESC NULLS LAST, contenido DESC NULLS LAST) AS r FROM largo_plazo),
it AS (
  SELECT DISTINCT 'contenido' AS ambito, CAST(id AS VARCHAR) AS rec, unnest(regexp_extract_all(lower(contenido), '[\p{L}\p{N}_]{4,}')) AS item FROM last WHERE r = 1
  UNION
  SELECT DISTINCT 'tipo', lower(trim(origen, ' ')), lower(trim(tipo, ' ')) FROM sinapsis WHERE trim(origen, ' ') <> '' AND trim(tipo, ' ') <> ''),
tot AS (SELECT ambito, count(DISTINCT rec) AS n FROM it GROUP BY 1),
c AS (SELECT ambito, item, count(*) AS n FROM it GROUP BY 1, 2),
ab AS (SELECT x.ambito, x.item AS item_a, y.item AS item_b, count(*) AS n_ab FROM it x JOIN it y ON x.ambito = y.ambito AND x.rec = y.rec AND x.item < y.item GROUP BY 1, 2, 3),
pares AS (
  SELECT ab.ambito, item_a, item_b, n_ab, a.n AS n_a, b.n AS n_b, tot.n, n_ab * CAST(tot.n AS DOUBLE) / (a.n * b.n) AS lift
  FROM ab JOIN c a ON a.ambito = ab.ambito AND a.item = item_a JOIN c b ON b.ambito = ab.ambito AND b.item = item_b JOIN tot ON tot.ambito = ab.ambito
  WHERE n_ab >= 9 AND n_ab * tot.n >= CASE ab.ambito WHEN 'contenido' THEN 6 ELSE 2 END * a.n * b.n)
"""

_P8 = """
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 300),
w AS (SELECT doc_id, i, md5(substr(text, i + 1, 300)) AS h FROM (SELECT doc_id, text, unnest(range(0, n - 299)) AS i FROM d)),
s AS (SELECT h FROM w GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 300 THEN 0 ELSE 1 END AS nuevo FROM w WHERE h IN (SELECT h FROM s)),
r AS (SELECT doc_id, i, sum(nuevo) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
tramos AS (SELECT doc_id, min(i) AS inicio, max(i) + 300 AS fin FROM r GROUP BY doc_id, k)
"""

SQL = {
    "p8_found": _P8 + "SELECT doc_id, inicio, fin FROM tramos",
    "p8_share": _P8
    + """, t AS (SELECT doc_id, count(*) AS tramos, CAST(sum(fin - inicio) AS BIGINT) AS compartidos FROM tramos GROUP BY 1)
SELECT d.doc_id, coalesce(length(d.text), 0) AS largo, coalesce(t.tramos, 0) AS tramos, coalesce(compartidos, 0) AS compartidos, round(CASE WHEN length(d.text) > 0 THEN coalesce(compartidos, 0) / CAST(length(d.text) AS DOUBLE) ELSE 0.0 END, 6) AS parte
FROM documents d LEFT JOIN t USING (doc_id)""",
    "p2_found": """
SELECT origen, destino FROM (
  SELECT origen, destino, row_number() OVER (PARTITION BY origen ORDER BY w DESC, destino) AS r FROM (
    SELECT lower(trim(origen, ' ')) AS origen, lower(trim(destino, ' ')) AS destino, max(peso) AS w FROM sinapsis
    WHERE trim(origen, ' ') <> '' AND trim(destino, ' ') <> '' AND peso >= 0 AND peso <= 1 AND NOT isnan(peso) GROUP BY 1, 2))
WHERE r <= 5""",
    "p4_found": _P4 + "SELECT ambito, item_a, item_b FROM pares",
    "p4_pairs": _P4 + "SELECT ambito, item_a, item_b, n_ab, n_a, n_b, n, lift FROM pares",
}
