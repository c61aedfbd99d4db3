"""SQL of the flagship: the layers and the ten signals, from the SQL of the queries that give them."""

from __future__ import annotations

from quipu.plans import fusion, meaning, memory, search
from quipu.plans.relational import W
from quipu.plans.search import _TOP
from quipu.plans.vectors import _QV, _VEC
from quipu.plans.views import Catalogue, with_views

C = Catalogue()
QUERIES, SQL = C.queries, C.sql

_NAME = W("replace(a.concepto, '_', ' ')", 3)
_FLAG = (
    "WITH "
    + _TOP
    + ", "
    + _VEC
    + ", "
    + _QV
    + f""",
hb AS (SELECT consulta, concepto, max(confianza) AS hub FROM dims JOIN ({search.SQL['se6b_hub_expansion']}) h ON h.hub_id = dim WHERE confianza >= 0.25 GROUP BY 1, 2),
fnd AS (SELECT consulta FROM top GROUP BY 1 HAVING count(*) >= {fusion.FEW}),
ch AS (SELECT CAST(consulta AS BIGINT) AS consulta, concepto, activacion FROM ({memory.SQL['se6m_chain_evocation']})),
vs AS (SELECT consulta, concepto FROM (SELECT *, row_number() OVER (PARTITION BY consulta ORDER BY coseno DESC, concepto) AS r FROM (SELECT consulta, k AS concepto, round(list_cosine_similarity(qv.v, CAST(vec.v AS DOUBLE[])), 6) AS coseno FROM qv, vec) WHERE coseno > 0) WHERE r <= 50),
lt AS (SELECT consulta, concepto FROM (SELECT *, row_number() OVER (PARTITION BY consulta ORDER BY peso DESC, concepto) AS r FROM (SELECT consulta, und.b AS concepto, max(und.peso) AS peso FROM top JOIN und ON und.a = top.concepto AND und.peso < 0.5 WHERE rango <= 5 GROUP BY 1, 2)) WHERE r <= 20),
ty AS (SELECT DISTINCT w.consulta, n.concepto FROM (SELECT item_id AS consulta, unnest(regexp_extract_all(lower(consulta), '[a-z0-9]{{6,}}')) AS palabra FROM casos_qa) w JOIN ({search.SQL['se6i_typo_fallback']}) t USING (palabra) JOIN (SELECT concepto, unnest(regexp_extract_all(replace(concepto, '_', ' '), '[a-z0-9]{{4,}}')) AS parecida FROM act) n USING (parecida)),
cd AS (SELECT consulta, concepto FROM top UNION SELECT consulta, concepto FROM ({memory.SQL['se6e_near']}) UNION SELECT consulta, concepto FROM hb UNION SELECT consulta, concepto FROM vs UNION SELECT consulta, concepto FROM ch UNION SELECT consulta, concepto FROM lt
  UNION SELECT consulta, concepto FROM ({memory.SQL['se6h_prefix_layer']}) WHERE consulta NOT IN (SELECT consulta FROM fnd) UNION SELECT consulta, concepto FROM ty WHERE consulta NOT IN (SELECT consulta FROM fnd)),
sig AS (SELECT cd.consulta, cd.concepto, list_distinct({W('k.consulta', 3)}) AS q, {_NAME} AS c, {W('a.sinonimos', 3)} AS s, coalesce(bm25, 0) AS b, a.peso, coalesce(g.n, 0) AS g, coalesce(coseno, 0) AS dim,
    greatest(coalesce(latente, 0), coalesce(activacion, 0)) AS lat, coalesce(tema, 0) AS tema, coalesce(least(1.0, 2 * hub), 0) AS hub, greatest(0.0, coalesce(list_cosine_similarity(qv.v, CAST(vec.v AS DOUBLE[])), 0.0)) AS vec
  FROM cd JOIN act a ON a.concepto = cd.concepto JOIN casos_qa k ON k.item_id = cd.consulta LEFT JOIN hits h ON h.consulta = cd.consulta AND h.concepto = cd.concepto
  LEFT JOIN (SELECT a AS x, count(*) AS n FROM und GROUP BY 1) g ON g.x = cd.concepto LEFT JOIN (SELECT a AS x, max(peso) AS latente FROM und WHERE peso < 0.5 GROUP BY 1) l ON l.x = cd.concepto
  LEFT JOIN ({memory.SQL['sf1i_dimension_cosine']}) d ON d.consulta = cd.consulta AND d.concepto = cd.concepto LEFT JOIN ch ON ch.consulta = cd.consulta AND ch.concepto = cd.concepto
  LEFT JOIN ({meaning.SQL['sf1e_theme_signal']}) t ON t.consulta = cd.consulta AND t.concepto = cd.concepto LEFT JOIN hb ON hb.consulta = cd.consulta AND hb.concepto = cd.concepto
  LEFT JOIN qv ON qv.consulta = cd.consulta LEFT JOIN vec ON vec.k = cd.concepto),
sc AS (SELECT *, CASE WHEN len(q) > 0 THEN len(list_intersect(q, s)) / CAST(len(q) AS DOUBLE) ELSE 0 END AS syn, CASE WHEN len(q) > 0 THEN len(list_intersect(q, c)) / CAST(len(q) AS DOUBLE) ELSE 0 END AS nam FROM sig),
pp AS (SELECT *, (0.25 * (b / (b + 3)) + 0.14 * dim + 0.08 * nam + 0.08 * syn + 0.10 * peso + 0.10 * lat + 0.08 * tema + 0.02 * least(1.0, g / 20.0) + 0.20 * hub + 0.15 * vec) / 1.54 AS p0 FROM sc),
pq AS (SELECT *, least(1 - 1e-6, greatest(1e-6, p0)) AS p FROM pp),
hyb AS (SELECT consulta, concepto, round(CASE WHEN len(list_filter(q, lambda x: NOT list_contains(c, x))) + len(list_filter(c, lambda x: NOT list_contains(q, x))) = 0 THEN 1 / (1 + exp(-(ln(p / (1 - p)) + 2.94)))
  WHEN syn >= 0.95 THEN 1 / (1 + exp(-(ln(p / (1 - p)) + ln((0.7 + 0.1 * vec) / (0.3 - 0.1 * vec))))) ELSE p0 END, 6) AS score FROM pq)"""
)


C.sql["se6_hybrid_search"] = with_views(_FLAG + " SELECT consulta, concepto, score FROM (SELECT *, row_number() OVER (PARTITION BY consulta ORDER BY score DESC, concepto) AS r FROM hyb) WHERE r <= 5", "nodes", "edges", "und", "dims")
C.sql["ag26_recall_mrr"] = with_views(
    _FLAG
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY consulta ORDER BY score DESC, concepto) AS r FROM hyb),
e AS (SELECT k.categoria, r.r FROM casos_qa k LEFT JOIN r ON r.consulta = k.item_id AND r.concepto = lower(k.concepto_esperado) AND r.r <= 5 WHERE concepto_esperado IS NOT NULL)
SELECT categoria, count(*) AS casos, round(avg(CASE WHEN r IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS recall5, round(avg(CASE WHEN r = 1 THEN 1.0 ELSE 0.0 END), 6) AS recall1, round(avg(coalesce(1.0 / r, 0.0)), 6) AS mrr FROM e GROUP BY 1""",
    "nodes",
    "edges",
    "und",
    "dims",
)
