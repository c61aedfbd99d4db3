"""Search: the index, the candidate layers, the signals, the fusion and the rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quipu.functions import score as S
from quipu.functions import text as T
from quipu.operators.graph import first_per, propagate
from quipu.operators.search import bm25, inverted_index
from quipu.operators.unpack import unpack
from quipu.plans.relational import W
from quipu.plans.views import Catalogue, Views

C = Catalogue()
QUERIES, SQL = C.queries, C.sql

_IDX = f"""act AS (SELECT * FROM nodes WHERE estado = 'activo'),
idx AS (SELECT concepto, term, sum(w) AS tf FROM (
  SELECT concepto, unnest({W("replace(concepto, '_', ' ')", 3)}) AS term, 5.0 AS w FROM act
  UNION ALL SELECT concepto, unnest({W('contenido', 3)}), 1.0 FROM act UNION ALL SELECT concepto, unnest({W('sinonimos', 3)}), 2.0 FROM act) GROUP BY 1, 2),
dl AS (SELECT concepto, len({W("replace(concepto, '_', ' ')", 3)}) + len({W('contenido', 3)}) + len({W('sinonimos', 3)}) AS dl FROM act),
st AS (SELECT count(*) AS n, avg(dl) AS m FROM dl),
dfs AS (SELECT term, count(*) AS df FROM idx GROUP BY 1),
q AS (SELECT DISTINCT item_id AS consulta, unnest({W('consulta', 3)}) AS term FROM casos_qa),
hits AS (SELECT consulta, concepto, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / m))), 6) AS bm25, count(*) AS terminos
  FROM q JOIN dfs USING (term) JOIN idx USING (term) JOIN dl USING (concepto), st GROUP BY 1, 2)"""
_TOP = _IDX + """,
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY consulta ORDER BY bm25 DESC, concepto) AS rango FROM hits) WHERE rango <= 50)"""


def _w() -> WindowSpec:
    return Window.partitionBy("consulta")


def index(v: Views) -> tuple[DataFrame, DataFrame]:
    fields = {"concepto": (T.words(F.translate("concepto", "_", " "), 3), 5.0), "contenido": (T.words("contenido", 3), 1.0), "sinonimos": (T.words("sinonimos", 3), 2.0)}
    return inverted_index(v.active, "concepto", fields)


def asked(v: Views) -> DataFrame:
    return v.table("casos_qa").select(F.col("item_id").alias("consulta"), F.explode(F.array_distinct(T.words("consulta", 3))).alias("term"))


def hits(v: Views) -> DataFrame:
    return bm25(*index(v), asked(v), "concepto")


def top(v: Views, n: int = 50) -> DataFrame:
    return first_per(hits(v), ["consulta"], [F.desc("bm25"), F.asc("concepto")], n)


def hybrid_hits(v: Views) -> DataFrame:
    """The flagship: the candidates of all layers, scored by the hybrid of the signals that have data."""
    from quipu.plans import fusion

    return fusion.hybrid_hits(v)


@C.add("sf1b_bm25_topk", "WITH " + _TOP + " SELECT consulta, concepto, bm25 FROM top WHERE rango <= 5", "nodes")
def _(v: Views) -> DataFrame:
    return top(v, 5).select("consulta", "concepto", "bm25")


@C.add("sf1a_bm25_unit", "WITH " + _TOP + " SELECT consulta, concepto, round(bm25 / (bm25 + 3), 6) AS unidad FROM top WHERE rango <= 5", "nodes")
def _(v: Views) -> DataFrame:
    return top(v, 5).select("consulta", "concepto", F.round(S.bm25_unit(F.col("bm25")), 6).alias("unidad"))


@C.add("se6_hybrid_search")  # SQL: flagship.py
def _(v: Views) -> DataFrame:
    return first_per(hybrid_hits(v), ["consulta"], [F.desc("score"), F.asc("concepto")], 5).select("consulta", "concepto", "score")


@C.add("ag26_recall_mrr")  # SQL: flagship.py
def _(v: Views) -> DataFrame:
    ranked = first_per(hybrid_hits(v), ["consulta"], [F.desc("score"), F.asc("concepto")], 5).select(F.col("consulta").alias("item_id"), F.col("concepto").alias("esperado"), "rango")
    cases = v.table("casos_qa").where("concepto_esperado is not null").select("item_id", "categoria", F.lower("concepto_esperado").alias("esperado"))
    e = cases.join(ranked, ["item_id", "esperado"], "left")
    rate = lambda c: F.round(F.avg(c), 6)
    return e.groupBy("categoria").agg(
        F.count(F.lit(1)).alias("casos"),
        rate(F.col("rango").isNotNull().cast("double")).alias("recall5"),
        rate(F.coalesce((F.col("rango") == 1).cast("double"), F.lit(0.0))).alias("recall1"),
        rate(F.coalesce(1.0 / F.col("rango"), F.lit(0.0))).alias("mrr"),
    )


@C.add("pr13_coverage_gate", "WITH " + _TOP + """, n AS (SELECT consulta, count(*) AS n FROM q GROUP BY 1), g AS (SELECT top.*, n.n, terminos / CAST(n.n AS DOUBLE) >= 0.5 AS pasa FROM top JOIN n USING (consulta))
SELECT consulta, concepto FROM (SELECT *, count(*) FILTER (WHERE pasa) OVER (PARTITION BY consulta) AS alguno FROM g) WHERE pasa OR n < 2 OR alguno = 0""", "nodes")
def _(v: Views) -> DataFrame:
    n = asked(v).groupBy("consulta").agg(F.count(F.lit(1)).alias("n"))
    g = top(v).join(n, "consulta").withColumn("pasa", F.col("terminos") / F.col("n") >= 0.5)
    return g.withColumn("alguno", F.count_if("pasa").over(_w())).where("pasa or n < 2 or alguno = 0").select("consulta", "concepto")


@C.add("wn9_reciprocal_rank_fusion", "WITH " + _TOP + """, a AS (SELECT consulta, concepto, 1.0 / (60 + rango) AS s FROM top), b AS (SELECT t.consulta, t.concepto, 1.0 / (60 + row_number() OVER (PARTITION BY t.consulta ORDER BY act.peso DESC, t.concepto)) AS s FROM top t JOIN act USING (concepto))
SELECT consulta, concepto, round(sum(s), 6) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2""", "nodes")
def _(v: Views) -> DataFrame:
    t = top(v).join(v.active.select("concepto", "peso"), "concepto")
    second = F.row_number().over(_w().orderBy(F.desc("peso"), "concepto"))
    return t.withColumn("r2", second).select("consulta", "concepto", F.round(S.reciprocal_rank(F.col("rango")) + S.reciprocal_rank(F.col("r2")), 6).alias("rrf"))


@C.add("wn10_zscore", "WITH " + _TOP + " SELECT consulta, concepto, round((bm25 - avg(bm25) OVER w) / (stddev_pop(bm25) OVER w + 1e-9), 4) AS z FROM top WINDOW w AS (PARTITION BY consulta)", "nodes")
def _(v: Views) -> DataFrame:
    return top(v).select("consulta", "concepto", F.round((F.col("bm25") - F.avg("bm25").over(_w())) / (F.stddev_pop("bm25").over(_w()) + 1e-9), 4).alias("z"))


@C.add("wn11_max_normalised", "WITH " + _TOP + " SELECT consulta, concepto, round(bm25 / max(bm25) OVER (PARTITION BY consulta), 6) AS norma FROM top", "nodes")
def _(v: Views) -> DataFrame:
    return top(v).select("consulta", "concepto", F.round(T.ratio(F.col("bm25"), F.max("bm25").over(_w())), 6).alias("norma"))


_RERANK = "WITH " + _TOP + f""", j AS (SELECT consulta, concepto, rango, round(bm25 / max(bm25) OVER (PARTITION BY consulta), 6) AS s,
  round(CASE WHEN len(u) > 0 THEN len(list_intersect(x, y)) / CAST(len(u) AS DOUBLE) ELSE 0 END, 6) AS jac FROM (SELECT top.*, x, y, list_distinct(list_concat(x, y)) AS u FROM top
  JOIN (SELECT item_id, list_distinct({W('consulta', 3)}) AS x FROM casos_qa) k ON k.item_id = top.consulta JOIN (SELECT concepto, list_distinct({W('contenido', 3)}) AS y FROM act) a USING (concepto))),
m AS (SELECT *, max(jac) OVER (PARTITION BY consulta) AS mj FROM j)
SELECT consulta, concepto, row_number() OVER (PARTITION BY consulta ORDER BY rango = 1 DESC, CASE WHEN rango <= 20 AND mj >= 0.04 THEN round(0.75 * s + 0.25 * jac / mj, 6) ELSE s - 1 END DESC, concepto) AS puesto FROM m"""


@C.add("wn12_jaccard_rerank", _RERANK, "nodes")
def _(v: Views) -> DataFrame:
    near = v.table("casos_qa").select(F.col("item_id").alias("consulta"), F.array_distinct(T.words("consulta", 3)).alias("x"))
    held = v.active.select("concepto", F.array_distinct(T.words("contenido", 3)).alias("y"))
    j = top(v).join(F.broadcast(near), "consulta").join(held, "concepto")
    m = j.select("consulta", "concepto", "rango", F.round(T.ratio(F.col("bm25"), F.max("bm25").over(_w())), 6).alias("s"), F.round(T.jaccard(F.col("x"), F.col("y")), 6).alias("jac")).withColumn("mj", F.max("jac").over(_w()))
    order = F.when((F.col("rango") <= 20) & (F.col("mj") >= 0.04), F.round(0.75 * F.col("s") + 0.25 * F.col("jac") / F.col("mj"), 6)).otherwise(F.col("s") - 1)
    place = F.row_number().over(_w().orderBy(F.desc(F.col("rango") == 1), order.desc(), "concepto"))
    return m.select("consulta", "concepto", place.cast("bigint").alias("puesto"))


@C.add("wn13_inhibition", "WITH " + _TOP + ", n AS (SELECT consulta, concepto, bm25 / max(bm25) OVER (PARTITION BY consulta) AS s FROM top) SELECT consulta, concepto, round(CASE WHEN max(s) OVER (PARTITION BY consulta) >= 0.8 AND s < 0.7 * max(s) OVER (PARTITION BY consulta) THEN s * 0.6 ELSE s END, 6) AS score FROM n", "nodes")
def _(v: Views) -> DataFrame:
    n = top(v).withColumn("s", T.ratio(F.col("bm25"), F.max("bm25").over(_w())))
    return n.select("consulta", "concepto", F.round(S.inhibited(F.col("s"), ["consulta"]), 6).alias("score"))


@C.add("wn14_tie_extension", "WITH " + _TOP + ", c AS (SELECT consulta, bm25 AS corte FROM top WHERE rango = 5) SELECT consulta, concepto, rango FROM top LEFT JOIN c USING (consulta) WHERE rango <= 5 OR (rango <= 15 AND bm25 >= 0.9 * corte)", "nodes")
def _(v: Views) -> DataFrame:
    cut = F.max(F.when(F.col("rango") == 5, F.col("bm25"))).over(_w())
    return top(v, 15).withColumn("corte", cut).where("rango <= 5 or bm25 >= 0.9 * corte").select("consulta", "concepto", F.col("rango").cast("bigint").alias("rango"))


@C.add("sf6_bayesian_bm25", "WITH " + _TOP + " SELECT consulta, concepto, round(1 / (1 + exp(-(bm25 - 0.7 * median(bm25) OVER (PARTITION BY consulta)))), 6) AS p FROM top", "nodes")
def _(v: Views) -> DataFrame:
    return top(v).select("consulta", "concepto", F.round(S.bayesian_bm25(F.col("bm25"), F.median("bm25").over(_w())), 6).alias("p"))


@C.add(
    "gr3_seed_propagation",
    "WITH " + _TOP + """, s AS (SELECT consulta, concepto, bm25 / (bm25 + 3) AS s, rango FROM top), g AS (SELECT a AS x, count(*) AS n FROM und GROUP BY 1),
b AS (SELECT consulta, und.b AS concepto, sum(und.peso / pow(g.n, 0.3)) AS r FROM s JOIN und ON und.a = s.concepto JOIN g ON g.x = und.b WHERE rango <= 10 GROUP BY 1, 2)
SELECT s.consulta, s.concepto, round(0.75 * s.s + 0.25 * least(1.0, coalesce(b.r, 0) / 2.5), 6) AS score FROM s LEFT JOIN b ON b.consulta = s.consulta AND b.concepto = s.concepto""",
    "nodes edges und",
)
def _(v: Views) -> DataFrame:
    s = top(v).select("consulta", "concepto", S.bm25_unit(F.col("bm25")).alias("score"))
    return propagate(s, v.und).select("consulta", "concepto", F.round("score", 6).alias("score"))


@C.add("sf1d_latent_boost", "SELECT concepto, max(peso) AS latente FROM (SELECT a AS concepto, peso FROM und WHERE peso < 0.5) GROUP BY 1", "edges und")
def _(v: Views) -> DataFrame:
    return v.und.where("peso < 0.5").groupBy(F.col("a").alias("concepto")).agg(F.max("peso").alias("latente"))


@C.add(
    "se5_soft_and",
    "SELECT concepto, round(least(1.0, n / 3.0 + CASE WHEN c > 0 THEN 0.1 ELSE 0 END), 6) AS score FROM (SELECT concepto, peso, contains(t, 'umbral')::INT + contains(t, 'regla')::INT + contains(t, 'firme')::INT AS n, contains(concepto, 'umbral')::INT + contains(concepto, 'regla')::INT + contains(concepto, 'firme')::INT AS c FROM (SELECT *, lower(concepto || ' ' || coalesce(contenido, '')) AS t FROM nodes)) WHERE n > 0 ORDER BY 2 DESC, peso DESC, concepto LIMIT 100",
    "nodes",
)
def _(v: Views) -> DataFrame:
    ws = ("umbral", "regla", "firme")
    t = F.lower(F.concat_ws(" ", "concepto", T.text("contenido")))
    n = sum((F.contains(t, F.lit(w)).cast("int") for w in ws), F.lit(0))
    c = sum((F.contains("concepto", F.lit(w)).cast("int") for w in ws), F.lit(0))
    s = F.round(F.least(F.lit(1.0), n / 3.0 + F.when(c > 0, 0.1).otherwise(0.0)), 6)
    return v.nodes.where(n > 0).select("concepto", s.alias("score"), "peso").orderBy(F.desc("score"), F.desc("peso"), "concepto").limit(100).select("concepto", "score")


@C.add("se4_content_coverage", "WITH " + _IDX + ", n AS (SELECT consulta, count(*) AS n FROM q GROUP BY 1) SELECT consulta, concepto, round(count(*) / CAST(n AS DOUBLE), 6) AS cobertura FROM q JOIN n USING (consulta) JOIN idx USING (term) JOIN dfs USING (term) GROUP BY 1, 2, n HAVING count(*) / CAST(n AS DOUBLE) >= 0.3", "nodes")
def _(v: Views) -> DataFrame:
    n = asked(v).groupBy("consulta").agg(F.count(F.lit(1)).alias("n"))
    return hits(v).join(n, "consulta").select("consulta", "concepto", F.round(F.col("terminos") / F.col("n"), 6).alias("cobertura")).where("cobertura >= 0.3")


@C.add(
    "se1_exact_then_trigram",
    """SELECT item_id, n.concepto, 1.0 AS score FROM casos_qa k JOIN nodes n ON n.concepto = lower(trim(k.concepto_esperado, ' ')) WHERE n.estado <> 'dormido'""",
    "nodes",
)
def _(v: Views) -> DataFrame:
    k = v.table("casos_qa").select("item_id", F.lower(F.trim("concepto_esperado")).alias("concepto"))
    return v.nodes.where("estado <> 'dormido'").select("concepto").join(k, "concepto").select("item_id", "concepto", F.lit(1.0).alias("score"))


@C.add(
    "se6b_hub_expansion",
    rf"""WITH qt AS (SELECT DISTINCT item_id AS consulta, unnest({W('consulta', 2)}) AS t FROM casos_qa), ht AS (SELECT DISTINCT dim, unnest(regexp_extract_all(replace(concepto, '_', ' '), '[\p{{L}}\p{{N}}]{{2,}}')) AS t FROM dims),
nq AS (SELECT consulta, count(*) AS n FROM qt GROUP BY 1), nh AS (SELECT dim, count(*) AS n FROM ht GROUP BY 1)
SELECT consulta, dim AS hub_id, round(count(*) / CAST(nq.n + nh.n - count(*) AS DOUBLE), 6) AS confianza FROM qt JOIN ht USING (t) JOIN nq USING (consulta) JOIN nh USING (dim) GROUP BY 1, 2, nq.n, nh.n""",
    "dims",
)
def _(v: Views) -> DataFrame:
    qt = v.table("casos_qa").select(F.col("item_id").alias("consulta"), F.explode(T.hub_tokens("consulta")).alias("t"))
    ht = v.dims.select("dim", F.explode(T.hub_tokens(F.translate("concepto", "_", " "))).alias("t")).distinct()
    nq, nh = qt.groupBy("consulta").agg(F.count(F.lit(1)).alias("nq")), ht.groupBy("dim").agg(F.count(F.lit(1)).alias("nh"))
    both = qt.join(ht, "t").groupBy("consulta", "dim").agg(F.count(F.lit(1)).alias("n")).join(nq, "consulta").join(nh, "dim")
    return both.select("consulta", F.col("dim").alias("hub_id"), F.round(F.col("n") / (F.col("nq") + F.col("nh") - F.col("n")), 6).alias("confianza"))


@C.add("se6d_domain_expansion")
def _(v: Views) -> DataFrame:
    """Synonyms of the terms of a query by the domain dictionary, three of each at most."""
    syn = unpack(v.table("concept_hub_domain_dict"), "synonyms", ["term"]).where("posicion <= 3")
    by_word = syn.select(F.explode(T.words(F.translate("term", "_-.", "   "), 3)).alias("term"), F.lower("valor").alias("sinonimo"), "posicion").distinct()
    return asked(v).join(by_word, "term").select("consulta", "term", "sinonimo").distinct()


@C.add(
    "se6i_typo_fallback",
    r"""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(replace(concepto, '_', ' '), '[a-z0-9]{4,}')) AS w FROM nodes), q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(consulta), '[a-z0-9]{6,}')) AS w FROM casos_qa),
g AS (SELECT DISTINCT w, unnest(list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))) AS t FROM v), h AS (SELECT DISTINCT w, unnest(list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))) AS t FROM q)
SELECT h.w AS palabra, g.w AS parecida, round(count(*) / CAST(c.n AS DOUBLE), 6) AS contencion FROM h JOIN g USING (t) JOIN (SELECT w, count(*) AS n FROM h GROUP BY 1) c ON c.w = h.w GROUP BY 1, 2, c.n HAVING count(*) / CAST(c.n AS DOUBLE) >= 0.7""",
    "nodes",
)
def _(v: Views) -> DataFrame:
    words = lambda c, n: F.explode(F.regexp_extract_all(c, F.lit(f"[a-z0-9]{{{n},}}"), F.lit(0)))
    g = v.nodes.select(words(F.translate("concepto", "_", " "), 4).alias("parecida")).distinct().select("parecida", F.explode(T.trigrams("parecida")).alias("t"))
    h = v.table("casos_qa").select(words(F.lower("consulta"), 6).alias("palabra")).distinct().select("palabra", F.size(T.trigrams("palabra")).alias("n"), F.explode(T.trigrams("palabra")).alias("t"))
    hit = h.join(g, "t").groupBy("palabra", "parecida", "n").agg(F.count(F.lit(1)).alias("k"))
    return hit.where(F.col("k") / F.col("n") >= 0.7).select("palabra", "parecida", F.round(F.col("k") / F.col("n"), 6).alias("contencion"))


@C.add("se6q_dimensional_fallback", "SELECT x.concepto AS semilla, y.concepto, count(*) AS comunes FROM dims x JOIN dims y USING (dim) WHERE x.concepto <> y.concepto GROUP BY 1, 2 HAVING count(*) >= 2", "dims")
def _(v: Views) -> DataFrame:
    x, y = v.dims.withColumnRenamed("concepto", "semilla"), v.dims
    return x.join(y, "dim").where("semilla <> concepto").groupBy("semilla", "concepto").agg(F.count(F.lit(1)).alias("comunes")).where("comunes >= 2")


@C.add("se8_validate_words", "WITH " + _IDX + " SELECT term, df FROM dfs WHERE term IN (SELECT term FROM q)", "nodes")
def _(v: Views) -> DataFrame:
    met = index(v)[0].join(F.broadcast(asked(v).select("term").distinct()), "term", "left_semi")
    return met.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@C.add("se7_burst", "WITH " + _TOP + " SELECT concepto, count(*) AS rafagas, round(sum(terminos) / CAST(count(*) AS DOUBLE), 6) AS densidad FROM top WHERE rango <= 10 GROUP BY 1", "nodes")
def _(v: Views) -> DataFrame:
    return top(v, 10).groupBy("concepto").agg(F.count(F.lit(1)).alias("rafagas"), F.round(F.sum("terminos") / F.count(F.lit(1)), 6).alias("densidad"))


_PAIR = f"par AS (SELECT k.item_id, k.consulta, n.concepto, n.contenido FROM casos_qa k JOIN nodes n ON n.concepto = lower(trim(k.concepto_esperado, ' ')))"


def pairs(v: Views) -> DataFrame:
    k = v.table("casos_qa").select("item_id", "consulta", F.lower(F.trim("concepto_esperado")).alias("concepto"))
    return k.join(v.nodes.select("concepto", "contenido"), "concepto")


def _sets(name: str, ours, sql: str) -> None:
    x, y = f"list_distinct({W('consulta', 3)})", f"list_distinct({W('contenido', 3)})"
    body = f"WITH {_PAIR}, s AS (SELECT item_id, {x} AS x, {y} AS y FROM par) SELECT item_id, round(coalesce({sql}, 0), 6) AS s FROM s"

    @C.add(name, body, "nodes")
    def _(v: Views) -> DataFrame:
        q, c = F.array_distinct(T.words("consulta", 3)), F.array_distinct(T.words("contenido", 3))
        return pairs(v).select("item_id", F.round(ours(q, c), 6).alias("s"))


_sets("sf2b_content_coverage", T.coverage, "len(list_intersect(x, y)) / nullif(CAST(len(x) AS DOUBLE), 0)")
_sets("sf9_overlap_coefficient", T.overlap, "len(list_intersect(x, y)) / nullif(CAST(least(len(x), len(y)) AS DOUBLE), 0)")
_sets("sf11_token_jaccard", T.jaccard, "len(list_intersect(x, y)) / nullif(CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE), 0)")


@C.add(
    "sf7_trigram_jaccard",
    r"""WITH g AS (SELECT concepto, CASE WHEN length(s) >= 3 THEN list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) ELSE [s] END AS t FROM (SELECT concepto, regexp_replace(concepto, '[^a-z0-9]', '', 'g') AS s FROM nodes))
SELECT a.concepto AS a, b.concepto AS b, round(len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE), 6) AS s FROM g a JOIN g b ON a.concepto < b.concepto AND list_has_any(a.t, b.t)
WHERE len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE) >= 0.55""",
    "nodes",
)
def _(v: Views) -> DataFrame:
    from quipu.operators.similar import jaccard_join

    sets = v.nodes.select(F.col("concepto").alias("k"), T.trigrams("concepto").alias("s"))
    return jaccard_join(sets, 0.55).select("a", "b", F.round("jaccard", 6).alias("s"))


@C.add(
    "sf5_edit_similarity",
    rf"""WITH {_PAIR}, q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(consulta), '[a-z0-9]{{4,}}')) AS t FROM par), c AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(concepto, '[a-z0-9]{{3,}}')) AS u FROM par)
SELECT item_id, t, round(max(1.0 - levenshtein(t, u) / CAST(greatest(length(t), length(u)) AS DOUBLE)), 6) AS s FROM q JOIN c USING (item_id) GROUP BY 1, 2""",
    "nodes",
)
def _(v: Views) -> DataFrame:
    p = pairs(v)
    q = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("consulta"), F.lit("[a-z0-9]{4,}"), F.lit(0)))).alias("t")
    c = F.regexp_extract_all("concepto", F.lit("[a-z0-9]{3,}"), F.lit(0))
    best = F.array_max(F.transform("c", lambda u: T.similarity(F.col("t"), u)))
    return p.select("item_id", q, c.alias("c")).where("size(c) > 0").select("item_id", "t", F.round(best, 6).alias("s"))


@C.add(
    "sf3_jensen_shannon",
    f"""WITH {_PAIR}, t AS (SELECT item_id, 0 AS lado, unnest({W('consulta', 3)}) AS w FROM par UNION ALL SELECT item_id, 1, unnest({W('contenido', 3)}) FROM par),
c AS (SELECT item_id, w, count(*) FILTER (WHERE lado = 0) AS x, count(*) FILTER (WHERE lado = 1) AS y FROM t GROUP BY 1, 2),
p AS (SELECT item_id, (x + 0.01) / (sum(x) OVER i + 0.01 * count(*) OVER i) AS p, (y + 0.01) / (sum(y) OVER i + 0.01 * count(*) OVER i) AS q FROM c WINDOW i AS (PARTITION BY item_id))
SELECT item_id, round(1 - sqrt(least(1.0, greatest(0.0, sum(0.5 * p * ln(2 * p / (p + q)) + 0.5 * q * ln(2 * q / (p + q)))))), 6) AS s FROM p GROUP BY 1""",
    "nodes",
)
def _(v: Views) -> DataFrame:
    p = pairs(v)
    side = lambda c, n: p.select("item_id", F.lit(n).alias("lado"), F.explode(T.words(c, 3)).alias("w"))
    c = side("consulta", 0).unionByName(side("contenido", 1)).groupBy("item_id", "w").agg(F.count_if(F.col("lado") == 0).alias("x"), F.count_if(F.col("lado") == 1).alias("y"))
    i = Window.partitionBy("item_id")
    smooth = lambda n: (F.col(n) + 0.01) / (F.sum(n).over(i) + 0.01 * F.count(F.lit(1)).over(i))
    d = c.select("item_id", smooth("x").alias("p"), smooth("y").alias("q"))
    jsd = F.sum(0.5 * F.col("p") * F.log(2 * F.col("p") / (F.col("p") + F.col("q"))) + 0.5 * F.col("q") * F.log(2 * F.col("q") / (F.col("p") + F.col("q"))))
    return d.groupBy("item_id").agg(F.round(1 - F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), jsd))), 6).alias("s"))
