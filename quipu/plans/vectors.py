"""Distributional queries, vectors, signatures and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quipu.functions import score as S
from quipu.functions import text as T
from quipu.functions.stem import with_stems
from quipu.operators import calibration as K
from quipu.operators import distribution as D
from quipu.operators.graph import first_per
from quipu.operators.running import running_before
from quipu.plans.relational import W
from quipu.plans.search import _IDX, hits, pairs
from quipu.plans.views import Catalogue, Views

C = Catalogue()
QUERIES, SQL = C.queries, C.sql
SIZE = 100

_CO = f"""tp AS (SELECT concepto, t, min(i) AS i FROM (SELECT concepto, unnest({W('contenido', 3)}) AS t, generate_subscripts({W('contenido', 3)}, 1) AS i FROM nodes) GROUP BY 1, 2),
ok AS (SELECT concepto FROM tp GROUP BY 1 HAVING count(*) >= 2), n AS (SELECT count(*) AS n FROM ok),
df AS (SELECT t, count(*) AS df FROM tp JOIN ok USING (concepto) GROUP BY 1),
al AS (SELECT concepto, t FROM tp JOIN ok USING (concepto)),
co AS (SELECT x.t AS a, y.t AS b, count(*) AS c FROM al x JOIN al y ON x.concepto = y.concepto AND x.t < y.t GROUP BY 1, 2),
np AS (SELECT a, b, c, x.df AS na, y.df AS nb, n.n, CASE WHEN c >= n.n THEN 1.0 ELSE greatest(-1.0, least(1.0, log2((c / CAST(n.n AS DOUBLE)) / ((x.df / CAST(n.n AS DOUBLE)) * (y.df / CAST(n.n AS DOUBLE)))) / -log2(c / CAST(n.n AS DOUBLE)))) END AS npmi
  FROM co JOIN df x ON x.t = a JOIN df y ON y.t = b, n WHERE c >= 3 AND x.df >= 3 AND y.df >= 3)"""


def npmi_pairs(v: Views) -> DataFrame:
    p, df, n = D.pair_counts(v.nodes, T.words("contenido", 3))
    return D.scored_pairs(p, df, n)


@C.add("ag8_cooccurrence", "WITH " + _CO + " SELECT a, b, c AS n FROM co WHERE c >= 2", "nodes")
def _(v: Views) -> DataFrame:
    return D.pair_counts(v.nodes, T.words("contenido", 3))[0].where("n >= 2")


@C.add("ag9_npmi", "WITH " + _CO + " SELECT a, b, round(npmi, 4) AS npmi FROM np", "nodes")
def _(v: Views) -> DataFrame:
    return npmi_pairs(v).select("a", "b", F.round("npmi", 4).alias("npmi"))


def _h(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN {x} * ln(CAST({x} AS DOUBLE)) ELSE 0 END"


@C.add(
    "ag10_dunning",
    "WITH " + _CO + f" SELECT a, b, round(greatest(0.0, 2 * ({_h('c')} + {_h('(na - c)')} + {_h('(nb - c)')} + {_h('(n - na - nb + c)')} - {_h('na')} - {_h('(n - na)')} - {_h('nb')} - {_h('(n - nb)')} + {_h('n')})), 4) AS llr FROM np WHERE n - na - nb + c >= 0",
    "nodes",
)
def _(v: Views) -> DataFrame:
    p, df, n = D.pair_counts(v.nodes, T.words("contenido", 3))
    return D.scored_pairs(p, df, n).where(n - F.col("na") - F.col("nb") + F.col("n") >= 0).select("a", "b", F.round("llr", 4).alias("llr"))


_BOTH = "WITH " + _CO + ", bo AS (SELECT a, b, round(npmi, 4) AS npmi FROM np WHERE npmi > 0 UNION ALL SELECT b, a, round(npmi, 4) FROM np WHERE npmi > 0)"


def partners(v: Views, n: int) -> DataFrame:
    p = npmi_pairs(v).where("npmi > 0").select("a", "b", F.round("npmi", 4).alias("npmi"))
    return first_per(p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "npmi")), ["a"], [F.desc("npmi"), F.asc("b")], n)


@C.add("ve9_strong_pairs", _BOTH + " SELECT a, b, npmi FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY npmi DESC, b) AS r FROM bo) WHERE r <= 5", "nodes")
def _(v: Views) -> DataFrame:
    return partners(v, 5).select("a", "b", "npmi")


@C.add(
    "se16_auto_paraphrase",
    _BOTH + f", q AS (SELECT DISTINCT item_id, unnest({W('consulta', 3)}) AS a FROM casos_qa), s AS (SELECT a, b, npmi FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY npmi DESC, b) AS r FROM bo) WHERE r <= 5 AND npmi >= 0.35) SELECT item_id, a AS palabra, b AS parafrasis FROM q JOIN s USING (a)",
    "nodes",
)
def _(v: Views) -> DataFrame:
    q = v.table("casos_qa").select("item_id", F.explode(F.array_distinct(T.words("consulta", 3))).alias("a"))
    return q.join(partners(v, 5).where("npmi >= 0.35"), "a").select("item_id", F.col("a").alias("palabra"), F.col("b").alias("parafrasis"))


@C.add(
    "sf2d_pmi_node_score",
    _BOTH + f""", pr AS (SELECT item_id, list_distinct({W('consulta', 3)}) AS q, list_distinct({W('contenido', 3)}) AS c FROM ({'SELECT k.item_id, k.consulta, n.contenido FROM casos_qa k JOIN nodes n ON n.concepto = lower(trim(k.concepto_esperado, chr(32)))'})),
x AS (SELECT item_id, unnest(q) AS a, c FROM pr), y AS (SELECT item_id, a, unnest(c) AS b FROM x),
z AS (SELECT y.item_id, y.a, max(CASE WHEN y.a = y.b THEN 1.0 ELSE coalesce(bo.npmi, 0.0) END) AS s FROM y LEFT JOIN bo ON bo.a = y.a AND bo.b = y.b GROUP BY 1, 2)
SELECT item_id, round(avg(s) + 1e-9, 4) AS score FROM z GROUP BY 1""",
    "nodes",
)
def _(v: Views) -> DataFrame:
    p = npmi_pairs(v).where("npmi > 0").select("a", "b", F.round("npmi", 4).alias("npmi"))
    both = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "npmi"))
    y = pairs(v).select("item_id", F.explode(F.array_distinct(T.words("consulta", 3))).alias("a"), F.array_distinct(T.words("contenido", 3)).alias("c")).select("item_id", "a", F.explode("c").alias("b"))
    z = y.join(both, ["a", "b"], "left").groupBy("item_id", "a").agg(F.max(F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce("npmi", F.lit(0.0)))).alias("s"))
    return z.groupBy("item_id").agg(F.round(F.avg("s") + 1e-9, 4).alias("score"))


_PPMI = f"""c AS (SELECT concepto AS doc, t AS term, count(*) AS n FROM (SELECT concepto, unnest({W('contenido', 3)}) AS t FROM nodes) GROUP BY 1, 2),
w AS (SELECT doc, term, ln(1 + n) AS w FROM c), tt AS (SELECT sum(w) AS s FROM w), t1 AS (SELECT term, pow(sum(w) / (SELECT s FROM tt), 0.75) AS pt FROM w GROUP BY 1),
dd AS (SELECT doc, sum(w) / (SELECT s FROM tt) AS pd FROM w GROUP BY 1),
pm AS (SELECT doc, term, ln((w / (SELECT s FROM tt)) / ((pt / (SELECT sum(pt) FROM t1)) * pd)) AS ppmi FROM w JOIN t1 USING (term) JOIN dd USING (doc))"""


def ppmi(v: Views) -> DataFrame:
    counts = v.nodes.select(F.col("concepto").alias("doc"), F.explode(T.words("contenido", 3)).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("n"))
    return D.ppmi_matrix(counts)


@C.add("ve1_ppmi_matrix", "WITH " + _PPMI + " SELECT doc, term, round(ppmi, 4) AS ppmi FROM pm WHERE ppmi > 0", "nodes")
def _(v: Views) -> DataFrame:
    return ppmi(v).select("doc", "term", F.round("ppmi", 4).alias("ppmi"))


@C.add("ve2_svd_vectors")
def _(v: Views) -> DataFrame:
    return D.truncated_svd(ppmi(v))


_VEC = "vec AS (SELECT lower(trim(concepto, ' ')) AS k, min(vector) AS v FROM nodos WHERE len(vector) = 100 AND trim(concepto, ' ') <> '' AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY 1)"


def usable(rows: DataFrame, key: str) -> DataFrame:
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    k = F.lower(F.trim(key))
    return rows.where((F.size("vector") == SIZE) & (k != "") & good).groupBy(k.alias("k")).agg(F.min("vector").alias("vector"))


@C.add("ag23_centroids", "WITH " + _VEC + ", p AS (SELECT categoria, v[1] AS x, v[2] AS y FROM vec JOIN nodes ON concepto = k WHERE categoria IS NOT NULL) SELECT categoria, count(*) AS n, round(avg(CAST(x AS DOUBLE)), 6) AS x, round(avg(CAST(y AS DOUBLE)), 6) AS y FROM p GROUP BY 1", "nodes")
def _(v: Views) -> DataFrame:
    rows = usable(v.table("nodos"), "concepto").join(v.nodes.select(F.col("concepto").alias("k"), "categoria"), "k").where("categoria is not null")
    n = rows.groupBy("categoria").agg(F.count(F.lit(1)).alias("n"))
    mean = D.weighted_mean(rows, ["categoria"], "vector", F.lit(1.0), SIZE)
    at = lambda i: F.round(F.get(F.col("vector"), F.lit(i)), 6)
    return mean.join(n, "categoria").select("categoria", "n", at(0).alias("x"), at(1).alias("y"))


def signatures(v: Views) -> DataFrame:
    """max(0, cosine) of every node with the centroid of each of the eleven categories."""
    rows = usable(v.table("nodos"), "concepto")
    centre = D.weighted_mean(rows.join(v.nodes.select(F.col("concepto").alias("k"), "categoria"), "k").where("categoria between 1 and 11"), ["categoria"], "vector", F.lit(1.0), SIZE)
    every = rows.withColumn("categoria", F.explode(F.sequence(F.lit(1), F.lit(11))))
    return every.join(F.broadcast(centre.withColumnRenamed("vector", "c")), "categoria").select("k", "categoria", F.round(F.greatest(F.lit(0.0), S.cosine(F.col("vector"), F.col("c"))), 6).alias("afinidad"))


def _mean(rows: str, by: str) -> str:
    """SQL of the weighted mean of the vectors v of rows with weights w, by a key."""
    return f"SELECT {by}, list(m ORDER BY i) AS v FROM (SELECT {by}, i, sum(w * x) / sum(w) AS m FROM (SELECT {by}, w, CAST(unnest(v) AS DOUBLE) AS x, generate_subscripts(v, 1) AS i FROM ({rows})) GROUP BY 1, 2) GROUP BY 1"


_AFF = f"""{_VEC}, cen AS ({_mean("SELECT categoria, 1.0 AS w, v FROM vec JOIN nodes ON concepto = k WHERE categoria BETWEEN 1 AND 11", "categoria")}),
aff AS (SELECT k, categoria, round(greatest(0.0, list_cosine_similarity(CAST(vec.v AS DOUBLE[]), cen.v)), 6) AS afinidad FROM vec, cen)"""
_TOK = f"""tvec AS (SELECT lower(trim(token, ' ')) AS k, min(vector) AS v FROM tokens WHERE len(vector) = 100 AND trim(token, ' ') <> '' AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY 1),
tk AS (SELECT k, v, greatest(0.01, ln(((SELECT count(*) FROM nodes) + 1) / CAST(f + 1 AS DOUBLE)) + 1) AS w FROM tvec JOIN (SELECT lower(trim(token, ' ')) AS k, max(freq) AS f FROM tokens GROUP BY 1) USING (k))"""
_QV = _TOK + f""",
qv AS ({_mean(f"SELECT consulta, w, v FROM (SELECT DISTINCT item_id AS consulta, unnest({W('consulta', 3)}) AS k FROM casos_qa) JOIN tk USING (k)", "consulta")})"""


def rounded(vector: str) -> Column:
    return F.transform(vector, lambda x: F.round(x, 6) + F.lit(0.0)).alias("vector")


@C.add("ve4_memberships", "WITH " + _AFF + " SELECT k AS concepto, categoria, afinidad, rango FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY afinidad DESC, categoria) AS rango FROM aff) WHERE rango <= 3", "nodes")
def _(v: Views) -> DataFrame:
    return first_per(signatures(v), ["k"], [F.desc("afinidad"), F.asc("categoria")], 3).select(F.col("k").alias("concepto"), "categoria", "afinidad", "rango")


@C.add("ex6_softmax_membership", "WITH " + _AFF + ", s AS (SELECT *, exp(afinidad) / sum(exp(afinidad)) OVER (PARTITION BY k) AS p FROM aff) SELECT k AS concepto, categoria, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p DESC, categoria) AS r FROM s) WHERE r <= 3", "nodes")
def _(v: Views) -> DataFrame:
    w = Window.partitionBy("k")
    soft = signatures(v).withColumn("p", F.exp("afinidad") / F.sum(F.exp("afinidad")).over(w))
    return first_per(soft, ["k"], [F.desc("p"), F.asc("categoria")], 3).select(F.col("k").alias("concepto"), "categoria", F.round("p", 6).alias("p"))


def token_vectors(v: Views) -> DataFrame:
    freq = v.table("tokens").groupBy(F.lower(F.trim("token")).alias("k")).agg(F.max("freq").alias("freq"))
    n = float(v.nodes.count())
    return usable(v.table("tokens"), "token").join(freq, "k").select("k", "vector", (F.log((n + 1) / (F.col("freq") + 1)) + 1).alias("idf"))


def query_vectors(v: Views) -> DataFrame:
    """Weighted mean of the vectors of a query's distinct tokens (weights: idf, 0 at least)."""
    q = v.table("casos_qa").select(F.col("item_id").alias("consulta"), F.explode(F.array_distinct(T.words("consulta", 3))).alias("k"))
    return D.weighted_mean(q.join(token_vectors(v), "k"), ["consulta"], "vector", F.greatest(F.lit(0.01), "idf"), SIZE)


@C.add("ve2c_query_vectors", "WITH " + _QV + " SELECT consulta, list_transform(v, lambda x: round(x, 6) + 0.0) AS vector FROM qv", "nodes")
def _(v: Views) -> DataFrame:
    return query_vectors(v).select("consulta", rounded("vector"))


@C.add("ve2b_document_vectors", "WITH " + _TOK + ", dv AS (" + _mean(f"SELECT concepto, w, v FROM (SELECT concepto, unnest({W('contenido', 3)}) AS k FROM nodes) JOIN tk USING (k)", "concepto") + ") SELECT concepto, list_transform(v, lambda x: round(x, 6) + 0.0) AS vector FROM dv", "nodes")
def _(v: Views) -> DataFrame:
    words = v.nodes.select("concepto", F.explode(T.words("contenido", 3)).alias("k"))
    return D.weighted_mean(words.join(token_vectors(v), "k"), ["concepto"], "vector", F.greatest(F.lit(0.01), "idf"), SIZE).select("concepto", rounded("vector"))


@C.add("ve3_vector_candidates", "WITH " + _IDX + ", " + _VEC + ", " + _QV + """, m AS (SELECT h.consulta, h.concepto, round(list_cosine_similarity(qv.v, CAST(vec.v AS DOUBLE[])), 6) AS coseno FROM hits h JOIN qv ON qv.consulta = h.consulta JOIN vec ON k = concepto)
SELECT consulta, concepto, coseno FROM (SELECT *, row_number() OVER (PARTITION BY consulta ORDER BY coseno DESC, concepto) AS r FROM m) WHERE r <= 10""", "nodes")
def _(v: Views) -> DataFrame:
    """Candidates by BM25, ranked by the cosine of query and node vectors."""
    # norms are taken once per vector, not per pair
    asked_ = query_vectors(v).select("consulta", D.normalised(F.col("vector")).alias("q"))
    nodes = usable(v.table("nodos"), "concepto").select(F.col("k").alias("concepto"), D.normalised(F.col("vector")).alias("u"))
    near = hits(v).select("consulta", "concepto").join(asked_, "consulta").join(nodes, "concepto")
    scored = near.select("consulta", "concepto", F.round(S.dot(F.col("q"), F.col("u")), 6).alias("coseno"))
    return first_per(scored, ["consulta"], [F.desc("coseno"), F.asc("concepto")], 10).select("consulta", "concepto", "coseno")


def _moved(pull: str) -> str:
    near = _mean("SELECT u.a, u.peso AS w, vec.v FROM und u JOIN vec ON vec.k = u.b WHERE u.a IN (SELECT k FROM vec)", "a")
    return f"""WITH {_VEC}, nm AS ({near}), g AS (SELECT a, count(*) AS n FROM und GROUP BY 1)
SELECT vec.k AS concepto, round({pull} * sqrt(list_sum(list_transform(list_zip(CAST(vec.v AS DOUBLE[]), nm.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS paso FROM vec JOIN nm ON nm.a = vec.k JOIN g ON g.a = vec.k
UNION ALL SELECT k, 0.0 FROM vec WHERE k NOT IN (SELECT a FROM nm)"""


@C.add("ve2e_retrofit", _moved("0.2"), "edges und")
def _(v: Views) -> DataFrame:
    """One round; the length of the way each vector moved."""
    before = usable(v.table("nodos"), "concepto")
    after = D.retrofit(before, v.und, SIZE).withColumnRenamed("vector", "w")
    moved = F.zip_with("vector", "w", lambda x, y: x.cast("double") - y)
    return before.join(after, "k").select(F.col("k").alias("concepto"), F.round(F.sqrt(S.dot(moved, moved)), 6).alias("paso"))


@C.add("ve2f_adaptive_retrofit", _moved("0.2 * (n / (n + 5.0))"), "edges und")
def _(v: Views) -> DataFrame:
    """As ve2e, pulled the more, the more neighbours a node has: 0.2 * n / (n + 5)."""
    before = usable(v.table("nodos"), "concepto")
    n = v.und.groupBy(F.col("a").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    after = D.retrofit(before, v.und, SIZE, 1.0).withColumnRenamed("vector", "w")  # the mean of the neighbours
    way = F.zip_with("vector", "w", lambda x, y: x.cast("double") - y)
    moved = before.join(after, "k").join(n, "k", "left")
    pull = F.coalesce(0.2 * F.col("n") / (F.col("n") + 5.0), F.lit(0.0))
    return moved.select(F.col("k").alias("concepto"), F.round(pull * F.sqrt(S.dot(way, way)), 6).alias("paso"))


_SIG = f"""sg AS (SELECT concepto, list_sort(list_distinct(list(p))) AS b FROM (SELECT concepto, CAST(('0x' || left(md5(t || '#' || k), 8)) AS BIGINT) % 2048 AS p FROM
  (SELECT DISTINCT concepto, unnest({W('contenido', 4)}) AS t FROM nodes), (VALUES ('0'), ('1'), ('2'), ('3')) ks(k)) GROUP BY 1)"""


@C.add("ve5_binary_signature", "WITH " + _SIG + " SELECT concepto, len(b) AS bits, b[1] AS primero, b[len(b)] AS ultimo FROM sg", "nodes")
def _(v: Views) -> DataFrame:
    s = v.nodes.select("concepto", D.signature(T.words("contenido", 4)).alias("b")).where("size(b) > 0")
    return s.select("concepto", F.size("b").cast("bigint").alias("bits"), F.array_min("b").alias("primero"), F.array_max("b").alias("ultimo"))


@C.add("ve6_signature_distance", "WITH " + _SIG + " SELECT origen, destino, len(x.b) + len(y.b) - 2 * len(list_intersect(x.b, y.b)) AS distancia FROM edges JOIN sg x ON x.concepto = origen JOIN sg y ON y.concepto = destino WHERE tipo = 'sinonimo_explicito'", "nodes edges")
def _(v: Views) -> DataFrame:
    s = v.nodes.select("concepto", D.signature(T.words("contenido", 4)).alias("b")).where("size(b) > 0")
    x, y = s.select(F.col("concepto").alias("origen"), F.col("b").alias("x")), s.select(F.col("concepto").alias("destino"), F.col("b").alias("y"))
    return v.edges.where("tipo = 'sinonimo_explicito'").join(x, "origen").join(y, "destino").select("origen", "destino", D.hamming(F.col("x"), F.col("y")).cast("bigint").alias("distancia"))


@C.add("ve7_majority_bundle", "WITH " + _SIG + ", p AS (SELECT categoria, unnest(b) AS p FROM sg JOIN nodes USING (concepto)), n AS (SELECT categoria, count(*) AS n FROM sg JOIN nodes USING (concepto) GROUP BY 1) SELECT p.categoria, p AS bit, count(*) AS veces FROM p JOIN n ON n.categoria IS NOT DISTINCT FROM p.categoria GROUP BY 1, 2, n HAVING count(*) * 2 > n", "nodes")
def _(v: Views) -> DataFrame:
    s = v.nodes.select("categoria", D.signature(T.words("contenido", 4)).alias("b")).where("size(b) > 0")
    n = s.groupBy(F.col("categoria").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    p = s.select("categoria", F.explode("b").alias("bit")).groupBy("categoria", "bit").agg(F.count(F.lit(1)).alias("veces"))
    return p.join(F.broadcast(n), F.col("categoria").eqNullSafe(F.col("c"))).where("veces * 2 > n").select("categoria", "bit", "veces")


@C.add(
    "se10_hamming_search",
    "WITH " + _VEC + ", b AS (SELECT k, list_transform(v[1:64], lambda x: (x > 0)::INT) AS s FROM vec), p AS (SELECT a.k AS a, b.k AS b, list_sum(list_transform(list_zip(a.s, b.s), lambda z: (z[1] <> z[2])::INT)) AS d FROM b a JOIN b ON a.k < b.k) SELECT a, b, CAST(d AS INT) AS distancia FROM p WHERE d <= 7",
)
def _(v: Views) -> DataFrame:
    """Vectors whose signs differ in seven of the first 64 places at most."""
    word = F.expr("aggregate(transform(slice(vector, 1, 64), (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (s, x) -> s | x)")
    return D.near_by_hamming(usable(v.table("nodos"), "concepto").select("k", word.alias("word")), 7)


@C.add(
    "ex1_window_cooccurrence",
    f"WITH t AS (SELECT doc_id, unnest({W('text', 4)}) AS w, generate_subscripts({W('text', 4)}, 1) AS i FROM documents) SELECT x.w AS a, y.w AS b, count(*) AS n FROM t x JOIN t y ON x.doc_id = y.doc_id AND y.i = x.i + 1 GROUP BY 1, 2 HAVING count(*) >= 20",
)
def _(v: Views) -> DataFrame:
    w = T.words("text", 4)
    pairs_ = v.table("documents").select(w.alias("w")).where("size(w) > 1").select(F.explode(F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("a"), F.expr("slice(w, 2, size(w) - 1)").alias("b"))).alias("p"))
    return pairs_.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


@C.add("ex5_mutual_top_k", "WITH t AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY peso DESC, b) AS r FROM und) WHERE r <= 5) SELECT x.a, x.b FROM t x JOIN t y ON y.a = x.b AND y.b = x.a WHERE x.a < x.b", "edges und")
def _(v: Views) -> DataFrame:
    t = first_per(v.und, ["a"], [F.desc("peso"), F.asc("b")], 5).select("a", "b")
    return t.where("a < b").join(t.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")


@C.add(
    "sf4_thematic_similarity",
    """WITH i AS (SELECT dim, ln((SELECT count(*) FROM nodes WHERE estado = 'activo') / CAST(count(*) AS DOUBLE)) AS idf FROM dims GROUP BY 1), s AS (SELECT concepto, count(*) AS n, sum(idf) AS w FROM dims JOIN i USING (dim) GROUP BY 1),
p AS (SELECT x.concepto AS a, y.concepto AS b, count(*) AS c, sum(idf) AS w FROM dims x JOIN dims y ON x.dim = y.dim AND x.concepto < y.concepto JOIN i ON i.dim = x.dim GROUP BY 1, 2)
SELECT a, b, round(0.4 * c / (sa.n + sb.n - c) + 0.6 * p.w / (sa.w + sb.w - p.w), 6) AS tema FROM p JOIN s sa ON sa.concepto = a JOIN s sb ON sb.concepto = b""",
    "nodes dims",
)
def _(v: Views) -> DataFrame:
    n = float(v.active.count())
    idf = v.dims.groupBy("dim").agg(F.log(F.lit(n) / F.count(F.lit(1))).alias("idf"))
    tagged = v.dims.join(idf, "dim")
    size = tagged.groupBy("concepto").agg(F.count(F.lit(1)).alias("n"), F.sum("idf").alias("w"))
    x, y = tagged.select("dim", "idf", F.col("concepto").alias("a")), v.dims.select("dim", F.col("concepto").alias("b"))
    p = x.join(y, "dim").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.sum("idf").alias("w"))
    of = lambda k: size.select(F.col("concepto").alias(k), F.col("n").alias(f"n{k}"), F.col("w").alias(f"w{k}"))
    both = p.join(of("a"), "a").join(of("b"), "b")
    return both.select("a", "b", F.round(0.4 * F.col("c") / (F.col("na") + F.col("nb") - F.col("c")) + 0.6 * T.ratio(F.col("w"), F.col("wa") + F.col("wb") - F.col("w")), 6).alias("tema"))


@C.add("sf10_stem_jaccard")
def _(v: Views) -> DataFrame:
    """Jaccard of the stems of a query and of the content expected for it."""
    side = lambda c, n: pairs(v).select("item_id", F.explode(F.array_distinct(T.words(c, 3))).alias("w"), F.lit(n).alias("lado"))
    tokens = side("consulta", 1).unionByName(side("contenido", 2))
    stems = with_stems(tokens, "w", "s").groupBy("item_id", "s").agg(F.min("lado").alias("a"), F.max("lado").alias("b"))
    return stems.groupBy("item_id").agg(F.round(F.count_if(F.col("a") != F.col("b")) / F.count(F.lit(1)), 6).alias("s"))


_SCORES = "WITH " + _IDX + ", s AS (SELECT k.item_id, k.categoria <> 'negativo' AS positivo, coalesce(max(bm25 / (bm25 + 3)), 0) AS score FROM casos_qa k LEFT JOIN hits ON hits.consulta = k.item_id GROUP BY 1, 2)"


def top_scores(v: Views) -> DataFrame:
    best = hits(v).groupBy(F.col("consulta").alias("item_id")).agg(F.max("bm25").alias("m"))
    return v.table("casos_qa").join(best, "item_id", "left").select("item_id", (F.col("categoria") != "negativo").alias("positivo"), F.coalesce(F.col("m") / (F.col("m") + 3), F.lit(0.0)).alias("score"))


@C.add("wn17_conformal_threshold", _SCORES + ", n AS (SELECT score, row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS n FROM s WHERE NOT positivo) SELECT round(score, 6) AS umbral, n FROM n WHERE r = least(n, CAST(ceil((n + 1) * 0.9 - 1e-9) AS BIGINT))", "nodes")
def _(v: Views) -> DataFrame:
    return K.conformal_threshold(top_scores(v).where("not positivo").select("score"), 0.1).select(F.round("umbral", 6).alias("umbral"), "n")


@C.add("ag27_auc", _SCORES + " SELECT round(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*), 6) AS auc FROM s p JOIN s n ON p.positivo AND NOT n.positivo", "nodes")
def _(v: Views) -> DataFrame:
    return K.auc(top_scores(v)).select(F.round("auc", 6).alias("auc"))


@C.add("ca1_platt")
def _(v: Views) -> DataFrame:
    s = top_scores(v)
    a, b = K.platt(s)
    return s.select("item_id", F.round(S.sigmoid(a * F.col("score") + b), 6).alias("p"))


@C.add("ca2_isotonic")
def _(v: Views) -> DataFrame:
    s = top_scores(v)
    steps = K.isotonic_steps(s)
    table = v.spark.createDataFrame([(float(b), float(K.step_value(steps, b / K.STEPS))) for b in range(K.STEPS + 1)], "b double, p double")
    bin_ = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")) * K.STEPS)
    return s.select("item_id", bin_.alias("b")).join(F.broadcast(table), "b").select("item_id", F.round("p", 6).alias("p"))


@C.add("ca4_logistic_fusion")
def _(v: Views) -> DataFrame:
    """Logistic regression of relevance on three signals of the BM25 candidates."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    expected = v.table("casos_qa").select(F.col("item_id").alias("consulta"), F.lower("concepto_esperado").alias("e"))
    rows = hits(v).join(expected, "consulta").join(v.nodes.select("concepto", "peso"), "concepto")
    rows = rows.select("consulta", "concepto", S.bm25_unit(F.col("bm25")).alias("b"), F.col("terminos").cast("double").alias("t"), "peso", F.coalesce((F.col("e") == F.col("concepto")).cast("double"), F.lit(0.0)).alias("label"))
    data = VectorAssembler(inputCols=["b", "t", "peso"], outputCol="features").transform(rows)
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(data)
    return model.transform(data).select("consulta", "concepto", F.round(vector_to_array("probability")[1], 6).alias("p"))


@C.add("ca8_stratified_split", "SELECT item_id, row_number() OVER (PARTITION BY categoria ORDER BY md5(CAST(item_id AS VARCHAR))) % 2 = 0 AS prueba FROM casos_qa")
def _(v: Views) -> DataFrame:
    cases = v.table("casos_qa").select("item_id", "categoria", F.md5(F.col("item_id").cast("string")).alias("h"))
    return running_before(cases, ["categoria"], [F.asc("h")], F.lit(1), "antes").select("item_id", (F.col("antes") % 2 == 1).alias("prueba"))


@C.add("sf12_certainty", _SCORES + " SELECT item_id, CASE WHEN score >= 0.8 THEN 'alta' WHEN score >= 0.6 THEN 'media' ELSE 'baja' END AS certeza FROM s", "nodes")
def _(v: Views) -> DataFrame:
    return top_scores(v).select("item_id", F.when(F.col("score") >= 0.8, "alta").when(F.col("score") >= 0.6, "media").otherwise("baja").alias("certeza"))

