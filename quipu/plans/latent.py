"""The latent score of eight signals, the layers that rest on it, and searches by meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quipu.functions import score as S
from quipu.functions import text as T
from quipu.operators import distribution as D
from quipu.operators import graph as G
from quipu.operators import sdm
from quipu.operators.cut import cut
from quipu.operators.graph import first_per
from quipu.operators.skew import join_checked
from quipu.plans import recall, search, signature, vectors
from quipu.plans.graphs import _TRANSITIVE
from quipu.plans.relational import W
from quipu.plans.search import _TOP, top
from quipu.plans.vectors import _BOTH, token_vectors, usable
from quipu.plans.views import Catalogue, Views

C = Catalogue()
QUERIES, SQL = C.queries, C.sql


def sub(name: str) -> str:
    """The SQL of a registered query, to be read from."""
    for plans in (search, recall, vectors, signature):
        if name in plans.SQL:
            return f"({plans.SQL[name]})"
    return f"({SQL[name]})"


_CAND = "WITH " + _TOP + ", gr AS (SELECT a AS x FROM und GROUP BY 1 HAVING count(*) >= 2), cand AS (SELECT consulta, concepto, bm25, rango FROM top JOIN gr ON x = concepto)"


class Met:
    """What the signals of a batch of queries rest on, written once: best (the 50 best by BM25), und (the undirected edges that begin at
    one of them; the others are not shuffled) and cand (the 50 best that have two neighbours or more)."""

    def __init__(self, v: Views):
        self.best = cut(top(v).select("consulta", "concepto", "bm25", "rango"))
        self.und = cut(join_checked(v.und, cut(self.best.select(F.col("concepto").alias("a")).distinct()), "a", "left_semi"))
        linked = G.neighbour_counts(self.und).where("n >= 2").select(F.col("a").alias("concepto"))
        self.cand = cut(self.best.join(linked, "concepto", "left_semi"))
        self.names = cut(self.cand.select("concepto").distinct())


def jaccard_of(und: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, jaccard of the neighbours of given pairs; each pair probes the list of its end of fewer neighbours."""
    n = G.neighbour_counts(und)
    sized = pairs.select("a", "b").distinct().join(n.select("a", F.col("n").alias("na")), "a").join(n.select(F.col("a").alias("b"), F.col("n").alias("nb")), "b")
    less = F.col("na") <= F.col("nb")
    probe = sized.select("a", "b", "na", "nb", F.when(less, F.col("a")).otherwise(F.col("b")).alias("few"), F.when(less, F.col("b")).otherwise(F.col("a")).alias("many"))
    near, closes = und.select(F.col("a").alias("few"), F.col("b").alias("c")), und.select(F.col("a").alias("many"), F.col("b").alias("c"))
    common = probe.join(near, "few").join(closes, ["many", "c"], "left_semi").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    return common.select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("jaccard"))


@C.add(
    "sf2c_network_similarity",
    _CAND + """, br AS (SELECT consulta, concepto AS a FROM top WHERE rango <= 10), pr AS (SELECT DISTINCT br.a, cand.concepto AS b FROM br JOIN cand USING (consulta) WHERE br.a <> cand.concepto),
dg AS (SELECT a AS x, count(*) AS n FROM und GROUP BY 1), cm AS (SELECT pr.a, pr.b, count(*) AS c FROM pr JOIN und x ON x.a = pr.a JOIN und y ON y.a = pr.b AND y.b = x.b GROUP BY 1, 2),
jc AS (SELECT cm.a, cm.b, c / CAST(p.n + q.n - c AS DOUBLE) AS j FROM cm JOIN dg p ON p.x = cm.a JOIN dg q ON q.x = cm.b)
SELECT cand.consulta, cand.concepto, round(max(j), 6) AS red FROM cand JOIN br USING (consulta) JOIN jc ON jc.a = br.a AND jc.b = cand.concepto GROUP BY 1, 2""",
    "nodes edges und",
)
def _(v: Views) -> DataFrame:
    return network(Met(v))


def network(m: Met) -> DataFrame:
    """The greatest neighbour Jaccard of a candidate and one of the ten best hits."""
    bridges = m.best.where("rango <= 10").select("consulta", F.col("concepto").alias("a"))
    met = cut(m.cand.select("consulta", F.col("concepto").alias("b")).join(bridges, "consulta").where("a <> b"))
    return met.join(jaccard_of(m.und, met), ["a", "b"]).groupBy("consulta", F.col("b").alias("concepto")).agg(F.round(F.max("jaccard"), 6).alias("red"))


@C.add(
    "sf2e_latent_score",
    _CAND + ", " + _TRANSITIVE + """, five AS (SELECT consulta, concepto AS s FROM top WHERE rango <= 5),
d AS (SELECT c.consulta, c.concepto, max(peso) AS p FROM cand c JOIN five USING (consulta) JOIN inf ON inf.origen = s AND inf.destino = c.concepto GROUP BY 1, 2),
o AS (SELECT c.consulta, c.concepto, max(peso) AS p FROM cand c JOIN five USING (consulta) JOIN inf ON inf.destino = s AND inf.origen = c.concepto GROUP BY 1, 2)
SELECT consulta, concepto, round(least(1.0, coalesce(d.p, o.p)) + 1e-9, 6) AS latente FROM d FULL JOIN o USING (consulta, concepto)""",
    "nodes edges und",
)
def _(v: Views) -> DataFrame:
    return inferred_signal(v, Met(v))


def inferred_signal(v: Views, m: Met) -> DataFrame:
    """The heaviest inferred edge from one of the five best hits to the candidate, otherwise from it to one of them."""
    five = m.best.where("rango <= 5").select("consulta", F.col("concepto").alias("s"))
    met = cut(m.cand.select("consulta", "concepto").join(five, "consulta"))
    origins = cut(met.select(F.explode(F.array("concepto", "s")).alias("origen")).distinct())
    inferred = cut(G.inferred_edges(v.weights, origins=origins).select("origen", "destino", "peso"))
    best = lambda a, b, n: met.join(inferred.select(F.col("origen").alias(a), F.col("destino").alias(b), "peso"), [a, b]).groupBy("consulta", "concepto").agg(F.max("peso").alias(n))
    both = best("s", "concepto", "d").join(best("concepto", "s", "o"), ["consulta", "concepto"], "full")
    return both.select("consulta", "concepto", F.round(F.least(F.lit(1.0), F.coalesce("d", "o")) + 1e-9, 6).alias("latente"))


@C.add(
    "sf2_pmi_names",
    _BOTH + f""", q AS (SELECT DISTINCT item_id AS consulta, unnest({W('consulta', 3)}) AS a FROM casos_qa), nm AS (SELECT DISTINCT concepto, unnest({W("replace(concepto, '_', ' ')", 3)}) AS b FROM nodes),
k AS (SELECT consulta, count(*) AS n FROM q GROUP BY 1), m AS (SELECT consulta, concepto, a, max(s) AS s FROM (SELECT consulta, concepto, q.a, 1.0 AS s FROM q JOIN nm ON nm.b = q.a UNION ALL SELECT consulta, concepto, q.a, npmi FROM q JOIN bo ON bo.a = q.a JOIN nm ON nm.b = bo.b) GROUP BY 1, 2, 3)
SELECT consulta, concepto, round(sum(s) / n + 1e-9, 4) AS pmi FROM m JOIN k USING (consulta) GROUP BY 1, 2, n""",
    "nodes",
)
def _(v: Views) -> DataFrame:
    return pmi_names(v)


def pmi_names(v: Views, pairs: DataFrame | None = None) -> DataFrame:
    """Mean over a query's words of the best NPMI with a word of the node's name (1 for the same word); of given pairs of consulta
    and concepto, or of all that have one. Only pairs of a query's and a name's word are counted in the contents."""
    q = cut(v.table("casos_qa").select(F.col("item_id").alias("consulta"), F.explode(F.array_distinct(T.words("consulta", 3))).alias("a")))
    nodes = v.nodes if pairs is None else join_checked(v.nodes, cut(pairs.select("concepto").distinct()), "concepto", "left_semi")
    names = cut(nodes.select("concepto", F.explode(F.array_distinct(T.words(F.translate("concepto", "_", " "), 3))).alias("b")))
    words = lambda rows, c: rows.select(F.col(c).alias("t")).distinct()
    p = D.directed_npmi(v.nodes, T.words("contenido", 3), words(q, "a"), words(names, "b")).where("npmi > 0").select("a", "b", F.round("npmi", 4).alias("s"))
    # what a word of a name is worth to each query's words; the names are joined last
    same = words(q, "a").join(words(names, "b"), "t").select(F.col("t").alias("a"), F.col("t").alias("b"), F.lit(1.0).alias("s"))
    worth = cut(q.join(p.unionByName(same), "a").groupBy("b").agg(F.collect_list(F.struct("consulta", "a", "s")).alias("w")))
    if pairs is None:
        m = _best_words(v, names, worth, q)
    else:
        met = pairs.select("consulta", "concepto").join(names, "concepto").join(worth.select("b", F.inline("w")), ["consulta", "b"])
        m = met.groupBy("consulta", "concepto", "a").agg(F.max("s").alias("s")).groupBy("consulta", "concepto").agg(F.sum("s").alias("s"))
    n = q.groupBy("consulta").agg(F.count(F.lit(1)).alias("n"))
    return m.join(n, "consulta").select("consulta", "concepto", F.round(F.col("s") / F.col("n") + 1e-9, 4).alias("pmi"))


def _best_words(v: Views, names: DataFrame, worth: DataFrame, q: DataFrame) -> DataFrame:
    """consulta, concepto, s: the sums over a query's words of the best worth of a word of the name. Names of the same words that are
    worth anything are one class, for which the sums are made once; rows of single words are combined before they are shuffled."""
    held = join_checked(names, cut(worth.select("b")), "b", "left_semi")
    of = cut(held.groupBy("concepto").agg(F.array_sort(F.collect_set("b")).alias("bs")))
    one = cut(of.select("bs").distinct().withColumn("i", F.monotonically_increasing_id()))
    rows = join_checked(one.select("i", F.explode("bs").alias("b")), worth, "b", "inner").select("i", F.inline("w"))
    sums = rows.groupBy("i", "consulta", "a").agg(F.max("s").alias("s")).groupBy("i", "consulta").agg(F.sum("s").alias("s"))
    per = sums.groupBy("i").agg(F.collect_list(F.struct("consulta", "s")).alias("u"))
    return of.join(one, "bs").select("concepto", "i").join(per, "i").select("concepto", F.inline("u"))


@C.add(
    "sf2_signature_similarity",
    f"""WITH {signature._SG}, qs AS (SELECT concepto AS consulta, list_sort(list(p)) AS q FROM (SELECT * FROM ({signature._many(f"list_distinct({W('consulta', 3)})", sdm.CONTENT, 4, '(SELECT item_id AS concepto, consulta FROM casos_qa)')})
  UNION {signature._many(f"list_distinct({W('consulta', 2)})", sdm.CONCEPT, 4, '(SELECT item_id AS concepto, consulta FROM casos_qa)')}) GROUP BY 1),
{_CAND[5:]} SELECT cand.consulta, cand.concepto, round({signature._w('list_intersect(q, b)')} / ({signature._w('q')} + {signature._w('b')} - {signature._w('list_intersect(q, b)')}), 4) AS sdm FROM cand JOIN qs USING (consulta) JOIN sg USING (concepto)""",
    "nodes edges und dims cat",
)
def _(v: Views) -> DataFrame:
    return alike_signatures(v, Met(v))


def alike_signatures(v: Views, m: Met) -> DataFrame:
    """Weighted Jaccard of a query's signature and a candidate's."""
    k = v.table("casos_qa").select(F.col("item_id").alias("concepto"), T.words("consulta", 3).alias("palabras"), T.words("consulta", 2).alias("nombre"), F.lit(None).cast("string").alias("categoria"))
    none = v.spark.createDataFrame([], "concepto bigint, dim string, idf double"), v.spark.createDataFrame([], "a bigint, b string")
    asked = sdm.signatures(k, *none).select(F.col("concepto").alias("consulta"), F.col("b").alias("q"))
    held = signature.parts(v, join_checked(v.nodes, m.names, "concepto", "left_semi"), m.und)
    rows = m.cand.select("consulta", "concepto").join(held, "concepto").join(asked, "consulta")
    return rows.select("consulta", "concepto", sdm.weighted_jaccard(F.col("q"), F.col("b")).alias("sdm"))


def _latent_sql() -> str:
    return f"""{_CAND}, qd AS (SELECT DISTINCT consulta, dim FROM top JOIN dims USING (concepto) WHERE rango <= 25), nd AS (SELECT c.consulta, c.concepto, count(*) AS n FROM cand c JOIN dims USING (concepto) JOIN qd ON qd.consulta = c.consulta AND qd.dim = dims.dim GROUP BY 1, 2),
tx AS (SELECT c.consulta, c.concepto, a.peso, len(list_intersect(list_distinct({W('k.consulta', 3)}), list_distinct({W('a.contenido', 3)}))) / CAST(greatest(1, len(list_distinct({W('k.consulta', 3)}))) AS DOUBLE) AS t FROM cand c JOIN act a USING (concepto) JOIN casos_qa k ON k.item_id = c.consulta),
lat AS (SELECT tx.consulta, tx.concepto, round(least(1.0, 0.25 * t + 0.15 * coalesce(red, 0) + 0.15 * coalesce(pmi, 0) + 0.15 * coalesce(latente, 0) + 0.10 * least(1.0, coalesce(nd.n, 0) * 0.35) + 0.10 * coalesce(sdm, 0) + 0.05 * least(1.0, tx.peso / 5) + 0.05 * coalesce(premio, 0)) + 1e-9, 4) AS score
FROM tx LEFT JOIN {sub('sf2c_network_similarity')} r USING (consulta, concepto) LEFT JOIN {sub('sf2_pmi_names')} p USING (consulta, concepto) LEFT JOIN {sub('sf2e_latent_score')} l USING (consulta, concepto)
LEFT JOIN {sub('sf2_signature_similarity')} s USING (consulta, concepto) LEFT JOIN nd USING (consulta, concepto) LEFT JOIN {sub('sf2f_context_bonus')} c ON c.concepto = tx.concepto)"""


def latent_scores(v: Views) -> DataFrame:
    """consulta, concepto, score: text, network, PMI, inferred edges, dimensions, signature, weight and context."""
    m = Met(v)
    cand = m.cand.select("consulta", "concepto")
    asked = v.table("casos_qa").select(F.col("item_id").alias("consulta"), F.array_distinct(T.words("consulta", 3)).alias("q"))
    rows = cand.join(join_checked(v.active, m.names, "concepto", "left_semi").select("concepto", "peso", F.array_distinct(T.words("contenido", 3)).alias("c")), "concepto").join(asked, "consulta")
    meant = m.best.where("rango <= 25").join(v.dims, "concepto").select("consulta", "dim").distinct()
    shared = cand.join(v.dims, "concepto").join(meant, ["consulta", "dim"]).groupBy("consulta", "concepto").agg(F.count(F.lit(1)).alias("nd"))
    pair = ["consulta", "concepto"]
    for signal in (network(m), pmi_names(v, m.cand), inferred_signal(v, m), alike_signatures(v, m)):
        rows = rows.join(signal, pair, "left")
    rows = rows.join(shared, pair, "left").join(recall.C.of["sf2f_context_bonus"](v), "concepto", "left")
    or_0 = lambda c: F.coalesce(c, F.lit(0.0))
    total = 0.25 * T.coverage(F.col("q"), F.col("c")) + 0.15 * or_0("red") + 0.15 * or_0("pmi") + 0.15 * or_0("latente") + 0.10 * F.least(F.lit(1.0), F.coalesce("nd", F.lit(0)) * 0.35) + 0.10 * or_0("sdm") + 0.05 * F.least(F.lit(1.0), F.col("peso") / 5) + 0.05 * or_0("premio")
    return rows.select("consulta", "concepto", F.round(F.least(F.lit(1.0), total) + 1e-9, 4).alias("score"))


@C.add("sf2_latent_score", _latent_sql() + " SELECT consulta, concepto, score FROM lat", "nodes edges und dims cat")
def _(v: Views) -> DataFrame:
    return latent_scores(v)


@C.add("se6j_latent_fallback", _latent_sql() + " SELECT consulta, concepto, score FROM (SELECT *, row_number() OVER (PARTITION BY consulta ORDER BY score DESC, concepto) AS r FROM lat WHERE score >= 0.15) WHERE r <= 5", "nodes edges und dims cat")
def _(v: Views) -> DataFrame:
    return first_per(latent_scores(v).where("score >= 0.15"), ["consulta"], [F.desc("score"), F.asc("concepto")], 5).drop("rango")


@C.add(
    "se6o_two_phases",
    _latent_sql() + """, gx AS (SELECT a AS x, count(*) AS n FROM und GROUP BY 1), sd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY consulta ORDER BY score DESC, concepto) AS r FROM lat) WHERE r <= 10),
bk AS (SELECT consulta, und.b AS concepto, sum(und.peso / pow(gx.n, 0.3)) AS s FROM sd JOIN und ON und.a = sd.concepto JOIN gx ON gx.x = und.b GROUP BY 1, 2),
z AS (SELECT lat.consulta, lat.concepto, round(0.75 * score + 0.25 * least(1.0, coalesce(s, 0) / 2.5), 6) AS score FROM lat LEFT JOIN bk USING (consulta, concepto)) SELECT consulta, concepto, score FROM z WHERE score >= 0.2""",
    "nodes edges und dims cat",
)
def _(v: Views) -> DataFrame:
    """The latent score, then what the ten best of a query send over their edges."""
    return G.propagate(cut(latent_scores(v)), v.und).select("consulta", "concepto", F.round("score", 6).alias("score")).where("score >= 0.2")
