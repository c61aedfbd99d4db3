"""Staged lookups and fallback layers of the search, and the signals that rest on names, hubs and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quipu.functions import text as T
from quipu.operators.cut import cut
from quipu.operators.graph import first_per
from quipu.operators.similar import meeting, prefixes
from quipu.plans.relational import W
from quipu.plans.search import _IDX, _TOP, asked, hits, top
from quipu.plans.views import Catalogue, Views
from quipu.sources import key

C = Catalogue()
QUERIES, SQL = C.queries, C.sql
#: Confidence from which a hub counts, and from which it goes in front; names of many words make these low.
SURE, FIRST = 0.05, 0.1

# ---- staged lookups: exact name, names alike by trigrams, contents

_GRAMS = "CASE WHEN length(s) >= 3 THEN list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) ELSE [s] END"
_STAGED = _IDX + rf""",
kq AS (SELECT clave AS consulta, clave, replace(clave, '_', ' ') AS frase FROM (SELECT lower(trim(node_concepto, ' ')) AS clave FROM concept_hub_nodes UNION SELECT lower(trim(concepto, ' ')) FROM sync_log) WHERE clave <> ''),
kg AS (SELECT consulta, {_GRAMS} AS g FROM (SELECT consulta, regexp_replace(clave, '[^a-z0-9]', '', 'g') AS s FROM kq) WHERE s <> ''),
ng AS (SELECT concepto, estado, {_GRAMS} AS g FROM (SELECT concepto, estado, regexp_replace(concepto, '[^a-z0-9]', '', 'g') AS s FROM nodes) WHERE s <> ''),
e1 AS (SELECT consulta, n.concepto, n.estado FROM kq JOIN nodes n ON n.concepto = kq.clave),
e2 AS (SELECT consulta, concepto, estado, round(len(list_intersect(kg.g, ng.g)) / CAST(len(list_distinct(list_concat(kg.g, ng.g))) AS DOUBLE), 6) AS s FROM kg JOIN ng ON list_has_any(kg.g, ng.g)),
e3 AS (SELECT kq.consulta, a.concepto, a.peso FROM kq JOIN act a ON contains(lower(a.contenido), kq.frase))"""


def phrases(v: Views) -> DataFrame:
    """consulta, clave, frase: the names that hub members and the change log refer to, known or not, and the same with blanks."""
    names = v.table("concept_hub_nodes").select(key("node_concepto").alias("clave")).unionByName(v.table("sync_log").select(key("concepto").alias("clave"))).where("clave is not null").distinct()
    return names.select(F.col("clave").alias("consulta"), "clave", F.replace("clave", F.lit("_"), F.lit(" ")).alias("frase"))


def exact_names(v: Views) -> DataFrame:
    return phrases(v).select("consulta", F.col("clave").alias("concepto")).join(v.nodes.select("concepto", "estado"), "concepto")


def alike_names(v: Views, least: float, asked: DataFrame | None = None) -> DataFrame:
    """consulta, concepto, estado, s: trigram Jaccard of `least` or more of a name asked for (or one of those given) and a node's. Rarest
    trigrams first, two such sets share one of their first size - ceil(least * size) + 1, so only those meet."""
    numbered = lambda rows, c: cut(rows.withColumn("c", T.trigrams(c)).where("c[0] <> ''").withColumn("i", F.monotonically_increasing_id()))
    ours = numbered((phrases(v) if asked is None else asked).select("consulta", "clave"), "clave")
    theirs = numbered(v.nodes.select("concepto", "estado"), "concepto")
    df = cut(theirs.select(F.explode("c").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")))
    met = meeting(prefixes(ours, df, least), prefixes(theirs, df, least), least)
    both = met.join(ours.select(F.col("i").alias("x"), "consulta", F.col("c").alias("g")), "x").join(theirs.select(F.col("i").alias("y"), "concepto", "estado", F.col("c").alias("h")), "y")
    return both.select("consulta", "concepto", "estado", F.round(T.jaccard(F.col("g"), F.col("h")), 6).alias("s")).where(F.col("s") >= least)


def phrase_hits(v: Views, asked: DataFrame | None = None) -> DataFrame:
    """consulta, concepto, peso of active nodes whose content holds the whole name with blanks. Only contents that hold the rarest inner
    word of it are read; a name of one or two words may begin or end inside a word, and is sought by that."""
    names = phrases(v) if asked is None else asked
    terms = v.active.select("concepto", F.explode(F.array_distinct(F.split(F.lower(T.text("contenido")), " "))).alias("t"))
    df = terms.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    inner = names.withColumn("w", F.split("frase", " ")).where("size(w) > 2").select("consulta", "frase", F.explode(F.expr("slice(w, 2, size(w) - 2)")).alias("t"))
    rare = inner.join(df, "t").groupBy("consulta", "frase").agg(F.min_by("t", F.struct("df", "t")).alias("t"))
    # a short name is looked for among the words themselves: those that end with its first and begin with its last part
    short = names.withColumn("w", F.split("frase", " ")).where("size(w) < 3").select("consulta", "frase", F.element_at("w", -1).alias("x"))
    starts = df.select("t", F.explode(F.expr("transform(sequence(1, length(t)), i -> substring(t, 1, i))")).alias("x"))
    inside = df.select("t", F.explode(F.expr("array_distinct(flatten(transform(sequence(1, length(t)), i -> transform(sequence(i, length(t)), j -> substring(t, i, j - i + 1)))))")).alias("x"))
    one, two = short.where(~F.contains("frase", F.lit(" "))), short.where(F.contains("frase", F.lit(" ")))
    probes = rare.select("consulta", "frase", "t").unionByName(one.join(inside, "x").select("consulta", "frase", "t")).unionByName(two.join(starts, "x").select("consulta", "frase", "t"))
    found = probes.join(terms, "t").select("consulta", "frase", "concepto").distinct()
    rows = found.join(v.active.select("concepto", "peso", F.lower("contenido").alias("c")), "concepto")
    return rows.where(F.contains("c", "frase")).select("consulta", "concepto", "peso")


def _staged(v: Views, least: float, every_state: bool) -> DataFrame:
    # a stage is for the names that those before it leave without a row
    names = cut(phrases(v))
    one = cut(names.select("consulta", F.col("clave").alias("concepto")).join(v.nodes.select("concepto", "estado"), "concepto").select("consulta", "concepto", "estado", F.lit(1.0).alias("s"), F.lit(1).alias("etapa")))
    left = cut(names.join(one, "consulta", "left_anti"))
    alike = alike_names(v, least, left)
    alike = alike if every_state else alike.where("estado = 'activo'")
    two = cut(first_per(alike, ["consulta"], [F.desc("s"), F.asc("concepto")], 1).select("consulta", "concepto", "estado", "s", F.lit(2).alias("etapa")))
    three = phrase_hits(v, cut(left.join(two, "consulta", "left_anti"))).select("consulta", "concepto", F.lit("activo").alias("estado"), (F.col("peso") - 1).alias("s"), F.lit(3).alias("etapa"))
    best = first_per(one.unionByName(two).unionByName(three), ["consulta"], [F.asc("etapa"), F.desc("s"), F.asc("concepto")], 1)
    return best if every_state else best.where("etapa > 1 or estado <> 'dormido'")


def _staged_sql(least: float, where: str, outer: str) -> str:
    return f"""WITH {_STAGED}, u AS (SELECT consulta, concepto, estado, 1.0 AS s, 1 AS etapa FROM e1 UNION ALL SELECT consulta, concepto, estado, s, 2 FROM e2 WHERE s >= {least} {where}
UNION ALL SELECT consulta, concepto, 'activo', peso - 1, 3 FROM e3), r AS (SELECT *, row_number() OVER (PARTITION BY consulta ORDER BY etapa, s DESC, concepto) AS r FROM u) SELECT consulta, concepto, etapa FROM r WHERE r = 1 {outer}"""


@C.add("se1_staged_lookup", _staged_sql(0.55, "AND estado = 'activo'", "AND (etapa > 1 OR estado <> 'dormido')"), "nodes")
def _(v: Views) -> DataFrame:
    """The node of a query's name; otherwise the most alike active name; otherwise the heaviest content with the phrase. A
    sleeping node of just that name gives nothing."""
    return _staged(v, 0.55, False).select("consulta", "concepto", "etapa")


@C.add("se2_deep_lookup", _staged_sql(0.4, "", ""), "nodes")
def _(v: Views) -> DataFrame:
    """As the staged lookup over nodes of any state and names of less likeness."""
    return _staged(v, 0.4, True).select("consulta", "concepto", "etapa")


@C.add(
    "se3_all_matches",
    f"""WITH {_STAGED}, nq AS (SELECT consulta, count(*) AS n FROM q GROUP BY 1),
u AS (SELECT consulta, concepto, 1.0 AS s FROM e1 UNION ALL SELECT consulta, concepto, s FROM e2 WHERE s >= 0.55 UNION ALL SELECT CAST(h.consulta AS VARCHAR), h.concepto, terminos / CAST(n AS DOUBLE) * 0.8 + 0.2 FROM hits h JOIN nq USING (consulta))
SELECT consulta, concepto, round(max(s), 6) AS score FROM u GROUP BY 1, 2""",
    "nodes",
)
def _(v: Views) -> DataFrame:
    """Every match with its best score: names asked for by name and likeness, queries by the words of a node."""
    n = asked(v).groupBy("consulta").agg(F.count(F.lit(1)).alias("n"))
    words = hits(v).join(n, "consulta").select(F.col("consulta").cast("string").alias("consulta"), "concepto", (F.col("terminos") / F.col("n") * 0.8 + 0.2).alias("s"))
    every = exact_names(v).select("consulta", "concepto", F.lit(1.0).alias("s")).unionByName(alike_names(v, 0.55).select("consulta", "concepto", "s")).unionByName(words)
    return every.groupBy("consulta", "concepto").agg(F.round(F.max("s"), 6).alias("score"))


# ---- layers


@C.add("se6a_expansion_probe", "WITH " + _IDX + ", n AS (SELECT consulta, count(*) AS n FROM q GROUP BY 1), w AS (SELECT h.consulta, count(*) AS c FROM hits h JOIN n USING (consulta) WHERE terminos = n GROUP BY 1) SELECT n.consulta, coalesce(c, 0) = 0 AS ampliar FROM n LEFT JOIN w USING (consulta)", "nodes")
def _(v: Views) -> DataFrame:
    """Whether no node holds all words of the query, so that it is to be expanded."""
    n = asked(v).groupBy("consulta").agg(F.count(F.lit(1)).alias("n"))
    whole = hits(v).join(n, "consulta").where("terminos = n").select("consulta").distinct().withColumn("hay", F.lit(True))
    return n.join(whole, "consulta", "left").select("consulta", F.col("hay").isNull().alias("ampliar"))


@C.add(
    "se6f_protected_terms",
    rf"""WITH t AS (SELECT item_id AS consulta, lower(unnest(list_concat(regexp_extract_all(consulta, '"([^"]+)"', 1), regexp_extract_all(consulta, '\b(?:[A-Z][A-Z0-9]+|[0-9]{{2,}})\b')))) AS t FROM casos_qa),
s AS (SELECT item_id AS consulta, w AS t FROM casos_qa, (VALUES ('dsl'), ('api'), ('mcp'), ('rag'), ('cpu'), ('ram'), ('gpu'), ('cli'), ('db'), ('ui'), ('ux'), ('os'), ('ai'), ('vm')) x(w) WHERE list_contains({W('consulta', 1)}, w)),
a AS (SELECT DISTINCT * FROM (SELECT * FROM t UNION ALL SELECT * FROM s)), n AS (SELECT concepto, list_distinct(list_concat({W("replace(concepto, '_', ' ')", 1)}, list_concat({W('contenido', 1)}, {W('sinonimos', 1)}))) AS w FROM nodes WHERE estado = 'activo')
SELECT DISTINCT consulta, concepto FROM a JOIN n ON list_contains(w, t)""",
    "nodes",
)
def _(v: Views) -> DataFrame:
    """Terms in double quotes or capitals, numbers and short technical words of a query, as whole words of a node."""
    q = v.table("casos_qa")
    marked = F.transform(F.concat(F.regexp_extract_all("consulta", F.lit('"([^"]+)"'), F.lit(1)), F.regexp_extract_all("consulta", F.lit(r"\b(?:[A-Z][A-Z0-9]+|[0-9]{2,})\b"), F.lit(0))), F.lower)
    short = F.array_intersect(T.words("consulta", 1), F.array(*map(F.lit, T.SHORT_GRAPH)))
    terms = q.select(F.col("item_id").alias("consulta"), F.explode(F.array_distinct(F.concat(marked, short))).alias("t"))
    words = F.concat(T.words(F.translate("concepto", "_", " "), 1), T.words("contenido", 1), T.words("sinonimos", 1))
    held = v.active.select("concepto", F.explode(F.array_distinct(words)).alias("t"))
    return held.join(terms, "t").select("consulta", "concepto").distinct()


@C.add(
    "se6k_whole_phrase",
    f"""WITH {_IDX}, w AS (SELECT item_id AS consulta, {W('consulta', 1)} AS w FROM casos_qa), f AS (SELECT DISTINCT consulta, w[i] AS a, w[i + 1] AS b FROM w, range(1, 200) r(i) WHERE i < len(w)),
c AS (SELECT concepto, peso, {W('contenido', 1)} AS w FROM act), g AS (SELECT DISTINCT concepto, peso, w[i] AS a, w[i + 1] AS b FROM c, range(1, 3000) r(i) WHERE i < len(w))
SELECT consulta, concepto, frases FROM (SELECT consulta, concepto, count(*) AS frases, row_number() OVER (PARTITION BY consulta ORDER BY count(*) DESC, peso DESC, concepto) AS r FROM f JOIN g USING (a, b) GROUP BY consulta, concepto, peso) WHERE r <= 50""",
    "nodes",
)
def _(v: Views) -> DataFrame:
    """Phrases of two words of the query that stand in a content word for word: 50 nodes by their number, then by weight."""
    two = lambda c: F.explode(F.array_distinct(F.arrays_zip(F.expr(f"slice({c}, 1, greatest(0, size({c}) - 1))").alias("a"), F.expr(f"slice({c}, 2, greatest(0, size({c}) - 1))").alias("b")))).alias("f")
    f = v.table("casos_qa").select(F.col("item_id").alias("consulta"), T.words("consulta", 1).alias("w")).select("consulta", two("w")).select("consulta", "f.*")
    g = v.active.select("concepto", "peso", T.words("contenido", 1).alias("w")).select("concepto", "peso", two("w")).select("concepto", "peso", "f.*")
    n = g.join(f, ["a", "b"]).groupBy("consulta", "concepto", "peso").agg(F.count(F.lit(1)).alias("frases"))
    return first_per(n, ["consulta"], [F.desc("frases"), F.desc("peso"), F.asc("concepto")], 50).select("consulta", "concepto", "frases")


def hub_confidence(v: Views) -> DataFrame:
    from quipu.plans import search

    return search.QUERIES["se6b_hub_expansion"](v.spark, v.dir)


_HUB = """hubq AS (SELECT consulta, hub_id, confianza FROM ({hub}) WHERE confianza >= 0.05),
can AS (SELECT consulta, lower(trim(canonical_node, ' ')) AS canonico, max(confianza) AS c FROM hubq JOIN concept_hubs USING (hub_id) WHERE trim(canonical_node, ' ') <> '' GROUP BY 1, 2)"""


def canonical(v: Views) -> DataFrame:
    """consulta, canonico, c: the canonical nodes of the hubs that a query means, with the confidence."""
    hubs = v.table("concept_hubs").select("hub_id", F.lower(F.trim("canonical_node")).alias("canonico")).where("canonico <> ''")
    return hub_confidence(v).where(F.col("confianza") >= SURE).join(hubs, "hub_id").groupBy("consulta", "canonico").agg(F.max("confianza").alias("c"))


def _hub_sql() -> str:
    from quipu.plans import search

    return _HUB.format(hub=search.SQL["se6b_hub_expansion"])


@C.add("sf1h_hub_signal", f"WITH {_hub_sql()} SELECT can.consulta, n.concepto, round(max(CASE WHEN n.concepto = canonico THEN least(1.0, 2 * c) ELSE least(0.8, 1.5 * c) END), 6) AS senal FROM can JOIN nodes n ON contains(canonico, n.concepto) GROUP BY 1, 2", "nodes")
def _(v: Views) -> DataFrame:
    """Canonical nodes of the hubs of a query, and nodes whose name is part of theirs: looked up by all parts of the name."""
    can = canonical(v)
    # every part of a canonical name is a key, so contained names are found by an equality
    cut = F.explode(F.expr("array_distinct(flatten(transform(sequence(1, length(canonico)), i -> transform(sequence(i, length(canonico)), j -> substring(canonico, i, j - i + 1)))))")).alias("concepto")
    names = can.select("canonico").distinct().select("canonico", cut)
    found = names.join(v.nodes.select("concepto"), "concepto").join(can, "canonico")
    s = F.when(F.col("concepto") == F.col("canonico"), F.least(F.lit(1.0), 2 * F.col("c"))).otherwise(F.least(F.lit(0.8), 1.5 * F.col("c")))
    return found.groupBy("consulta", "concepto").agg(F.round(F.max(s), 6).alias("senal"))


@C.add(
    "se6r_hub_first",
    f"""WITH {_TOP}, {_hub_sql()}, pri AS (SELECT consulta, canonico, c FROM (SELECT *, row_number() OVER (PARTITION BY consulta ORDER BY c DESC, canonico) AS r FROM can) JOIN act ON act.concepto = canonico WHERE r = 1 AND c >= 0.1),
u AS (SELECT consulta, concepto, bm25 / (bm25 + 3) AS s, 0 AS p FROM top WHERE rango <= 10 UNION ALL SELECT consulta, canonico, least(0.95, 0.95 * c), 1 FROM pri),
g AS (SELECT consulta, concepto, max(p) AS p, max(CASE WHEN p = 1 THEN s END) AS f, max(s) AS s FROM u GROUP BY 1, 2)
SELECT consulta, concepto, round(coalesce(f, s), 6) AS score, row_number() OVER (PARTITION BY consulta ORDER BY p DESC, s DESC, concepto) AS puesto FROM g""",
    "nodes",
)
def _(v: Views) -> DataFrame:
    """The ten best with the first canonical node of a sure hub put in front."""
    pri = first_per(canonical(v), ["consulta"], [F.desc("c"), F.asc("canonico")], 1).where(F.col("c") >= FIRST).select("consulta", F.col("canonico").alias("concepto"), "c").join(v.active.select("concepto"), "concepto", "left_semi")
    ten = top(v, 10).select("consulta", "concepto", (F.col("bm25") / (F.col("bm25") + 3)).alias("s"), F.lit(0).alias("p"))
    every = ten.unionByName(pri.select("consulta", "concepto", F.least(F.lit(0.95), 0.95 * F.col("c")).alias("s"), F.lit(1).alias("p")))
    g = every.groupBy("consulta", "concepto").agg(F.max("p").alias("p"), F.max(F.when(F.col("p") == 1, F.col("s"))).alias("f"), F.max("s").alias("s"))
    place = F.row_number().over(Window.partitionBy("consulta").orderBy(F.desc("p"), F.desc("s"), "concepto")).cast("bigint")
    return g.select("consulta", "concepto", F.round(F.coalesce("f", "s"), 6).alias("score"), place.alias("puesto"))


@C.add(
    "sf2g_subterms",
    f"""WITH t AS (SELECT DISTINCT unnest({W('consulta', 3)}) AS t FROM casos_qa), k AS (SELECT t, length(t) AS l, length(t) // 4 + 1 AS k, length(t) // (length(t) // 4 + 1) AS w FROM t)
SELECT t AS palabra, array_to_string(CASE WHEN l < 4 THEN [t] WHEN w < 3 THEN list_transform(range(1, l - 1), lambda i: substr(t, i, 3)) ELSE list_transform(range(0, k), lambda i: CASE WHEN i < k - 1 THEN substr(t, i * w + 1, w) ELSE substr(t, i * w + 1) END) END, '|') AS partes FROM k""",
)
def _(v: Views) -> DataFrame:
    """Parts of a query word of which one stays whole under its allowed edits: that many and one parts, or trigrams."""
    t = v.table("casos_qa").select(F.explode(T.words("consulta", 3)).alias("palabra")).distinct()
    n = F.length("palabra")
    k = t.withColumn("l", n).withColumn("k", F.floor(n / 4).cast("int") + 1).withColumn("w", F.floor(n / (F.floor(n / 4) + 1)).cast("int"))
    grams = F.expr("transform(sequence(1, greatest(1, l - 2)), i -> substring(palabra, i, 3))")
    pieces = F.expr("transform(sequence(0, k - 1), i -> if(i < k - 1, substring(palabra, i * w + 1, w), substring(palabra, i * w + 1)))")
    return k.select("palabra", F.array_join(F.when(F.col("l") < 4, F.array("palabra")).when(F.col("w") < 3, grams).otherwise(pieces), "|").alias("partes"))


@C.add(
    "sf2f_context_bonus",
    """WITH r AS (SELECT concepto FROM nodes WHERE ultimo_acceso IS NOT NULL ORDER BY ultimo_acceso DESC, concepto LIMIT 10), w AS (SELECT DISTINCT unnest(string_split(concepto, '_')) AS t FROM r)
SELECT DISTINCT n.concepto, CASE WHEN n.concepto IN (SELECT concepto FROM r) THEN CAST(0.05 AS DOUBLE) ELSE CAST(0.03 AS DOUBLE) END AS premio FROM (SELECT concepto, unnest(string_split(concepto, '_')) AS t FROM nodes) n JOIN w USING (t)""",
    "nodes",
)
def _(v: Views) -> DataFrame:
    """Bonus of the ten nodes used last, and of those that share a word of their names."""
    recent = context(v)
    words = recent.select(F.explode(F.split("concepto", "_")).alias("t")).distinct()
    alike = v.nodes.select("concepto", F.explode(F.split("concepto", "_")).alias("t")).join(F.broadcast(words), "t", "left_semi").select("concepto").distinct()
    own = recent.withColumn("x", F.lit(True))
    return alike.join(F.broadcast(own), "concepto", "left").select("concepto", F.when(F.col("x"), 0.05).otherwise(0.03).alias("premio"))


def context(v: Views, n: int = 10) -> DataFrame:
    """The n nodes used last: ten rows, the working memory."""
    return v.nodes.where("ultimo_acceso is not null").orderBy(F.desc("ultimo_acceso"), "concepto").limit(n).select("concepto")


# ---- symbolic fallback

_ACC = "translate(lower(replace(replace({x}, '_', ' '), '-', ' ')), 'áéíóúüñàèìòùâêîôûãõç', 'aeiouunaeiouaeiouaoc')"
_SYM = f"""fq AS (SELECT DISTINCT item_id AS consulta, unnest(regexp_extract_all({_ACC.format(x='consulta')}, '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS t FROM casos_qa),
fn AS (SELECT DISTINCT concepto, unnest(regexp_extract_all({_ACC.format(x="concepto || ' ' || coalesce(contenido, '') || ' ' || coalesce(sinonimos, '')")}, '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS u FROM nodes WHERE estado = 'activo'),
fv AS (SELECT t, u, round(1 - levenshtein(t, u) / CAST(greatest(length(t), length(u)) AS DOUBLE), 4) AS s FROM (SELECT DISTINCT t FROM fq), (SELECT DISTINCT u FROM fn) WHERE abs(length(t) - length(u)) <= greatest(length(t), length(u)) * 0.25 AND levenshtein(t, u) <= greatest(length(t), length(u)) * 0.25),
fm AS (SELECT fq.consulta, fn.concepto, fq.t, max(s) AS s FROM fq JOIN fv USING (t) JOIN fn USING (u) WHERE s >= 0.75 GROUP BY 1, 2, 3),
fs AS (SELECT m.consulta, concepto, round(sum(s) / n + 1e-9, 4) AS score FROM fm m JOIN (SELECT consulta, count(*) AS n FROM fq GROUP BY 1) c ON c.consulta = m.consulta GROUP BY 1, 2, n)"""


def similar_words(ours: DataFrame, theirs: DataFrame, least: float = 0.75) -> DataFrame:
    """t, u, s: words of both sides whose edit similarity is at least `least` (0.75 or more).

    A word of length l allows k = floor(l / 4) edits; cut into k + 1 parts one of them stays whole in the other word, moved by k places at
    most. So words meet by a part, its length and its place, and only these are compared.
    """
    n = F.length("w")
    k = F.floor(F.greatest(n, F.lit(1)) * (1 - least) / least + 1e-9).cast("int")  # edits that the longer of the two may have
    sized = ours.select(F.col("t").alias("w")).distinct().withColumn("n", n).withColumn("k", k)
    parts = sized.withColumn("p", F.expr("floor(n / (k + 1))")).select("w", "n", "k", F.explode(F.expr("transform(sequence(0, k), i -> struct(cast(i * p as int) as at, if(i < k, substring(w, int(i * p) + 1, int(p)), substring(w, int(i * p) + 1)) as x))")).alias("y"))
    mine = parts.select(F.col("w").alias("t"), "k", "y.x", F.explode(F.expr("sequence(greatest(0, y.at - k), y.at + k)")).alias("at")).where("x <> ''")
    lengths = [r[0] for r in mine.select(F.length("x")).distinct().collect()]  # fewer than a long word has characters
    zs = F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")
    spots = F.explode(F.expr("flatten(transform(zs, z -> transform(sequence(0, greatest(0, length(u) - z)), i -> struct(substring(u, i + 1, z) as x, i as at))))"))
    yours = theirs.select("u").distinct().withColumn("zs", zs).select("u", spots.alias("y")).select("u", "y.x", "y.at")
    met = mine.join(yours, ["x", "at"]).select("t", "u").distinct()
    return met.withColumn("s", T.similarity(F.col("t"), F.col("u"))).where(F.col("s") >= least)


def symbolic(v: Views) -> DataFrame:
    """consulta, concepto, score: the mean over a query's words of their best edit similarity of 0.75 or more in a node."""
    flat = lambda *c: F.array_distinct(F.regexp_extract_all(T.folded(F.concat_ws(" ", *(T.text(x) for x in c))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)))
    q = v.table("casos_qa").select(F.col("item_id").alias("consulta"), F.explode(flat("consulta")).alias("t"))
    held = v.active.select("concepto", F.explode(flat("concepto", "contenido", "sinonimos")).alias("u"))
    near = similar_words(q, held)
    best = held.join(near, "u").groupBy("concepto", "t").agg(F.max("s").alias("s"))
    n = q.groupBy("consulta").agg(F.count(F.lit(1)).alias("n"))
    return q.join(best, "t").groupBy("consulta", "concepto").agg(F.sum("s").alias("s")).join(n, "consulta").select("consulta", "concepto", F.round(F.col("s") / F.col("n") + 1e-9, 4).alias("score"))


@C.add("se6n_symbolic_fallback", f"WITH {_SYM} SELECT consulta, concepto, score FROM (SELECT *, row_number() OVER (PARTITION BY consulta ORDER BY score DESC, concepto) AS r FROM fs WHERE score >= 0.6) WHERE r <= 10", "nodes")
def _(v: Views) -> DataFrame:
    return first_per(symbolic(v).where("score >= 0.6"), ["consulta"], [F.desc("score"), F.asc("concepto")], 10).select("consulta", "concepto", "score")
