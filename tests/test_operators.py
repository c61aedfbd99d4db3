import math
import random

import pytest
from pyspark.sql import functions as F

from quipu.functions import score as S
from quipu.functions import text as T
from quipu.functions.stem import english, spanish, stem_word, with_stems
from quipu.operators import calibration as K
from quipu.operators import distribution as D
from quipu.operators import graph as G
from quipu.operators import lifecycle as L
from quipu.operators.similar import jaccard_join
from quipu.operators.skew import heavy_keys, join_with_heavy
from tests.conftest import rows


@pytest.fixture(scope="module")
def net(spark):
    r = random.Random(5)
    es = {}
    for _ in range(300):
        a, b = r.randrange(30), r.randrange(30)
        if a != b:
            es[f"n{a:02}", f"n{b:02}"] = round(r.random(), 2)
    return es, spark.createDataFrame([(a, b, w) for (a, b), w in es.items()], "origen string, destino string, peso double")


def near(es):
    u = {}
    for (a, b), w in es.items():
        for x, y in ((a, b), (b, a)):
            u[x, y] = max(w, u.get((x, y), -1))
    return u


def test_common_neighbours_and_jaccard(net):
    es, df = net
    u = near(es)
    of = {}
    for a, b in u:
        of.setdefault(a, set()).add(b)
    want = {(a, b): len(of[a] & of[b]) for a, b in u if a < b and of[a] & of[b]}
    und = G.undirected(df)
    assert {(a, b): n for a, b, n in rows(G.common_neighbours(und))} == want
    for a, b, j in rows(G.neighbour_jaccard(und).select("a", "b", "jaccard")):
        assert j == pytest.approx(len(of[a] & of[b]) / len(of[a] | of[b]))


def test_transitive_edges_are_the_best_two_step_paths(net):
    es, df = net
    best = {}
    for (a, m), w in es.items():
        for (m2, b), x in es.items():
            if m == m2 and b != a and w >= 0.25 and x >= 0.25 and w * 0.7 * x * 0.7 >= 0.05 and (a, b) not in es:
                best[a, b] = max(best.get((a, b), 0), w * 0.7 * x * 0.7)
    got = {(a, b): w for a, b, w, _ in rows(G.transitive_edges(df, fan=100))}
    assert set(got) <= set(best) and all(got[k] == pytest.approx(best[k]) for k in got)
    count = {}
    for a, _ in best:
        count[a] = count.get(a, 0) + 1
    assert len(got) == sum(min(20, n) for n in count.values())


def test_label_propagation_finds_two_cliques(spark):
    es = [(f"a{i}", f"a{j}", 1.0) for i in range(5) for j in range(i)] + [(f"b{i}", f"b{j}", 1.0) for i in range(5) for j in range(i)] + [("a0", "b0", 0.1)]
    und = G.undirected(spark.createDataFrame(es, "origen string, destino string, peso double"))
    labels = G.label_propagation(und, 4)
    got = dict(rows(labels))
    assert len({got[f"a{i}"] for i in range(5)}) == 1 and len({got[f"b{i}"] for i in range(5)}) == 1 and got["a1"] != got["b1"]
    assert G.communities(und, labels).count() == 2


def test_upsert_keeps_protected_type_and_greatest_weight(spark):
    s = "origen string, destino string, peso double, tipo string, creado timestamp_ntz, uso timestamp_ntz"
    old = spark.createDataFrame([("a", "b", 0.4, "sinonimo_explicito", None, None), ("a", "c", 0.6, "manual", None, None)], s)
    new = spark.createDataFrame([("a", "b", 0.9, "co_nombre", None, None), ("x", "y", 0.1, "test", None, None)], s)
    got = [(r[0], r[1], r[2], r[3]) for r in rows(G.upsert_edges(old, new))]
    assert got == [("a", "b", 0.9, "sinonimo_explicito"), ("a", "c", 0.6, "manual"), ("x", "y", 0.1, "test")]


def test_jaccard_join_against_all_pairs(spark):
    r = random.Random(1)
    sets = [(k, sorted({r.choice("abcdefghij") for _ in range(r.randint(0, 6))})) for k in range(60)] + [(99, ["a", "b"]), (98, ["b", "a"])]
    df = spark.createDataFrame(sets, "k int, s array<string>")
    for least in (0.5, 0.8, 1.0):
        want = sorted((a, b) for a, x in sets for b, y in sets if a < b and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= least)
        assert [(a, b) for a, b, _ in sorted(map(tuple, jaccard_join(df, least).collect()))] == want


def test_join_with_heavy_equals_join(spark):
    big = spark.createDataFrame([("h" if i % 3 else f"k{i}", i) for i in range(3000)] + [(None, -1)], "k string, n int")
    small = spark.createDataFrame([("h", 1), ("k3", 2), ("zz", 3)], "k string, v int")
    got = join_with_heavy(big, small, "k", heavy_keys(big, "k", 3001))
    assert rows(got.select("k", "n", "v")) == rows(big.join(small, "k").select("k", "n", "v"))


def test_tokenizers(spark):
    df = spark.createDataFrame([("El_Nodo API de-búsqueda, ui x1 corteza corteza", 1), (None, 2), ("", 3)], "t string, k int").orderBy("k")
    take = lambda c: [r[0] for r in df.select(c).collect()]
    assert [sorted(x) for x in take(T.graph_tokens("t"))] == [["api", "búsqueda", "corteza", "ui"], [], []]
    assert take(T.pmi_tokens("t"))[0] == ["api", "búsqueda", "corteza", "corteza", "api"]
    assert sorted(take(T.folded_tokens("t"))[0]) == ["api", "busqueda", "corteza", "de", "el", "nodo", "ui", "x1"]
    assert take(T.trigrams(F.lit("ab")))[0] == ["ab"] and take(T.trigrams(F.lit("abcd")))[0] == ["abc", "bcd"]
    assert take(T.whole_word(F.lit("nodo"), "t")) == [True, False, False]
    assert take(T.word_prefix(F.lit("búsq"), "t")) == [True, False, False]
    assert take(T.preview("t", 5)) == ["El_No...", "", ""]


def test_hybrid_is_bounded_and_monotone(spark):
    base = {k: F.lit(0.3) for k in S.WEIGHTS}
    value = lambda **kw: spark.range(1).select(S.hybrid(base | {k: F.lit(v) for k, v in kw.items()})).first()[0]
    low = value()
    for k in S.WEIGHTS:
        assert low <= value(**{k: 0.8}) <= 1.0
    assert spark.range(1).select(S.hybrid(base, F.lit(True))).first()[0] > low
    assert math.isclose(sum(S.WEIGHTS.values()), 1.39)


def test_statistics_against_formulas(spark):
    df = spark.createDataFrame([(5, 9, 8, 100), (3, 3, 3, 3)], "c int, x int, y int, n int")
    got = rows(df.select(S.npmi(F.col("c"), F.col("x"), F.col("y"), F.col("n")), S.dunning(F.col("c"), F.col("x"), F.col("y"), F.col("n"))))
    p = 0.05
    assert got[0][0] == pytest.approx(math.log2(p / (0.09 * 0.08)) / -math.log2(p)) and got[1][0] == 1.0
    assert got[0][1] > 0 and got[1][1] == pytest.approx(0)


def test_svd_reconstructs_the_gram_matrix(spark):
    r = random.Random(2)
    cells = [(f"d{d}", f"t{t}", r.random()) for d in range(12) for t in range(6) if r.random() < 0.7]
    vectors = dict(rows(D.truncated_svd(spark.createDataFrame(cells, "doc string, term string, ppmi double"), 6, 6)))
    assert len(vectors) == 12 and {len(v) for v in vectors.values()} == {6}
    assert D.truncated_svd(spark.createDataFrame([], "doc string, term string, ppmi double")).count() == 0


def test_near_by_hamming_is_exact(spark):
    r = random.Random(4)
    words = [(k, r.getrandbits(16) - (1 << 63) * (k % 2)) for k in range(80)] + [(200, 7), (201, 7), (202, None)]
    df = spark.createDataFrame(words, "k int, word bigint")
    m = (1 << 64) - 1
    want = sorted((a, b, bin((x ^ y) & m).count("1")) for a, x in words for b, y in words if a < b and None not in (x, y) and bin((x ^ y) & m).count("1") <= 3)
    assert rows(D.near_by_hamming(df, 3)) == sorted(want, key=repr)


def test_conformal_and_auc(spark):
    s = [0.3372, 0.40, 0.42, 0.45, 0.50, 0.55, 0.58, 0.61]
    df = spark.createDataFrame([(x,) for x in s], "score double")
    assert K.conformal_threshold(df, 0.2).first()["umbral"] == 0.61
    assert K.conformal_threshold(df, 0.5).first()["umbral"] == 0.50
    assert K.conformal_threshold(df.limit(0)).count() == 0
    pairs = spark.createDataFrame([(0.2, False), (0.3, False), (0.5, True), (0.6, True), (0.3, True)], "score double, positivo boolean")
    assert K.auc(pairs).first()["auc"] == pytest.approx((2 + 2 + 1.5) / 6)
    a, b = K.platt(pairs)
    assert a > 0
    steps = K.isotonic_steps(pairs)
    assert steps == sorted(steps) and [p for _, p in steps] == sorted(p for _, p in steps)
    assert K.step_value(steps, 0.95) == 1.0


def test_reinforcement_in_order(spark):
    ev = spark.createDataFrame([("a", 2, 1, False), ("a", 1, 2, True), ("b", 1, 3, False), (None, 1, 4, True)], "clave string, ts int, event_id int, exito boolean")
    w = 0.5 + 0.15 * (1 - 0.15)
    w = max(0.05, w - 0.10 / (1 + math.log(2)))
    assert rows(L.reinforce(ev)) == [("a", round(w, 6), 1, 2), ("b", 0.4, 0, 1)]
    assert L.reinforce(ev.limit(0)).count() == 0


def test_stems_of_the_published_vocabularies():
    """Words with the stems that the algorithms' published samples give (without accents)."""
    ours = {"consigned": "consign", "knackeries": "knackeri", "generously": "generous", "happily": "happili", "relational": "relat", "hopping": "hop", "hoping": "hope", "skies": "sky", "succeed": "succeed"}
    assert {w: english(w) for w in ours} == ours
    theirs = {"chicas": "chic", "torneos": "torne", "cheques": "chequ", "chimenea": "chimene", "toreros": "torer", "rapidamente": "rapid", "velocidad": "veloc", "biologia": "biolog", "sigue": "sig"}
    assert {w: spanish(w) for w in theirs} == theirs


def test_stems_are_joined_back(spark):
    df = spark.createDataFrame([("configurar", 1), ("configurar", 2), (None, 3), ("memories", 4)], "w string, _w int")
    got = {r["_w"]: r["s"] for r in with_stems(df.withColumnRenamed("_w", "n"), "w", "s").withColumnRenamed("n", "_w").collect()}
    assert got == {1: "configur", 2: "configur", 3: None, 4: "memori"}


def test_stems_meet():
    assert stem_word("configurado") == stem_word("configurar")
    assert stem_word("sol") == "sol"
