"""Helpers for groups of any size, against brute force and on skewed input."""

import random

from pyspark.sql import functions as F

from quipu.operators.calibration import auc, conformal_threshold
from quipu.operators.graph import inferred_edges
from quipu.operators.running import running_before
from quipu.operators.sdm import search, signatures
from quipu.operators.skew import join_checked
from quipu.plans.recall import similar_words
from tests.conftest import rows


def test_running_sums_of_a_group_of_most_rows(spark):
    r = random.Random(4)
    data = [("hot" if r.random() < 0.7 else r.choice(["a", "b", None]), i, r.randrange(50)) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, i int, _v int").withColumnRenamed("_v", "w")
    for by in (["g"], []):
        got = {x["i"]: x["s"] for x in running_before(df, by, [F.asc("w"), F.asc("i")], F.col("w"), "s").collect()}
        want, sums = {}, {}
        for g, i, w in sorted(data, key=lambda x: (x[2], x[1])):
            k = g if by else 0
            want[i] = sums.get(k, 0)
            sums[k] = want[i] + w
        assert got == want
    assert running_before(df.limit(0), ["g"], [F.asc("i")], F.col("w"), "s").count() == 0


def test_thresholds_and_auc_on_many_ties(spark):
    r = random.Random(5)
    data = [(r.randrange(20) / 20, r.random() < 0.4) for _ in range(500)]
    df = spark.createDataFrame(data, "score double, positivo boolean")
    p, n = [s for s, y in data if y], [s for s, y in data if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))
    assert abs(auc(df).first()[0] - want) < 1e-9
    import math

    k = min(len(n), math.ceil((len(n) + 1) * 0.9 - 1e-9))
    assert tuple(conformal_threshold(df.where("not positivo").select("score"), 0.1).first()) == (sorted(n)[k - 1], len(n))


def test_inferred_edges_are_exact_around_a_hub(spark):
    r = random.Random(6)
    w = {}
    for k in range(300):
        w[f"n{k % 90}", "hub"] = r.choice([0.2, 0.5, 0.9])
        w["hub", f"n{r.randrange(200)}"] = r.choice([0.1, 0.4, 0.8, 0.8, 1.0])
        a, b = f"n{r.randrange(200)}", f"n{r.randrange(200)}"
        if a != b:
            w[a, b] = r.random()
    best = {}
    for (a, m), x in w.items():
        for (m2, b), y in w.items():
            v = x * 0.7 * y * 0.7
            if m == m2 and a != b and x >= 0.25 and y >= 0.25 and v >= 0.05 and (a, b) not in w:
                best[a, b] = max(v, best.get((a, b), 0))
    want = set()
    for o in {a for a, _ in best}:
        want |= {(o, b) for _, b in sorted((-round(v, 9), b) for (a, b), v in best.items() if a == o)[:20]}
    df = spark.createDataFrame([(a, b, x) for (a, b), x in w.items()], "origen string, destino string, peso double")
    assert {(x["origen"], x["destino"]) for x in inferred_edges(df).collect()} == want


def test_similar_words_against_brute_force(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(2, 12)))
    ours, theirs = {word() for _ in range(120)}, {word() for _ in range(120)}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(a, b) for a in ours for b in theirs if 1 - distance(a, b) / max(len(a), len(b)) >= 0.75}
    got = similar_words(spark.createDataFrame([(x,) for x in ours], "t string"), spark.createDataFrame([(x,) for x in theirs], "u string"))
    assert {(x["t"], x["u"]) for x in got.collect()} == want


def test_a_counted_lookup_and_a_large_one_give_the_same(spark, monkeypatch):
    import quipu.operators.skew as skew

    df = spark.range(1000).selectExpr("id % 7 k", "id")
    few = spark.createDataFrame([(1, "x"), (3, "y")], "k bigint, v string")
    want = rows(df.join(few, "k", "left"))
    assert rows(join_checked(df, few, "k", "left")) == want
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 1)
    assert rows(join_checked(df, few, "k", "left")) == want


def test_signatures_of_odd_nodes_and_search(spark):
    n = spark.createDataFrame([("a", ["uno", "dos"], ["a"], "Lesson"), ("b", ["uno", "dos"], ["b"], None), ("vacio", [], [], None)], "concepto string, palabras array<string>, nombre array<string>, categoria string")
    none = spark.createDataFrame([], "concepto string, dim string, idf double"), spark.createDataFrame([], "a string, b string")
    got = {r["concepto"]: r["b"] for r in signatures(n, *none).collect()}
    assert set(got) == {"a", "b"} and all(0 <= p < 2048 for b in got.values() for p in b) and got["a"] != got["b"]
    index = spark.createDataFrame([("x", [1, 2, 3]), ("y", [1, 2, 3]), ("z", [900])], "concepto string, b array<int>")
    asked = spark.createDataFrame([(1, [1, 2, 3])], "consulta bigint, b array<int>")
    assert [tuple(r) for r in search(index, asked, 400, 2).orderBy("concepto").collect()] == [(1, "x", 0, 1.0), (1, "y", 0, 1.0)]
    assert search(index, asked, 3, 5).count() == 2
