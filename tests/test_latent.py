import random

from pyspark.sql import functions as F

from quipu.operators import distribution as D
from quipu.operators import graph as G
from tests.conftest import rows


def test_pairs_of_given_words_have_the_npmi_of_all_pairs(spark):
    r = random.Random(3)
    texts = spark.createDataFrame([([r.choice("abcdefghij") for _ in range(r.randint(0, 6))],) for _ in range(80)], "t array<string>")
    pairs, df, n = D.pair_counts(texts, F.col("t"))
    each = {(a, b): x for a, b, x in D.scored_pairs(pairs, df, n).select("a", "b", "npmi").collect()}
    left, right = "abcz", "bcdefy"
    want = {(a, b): each[min(a, b), max(a, b)] for a in left for b in right if (min(a, b), max(a, b)) in each}
    words = lambda s: spark.createDataFrame([(c,) for c in s], "t string")
    got = D.directed_npmi(texts, F.col("t"), words(left), words(right)).collect()
    assert want and {(a, b): x for a, b, x in got} == want and len(got) == len(want)


def test_inferred_edges_of_given_origins_are_those_of_all(spark):
    r = random.Random(6)
    edges = {(f"n{r.randrange(25):02}", f"n{r.randrange(25):02}"): round(r.uniform(0.2, 1), 2) for _ in range(160)}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items() if a != b], "origen string, destino string, peso double")
    origins = spark.createDataFrame([("n01",), ("n07",), ("nadie",)], "origen string")
    want = [x for x in rows(G.inferred_edges(df, keep=3)) if x[0] in ("n01", "n07")]
    assert want and rows(G.inferred_edges(df, keep=3, origins=origins)) == want
