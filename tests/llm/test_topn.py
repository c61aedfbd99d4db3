import random

import pytest

import quipu.llm.topn as topn
from quipu.llm.topn import top_n
from tests.conftest import rows


def brute(data, n):
    best = {}
    for g, i, s in data:
        if None not in (g, i, s) and s == s:
            best[g, i] = max(s, best.get((g, i), s))
    out = []
    for g in {g for g, _ in best}:
        ranked = sorted(((-s, i) for (h, i), s in best.items() if h == g))[:n]
        out += [(g, i, -s) for s, i in ranked]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("gathered", "held"), [(200_000, 1_000_000), (50, 1_000_000), (50, 60)])
def test_against_brute_force(spark, monkeypatch, gathered, held):
    """In one go, merged on the way, and with states that go out early."""
    monkeypatch.setattr(topn, "GATHERED", gathered)
    monkeypatch.setattr(topn, "HELD", held)
    r = random.Random(1)
    data = [("hot" if r.random() < 0.4 else f"g{r.randrange(50)}", f"i{r.randrange(300):03}", r.choice([0.1, 0.5, 0.5, 0.9, r.random()])) for _ in range(4000)]
    data += [(None, "i", 1.0), ("g1", None, 1.0), ("g1", "nan", float("nan")), ("g1", "nul", None), ("one", "i", 0.0)]
    df = spark.createDataFrame([(*x, "clash") for x in data], "g string, i string, s double, _cell string")
    for n in (1, 5, 400):
        got = top_n(df, "g", "i", "s", n)
        assert got.columns == ["g", "i", "s"]
        assert rows(got) == brute(data, n)


def test_a_group_of_a_third_of_all_rows_sends_n_rows_a_partition(spark):
    df = spark.range(30_000, numPartitions=6).selectExpr("if(id % 3 = 0, 'hot', cast(id % 5000 as string)) g", "cast(id as string) i", "cast(id % 977 as double) s")
    sent = df.selectExpr("g _g", "i _i", "s _s").mapInArrow(topn._local(4), "_g string, _i string, _s double, _r int")
    assert sent.where("_g = 'hot'").count() == 24
    want = rows(df.selectExpr("g", "i", "s", "row_number() over (partition by g order by s desc, i) r").where("r <= 4").drop("r"))
    assert rows(top_n(df, "g", "i", "s", 4)) == want


def test_empty(spark):
    assert top_n(spark.createDataFrame([], "g string, i string, s double"), "g", "i", "s", 3).count() == 0
