import random

import pytest
from pyspark.sql import functions as F

from quipu.operators import similar
from tests.conftest import rows


@pytest.mark.parametrize("at_once", [16_000, 3])
def test_common_elements_meet_in_parts(spark, monkeypatch, at_once):
    monkeypatch.setattr(similar, "AT_ONCE", at_once)
    r = random.Random(2)
    sets = [(k, sorted({r.choice("abcdefgh") for _ in range(r.randint(1, 7))})) for k in range(70)]
    df = spark.createDataFrame(sets, "k int, s array<string>")
    want = sorted((a, b) for a, x in sets for b, y in sets if a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.4)
    assert [(a, b) for a, b, _ in sorted(map(tuple, similar.jaccard_join(df, 0.4).collect()))] == want


def test_only_alike_sets_leave_the_place_where_they_meet(spark):
    """All share a common element of their prefixes, so each pair met, was shuffled and compared before."""
    sets = spark.createDataFrame([(i, ["comun", *[f"{i}-{j}" for j in range(6)]]) for i in range(100)] + [(100, ["comun", *[f"7-{j}" for j in range(5)]])], "i bigint, c array<string>")
    df = spark.createDataFrame([("comun", 1)], "t string, df bigint")
    p = similar.prefixes(sets, df, 0.4)
    met = similar.meeting(p, p, 0.4, F.col("xi") < F.col("yi"))
    assert (7, 100) in rows(met) and met.count() < 10


def test_sets_of_common_words_meet_in_arrays(spark):
    """Every meeting of two sets at a common element was a joined row before."""
    sets = spark.createDataFrame([(f"k{i}", ["comun", f"a{i % 7}", f"b{i % 5}"]) for i in range(40)], "k string, s array<string>")
    plan = similar.jaccard_join(sets, 0.4)._jdf.queryExecution().executedPlan().toString()
    assert "bit_count" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize(("block", "meetings", "many"), [(100_000, 100_000, 20_000), (9, 5, 3), (30, 50, 1), (30, 7, 10**9)])
@pytest.mark.parametrize("least", [0.1, 0.4, 0.75, 1.0])
def test_alike_is_exact_over_many_cells(spark, monkeypatch, block, meetings, many, least):
    for name, value in (("BLOCK", block), ("MEETINGS", meetings), ("MANY", many)):
        monkeypatch.setattr(similar, name, value)
    r = random.Random(6)
    sets = [(i, sorted({r.choice("aaaabbcdeñfghij") for _ in range(r.randint(1, 14))} | {r.choice(["", f"solo{i}"])})) for i in range(60)]
    share = lambda x, y: round(len(set(x) & set(y)) / len(set(x) | set(y)), 9)
    want = sorted((*sorted((i, j)), share(x, y)) for i, x in sets for j, y in sets if i < j and share(x, y) >= least)
    got = similar.alike(spark.createDataFrame(sets, "i bigint, c array<string>"), least).collect()
    assert sorted((*sorted((x, y)), round(s, 9)) for x, y, s in got) == want


def test_no_sets_are_in_no_pair(spark):
    none = spark.createDataFrame([("a", []), ("b", None)], "k string, s array<string>")
    assert similar.jaccard_join(none, 0.4).count() == 0
