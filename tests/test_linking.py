import random

import pytest

from quipu.operators import overlap
from quipu.operators.linking import _shared, link_by_name
from quipu.plans import registry
from tests.conftest import rows
from tests.test_search import folder


def test_shared_is_exact_for_common_elements(spark):
    r = random.Random(3)
    sets = {f"k{i:03}": sorted({r.choice("abcdefgh") for _ in range(r.randint(1, 5))}) for i in range(150)}
    want = {}
    for a in sets:
        for b in sets:
            share = len(set(sets[a]) & set(sets[b])) / min(len(sets[a]), len(sets[b]))
            if a < b and share >= 0.4:
                want[a, b] = round(share, 9)
    got = rows(_shared(spark.createDataFrame(list(sets.items()), "k string, s array<string>"), 0.4))
    assert len(got) == len(want) and {(a, b): round(s, 9) for a, b, s in got} == want


def test_names_of_common_words_are_linked(spark):
    nodes = spark.createDataFrame([(f"comun_n{i}",) for i in range(60)], "concepto string")
    assert link_by_name(nodes).count() == 60 * 59 // 2


def test_pairs_of_names_are_not_shuffled(spark):
    """Each pair of a common word was shuffled before: as a candidate, with either set and with its members."""
    nodes = spark.createDataFrame([(f"comun_n{i}",) for i in range(60)], "concepto string")
    plan = link_by_name(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("MapInArrow")[0] and plan.count("Exchange") == 1


@pytest.mark.parametrize(("block", "batch"), [(24_000, 250_000), (13, 20)])
@pytest.mark.parametrize("least", [0.05, 0.3, 1.0])
def test_sets_that_share_enough_are_exact_over_many_cells(spark, monkeypatch, block, batch, least):
    monkeypatch.setattr(overlap, "BLOCK", block)
    monkeypatch.setattr(overlap, "BATCH", batch)
    r = random.Random(4)
    sets = {f"k{i:03}": sorted({r.choice("aaaabcdefghijklmnñ") for _ in range(r.randint(0, 9))}) for i in range(70)}
    share = lambda x, y: len(set(x) & set(y)) / max(1, min(len(x), len(y)))
    want = [(a, b, round(share(x, y), 6)) for a, x in sets.items() for b, y in sets.items() if a < b and share(x, y) >= least]
    got = rows(overlap.sharing(spark.createDataFrame([*sets.items(), (None, ["a"]), ("z", None)], "k string, s array<string>"), least, 6))
    assert got == sorted(want)


def test_queries_meet_names_of_common_words(spark, tmp_path):
    d = folder(spark, tmp_path, [(f"comun_n{i}", "texto") for i in range(60)], [(1, "algo comun")])
    assert registry.QUERIES["se18_familiarity"](spark, d).count() == 60


def test_a_node_with_a_light_edge_is_not_isolated(spark, tmp_path):
    d = folder(spark, tmp_path, [(c, "texto") for c in "abc"], [(1, "texto")])
    edge = "origen string, destino string, peso double, tipo string, creado_en timestamp_ntz, ultimo_uso timestamp_ntz"
    spark.createDataFrame([("a", "b", 0.1, "manual", None, None)], edge).write.parquet(f"{d}/sinapsis.parquet")
    assert rows(registry.QUERIES["jn11_isolated"](spark, d)) == [("c",)]
