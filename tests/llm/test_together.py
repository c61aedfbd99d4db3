import random
from collections import Counter
from itertools import combinations

import pytest

import quipu.llm.together as together
from tests.conftest import rows


def brute(records, least, lift):
    n = sum(1 for r in records.values() if r)
    single, pair = Counter(), Counter()
    for items in records.values():
        single.update(items)
        pair.update(combinations(sorted(items), 2))
    return sorted((a, b, c, single[a], single[b]) for (a, b), c in pair.items() if c >= least and c * n >= lift * single[a] * single[b])


@pytest.mark.parametrize(("dense", "wide", "part"), [(4, 256, 9), (16, 256, 9), (100_000, 256, 9), (16, 2, 2), (4, 1, 1), (16, 4, 2)])
def test_against_brute_force(spark, monkeypatch, dense, wide, part):
    """Whatever counts as frequent, the three ways of counting give the same, also where records are wide."""
    monkeypatch.setattr(together, "DENSE", dense)
    monkeypatch.setattr(together, "BLOCK", 70)
    monkeypatch.setattr(together, "GATHERED", 300)
    monkeypatch.setattr(together, "WIDE", wide)
    monkeypatch.setattr(together, "PART", part)
    r = random.Random(dense)
    records = {}
    for k in range(300):
        topic = r.randrange(6)
        records[str(k)] = {f"w{topic}{r.randrange(5)}" for _ in range(r.randint(0, 5))} | {f"ñ{r.randrange(40)}" for _ in range(r.randint(0, 4))} | {"común"}
    data = [("s", k, i) for k, items in records.items() for i in items] + [("otro", "1", "w00")]
    df = spark.createDataFrame(data, "_scope string, _rec string, _item string")
    got = together.pairs_of_scope(df, "s", 4, 2.0)
    assert rows(got.select("item_a", "item_b", "n_ab", "n_a", "n_b")) == sorted(brute(records, 4, 2.0), key=repr)
    assert got.count() > 5


def test_a_record_of_very_many_items(spark):
    """A third of all rows lie in one record: its pairs are not spelled out."""
    many = spark.range(50_000).selectExpr("'s' _scope", "'ancho' _rec", "cast(id as string) _item")
    few = spark.range(100_000).selectExpr("'s' _scope", "cast(id % 10000 as string) _rec", "cast((id % 10000) * 5 + id div 20000 as string) _item").distinct()
    again = spark.range(60).selectExpr("'s' _scope", "concat('r', id % 12) _rec", "cast(7 + 9 * (id % 5) as string) _item").distinct()
    got = together.pairs_of_scope(many.unionByName(few).unionByName(again), "s", 9, 2.0)
    assert {(r["item_a"], r["item_b"]) for r in got.collect()} == {tuple(sorted(x)) for x in combinations(map(str, range(7, 52, 9)), 2)}


def test_empty(spark):
    df = spark.createDataFrame([], "_scope string, _rec string, _item string")
    assert together.pairs_of_scope(df, "s", 2, 1.0).count() == 0
