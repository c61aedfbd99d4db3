import random

import numpy as np
import pytest

from quipu.operators import overlap
from tests.conftest import rows


@pytest.mark.parametrize("held_at_most", [10_000, 40])
def test_most_shared_is_what_brute_force_gives(spark, monkeypatch, held_at_most):
    monkeypatch.setattr(overlap, "HELD", held_at_most)
    r = random.Random(5)
    words = [f"p{i}" for i in range(30)]
    held = {f"n{i:03}": {*r.sample(words[:12] if i % 2 else words, r.choice([1, 2, 3, 4, 5, 12]))} for i in range(120)}
    asked = {i: {*r.sample(words, r.choice([0, 1, 2, 6, 15, 30])), "ajena"} for i in range(60)}
    want = []
    for d, x in asked.items():
        best = sorted((-len(x & y), k) for k, y in held.items() if len(x & y) > 1)[:10]
        want += [(d, k, -m) for m, k in best]
    each = lambda sets, schema: spark.createDataFrame([(k, t) for k, s in sets.items() for t in s], schema)
    got = overlap.most_shared(each(asked, "doc_id bigint, t string"), each(held, "concepto string, t string"), "doc_id", "concepto", 10)
    assert rows(got) == sorted(want, key=repr)


def test_a_common_word_makes_no_pairs(spark):
    """A thousand sets and a thousand askers share one word: the join on words would give a million rows."""
    held = spark.createDataFrame([(f"n{i:04}", t) for i in range(1000) for t in ("comun", f"raro{i}")], "concepto string, t string")
    asked = spark.createDataFrame([(i, t) for i in range(1000) for t in ("comun", f"raro{i % 7}")], "doc_id bigint, t string")
    got = overlap.most_shared(asked, held, "doc_id", "concepto", 10).collect()
    assert {(r["doc_id"], r["concepto"], r["n"]) for r in got} == {(i, f"n{i % 7:04}", 2) for i in range(1000)}
    assert overlap._levels(*_coded(held), 10)[0][0].size == 1000  # one combination a set, none of the common word alone


def _coded(held):
    codes = {t: i for i, t in enumerate(sorted({r["t"] for r in held.collect()}))}
    sets = {}
    for r in held.collect():
        sets.setdefault(r["concepto"], []).append(codes[r["t"]])
    return np.array([len(sets[k]) for k in sorted(sets)]), np.array([c for k in sorted(sets) for c in sorted(sets[k])]), len(codes)


def test_a_side_without_sets_gives_nothing(spark):
    one = spark.createDataFrame([(1, "a"), (1, "b")], "doc_id bigint, t string")
    held = spark.createDataFrame([("n", "x"), ("n", "y")], "concepto string, t string")
    assert overlap.most_shared(one, held, "doc_id", "concepto", 10).count() == 0
    assert overlap.most_shared(one.limit(0), held, "doc_id", "concepto", 10).count() == 0


@pytest.mark.parametrize("held_at_most", [10_000, 30])
def test_most_alike_before_is_what_brute_force_gives(spark, monkeypatch, held_at_most):
    monkeypatch.setattr(overlap, "HELD", held_at_most)
    r = random.Random(8)
    sets = [(f"k{i:02}", r.randrange(40), sorted({"comun", *r.sample("abcdefghij", r.randint(0, 6))})) for i in range(80)]
    want = []
    for k, at, c in sets:
        s = sorted((-len({*c} & {*d}) / len({*c} | {*d}), q) for q, when, d in sets if when < at)
        want += [(k, q, -x) for x, q in s[:3] if -x >= 0.3]
    got = overlap.most_alike_before(spark.createDataFrame(sets, "k string, at bigint, c array<string>"), 0.3, 3)
    assert rows(got) == sorted(want, key=repr)
