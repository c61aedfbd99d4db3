import random

import pytest

from quipu.llm.leaks import _tiles, leaks, words
from tests.conftest import rows

import numpy as np


def brute(docs, items, size):
    out = set()
    for d, t in docs:
        w = words(t)
        have = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        for k, p in items:
            q = words(p)
            if any(tuple(q[i : i + size]) in have for i in range(len(q) - size + 1)):
                out.add((d, k))
    return sorted(out)


def test_words():
    assert words("Él_dijo: ÑANDÚ-2, ﬁn x²!") == ["el", "dijo", "nandu", "2", "fin", "x2"]
    assert words(None) == words("") == words(" ,.") == []


def test_against_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"palabra{i}" for i in range(30)]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, line(r.randint(5, 40))) for k in range(30)]
    docs = []
    for d in range(200):
        t = line(r.randint(0, 60))
        if d % 3 == 0:
            p = words(items[r.randrange(30)][1])
            a = r.randrange(len(p))
            cut = p[a : a + r.randint(8, 20)]
            t += ". " + "\n".join(x.upper() for x in cut) + " " + line(5)
        docs.append((d, t))
    docs += [(900, None), (901, ""), (902, items[0][1]), (903, items[0][1]), (904, items[3][1] * 400)]
    extra = [(99, None), (98, ""), items[0]]
    df = spark.createDataFrame([(*x, "clash") for x in docs], "_id bigint, _text string, _h string")
    it = spark.createDataFrame(items + extra, "_item bigint, _passage string")
    got = leaks(df, it, 12)
    assert sorted(map(tuple, got.select("_id", "_item").collect())) == brute(docs, items, 12)
    assert all(0 < r_["cobertura"] <= 1 and r_["mas_larga"] >= 12 for r_ in got.collect())


def test_reordered_passage_is_tiled_whole():
    # item words 0..39; document has 20..39 first, then 0..19
    p = np.array([i for i in range(20 - 11)] + [20 + i for i in range(20 - 11)])
    q = np.array([20 + i for i in range(20 - 11)] + [i for i in range(20 - 11)])
    assert sorted(t[2] for t in _tiles(p, q, 12)) == [20, 20]


def test_tiles_do_not_overlap():
    p = np.array([0, 1, 2, 3, 0, 1])
    q = np.array([0, 1, 2, 3, 30, 31])
    assert _tiles(p, q, 3) == [(0, 0, 6)]


@pytest.mark.parametrize("seed", range(30))
def test_tiles_are_disjoint_and_miss_no_free_window(seed):
    r = random.Random(seed)
    x, y = ([r.randrange(2 + seed % 5) for _ in range(r.randint(3, 60))] for _ in range(2))
    same = [(i, j) for i in range(len(x) - 2) for j in range(len(y) - 2) if x[i : i + 3] == y[j : j + 3]]
    if not same:
        return
    p, q = map(np.array, zip(*same))
    tiles = _tiles(p, q, 3)
    ours, theirs = [a + k for a, _, n in tiles for k in range(n)], [b + k for _, b, n in tiles for k in range(n)]
    assert len(set(ours)) == len(ours) and len(set(theirs)) == len(theirs)
    assert all(x[a : a + n] == y[b : b + n] and n >= 3 for a, b, n in tiles)
    assert not [(i, j) for i, j in same if not {i, i + 1, i + 2} & set(ours) and not {j, j + 1, j + 2} & set(theirs)]
    assert max(n for *_, n in tiles) == max(k for i in range(len(x)) for j in range(len(y)) for k in range(3, 61) if x[i : i + k] == y[j : j + k] and i + k <= len(x) and j + k <= len(y))


def test_a_passage_in_a_third_of_all_documents(spark):
    vocabulary = [f"v{i}" for i in range(200)]
    r = random.Random(9)
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    hot = line(30)
    items = [(k, hot) for k in range(5)] + [(10 + k, line(20)) for k in range(20)] + [(3, items_ := line(25))]
    docs = [(d, line(20) + (" " + hot if d % 3 == 0 else "") + (" " + items_ if d % 50 == 0 else "")) for d in range(1500)]
    got = leaks(spark.createDataFrame(docs, "_id bigint, _text string"), spark.createDataFrame(items, "_item bigint, _passage string"))
    assert sorted(map(tuple, got.select("_id", "_item").collect())) == sorted(set(brute(docs, items, 12)))


def test_empty(spark):
    d, i = spark.createDataFrame([], "_id bigint, _text string"), spark.createDataFrame([], "_item bigint, _passage string")
    assert leaks(d, i).count() == 0
    assert rows(leaks(spark.createDataFrame([(1, "a b c")], "_id bigint, _text string"), i)) == []
