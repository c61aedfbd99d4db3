import math

import numpy as np
import pytest

import quipu.llm.neighbours as neighbours
from quipu.llm.graph_index import ProximityGraph
from quipu.llm.neighbours import most_similar


def brute(keys, X, k, least):
    U = X / np.linalg.norm(X, axis=1)[:, None]
    S = U @ U.T
    out = set()
    for i in range(len(keys)):
        order = sorted((j for j in range(len(keys)) if j != i), key=lambda j: (-round(S[i, j], 6), keys[j]))[:k]
        out |= {(keys[i], keys[j]) for j in order if S[i, j] >= least}
    return out


def test_graph_recall():
    r = np.random.default_rng(1)
    X = r.normal(size=(1500, 40))
    X /= np.linalg.norm(X, axis=1)[:, None]
    ids, _ = ProximityGraph(X.astype(np.float32)).search(X[:200].astype(np.float32))
    top = np.argsort(-(X[:200] @ X.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids[:, :12].tolist(), top.tolist())]) > 0.9


@pytest.mark.parametrize(("cell", "wide", "asked"), [(8000, 3, 120_000), (60, 3, 120_000), (60, 1, 100)])
def test_recall_and_shape(spark, monkeypatch, cell, wide, asked):
    """In one cell, in several, and with cells cut into shards that are copied for their queries."""
    monkeypatch.setattr(neighbours, "CELL", cell)
    monkeypatch.setattr(neighbours, "WIDE", wide)
    monkeypatch.setattr(neighbours, "ASKED", asked)
    r = np.random.default_rng(2)
    centres = r.normal(size=(60, 20))
    X = np.concatenate([c + 0.15 * r.normal(size=(10, 20)) for c in centres])
    keys = [f"k{i:04}" for i in range(len(X))]
    data = [(k, [float(x) for x in v], "clash") for k, v in zip(keys, X)]
    data += data[:20] + [("nulo", None, ""), ("vacio", [], ""), ("cero", [0.0] * 20, ""), ("corto", [1.0], ""), ("nan", [float("nan")] * 20, ""), ("inf", [math.inf] + [0.0] * 19, ""), (None, [1.0] * 20, "")]
    df = spark.createDataFrame(data, "_k string, _v array<float>, _c string")
    got = {(a, b) for a, b, s in map(tuple, most_similar(df, 5, 20, 0.5).collect())}
    want = brute(keys, X, 5, 0.5)
    assert len(want & got) >= 0.95 * len(want)
    assert {a for a, _ in got} <= set(keys)


def test_copies_are_given_by_key(spark):
    data = [(f"c{i:02}", [1.0, 2.0]) for i in range(30)] + [("d", [2.0, 4.0]), ("e", [1.0, -3.0])]
    got = sorted(map(tuple, most_similar(spark.createDataFrame(data, "_k string, _v array<float>"), 3, 2, 0.9).select("_k", "_b").collect()))
    assert [b for a, b in got if a == "c00"] == ["c01", "c02", "c03"]
    assert [b for a, b in got if a == "c20"] == ["c00", "c01", "c02"]
    assert [b for a, b in got if a == "d"] == ["c00", "c01", "c02"]
    assert not [1 for a, _ in got if a == "e"]


def test_a_key_of_several_vectors_keeps_one(spark):
    data = [("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [1.0, 0.01]), ("c", [0.01, 1.0])]
    got = sorted(map(tuple, most_similar(spark.createDataFrame(data, "_k string, _v array<float>"), 3, 2, 0.9).select("_k", "_b").collect()))
    assert got in ([("a", "b"), ("b", "a")], [("a", "c"), ("c", "a")])


def test_pivots_in_two_steps(monkeypatch):
    monkeypatch.setattr(neighbours, "FLAT", 50)
    r = np.random.default_rng(5)
    P, V = (x / np.linalg.norm(x, axis=1)[:, None] for x in (r.normal(size=(400, 12)), r.normal(size=(300, 12))))
    tree = neighbours.Pivots(P.astype(np.float32))
    got, want = tree.nearest(V.astype(np.float32), 3), np.argsort(-(V @ P.T), axis=1)[:, :3]
    assert all(len({x for x in g if x >= 0}) == 3 for g in got.tolist())
    assert np.mean([len(set(a) & set(b)) / 3 for a, b in zip(got.tolist(), want.tolist())]) > 0.85
    assert neighbours.Pivots(P[:2].astype(np.float32)).nearest(V[:4].astype(np.float32), 3).shape == (4, 2)


def test_rows_sent_do_not_grow_with_the_cells_at_their_limit(spark, monkeypatch):
    """Beyond the most cells these become larger; a vector still asks in PROBES of them."""
    monkeypatch.setattr(neighbours, "CELL", 20)
    monkeypatch.setattr(neighbours, "MOST_CELLS", 4)
    sent = {}
    route = neighbours._route

    def counted(size, pivots, plan):
        first, shards, copies = plan.value
        sent[n] = max(s * c for s, c in zip(shards, copies))
        return route(size, pivots, plan)

    monkeypatch.setattr(neighbours, "_route", counted)
    r = np.random.default_rng(6)
    for n in (400, 1600):
        X = r.normal(size=(n, 8))
        df = spark.createDataFrame([(f"k{i}", [float(x) for x in v]) for i, v in enumerate(X)], "_k string, _v array<float>")
        got = {(a, b) for a, b, s in map(tuple, most_similar(df, 3, 8).collect())}
        want = brute([f"k{i}" for i in range(n)], X, 3, -1)
        assert len(want & got) >= 0.9 * len(want)
    assert sent[1600] <= 2 and sent[400] <= 2


def test_empty(spark):
    assert most_similar(spark.createDataFrame([], "_k string, _v array<float>"), 3, 2).count() == 0
