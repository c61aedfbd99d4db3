"""The most similar vectors of every vector: proximity graphs over shards, searched by beam."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quipu.llm.graph_index import ProximityGraph
from quipu.operators.cut import cut
from quipu.operators.skew import heavy_keys, join_with_heavy

#: Vectors per cell aimed at; most cells (26 MB of pivots at 100 elements); cells in which a vector is asked for.
CELL, MOST_CELLS, PROBES = 8000, 65536, 3
#: A cell of more than WIDE times the mean is cut in shards; queries of a shard beyond ASKED go to further copies of it.
WIDE, ASKED = 3, 120_000
#: One class of vectors in SAMPLE is the sample of pivots and of the sizes of cells.
SAMPLE = 16
#: Pivots above which the nearest are sought in two steps, and the neighbourhoods looked into.
FLAT, NEIGHBOURHOODS = 1024, 8
#: Decimals of the unit vector to which vectors count as copies of each other.
SAME = 6
#: Classes remembered by a task that routes, so that copies leave it once.
REMEMBERED = 200_000


def usable(rows: DataFrame, size: int) -> DataFrame:
    """_k, _v of rows with a key and `size` finite elements that are not all zero."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = (F.size("_v") == size) & F.forall("_v", number) & F.exists("_v", lambda x: x != 0)
    return rows.where("_k is not null and _v is not null").where(good).select("_k", "_v")


def _units(b: pa.RecordBatch, size: int) -> tuple[np.ndarray, list[bytes]]:
    """Unit vectors of a batch of keys and arrays, and the names of their classes of copies."""
    import xxhash

    v = np.asarray(b.column(1).flatten()).astype(np.float64).reshape(-1, size)
    v /= np.abs(v).max(axis=1)[:, None]
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    return v, [xxhash.xxh3_128_digest(r.tobytes()) for r in np.round(v, SAME) + 0.0]


def _packed(v: np.ndarray) -> list[bytes]:
    """Two bytes an element, in parts of the greatest; cosines keep an error of about 4e-6."""
    return [r.tobytes() for r in np.rint(v / np.abs(v).max(axis=1)[:, None] * 32767).astype(np.int16)]


def _unpacked(blobs: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(blobs), np.int16).reshape(len(blobs), -1).astype(np.float32)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _in_sample(name: bytes) -> bool:
    return int.from_bytes(name[:4], "big") % SAMPLE == 0


def _classes(size: int):
    """Rows (_k, _c, _u): key, class, and for one class in SAMPLE its vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v, names = _units(b, size)
                u = [p if _in_sample(c) else None for c, p in zip(names, _packed(v))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.binary()), pa.array(u, pa.binary())], ["_k", "_c", "_u"])

    return run


def _best(sims: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n greatest values of each row, greatest first."""
    some = np.argpartition(-sims, n, axis=1)[:, :n] if n < sims.shape[1] else np.tile(np.arange(sims.shape[1]), (len(sims), 1))
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(sims, some, 1), axis=1, kind="stable"), 1)


class Pivots:
    """The nearest pivots of vectors. Above FLAT pivots, about the root of them head neighbourhoods, every pivot belongs to
    the three nearest of these, and only the NEIGHBOURHOODS nearest ones of a vector are looked into."""

    def __init__(self, P: np.ndarray):
        self.P, self.heads = P, None
        if len(P) > FLAT:
            self.heads = P[: int(np.ceil(np.sqrt(len(P))))]
            of = np.concatenate([_best(P[lo : lo + 4096] @ self.heads.T, 3) for lo in range(0, len(P), 4096)])
            order = np.argsort(of.ravel(), kind="stable")
            self.members = np.split(order // 3, np.cumsum(np.bincount(of.ravel(), minlength=len(self.heads)))[:-1])

    def nearest(self, V: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the n nearest pivots of each row, nearest first; -1 where fewer."""
        if self.heads is None:
            return _best(V @ self.P.T, n)
        into = _best(V @ self.heads.T, NEIGHBOURHOODS)
        ids = np.full((len(V), NEIGHBOURHOODS * n), -1)
        sims = np.full(ids.shape, -3.0, np.float32)
        for k in range(into.shape[1]):
            order = np.argsort(into[:, k], kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(into[order, k])) + 1):
                members = self.members[into[rows[0], k]]
                s = V[rows] @ self.P[members].T
                best = _best(s, n)
                at = k * n + np.arange(best.shape[1])
                ids[rows[:, None], at], sims[rows[:, None], at] = members[best], np.take_along_axis(s, best, 1)
        order = np.argsort(ids, axis=1, kind="stable")  # a pivot of several neighbourhoods counts once
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -3
        top = _best(sims, n)
        return np.where(np.take_along_axis(sims, top, 1) > -3, np.take_along_axis(ids, top, 1), -1)


def _sizes(pivots):
    """Rows (_cell, _own) of sampled vectors: where they live and where they ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = pivots.value.nearest(_unpacked(b.column(0).to_pylist()), PROBES)
                own = np.tile(np.arange(near.shape[1]) == 0, len(near))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), pa.array(own)], ["_cell", "_own"])

    return run


def _route(size: int, pivots, plan):
    """Rows (_at, _role, _c, _u): a vector lives in one shard of its nearest cell (role 1; 3 in the copy of the shard that it
    asks) and asks in all shards of its PROBES nearest cells (role 2). plan: first place, shards and copies of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, shards, copies = plan.value
        known: set[bytes] = set()
        for b in batches:
            if not b.num_rows:
                continue
            v, names = _units(b, size)
            fresh = []
            for i, c in enumerate(names):
                if c not in known:
                    known.add(c)
                    fresh.append(i)
            if len(known) > REMEMBERED:
                known.clear()
            if not fresh:
                continue
            packed = _packed(v[fresh])
            near = pivots.value.nearest(_unpacked(packed), PROBES)
            at, role, name, blob = [], [], [], []
            for i, u, row in zip(fresh, packed, near.tolist()):
                h = int.from_bytes(names[i][4:12], "big")
                for k, cell in enumerate(row):
                    if cell < 0:
                        continue
                    home, ask = (h % shards[cell] if k == 0 else -1), (h >> 20) % copies[cell]
                    for s in range(shards[cell]):
                        for q in range(copies[cell]) if s == home else (ask,):
                            at.append(first[cell] + s * copies[cell] + q)
                            role.append((s == home) + 2 * (q == ask))
                            name.append(names[i])
                            blob.append(u)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(role, pa.int8()), pa.array(name, pa.binary()), pa.array(blob, pa.binary())], ["_at", "_role", "_c", "_u"])

    return run


def _search(k: int, least: float):
    """A partition is a copy of a shard: its graph is built, then everything that asks there is searched for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, roles, blobs = [], [], []
        for b in batches:
            names += b.column(0).to_pylist()
            roles += b.column(1).to_pylist()
            blobs += b.column(2).to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)  # the graph depends on the order of its nodes
        order = [i for n, i in enumerate(order) if not n or names[i] != names[order[n - 1]]]  # copies from several tasks
        lives, asks = [i for i in order if roles[i] & 1], [i for i in order if roles[i] & 2]
        if not lives or not asks:
            return
        X, at = _unpacked([blobs[i] for i in lives]), {names[i]: n for n, i in enumerate(lives)}
        graph = ProximityGraph(X, beam=max(24, 2 * k))
        ends = pa.array([names[i] for i in lives], pa.binary())
        for lo in range(0, len(asks), 512):
            who = asks[lo : lo + 512]
            Q = _unpacked([blobs[i] for i in who])
            own = np.array([at.get(names[i], -1) for i in who], np.int32)
            ids, sims = graph.search(Q, own)
            sims = np.where((ids >= 0) & (ids != own[:, None]), sims, -2)
            top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            i, j = np.nonzero(np.take_along_axis(sims, top, 1) >= max(least - 1e-4, -1))
            if len(i):
                end = np.take_along_axis(ids, top, 1)[i, j]
                exact = np.einsum("ij,ij->i", Q[i].astype(np.float64), X[end].astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array([names[who[n]] for n in i.tolist()], pa.binary()), ends.take(pa.array(end)), pa.array(exact)], ["_c", "_d", "_s"])

    return run


def _plan(sample: DataFrame, cells: int, size: int):
    """Pivots, and for every cell its first partition, its shards and their copies; the number of partitions."""
    context = sample.sparkSession.sparkContext
    taken = [bytes(r["_u"]) for r in sample.orderBy("_c").limit(cells).collect()]  # MOST_CELLS at most
    pivots = context.broadcast(Pivots(_unpacked(taken) if taken else np.ones((1, size), np.float32)))
    lives, asks = np.zeros(max(1, len(taken)), np.int64), np.zeros(max(1, len(taken)), np.int64)
    counts = sample.select("_u").mapInArrow(_sizes(pivots), "_cell int, _own boolean").where("_cell >= 0").groupBy("_cell").agg(F.count_if("_own").alias("l"), F.count(F.lit(1)).alias("a"))
    for r in counts.collect():  # a row per cell
        lives[r["_cell"]], asks[r["_cell"]] = SAMPLE * r["l"], SAMPLE * r["a"]
    shards = np.maximum(1, -(-lives // (WIDE * max(CELL, int(lives.mean())))))
    copies = np.maximum(1, -(-asks // ASKED))
    first = np.cumsum(shards * copies) - shards * copies
    return pivots, context.broadcast((first.tolist(), shards.tolist(), copies.tolist())), int((shards * copies).sum())


def most_similar(rows: DataFrame, k: int, size: int, least: float = -1.0) -> DataFrame:
    """For every key the k most similar other keys with a cosine of at least `least`: _k, _b, _s.

    rows: _k (string), _v (array of float); other columns are ignored. Ties go to the smaller key. Rows without a usable
    vector (see usable) take no part, repeated rows count once, of different vectors of one key one stands (the least by
    its class's name); an empty table gives no rows. Approximate: recall is measured in the tests.

    Copies (equal to SAME decimals as unit vectors) are one class, one node of the graphs, and are given to each other by
    key, k of them at most per key, so a hot group of copies costs what its rows cost.

    Nodes are cut into cells by pivots. Cells grow in number with the data, and beyond MOST_CELLS in size. A partition holds
    a cell (or a shard of a cell that is far above the mean), builds its graph and answers the queries that come there, so
    every vector is in one graph and asks in PROBES, whatever the size of the data. Only a shard that more than ASKED
    vectors ask is built again, once per further ASKED. Vectors travel PROBES times at two bytes an element.
    """
    spark = rows.sparkSession
    clean = usable(rows, size)
    named = clean.mapInArrow(_classes(size), "_k string, _c binary, _u binary")
    keyed = cut(named.groupBy("_k").agg(F.min("_c").alias("_c"), F.min_by("_u", "_c").alias("_u"), (F.min("_c") < F.max("_c")).alias("_many")))
    total = keyed.agg(F.count(F.lit(1)).alias("n"), F.count_if("_many").alias("m")).first()
    if not total["n"]:
        return spark.createDataFrame([], "_k string, _b string, _s double")
    if total["m"]:  # of a key of several vectors only the one that stands goes on
        again = clean.join(keyed.where("_many").select("_k", "_c"), "_k", "left").mapInArrow(_standing(size), "_k string, _v array<float>")
        clean = again
    sample = cut(keyed.where("_u is not null").groupBy("_c").agg(F.min("_u").alias("_u")))
    pivots, plan, places = _plan(sample, max(1, min(MOST_CELLS, total["n"] // CELL)), size)
    placed = clean.mapInArrow(_route(size, pivots, plan), "_at int, _role byte, _c binary, _u binary")
    found = placed.repartitionById(places, "_at").select("_c", "_role", "_u").mapInArrow(_search(k, least), "_c binary, _d binary, _s double")
    best = Window.partitionBy("_c").orderBy(F.desc("_s"), F.asc("_d"))
    once = found.where("_c <> _d").groupBy("_c", "_d").agg(F.max("_s").alias("_s"))
    links = cut(once.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).select("_c", "_d", "_s"))

    # of a class of copies, k + 1 keys are enough for anyone; rank limits are applied before the shuffle
    members = keyed.select("_k", "_c")
    first = members.withColumn("_r", F.row_number().over(Window.partitionBy("_c").orderBy("_k"))).where(F.col("_r") <= k + 1).select("_c", "_k")
    near = links.join(first.withColumnRenamed("_c", "_d"), "_d").select("_c", F.col("_k").alias("_b"), "_s")
    near = near.unionByName(first.select("_c", F.col("_k").alias("_b"), F.lit(1.0).alias("_s")))
    top = near.withColumn("_r", F.row_number().over(Window.partitionBy("_c").orderBy(F.desc("_s"), F.asc("_b")))).where(F.col("_r") <= k + 1)
    offers = top.groupBy("_c").agg(F.array_sort(F.collect_list(F.struct("_r", "_b", "_s"))).alias("_o")).where("size(_o) > 1")
    offered = join_with_heavy(members, cut(offers), "_c", heavy_keys(members, "_c", total["n"]))
    mine = F.slice(F.filter("_o", lambda o: o["_b"] != F.col("_k")), 1, k)
    return offered.select("_k", F.inline(mine)).select("_k", "_b", "_s").where(F.col("_s") >= least)


def _standing(size: int):
    """Rows of which the class is the one that stands for their key, where there are several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, names = _units(b, size)
                keep = [want is None or want == c for want, c in zip(b.column(2).to_pylist(), names)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["_k", "_v"]).filter(pa.array(keep))

    return run
