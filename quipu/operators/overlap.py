"""The sets that share most elements with each of many others, and all that share enough."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quipu.operators.cut import cut
from quipu.operators.graph import first_per
from quipu.operators.skew import join_checked, spread

#: Held and asking sets of a task, at most; sets of more words than WIDE are met word by word; combinations spelled out at a time.
HELD, ASKING, WIDE, AT_ONCE = 200_000, 50_000, 8, 4_000_000

#: Sets on either side of a cell where all pairs come out: their keys fit the dictionary (1 MB) of a Parquet column. Pairs of a batch.
BLOCK, BATCH = 24_000, 250_000


def most_shared(asked: DataFrame, held: DataFrame, ask: str, key: str, n: int) -> DataFrame:
    """asked: ask, t; held: key, t. Of every asking set the n held sets that share most words, two at least, ties to the least key:
    ask, key, n.

    Exact without spelling out the sets that share one common word: what a set shares with another is one of its combinations of
    words, and of the held sets around a combination the first n by key are enough for anyone, as those before share as much.
    """
    words = cut(held.select("t").distinct().withColumn("i", F.monotonically_increasing_id()))
    a = cut(join_checked(asked, words, "t", "inner").groupBy(ask).agg(F.array_sort(F.collect_set("i")).alias("w")).where("size(w) > 1"))
    used = a.select(F.explode("w").alias("i")).distinct()
    h = cut(held.join(words, "t").join(used, "i", "left_semi").groupBy(key).agg(F.array_sort(F.collect_set("i")).alias("w")).where("size(w) > 1"))
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across = max(1, -(-h.count() // HELD))
    down = max(1, -(-a.count() // ASKING), -(-parts // across))
    cell = lambda x, y: (x * across + y).alias("k")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    a = a.withColumn("y", every(across)).select(ask, "w", cell(F.pmod(F.xxhash64(ask), F.lit(down)), F.col("y")))
    h = h.withColumn("x", every(down)).select(key, "w", cell(F.col("x"), F.pmod(F.xxhash64(key), F.lit(across))))
    kinds = dict(asked.dtypes)
    best = spread(a, "k", parts=2 * across * down).groupBy("k").cogroup(spread(h, "k", parts=2 * across * down).groupBy("k")).applyInArrow(_best(ask, key, n, to_arrow_type(asked.schema[ask].dataType)), f"{ask} {kinds[ask]}, {key} string, n bigint")
    return best if across == 1 else first_per(best, [ask], [F.desc("n"), F.asc(key)], n).drop("rango")


def _after(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items repeated by their counts: which, and the how manieth (from 0)."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def _slices(counts: np.ndarray, most: int):
    """Ranges of items whose counts make `most` together, or that are one item."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def _longer(node: np.ndarray, place: np.ndarray, end: np.ndarray, code: np.ndarray, width: int):
    """Combinations, each with one further word of its set that comes later: which it was, the new place, the new number."""
    which, step = _after(end - place - 1)
    at = place[which] + 1 + step
    return which, at, node[which] * width + code[at]


def _levels(size: np.ndarray, code: np.ndarray, width: int, n: int) -> list:
    """By number of words from two on: numbers of the combinations that sets hold, sorted, and the first n sets around each."""
    item = np.repeat(np.arange(len(size)), size)
    end = np.cumsum(size)[item]
    node, place, out = code.astype(np.int64), np.arange(len(code)), []
    while True:
        which, place, number = _longer(node, place, end, code, width)
        if not len(which):
            return out
        item, end = item[which], end[which]
        keys, node = np.unique(number, return_inverse=True)
        order = np.argsort(node, kind="stable")  # sets are in order of their keys, and stay so
        start = np.searchsorted(node[order], np.arange(len(keys)))
        kept = np.minimum(np.diff(np.append(start, len(order))), n)
        one, j = _after(kept)
        out.append((keys, item[order[start[one] + j]], np.cumsum(kept) - kept, kept))


def _best(ask: str, key: str, n: int, kind: pa.DataType):
    def lists(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        w = t.column(name).combine_chunks()
        return np.asarray(pc.list_value_length(w), dtype=np.int64), np.asarray(w.flatten(), dtype=np.int64)

    def run(a: pa.Table, h: pa.Table) -> pa.Table:
        if not a.num_rows or not h.num_rows:
            return pa.table({ask: a.column(ask).slice(0, 0) if a.num_rows else pa.nulls(0, kind), key: h.column(key).slice(0, 0) if h.num_rows else pa.nulls(0, pa.string()), "n": pa.nulls(0, pa.int64())})
        h = h.take(pc.sort_indices(h.column(key).combine_chunks()))
        (na, wa), (nh, wh) = lists(a, "w"), lists(h, "w")
        vocabulary, ch = np.unique(wh, return_inverse=True)
        ca = np.searchsorted(vocabulary, wa)
        known = np.append(vocabulary, -1)[ca] == wa if len(vocabulary) else np.zeros(len(wa), dtype=bool)
        of = np.repeat(np.arange(len(na)), na)[known]
        ca, na, width = ca[known], np.bincount(of, minlength=len(na)), max(1, len(vocabulary))
        wide = nh > WIDE
        slim = np.flatnonzero(~wide)
        levels = _levels(nh[~wide], ch[np.repeat(~wide, nh)], width, n)
        # words of the wide sets, with those that hold them
        word, holder = ch[np.repeat(wide, nh)], np.repeat(np.arange(len(nh)), nh)[np.repeat(wide, nh)]
        order = np.argsort(word, kind="stable")
        word, holder = word[order], holder[order]
        found = [[], [], []]
        for lo, hi in _slices(na, AT_ONCE // 20):
            for x, y in zip(found, _ranked(na[lo:hi], ca[np.sum(na[:lo]) : np.sum(na[:hi])], levels, slim, word, holder, width, len(nh), n), strict=True):
                x.append(y + lo if x is found[0] else y)
        who, what, shared = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in found)
        return pa.table({ask: a.column(ask).take(who), key: h.column(key).take(what), "n": shared})

    return run


def _ranked(size, code, levels, slim, word, holder, width, total, n):
    """asking set, held set, words shared: the n best of each."""
    own = np.repeat(np.arange(len(size)), size)
    ends = np.cumsum(size)[own]
    who, what, shared = [], [], []
    item, node, place, end = own, code.astype(np.int64), np.arange(len(code)), ends
    for depth, (keys, sets, start, kept) in enumerate(levels, 2):
        parts = []
        for lo, hi in _slices(end - place - 1, AT_ONCE):
            which, at, number = _longer(node[lo:hi], place[lo:hi], end[lo:hi], code, width)
            to = np.minimum(np.searchsorted(keys, number), len(keys) - 1)
            hit = keys[to] == number
            parts.append((item[lo:hi][which[hit]], to[hit], at[hit], end[lo:hi][which[hit]]))
        if not parts:
            break
        item, node, place, end = map(np.concatenate, zip(*parts, strict=True))
        one, j = _after(kept[node])
        who.append(item[one])
        what.append(slim[sets[start[node[one]] + j]])
        shared.append(np.full(len(one), depth))
    first, last = np.searchsorted(word, code), np.searchsorted(word, code, "right")
    pairs = []
    for lo, hi in _slices(last - first, AT_ONCE) if len(word) else []:
        one, j = _after((last - first)[lo:hi])
        pairs.append(own[lo:hi][one] * total + holder[first[lo:hi][one] + j])
    if pairs:
        pair, times = np.unique(np.concatenate(pairs), return_counts=True)
        pair, times = pair[times > 1], times[times > 1]
        who, what, shared = [*who, pair // total], [*what, pair % total], [*shared, times]
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    who, what, shared = map(np.concatenate, (who, what, shared))
    order = np.lexsort((-shared, what, who))
    who, what, shared = who[order], what[order], shared[order]
    new = np.append(True, (who[1:] != who[:-1]) | (what[1:] != what[:-1]))[: len(who)]  # the most that the two share
    who, what, shared = who[new], what[new], shared[new]
    order = np.lexsort((what, -shared, who))
    who, what, shared = who[order], what[order], shared[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    return who[rank < n], what[rank < n], shared[rank < n]


def most_alike_before(sets: DataFrame, least: float, n: int) -> DataFrame:
    """sets: k, at (bigint, not null), c (distinct words, one at least). For each the n of greatest Jaccard, `least` at least, among
    those of a smaller `at`, ties to the least key: x, y, s. Every pair of a common word is counted, in arrays of one count a set."""
    words = cut(sets.select(F.explode("c").alias("t")).distinct().withColumn("i", F.monotonically_increasing_id()))
    coded = cut(join_checked(sets.select("k", "at", F.explode("c").alias("t")), words, "t", "inner").groupBy("k", "at").agg(F.collect_list("i").alias("w")))
    parts, total = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), coded.count()
    across = max(1, -(-total // HELD))
    down = max(1, -(-total // ASKING), -(-parts // across))
    of = lambda m: F.pmod(F.xxhash64("k"), F.lit(m))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    a = coded.select("k", "at", "w", every(across).alias("y")).withColumn("cell", of(down) * across + F.col("y"))
    h = coded.select("k", "at", "w", every(down).alias("x")).withColumn("cell", F.col("x") * across + of(across))
    cell = lambda rows: spread(rows.select(*[F.col(c).alias(c) for c in ("cell", "k", "at", "w")]), "cell", parts=2 * across * down).groupBy("cell")
    best = cell(a).cogroup(cell(h)).applyInArrow(_alike(least, n), "x string, y string, s double")
    return best if across == 1 else first_per(best, ["x"], [F.desc("s"), F.asc("y")], n).drop("rango")


def _alike(least: float, n: int):
    empty = pa.table({"x": pa.array([], pa.string()), "y": pa.array([], pa.string()), "s": pa.array([], pa.float64())})

    def run(a: pa.Table, h: pa.Table) -> pa.Table:
        if not a.num_rows or not h.num_rows:  # a cell of one side has no columns on the other
            return empty
        h = h.take(pc.sort_indices(h.column("k").combine_chunks()))
        wa, wh = a.column("w").combine_chunks(), h.column("w").combine_chunks()
        na, nh = (np.asarray(pc.list_value_length(w), dtype=np.int64) for w in (wa, wh))
        flat, when, mine = np.asarray(wh.flatten()), h.column("at").to_numpy(), a.column("at").to_numpy()
        order = np.argsort(flat, kind="stable")
        holder, flat = np.repeat(np.arange(len(nh)), nh)[order], flat[order]
        asked = np.asarray(wa.flatten())
        lo, hi, end = np.searchsorted(flat, asked), np.searchsorted(flat, asked, "right"), np.cumsum(na)
        out = [[], [], []]
        for i in range(len(na)):
            own = [holder[p:q] for p, q in zip(lo[end[i] - na[i] : end[i]], hi[end[i] - na[i] : end[i]], strict=True)]
            common = np.bincount(np.concatenate(own), minlength=len(nh)) * (when < mine[i])
            s = common / (nh + na[i] - common)
            for _ in range(n):
                j = int(np.argmax(s))  # the first, so of the least key
                if s[j] < least:
                    break
                for x, y in zip(out, (i, j, s[j]), strict=True):
                    x.append(y)
                s[j] = -1
        who, what = (np.array(x, dtype=np.int64) for x in out[:2])
        return pa.table({"x": a.column("k").take(who), "y": h.column("k").take(what), "s": np.array(out[2], dtype=float)})

    return run


def sharing(sets: DataFrame, least: float, digits: int | None = None) -> DataFrame:
    """sets: k (string), s (distinct strings). Pairs a < b of keys whose sets share `least` or more of the smaller one: a, b, s (rounded
    half up to `digits`).

    Pairs are neither shuffled nor held: blocks of sets meet in cells, any two sets in one of them, and a pair leaves it as it is found.
    """
    kept = cut(sets.where("k is not null and size(s) > 0").select("k", F.col("s").alias("c")).withColumn("i", F.monotonically_increasing_id()))
    parts, total = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), kept.count()
    across = max(1, -(-total // BLOCK))
    down = max(across, -(-parts // across))
    return in_cells(kept, across, down).mapInArrow(over_cells(lambda a, h: _sharing(a, h, least, digits)), "a string, b string, s double")


def in_cells(sets: DataFrame, across: int, down: int) -> DataFrame:
    """sets: i (bigint), c (strings), perhaps more. They lie compressed in down * across cells, one a partition: each set asks in the cells
    of one line and is held in those of one column, so any two meet in one cell, either way round."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (read := list(batches)):
            return
        rows = pa.Table.from_batches(read)
        for asks, groups in ((True, down), (False, across)):
            for g in range(groups):
                here = rows.filter(pa.array(rows.column("i").to_numpy() % groups == g))
                if here.num_rows:
                    c = here.column("c").combine_chunks()
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(pc.list_value_length(c))), pa.int32()), c.flatten().dictionary_encode())
                    table, sink = here.drop_columns("c").append_column("c", lists), pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                        to.write_table(table.combine_chunks())
                    cells = [g * across + k for k in range(across)] if asks else [k * across + g for k in range(down)]
                    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array([asks] * len(cells)), pa.array([sink.getvalue().to_pybytes()] * len(cells))], ["cell", "asks", "sets"])

    return sets.mapInArrow(pack, "cell int, asks boolean, sets binary").repartitionById(across * down, F.col("cell"))


def over_cells(meet: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]]):
    """meet: gets the asking and the held sets of a cell."""

    def unpacked(rows: pa.Table) -> pa.Table:
        batches = [b for x in rows.column("sets") for b in pa.ipc.open_stream(x.as_buffer())]
        lists = [b.column("c") for b in batches]
        c = pa.chunked_array([pa.ListArray.from_arrays(x.offsets, x.values.dictionary_decode()) for x in lists])
        return pa.table({n: pa.chunked_array([b.column(n) for b in batches]) for n in batches[0].schema.names if n != "c"} | {"c": c})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (read := list(batches)):
            return
        rows = pa.Table.from_batches(read)
        for cell in pc.unique(rows.column("cell")):
            here = rows.filter(pc.equal(rows.column("cell"), cell))
            a, h = here.filter(here.column("asks")), here.filter(pc.invert(here.column("asks")))
            if a.num_rows and h.num_rows:
                yield from meet(unpacked(a), unpacked(h))

    return run


def _sharing(a: pa.Table, h: pa.Table, least: float, digits: int | None) -> Iterator[pa.RecordBatch]:
    """Of each asking set the held ones of greater keys that share enough. Those of its commonest word are taken as they lie; only what
    its other words add to them is sorted."""
    h = h.take(pc.sort_indices(h.column("k").combine_chunks()))
    ka, kh = a.column("k").combine_chunks(), h.column("k").combine_chunks()
    wa, wh = a.column("c").combine_chunks(), h.column("c").combine_chunks()
    na, nh = (np.asarray(pc.list_value_length(w), dtype=np.int64) for w in (wa, wh))
    rank = np.asarray(pc.rank(pa.concat_arrays([kh, ka]), tiebreaker="dense"))
    after = np.searchsorted(rank[: len(nh)], rank[len(nh) :], "right")
    coded = wh.flatten().dictionary_encode()
    code, own = np.asarray(coded.indices, dtype=np.int64), np.repeat(np.arange(len(na)), na)
    asked = np.asarray(pc.fill_null(pc.index_in(wa.flatten(), value_set=coded.dictionary), -1), dtype=np.int64)
    own, asked, width = own[asked >= 0], asked[asked >= 0], len(nh)
    holders = np.sort(code * width + np.repeat(np.arange(width), nh))  # by word, then by key
    holder = holders % width
    lo = np.searchsorted(holders, asked * width + after[own])
    meets = np.searchsorted(holders, (asked + 1) * width) - lo
    order = np.lexsort((-meets, own))
    own, asked, lo, meets = own[order], asked[order], lo[order], meets[order]
    top = np.append(True, own[1:] != own[:-1])[: len(own)]
    base, base_lo, base_n = (np.zeros(len(na), dtype=np.int64) for _ in range(3))
    base[own[top]], base_lo[own[top]], base_n[own[top]] = asked[top], lo[top], meets[top]
    # asking sets of one commonest word follow each other, so the same held keys come again and again
    place = np.empty(len(na), dtype=np.int64)
    place[turn := np.lexsort((after, base))] = np.arange(len(na))
    rest = np.flatnonzero(~top)
    rest = rest[np.argsort(place[own[rest]], kind="stable")]
    rest_place = place[own[rest]]
    each = np.bincount(place[own], weights=meets, minlength=len(na)).astype(np.int64)
    for x0, x1 in _slices(each, BATCH):
        xs = turn[x0:x1]
        x, step = _after(base_n[xs])
        y, n = holder[base_lo[xs][x] + step], np.ones(len(x), dtype=np.int64)
        more = rest[np.searchsorted(rest_place, x0) : np.searchsorted(rest_place, x1)]
        which, step = _after(meets[more])
        pair, times = np.unique((place[own[more]] - x0)[which] * width + holder[lo[more][which] + step], return_counts=True)
        px, py = pair // width, pair % width
        number = base[xs][px] * width + py
        at = np.minimum(np.searchsorted(holders, number), len(holders) - 1)
        there = holders[at] == number
        start = np.cumsum(base_n[xs]) - base_n[xs]
        n[(start[px] + at - base_lo[xs][px])[there]] += times[there]
        x, y, n = np.append(x, px[~there]), np.append(y, py[~there]), np.append(n, times[~there])
        share = n / np.minimum(na[xs][x], nh[y])
        good = share >= least
        if good.any():
            shown = share[good] if digits is None else np.floor(share[good] * 10**digits + 0.5) / 10**digits
            yield pa.RecordBatch.from_arrays([ka.take(pa.array(xs[x[good]])), kh.take(pa.array(y[good])), pa.array(shown)], ["a", "b", "s"])
