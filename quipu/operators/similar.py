"""Similarity joins of sets by prefix filtering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quipu.operators.cut import cut
from quipu.operators.overlap import _after, _slices, in_cells, over_cells
from quipu.operators.skew import join_checked

#: A set's elements are marked in MARKS words of 64 bits; sets of one element that meet in a task, at most AT_ONCE on one side.
MARKS, AT_ONCE = 4, 16_000

#: Sets on either side of a cell; their meetings at a time; meetings of one element from which they are all compared side by side.
BLOCK, MEETINGS, MANY = 100_000, 100_000, 20_000


def marks(items: Column) -> list[Column]:
    """m0..: bits of the elements' hashes. A bit that one of two sets has and the other lacks is an element of which that holds too."""
    hashes = F.transform(items, lambda x: F.xxhash64(x))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    bit = lambda h: F.call_function("shiftleft", one, h.bitwiseAND(F.lit(63)).cast("int"))
    of = lambda k: lambda s, h: s.bitwiseOR(F.when(F.shiftright(h, 6).bitwiseAND(F.lit(MARKS - 1)) == k, bit(h)).otherwise(zero))
    return [F.aggregate(hashes, zero, of(k)).alias(f"m{k}") for k in range(MARKS)]


def apart(x: str, y: str) -> Column:
    """Elements that only one of two sets holds, by their marks: the true number or less."""
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{x}m{k}").bitwiseXOR(F.col(f"{y}m{k}"))) for k in range(MARKS)])


def prefixes(rows: DataFrame, df: DataFrame, least: float) -> DataFrame:
    """rows: i, c (a set). The first size - ceil(least * size) + 1 elements of each, rarest first: t (its hash), df, i, n, marks."""
    items = join_checked(rows.select("i", F.explode("c").alias("t")), df, "t", "left")
    sets = items.groupBy("i").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t"))).alias("e"))
    first = F.slice("e", 1, (F.size("e") - F.ceil(F.lit(least) * F.size("e") - 1e-9) + 1).cast("int"))
    p = sets.select("i", F.size("e").alias("n"), *marks(F.col("e.t")), F.explode(first).alias("p"))
    return p.select(F.xxhash64("p.t").alias("t"), "p.df", "i", "n", *[f"m{k}" for k in range(MARKS)])


def meeting(x: DataFrame, y: DataFrame, least: float, other: Column | None = None) -> DataFrame:
    """x, y: prefixes. Pairs of their sets (x, y) whose Jaccard may be `least`: by size and marks, which are compared where the sets
    meet, so that only pairs that are alike leave it. Sets of a common element meet in parts."""
    named = lambda rows, a: rows.select("t", "salt", *[F.col(c).alias(f"{a}{c}") for c in rows.columns if c not in ("t", "df", "salt")])
    parts = F.ceil((F.col("df") + 1) / AT_ONCE).cast("int")
    xs = named(x.withColumn("salt", F.pmod("i", parts).cast("int")), "x")
    ys = named(y.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))), "y")
    close = (F.least("xn", "yn") >= F.greatest("xn", "yn") * (least - 1e-9)) & (apart("x", "y") <= (F.col("xn") + F.col("yn")) * ((1 - least) / (1 + least)) + 1e-6)
    return xs.join(ys, ["t", "salt"]).where(close if other is None else close & other).select(F.col("xi").alias("x"), F.col("yi").alias("y")).distinct()


def jaccard_join(sets: DataFrame, least: float) -> DataFrame:
    """Pairs a < b of keys whose sets have a Jaccard of `least` or more: a, b, jaccard.

    sets: k, s (array of distinct strings); empty sets are in no pair. Exact (see alike). Equal sets are one row
    while they meet; the pairs of their keys come out at the end.
    """
    keyed = sets.where(F.size("s") > 0).withColumn("c", F.array_sort("s")).select("k", "c")
    one = cut(keyed.groupBy("c").agg(F.sort_array(F.collect_list("k")).alias("ks")).withColumn("i", F.monotonically_increasing_id()))
    of = lambda a: one.select(F.col("i").alias(a), F.col("ks").alias(f"k{a}"))
    scored = alike(one.select("i", "c"), least).join(of("x"), "x").join(of("y"), "y")
    pairs = scored.select(F.explode("kx").alias("p"), "ky", "jaccard").select("p", F.explode("ky").alias("q"), "jaccard")
    same = one.where("size(ks) > 1").select(F.posexplode("ks").alias("j", "p"), "ks").select("p", F.explode(F.expr("slice(ks, j + 2, size(ks))")).alias("q"), F.lit(1.0).alias("jaccard"))
    return pairs.unionByName(same).where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "jaccard")


def alike(sets: DataFrame, least: float) -> DataFrame:
    """sets: i (bigint), c (distinct strings, one at least). Pairs whose Jaccard is `least` or more, the larger set first: x, y, jaccard.

    Exact: with elements in order of their frequency, rarest first, two sets that are similar enough share one of the first
    size - ceil(least * size) + 1 of the larger and the first size - ceil(2 * least / (1 + least) * size) + 1 of the smaller, so only
    those meet, in arrays. The order is that of the cell: the two sets of a pair meet in one.
    """
    parts, blocks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sets.count() // BLOCK)
    across = max(1, blocks, int(parts**0.5))
    down = max(blocks, -(-parts // across))
    return in_cells(sets.select("i", "c"), across, down).mapInArrow(over_cells(lambda a, h: _alike(a, h, least)), "x bigint, y bigint, jaccard double")


def _folds(own: np.ndarray, code: np.ndarray, sets: int, n: int) -> list[np.ndarray]:
    """Marks of sets of numbers, in n words (a power of two) that share their elements."""
    h = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bit, word, out = np.uint64(1) << (h >> np.uint64(58)), h >> np.uint64(40) & np.uint64(n - 1), []
    for k in range(n):
        out.append(np.zeros(sets, dtype=np.uint64))
        np.bitwise_or.at(out[k], own[word == k], bit[word == k])
    return out


def _alike(a: pa.Table, h: pa.Table, least: float) -> Iterator[pa.RecordBatch]:
    """Of each asking set the held ones before it, by size and number, that are similar enough."""
    ia, ih = a.column("i").to_numpy(), h.column("i").to_numpy()
    ca, ch = a.column("c").combine_chunks(), h.column("c").combine_chunks()
    na, nh = (np.asarray(pc.list_value_length(c), dtype=np.int64) for c in (ca, ch))
    coded = ch.flatten().dictionary_encode()
    flat = np.asarray(coded.indices, dtype=np.int64)
    rarest = np.argsort(np.argsort(np.bincount(flat), kind="stable"), kind="stable")
    asked = np.asarray(pc.fill_null(pc.index_in(ca.flatten(), value_set=coded.dictionary), -1), dtype=np.int64)
    asked, flat, words = np.where(asked < 0, -1, rarest[asked]), rarest[flat], len(rarest)
    # held sets in order of size and number, the elements of each in order of frequency
    order = np.lexsort((ih, nh))
    held = np.empty(len(nh), dtype=np.int64)
    held[order] = np.arange(len(nh))
    holds = np.sort(np.repeat(held, nh) * words + flat)
    ih, nh, width = ih[order], nh[order], len(nh)
    holder, flat = holds // words, holds % words
    own = np.repeat(np.arange(len(na)), na)
    by = np.lexsort((asked, own))
    asked = asked[by]  # elements that no held set has come first
    first = lambda n, part: n - np.ceil(part * n - 1e-9).astype(np.int64) + 1
    early = _after(nh)[1] < first(nh, 2 * least / (1 + least))[holder]
    posting = np.sort(flat[early] * width + holder[early])
    # held sets before an asking one: from the size that it needs to its own place
    both = np.lexsort((np.repeat([1, 0], [width, len(na)]), np.append(ih, ia), np.append(nh, na)))
    before = np.empty(len(both), dtype=np.int64)
    before[both] = np.cumsum(both < width)
    before = before[width:]
    low = np.searchsorted(nh, np.ceil(least * na - 1e-9))
    known = asked >= 0
    marks_h, marks_a, more_h, more_a = (_folds(*of, n) for n in (2, 2 * MARKS) for of in ((holder, flat, width), (own[known], asked[known], len(na))))
    part = (1 - least) / (1 + least)
    most_a, most_h = na * part + 1e-6 - (na - np.bincount(own[known], minlength=len(na))), nh * part
    asks = np.flatnonzero(known & (_after(na)[1] < first(na, least)[own]))
    asks = asks[np.lexsort((before[own[asks]], asked[asks]))]
    x, t = own[asks], asked[asks]
    lo = np.searchsorted(posting, t * width + low[x])
    meets = np.maximum(np.searchsorted(posting, t * width + before[x]) - lo, 0)
    place, begin = posting % width, np.cumsum(na) - na
    found, count = [], 0
    for z, y, by in _meetings(x, t, lo, meets, place, marks_a, [m[place] for m in marks_h], most_a, most_h[place]):
        for own_marks, marks in ((marks_a, marks_h), (more_a, more_h)):
            close = sum(np.bitwise_count(p[z] ^ q[y]).astype(np.int64) for p, q in zip(own_marks, marks, strict=True)) <= most_a[z] + most_h[y]
            z, y, by = z[close], y[close], by[close]
        close = (y >= low[z]) & (y < before[z])
        found.append((z[close], y[close], by[close]))
        count += len(found[-1][0])
        if count >= MEETINGS:
            yield from _scored(*map(np.concatenate, zip(*found, strict=True)), na, nh, begin, asked, holds, words, least, ia, ih)
            found, count = [], 0
    if count:
        yield from _scored(*map(np.concatenate, zip(*found, strict=True)), na, nh, begin, asked, holds, words, least, ia, ih)


def _meetings(x, t, lo, meets, place, marks_x, marks_p, most_x, most_p) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Asking and held sets that meet at an element, and the element. Of common elements only those that may be alike by their marks, and
    some that are out of order."""
    starts = np.flatnonzero(np.append(True, t[1:] != t[:-1])[: len(t)])
    ends = np.append(starts[1:], len(t))
    total = np.add.reduceat(meets, starts) if len(t) else meets
    many = total >= MANY
    for s, e in zip(starts[many], ends[many], strict=True):
        at = s
        while at < e:
            to = min(e, at + max(1, MEETINGS // int((lo[e - 1] + meets[e - 1]) - lo[s] or 1)))
            p0, p1 = lo[at:to].min(), (lo[at:to] + meets[at:to]).max()
            xs = x[at:to]
            most = np.clip(np.floor(most_x[xs].max() + most_p[p0:p1]), 0, 255).astype(np.uint8)
            i = np.flatnonzero(sum(np.bitwise_count(p[xs][:, None] ^ q[p0:p1]) for p, q in zip(marks_x, marks_p, strict=True)) <= most)
            if len(i):
                yield xs[i // (p1 - p0)], place[p0 + i % (p1 - p0)], np.full(len(i), t[s])
            at = to
    few = np.flatnonzero(np.repeat(~many, ends - starts))
    for s, e in _slices(meets[few], MEETINGS):
        which, step = _after(meets[few[s:e]])
        yield x[few[s:e]][which], place[lo[few[s:e]][which] + step], t[few[s:e]][which]


def _scored(z, y, by, na, nh, begin, asked, holds, words, least, ia, ih) -> Iterator[pa.RecordBatch]:
    """The pairs that are alike; of the meetings of two sets the one at their rarest common element counts."""
    for p0, p1 in _slices(na[z], 10 * MEETINGS):
        x, h = z[p0:p1], y[p0:p1]
        which, step = _after(na[x])
        code = asked[begin[x][which] + step]
        number = h[which] * words + code
        there = (holds[np.minimum(np.searchsorted(holds, number), len(holds) - 1)] == number) & (code >= 0)
        common = np.bincount(which[there], minlength=len(x))
        which, code = which[there], code[there]  # every two sets here have an element in common
        rarest = code[np.append(True, which[1:] != which[:-1])]
        jaccard = common / (na[x] + nh[h] - common)
        good = (jaccard >= least - 1e-12) & (rarest == by[p0:p1])
        yield pa.RecordBatch.from_arrays([pa.array(ia[x[good]]), pa.array(ih[h[good]]), pa.array(jaccard[good])], ["x", "y", "jaccard"])
