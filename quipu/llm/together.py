"""Items that occur together in one record far more often than chance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quipu.operators.cut import cut
from quipu.operators.skew import join_checked

#: An item is frequent if it is in more than one in DENSE of all item occurrences, so there
#: are fewer than DENSE frequent items whatever the data.
DENSE = 1024
#: Records of one bit matrix (DENSE * BLOCK / 8 bytes at most), and occurrences gathered for one.
BLOCK, GATHERED = 4096, 1 << 17
#: Pairs counted in a task before partial counts go out.
HELD = 1 << 20
#: Rare items of a record above which it is wide; items of a part of a wide record.
WIDE, PART = 256, 1 << 16


def item_counts(pairs: DataFrame) -> DataFrame:
    """Records of every item: n. pairs: _scope, _rec, _item, distinct."""
    return pairs.groupBy("_scope", "_item").agg(F.count(F.lit(1)).alias("n"))


def _dense_and_mixed(names: list[str]):
    """Counts of pairs of frequent items by popcount, and of a rare with a frequent item by
    probing the bit matrix at the places of the rare item's list.

    Rows (_rec, _part, _f, _item) come sorted by record and part. A part is never cut: it holds PART rare items or so and
    fewer than DENSE frequent ones, and it is the first part of a record (0) in which the frequent ones are counted together."""
    many = len(names)
    schema = pa.schema([("_a", pa.string()), ("_b", pa.string()), ("n_ab", pa.int64())])
    words = np.array(names, dtype=object)

    def rows(a: list, b: list, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], schema=schema)

    def block(heavy_row: np.ndarray, heavy: np.ndarray, light_row: np.ndarray, light: pa.Array, counted: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """counted: which records' frequent items haven't been counted against each other yet."""
        bits = np.zeros((many, -(-len(counted) // 64) * 64), dtype=bool)
        bits[heavy, heavy_row] = True
        new = np.zeros(bits.shape[1], bool)
        new[: len(counted)] = counted
        packed = np.packbits(bits & new, axis=1, bitorder="little").view(np.uint64)
        for i in np.flatnonzero(packed.any(axis=1)).tolist():
            counts[i, i + 1 :] += np.bitwise_count(packed[i] & packed[i + 1 :]).sum(axis=1, dtype=np.int64)
        if not len(light):
            return
        coded = light.dictionary_encode()
        code, place = np.asarray(coded.indices), light_row
        order = np.argsort(code, kind="stable")
        code, place = code[order], place[order]
        begin = np.flatnonzero(np.diff(code, prepend=-1))
        by_record = np.ascontiguousarray(bits.T).view(np.uint8)
        rare = np.array(coded.dictionary.to_pylist(), dtype=object)
        step = max(1, HELD // max(1, many))
        for k in range(0, len(begin), step):  # lists of several rare items at a time
            lo = begin[k]
            hi = begin[k + step] if k + step < len(begin) else len(code)
            probed = np.add.reduceat(by_record[place[lo:hi]], begin[k : k + step] - lo, axis=0, dtype=np.int32)
            i, j = np.nonzero(probed)
            if len(i):
                a, c = rare[code[begin[k : k + step]][i]], words[j]
                first = a < c
                yield rows(np.where(first, a, c).tolist(), np.where(first, c, a).tolist(), probed[i, j].astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((many, many), dtype=np.int64)
        held: list[pa.RecordBatch] = []
        waiting = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, waiting
            t = pa.Table.from_batches(held).combine_chunks()
            code = np.asarray(t["_rec"].combine_chunks().dictionary_encode().indices)
            part, item = np.asarray(t["_part"].combine_chunks()), t["_item"].combine_chunks()
            f = np.asarray(t["_f"].combine_chunks().fill_null(-1))
            begins = np.concatenate([[True], (code[1:] != code[:-1]) | (part[1:] != part[:-1])])
            row, start = np.cumsum(begins) - 1, np.flatnonzero(begins)
            if not last:  # the last part may go on
                held = t.slice(start[-1]).to_batches()
                waiting = len(t) - int(start[-1])
                row, start = row[: start[-1]], start[:-1]
            for lo in range(0, len(start), BLOCK):
                b, e = start[lo], (start[lo + BLOCK] if lo + BLOCK < len(start) else len(row))
                heavy, light = np.flatnonzero(f[b:e] >= 0) + b, np.flatnonzero(f[b:e] < 0) + b
                yield from block(row[heavy] - lo, f[heavy], row[light] - lo, item.take(pa.array(light)), part[start[lo : lo + BLOCK]] == 0, counts)

        for b in batches:
            if b.num_rows:
                held.append(b)
                waiting += b.num_rows
                if waiting >= GATHERED:
                    yield from flush(False)
        if held:
            yield from flush(True)
        i, j = np.nonzero(counts)
        if len(i):
            yield rows(words[i].tolist(), words[j].tolist(), counts[i, j])

    return run


def _rare_pairs(rare: DataFrame, wide: DataFrame, least: int) -> DataFrame:
    """Counts of pairs of rare items, by hash: _a < _b, n_ab; pairs below `least` may be missing or too low.

    A record of more than WIDE rare items is wide. The others hold at most WIDE**2 / 2 pairs each. Wide ones aren't spelled out: a pair
    of items that at least `least` wide records each hold is counted there by blocks; for any other pair `least` records can
    only come together with others, so it is known from these and looked up in the fewer than `least` wide records of one item.
    """
    in_wide = join_checked(rare, wide.select("_rec"), "_rec", "left_semi")
    few = join_checked(rare, wide.select("_rec"), "_rec", "left_anti")
    after = F.explode(F.expr("filter(transform(_s, (x, i) -> struct(x as _a, slice(_s, i + 2, size(_s)) as _c)), x -> size(x._c) > 0)"))
    lists = few.groupBy("_rec").agg(F.array_sort(F.collect_list("_item")).alias("_s")).where("size(_s) > 1")
    known = lists.select(after.alias("_x")).select("_x._a", F.explode("_x._c").alias("_b")).groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("n_ab"))
    if wide.isEmpty():
        return known
    in_wide, known = cut(in_wide), cut(known)
    held = cut(in_wide.groupBy("_item").agg(F.count(F.lit(1)).alias("_w")))
    # items of `least` wide records or more: their pairs, a block of items against a block
    common = in_wide.join(held.where(F.col("_w") >= least).select("_item"), "_item", "left_semi").join(wide, "_rec")
    block = F.pmod(F.xxhash64("_item"), F.ceil(F.col("_n") / WIDE))
    blocks = common.groupBy("_rec", block.alias("_q")).agg(F.collect_list("_item").alias("_l"))
    x, y = blocks.withColumnsRenamed({"_q": "_q1", "_l": "_l1"}), blocks.withColumnsRenamed({"_q": "_q2", "_l": "_l2"})
    met = x.join(y, "_rec").where("_q1 <= _q2").repartition(F.xxhash64("_rec", "_q1", "_q2"))
    spelled = met.select("_q1", "_q2", F.explode("_l1").alias("_x"), "_l2").select("_q1", "_q2", "_x", F.explode("_l2").alias("_y")).where("_q1 < _q2 or _x < _y")
    often = spelled.select(F.least("_x", "_y").alias("_a"), F.greatest("_x", "_y").alias("_b")).groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("n_ab"))
    # the others: known from narrow records, looked up by the item of fewer wide ones
    a, b = held.select(F.col("_item").alias("_a"), F.col("_w").alias("_wa")), held.select(F.col("_item").alias("_b"), F.col("_w").alias("_wb"))
    asked = known.join(a, "_a").join(b, "_b").where(F.least("_wa", "_wb") < least).where(F.col("n_ab") + F.least("_wa", "_wb") >= least)
    asked = asked.select("_a", "_b", F.when(F.col("_wa") <= F.col("_wb"), F.col("_a")).otherwise(F.col("_b")).alias("_item"), F.when(F.col("_wa") <= F.col("_wb"), F.col("_b")).otherwise(F.col("_a")).alias("_other"))
    places = asked.join(in_wide, "_item").select("_a", "_b", "_rec", F.col("_other").alias("_item"))
    seldom = places.join(in_wide, ["_rec", "_item"]).groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("n_ab"))
    return known.unionByName(often).unionByName(seldom).groupBy("_a", "_b").agg(F.sum("n_ab").alias("n_ab"))


def pairs_of_scope(pairs: DataFrame, scope: str, least: int, lift: float) -> DataFrame:
    """Pairs of items of one scope that at least `least` records share, `lift` times as many as chance.

    pairs: _scope, _rec, _item, distinct; rows with a null take no part. Out: ambito, item_a < item_b (by code point), n_ab,
    n_a, n_b, n (records with an item), lift = n_ab * n / (n_a * n_b).

    An item of fewer than `least` records, or of more than n / lift records, is in no such pair
    and goes first. Of the rest, frequent items (fewer than DENSE) are counted against each
    other and against rare ones in bit matrices of BLOCK records, through which the records are streamed; pairs of two rare
    items are counted by hash with a partial count per task. The three counts of a pair never overlap and are united.
    A record of many rare items is cut into parts, each with its frequent items; see _rare_pairs for its rare ones.
    """
    own = cut(pairs.where(F.col("_scope") == scope).where("_rec is not null and _item is not null").select("_rec", "_item"))
    n = own.select("_rec").distinct().count()
    counts = cut(own.groupBy("_item").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    fits = (F.col("n") >= least) & (F.col("n") * F.lit(float(lift)) <= n)
    # fewer than DENSE rows, by the threshold; those that don't fit are known too, so that they go where they lie
    dense = counts.where(F.col("n") > max(1, -(-total // DENSE))).select("_item", fits.alias("_fits")).orderBy("_item").collect()
    frequent = [r["_item"] for r in dense if r["_fits"]]
    numbered = own.sparkSession.createDataFrame([(r["_item"],) for r in dense], "_item string")
    number = own.sparkSession.createDataFrame([(w, i) for i, w in enumerate(frequent)], "_item string, _f int")
    heavy = own.join(F.broadcast(number), "_item").select("_rec", "_f", "_item")
    rest = own.join(F.broadcast(numbered), "_item", "left_anti").join(counts.where(fits).select("_item"), "_item", "left_semi")
    rare = cut(rest.select("_rec", "_item"))
    wide = cut(rare.groupBy("_rec").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > WIDE))
    with_rare = _rare_pairs(rare, wide, least)
    if frequent:
        parts = F.coalesce(F.ceil(F.col("_n") / PART), F.lit(1)).cast("int")
        light = join_checked(rare, wide, "_rec", "left").select("_rec", F.pmod(F.xxhash64("_item"), parts).cast("int").alias("_part"), F.lit(None).cast("int").alias("_f"), "_item")
        heads = join_checked(heavy, wide, "_rec", "left").select("_rec", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"), "_f", F.lit(None).cast("string").alias("_item"))
        records = light.unionByName(heads).repartition("_rec", "_part").sortWithinPartitions("_rec", "_part")
        with_frequent = records.select("_rec", "_part", "_f", "_item").mapInArrow(_dense_and_mixed(frequent), "_a string, _b string, n_ab bigint")
        with_rare = with_frequent.unionByName(with_rare)
    both = with_rare.groupBy("_a", "_b").agg(F.sum("n_ab").alias("n_ab")).where(F.col("n_ab") >= least)
    a, b = (counts.select(F.col("_item").alias(f"_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    scored = both.join(a, "_a").join(b, "_b").withColumn("n", F.lit(n).cast("bigint"))
    rate = F.col("n_ab") * F.col("n").cast("double") / (F.col("n_a") * F.col("n_b"))
    enough = F.col("n_ab") * F.col("n").cast("double") >= F.lit(float(lift)) * F.col("n_a") * F.col("n_b")
    return scored.where(enough).select(F.lit(scope).alias("ambito"), F.col("_a").alias("item_a"), F.col("_b").alias("item_b"), "n_ab", "n_a", "n_b", "n", rate.alias("lift"))
