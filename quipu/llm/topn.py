"""Top N items within every group, also where one group holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows gathered before a task ranks them; rows kept, after ranking, before they go out.
GATHERED, HELD = 200_000, 1_000_000


def _ranked(rows: pa.Table, n: int) -> pa.Table:
    """The n best items of every group of the table, with the rank _r of each; repeated items count once."""
    best = rows.group_by(["_g", "_i"], use_threads=False).aggregate([("_s", "max")]).rename_columns({"_s_max": "_s"})
    best = best.take(pc.sort_indices(best, [("_g", "ascending"), ("_s", "descending"), ("_i", "ascending")])).combine_chunks()
    if not len(best):
        return best.append_column("_r", pa.array([], pa.int32()))
    group = best["_g"].combine_chunks()
    begins = np.concatenate([[True], pc.not_equal(group[1:], group[:-1]).to_numpy(zero_copy_only=False)])
    place = np.arange(len(best))
    rank = place - np.maximum.accumulate(np.where(begins, place, 0)) + 1
    return best.append_column("_r", pa.array(rank.astype(np.int32))).filter(pa.array(rank <= n))


def _local(n: int):
    """The n best items of every group among the rows of a partition. A state of more than HELD rows goes out and
    begins anew: what it ranked is then the best of a part, which is as good a bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, fresh, waiting = None, [], 0

        def merged() -> pa.Table:
            parts = [pa.Table.from_batches(fresh)] if fresh else []
            if state is not None:
                parts.append(state.drop_columns(["_r"]))
            return _ranked(pa.concat_tables(parts), n)

        for b in batches:
            fresh.append(b)
            waiting += b.num_rows
            if waiting >= GATHERED:
                state, fresh, waiting = merged(), [], 0
                if len(state) > HELD:
                    yield from state.to_batches()
                    state = None
        if fresh or state is not None:
            yield from merged().to_batches()

    return run


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """The n best items of every group: score descending, then item ascending.

    An item's score is the highest of its rows, so repeated rows count once. Out: the columns
    group, item, score; other columns are ignored. Rows with a null group, item or score, or a
    NaN score, take no part; groups of fewer than n items give them all.

    Every input partition keeps the n best different items of each of its groups, so that a group sends at most n rows a
    partition, however many it has, and there is one shuffle. The n-th best score of a partition is a lower bound of the
    group's n-th best. The greatest bound of a group meets its rows by a window, on the partitioning they have by then (a join
    would read them twice), and removes what can't be among its n best. Only the survivors are merged by item and ranked.
    """
    g, i, s = F.col(f"`{group}`").alias("_g"), F.col(f"`{item}`").alias("_i"), F.col(f"`{score}`").alias("_s")
    clean = rows.select(g, i, s).where("_g is not null and _i is not null and _s is not null and not isnan(_s)")
    kinds = dict(clean.dtypes)
    local = clean.mapInArrow(_local(n), f"_g {kinds['_g']}, _i {kinds['_i']}, _s {kinds['_s']}, _r int").repartition("_g")
    bound = F.max(F.when(F.col("_r") == n, F.col("_s"))).over(Window.partitionBy("_g"))
    survivors = local.withColumn("_bound", bound).where(F.col("_bound").isNull() | (F.col("_s") >= F.col("_bound")))
    merged = survivors.groupBy("_g", "_i").agg(F.max("_s").alias("_s"))
    ranked = merged.withColumn("_q", F.row_number().over(Window.partitionBy("_g").orderBy(F.desc("_s"), F.asc("_i")))).where(F.col("_q") <= n)
    return ranked.select(F.col("_g").alias(group), F.col("_i").alias(item), F.col("_s").alias(score))
