"""Running sums over groups of any size, one of all rows included."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quipu.operators.cut import cut


def running_before(rows: DataFrame, by: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """rows with the sum of `value` over the rows of the same group (columns `by`, nulls are a group; none: all rows)
    that come before in the order, which should leave no ties; 0 for the first.

    Rows are sorted into ranges of the group and the order, so a large group has many. Sums run inside a range; what
    comes from earlier ranges of the group is known from one total a range, and added.
    """
    ranged = cut(rows.withColumn("_v", value).repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_p", F.spark_partition_id()))
    totals = ranged.groupBy("_p", *by).agg(F.sum("_v").alias("_t"))
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    named = {c: f"_by{k}" for k, c in enumerate(by)} | {"_p": "_q"}
    before = totals.select("_p", *by, F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_b")).withColumnsRenamed(named)
    same = reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(b)) for a, b in named.items()])
    inside = Window.partitionBy("_p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_s", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return local.join(before, same).withColumn(out, F.col("_s") + F.col("_b")).drop("_v", "_s", "_b", "_p", *named.values())
