"""Helpers for keys that hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that may be broadcast after they have been counted: some ten MB of short keys.
BROADCAST_ROWS = 200_000

#: A key is heavy if it holds more than one row in HEAVY_PARTS of all rows, so there are
#: fewer than HEAVY_PARTS of them whatever the data: that is what bounds their broadcast.
HEAVY_PARTS = 1000


def heavy_keys(rows: DataFrame, column: str, total: int, parts: int = HEAVY_PARTS) -> DataFrame:
    """Keys of `column` with more than total/parts rows: fewer than `parts` rows come out.

    `total` must be at least the number of rows of `rows`, which makes the bound hold.
    Counts are combined before the shuffle. Nulls are never heavy.
    """
    least = max(1, -(-total // parts))
    return (
        rows.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > least)
    )


def spread(rows: DataFrame, *columns: str, parts: int | None = None) -> DataFrame:
    """rows hashed by the columns into a fixed number of partitions (spark.sql.shuffle.partitions).

    For groups whose work is large for their bytes: adaptive execution would merge them into few tasks.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *columns)


def join_with_heavy(rows: DataFrame, lookup: DataFrame, column: str, heavy: DataFrame) -> DataFrame:
    """rows ⋈ lookup on `column`, where rows may be skewed and lookup has one row per key.

    Rows of heavy keys meet a broadcast copy of their lookup rows (fewer than HEAVY_PARTS, see
    heavy_keys) where they lie; only the others are shuffled. Null keys match nothing.
    """
    hot = F.broadcast(heavy.select(column))
    hot_lookup = F.broadcast(lookup.join(hot, column, "left_semi"))
    here = rows.join(hot_lookup, column)
    there = rows.join(hot, column, "left_anti").join(lookup, column)
    return here.unionByName(there)


def join_checked(rows: DataFrame, lookup: DataFrame, column: str, how: str) -> DataFrame:
    """rows joined with a lookup of one narrow row per key: in place if the lookup, counted here, has BROADCAST_ROWS
    at most, by a shuffle otherwise (a key's rows are then split by adaptive execution). The lookup should be cut."""
    small = lookup.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(lookup) if small else lookup, column, how)
