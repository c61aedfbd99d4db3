"""References to records that do not exist: orphan and too-early references, and their report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quipu.operators.skew import heavy_keys, join_with_heavy


def reference_status(parents: DataFrame, children: DataFrame) -> DataFrame:
    """One row per key that some child row refers to and that is missing or stored too late.

    parents: clave, creado. children: clave, momento (any further columns are ignored).
    Both sides are tagged and united in long form and grouped by key once; the counts and
    minima are combined before the shuffle, so a hot key costs one row per task.
    Out: clave, padre (boolean), creado (earliest). Null keys refer to nothing.
    """
    long = parents.select("clave", F.lit(True).alias("padre"), "creado", F.lit(None).cast("timestamp_ntz").alias("momento")).unionByName(
        children.select("clave", F.lit(False).alias("padre"), F.lit(None).cast("timestamp_ntz").alias("creado"), "momento")
    )
    by_key = (
        long.where(F.col("clave").isNotNull())
        .groupBy("clave")
        .agg(
            F.max("padre").alias("padre"),
            F.min("padre").alias("_solo_padre"),
            F.min("creado").alias("creado"),
            F.min("momento").alias("_primera"),
        )
    )
    return by_key.where(~F.col("_solo_padre") & (~F.col("padre") | (F.col("_primera") < F.col("creado")))).select("clave", "padre", "creado")


def broken_references(parents: DataFrame, children: DataFrame, total: int) -> DataFrame:
    """Every child row whose key is stored nowhere, or was stored later than the reference.

    parents: clave, creado (timestamp_ntz). children: tabla, campo, fila, clave, momento.
    total: an upper bound of the rows of children (a row count of the tables will do).
    Out: tabla, campo, fila, clave, momento, tardia (boolean); one row per tabla, campo and
    fila, so re-delivered rows count once. A null time on either side is not late; null and
    blank keys refer to nothing; empty tables give no rows, or all references if parents
    is empty.
    """
    status = reference_status(parents, children)
    keyed = children.where(F.col("clave").isNotNull())
    heavy = heavy_keys(keyed, "clave", total)
    late = F.col("padre") & (F.col("momento") < F.col("creado"))
    hit = join_with_heavy(keyed, status, "clave", heavy).where(~F.col("padre") | late)
    return (
        hit.groupBy("tabla", "campo", "fila")
        .agg(F.min(F.struct("clave", "momento", F.col("padre").alias("tardia"))).alias("_r"))
        .select("tabla", "campo", "fila", "_r.*")
    )


def reference_report(broken: DataFrame, deleted: DataFrame) -> DataFrame:
    """Counts per tabla, campo and month of reference of those never stored, deleted and late.

    broken: as broken_references gives it. deleted: clave of every deletion logged (repeats allowed).
    Null times are counted under the period "sin_fecha". Counts are summed per key first, so
    the join with the deletions sees each key once per period.
    """
    per_key = (
        broken.withColumn("periodo", F.coalesce(F.date_format("momento", "yyyy-MM"), F.lit("sin_fecha")))
        .groupBy("tabla", "campo", "periodo", "clave", "tardia")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    gone = deleted.where(F.col("clave").isNotNull()).select("clave").distinct().withColumn("_borrada", F.lit(True))
    was = F.coalesce(F.col("_borrada"), F.lit(False))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("bigint")
    return (
        per_key.join(gone, "clave", "left")
        .groupBy("tabla", "campo", "periodo")
        .agg(
            total(~F.col("tardia") & ~was).alias("nunca"),
            total(~F.col("tardia") & was).alias("borradas"),
            total(F.col("tardia")).alias("tardias"),
        )
    )
