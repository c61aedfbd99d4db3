"""Table reads and the key normalisation every join in this package uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table. Projection and filters on it reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(column: str | Column) -> Column:
    """Outer spaces (U+0020) removed, lower-cased; null and blank both give null."""
    c = F.lower(F.trim(F.col(column) if isinstance(column, str) else column))
    return F.when(c != "", c)
