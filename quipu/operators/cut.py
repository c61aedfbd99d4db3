"""Lineage cuts that survive the loss of executors, and the shared folder they lie in."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a session in one process (as in tests) gets a
    temporary folder; on a cluster that would be a path of one machine, so there it is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="quipu-"))
    return context.getCheckpointDir()


def cut(rows: DataFrame) -> DataFrame:
    """rows, written to the shared checkpoint folder of the session and read from there."""
    context = rows.sparkSession.sparkContext
    folder = shared_folder(rows.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return rows.checkpoint()
