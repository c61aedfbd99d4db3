"""Structured Streaming counterparts of the log and lifecycle operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quipu.operators.cut import shared_folder
from quipu.operators.lifecycle import reinforce_one


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files; it may be one file or a folder of files."""
    path = f"{sf_dir}/{name}.parquet"
    glob = path if os.path.isdir(path) else f"{sf_dir}/{name}.parque[t]"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(glob)


def read_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of its files, with ts as a timestamp (UTC)."""
    return read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def fresh_only(log: DataFrame, keep: str = "7 days") -> DataFrame:
    """Events by id once, as long as the watermark still holds them: a TTL on the stream's state."""
    return log.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["event_id"])


def sessions(log: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sessions of a user that end with `gap` of silence; given out when the watermark has passed."""
    return log.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("eventos"), F.min("ts").alias("inicio"), F.max("ts").alias("fin")).drop("s")


def hourly(log: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events and mean value per kind and hour."""
    w = F.window("ts", "1 hour")
    return log.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("media")).select(F.col("w.start").alias("hora"), "event_type", "n", F.round("media", 6).alias("media"))


def _reinforced(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    weight, good, count = state.get if state.exists else (0.5, 0, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])  # of one key and micro-batch
    for ok in rows["exito"]:
        weight, good = reinforce_one(weight, good, bool(ok))
        count += 1
    state.update((weight, good, count))
    yield pd.DataFrame([(key[0], weight, good, count)], columns=["clave", "peso", "exitos", "eventos"])


def reinforced(log: DataFrame) -> DataFrame:
    """Weight per key after each micro-batch, from state; log: clave, ts, event_id, exito."""
    return log.groupBy("clave").applyInPandasWithState(_reinforced, "clave string, peso double, exitos bigint, eventos bigint", "peso double, exitos bigint, eventos bigint", "update", GroupStateTimeout.NoTimeout)


def working_memory(log: DataFrame, keep: int = 20) -> DataFrame:
    """Per user the latest `keep` events seen so far, as a list kept in state."""

    def last(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for b in batches:  # no more than `keep` are held after each batch
            held = sorted([*held, *zip(b["ts"].astype("int64").tolist(), b["event_id"].tolist())])[-keep:]
        state.update(([t for t, _ in held], [e for _, e in held]))
        yield pd.DataFrame({"user_id": [key[0]], "eventos": [",".join(str(e) for _, e in held)], "n": [len(held)]})

    return log.groupBy("user_id").applyInPandasWithState(last, "user_id bigint, eventos string, n bigint", "t array<bigint>, e array<bigint>", "update", GroupStateTimeout.NoTimeout)


def upsert_batch(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: the last row per key of every batch, one folder per batch, so a batch that runs
    again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), order).alias("r"))
        last.select(*keys, "r.*").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def run_to_end(stream: DataFrame, mode: str = "append", keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """What the stream gives for all that its source holds now, read back from files in the shared
    folder (spark.checkpoint.dir). With keys, only the last row per key of each batch is written."""
    spark = stream.sparkSession
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    if keys:
        writer.foreachBatch(upsert_batch(f"{out}/rows", keys, order)).start().awaitTermination()
        found = spark.read.parquet(f"{out}/rows")
        return found.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in found.columns if c not in (*keys, "batch")]), F.struct("batch", order)).alias("r")).select(*keys, "r.*")
    writer.format("parquet").start(f"{out}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def each_batch(stream: DataFrame, make: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """What `make` gives for every micro-batch that the source holds now; per key the rows of the last batch that gave any.
    A batch that runs again replaces its own folder."""
    spark = stream.sparkSession
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    stream.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    found = spark.read.parquet(f"{out}/rows")
    last = found.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return found.join(last, [*keys, "batch"], "left_semi").drop("batch")
