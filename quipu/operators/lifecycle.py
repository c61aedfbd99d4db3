"""Snapshot-in, snapshot-out transforms of node and edge weights."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quipu.functions import text as T
from quipu.operators.running import running_before


def decay_nodes(nodes: DataFrame, categories: DataFrame) -> DataFrame:
    """Weights after one cycle: less 0.05 * category rate * priority factor, not below 0.

    Exempt: priority 0 and 1, valence of 0.8 or more, Principle and Protocol. categories has eleven rows.
    """
    factor = F.when(F.col("prioridad") == 2, 0.5).when(F.col("prioridad") == 3, 1.0).when(F.col("prioridad") == 4, 1.5).when(F.col("prioridad") >= 5, 2.5).otherwise(1.5)
    exempt = F.coalesce(F.col("prioridad").isin(0, 1), F.lit(False)) | (F.col("valencia") >= 0.8) | F.coalesce(F.col("nombre").isin("Principle", "Protocol"), F.lit(False))
    less = F.greatest(F.lit(0.0), T.half_up(F.col("peso") - 0.05 * F.coalesce("decay", F.lit(1.0)) * factor, 2))
    named = nodes.join(F.broadcast(categories), F.col("categoria") == F.col("cid"), "left")
    return named.withColumn("peso", F.when(exempt, F.col("peso")).otherwise(less)).drop("cid", "nombre", "decay")


def decay_edges(edges: DataFrame, at) -> DataFrame:
    """Edges unused for seven days before `at` lose 5 %; those below 0.05 go."""
    idle = F.coalesce("uso", "creado") < F.lit(at) - F.expr("interval 7 days")
    return edges.withColumn("peso", F.when(idle, T.half_up(F.col("peso") * 0.95, 3)).otherwise(F.col("peso"))).where("peso >= 0.05")


def inhibit(nodes: DataFrame) -> DataFrame:
    """Nodes put to sleep per category: from the weakest on, as long as the summed weight before a node
    is less than the excess over half the allowed number (0.8 of the nodes, ten at least)."""
    allowed = nodes.groupBy("categoria").agg((F.sum("peso") - F.greatest(F.lit(10.0), 0.8 * F.count(F.lit(1))) * 0.5).alias("exceso"))
    order = [F.asc("peso"), F.asc_nulls_first("ultimo_acceso"), F.asc("concepto")]
    limit = allowed.select(F.col("categoria").alias("_c"), "exceso")
    run = running_before(nodes, ["categoria"], order, F.col("peso"), "antes").join(F.broadcast(limit), F.col("categoria").eqNullSafe(F.col("_c")))
    return run.where(F.round(F.col("exceso") - F.col("antes"), 6) > 0).withColumn("peso", F.greatest(F.lit(0.05), T.half_up(F.col("peso") * 0.9, 2)))


def homeostasis(nodes: DataFrame, limit: float = 0.70) -> DataFrame:
    """Where the mean weight of a category is above the limit, all its weights lose 2 %."""
    mean = nodes.groupBy(F.col("categoria").alias("_c")).agg(F.avg("peso").alias("_m"))
    rows = nodes.join(F.broadcast(mean), F.col("categoria").eqNullSafe(F.col("_c")), "left")
    return rows.withColumn("peso", F.when(F.col("_m") > limit, T.half_up(F.col("peso") * 0.98, 2)).otherwise(F.col("peso"))).drop("_c", "_m")


def consolidate(long_term: DataFrame, short_term: DataFrame) -> DataFrame:
    """Short-term rows merged into long-term: known concepts gain 0.2 (1 at most) and new content behind the
    old, unknown ones enter at 1.0; the greater valence stays."""
    a = long_term.select("concepto", F.col("contenido").alias("c1"), F.col("peso").alias("p"), F.col("valencia").alias("v1"), F.lit(True).alias("k1"))
    b = short_term.select("concepto", F.col("contenido").alias("c2"), F.col("valencia").alias("v2"), F.lit(True).alias("k2"))
    both = a.join(b, "concepto", "full")
    weight = F.when(F.col("k1").isNull(), 1.0).when(F.col("k2").isNull(), F.col("p")).otherwise(F.least(F.lit(1.0), F.col("p") + 0.2))
    content = F.when(F.col("c1").isNull(), F.col("c2")).when(F.col("c2").isNull() | F.contains("c1", "c2"), F.col("c1")).otherwise(F.concat("c1", F.lit(" | "), "c2"))
    return both.select("concepto", weight.alias("peso"), F.greatest("v1", "v2").alias("valencia"), content.alias("contenido"))


def reinforce_one(weight: float, good: int, success: bool) -> tuple[float, int]:
    """One event: a success adds 0.15 * (1 - 0.3 w), 1 at most; a failure takes
    0.10 / (1 + ln(1 + successes)), down to 0.05."""
    import math

    if success:
        return min(1.0, weight + 0.15 * (1 - 0.3 * weight)), good + 1
    return max(0.05, weight - 0.10 / (1 + math.log(1 + good))), good


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, weight, good, count = None, 0.5, 0, 0
    for b in batches:
        out = []
        for k, ok in zip(b["clave"], b["exito"]):
            if k != key:
                if key is not None:
                    out.append((key, weight, good, count))
                key, weight, good, count = k, 0.5, 0, 0
            weight, good = reinforce_one(weight, good, bool(ok))
            count += 1
        yield pd.DataFrame(out, columns=["clave", "peso", "exitos", "eventos"])
    if key is not None:
        yield pd.DataFrame([(key, weight, good, count)], columns=["clave", "peso", "exitos", "eventos"])


def reinforce(events: DataFrame) -> DataFrame:
    """events: clave, ts, event_id, exito. Weight per key after its events in order, from 0.5 on.

    Partitions are sorted and folded as a stream of batches, so no key's events are held at once.
    """
    ordered = events.where("clave is not null").repartition("clave").sortWithinPartitions("clave", "ts", "event_id").select("clave", "exito")
    return ordered.mapInPandas(_fold, "clave string, peso double, exitos bigint, eventos bigint").withColumn("peso", F.round("peso", 6))


def implicit_feedback(log: DataFrame) -> DataFrame:
    """log: event_id, user_id, event_type (what was asked), ts. The same asked again within 120 s says not useful
    (0.9), silence of over 600 s useful (0.55), anything else nothing."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.expr("unix_micros(cast(ts as timestamp))")
    s = log.select("event_id", "event_type", F.lead("event_type").over(w).alias("sig"), (F.lead(us).over(w) - us).alias("dt"))
    again = (F.col("dt") > 0) & (F.col("dt") <= 120_000_000) & (F.col("sig") == F.col("event_type"))
    quiet = F.col("dt").isNull() | (F.col("dt") > 600_000_000)
    return s.select("event_id", F.when(again, 0).when(quiet, 1).alias("util"), F.when(again, 0.9).when(quiet, 0.55).alias("confianza"))


def infer_category(rows: DataFrame, key: str, text: str, terms: dict[str, list[str]]) -> DataFrame:
    """Category by contained terms: number of terms times length of the longest, first of equals, else General."""
    t = F.lower(T.text(text))
    scores = []
    for k, (name, ws) in enumerate(terms.items()):
        hits = F.filter(F.array(*map(F.lit, ws)), lambda w: F.contains(t, w))
        longest = F.coalesce(F.array_max(F.transform(hits, F.length)), F.lit(0))
        scores.append(F.struct((F.size(hits) * longest).alias("s"), F.lit(-k).alias("o"), F.lit(name).alias("n")))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return rows.select(key, best.alias("b")).select(key, F.when(F.col("b.s") > 0, F.col("b.n")).otherwise("General").alias("categoria"))
