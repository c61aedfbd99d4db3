"""Registered streaming queries: each runs its stream over the whole event table to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quipu.plans.views import Catalogue, Views
from quipu.streaming import jobs as J

C = Catalogue()
QUERIES, SQL = C.queries, C.sql


@C.add("str1_ttl_dedup", "SELECT event_id, user_id FROM events")
def _(v: Views) -> DataFrame:
    return J.run_to_end(J.fresh_only(J.read_log(v.spark, v.dir)).select("event_id", "user_id"))


@C.add("str2_session_stream")
def _(v: Views) -> DataFrame:
    """Sessions that the watermark has closed; those still open at the end are not given out."""
    return J.run_to_end(J.sessions(J.read_log(v.spark, v.dir)))


@C.add("str3_hourly_stream")
def _(v: Views) -> DataFrame:
    return J.run_to_end(J.hourly(J.read_log(v.spark, v.dir)))


@C.add("str4_reinforcement_stream")
def _(v: Views) -> DataFrame:
    log = J.read_log(v.spark, v.dir).select(F.col("user_id").cast("string").alias("clave"), "ts", "event_id", (F.col("event_type") == "purchase").alias("exito"))
    return J.run_to_end(J.reinforced(log), "update", ["clave"], "eventos").withColumn("peso", F.round("peso", 6))


@C.add("str5_working_memory", "SELECT user_id, string_agg(event_id, ',' ORDER BY ts, event_id) AS eventos, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20 GROUP BY 1")
def _(v: Views) -> DataFrame:
    return J.run_to_end(J.working_memory(J.read_log(v.spark, v.dir).select("user_id", "ts", "event_id")), "update", ["user_id"], "n")
