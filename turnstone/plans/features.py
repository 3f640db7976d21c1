"""Queries of the feature store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as O
from .catalog import query, tidy
from .tables import TRACE_SQL, events, trace

NOW = 1706745600.0  # 2024-02-01


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, sf_dir)
    requests = e.where("event_type = 'purchase'").select(F.col("user_id").alias("entity_id"), F.col("sec").alias("event_ts"), F.col("event_id").alias("request_id"))
    seen = e.where("event_type = 'view'").select(F.col("user_id").alias("entity_id"), F.col("sec").alias("event_ts"), F.col("event_id").alias("_seq"), "value", F.get_json_object("props", "$.k").alias("k"))
    return requests, seen


_PIT = """
WITH e AS (SELECT *, epoch(ts) AS sec FROM events),
r AS (SELECT user_id AS entity_id, sec AS event_ts, event_id AS request_id FROM e WHERE event_type = 'purchase'),
f AS (SELECT user_id AS entity_id, sec AS event_ts, {value} AS value, json_extract_string(props, '$.k') AS k FROM e WHERE event_type = 'view')
SELECT r.entity_id, round(r.event_ts, 6) AS event_ts, r.request_id,
       {v} AS value, {k} AS k
FROM r ASOF LEFT JOIN f ON r.entity_id = f.entity_id AND r.event_ts >= f.event_ts
"""


@query(_PIT.format(value="value", v="round(CASE WHEN r.event_ts - f.event_ts <= 86400 THEN f.value END, 6)", k="CASE WHEN r.event_ts - f.event_ts <= 86400 THEN f.k END"))
def pit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its user's latest view of the day before."""
    r, f = _sides(spark, sf_dir)
    return tidy(O.point_in_time_join(r, f, ["value", "k"], seq="_seq", ttl_s=86400))


@query(_PIT.format(value="value", v="round(f.value, 6)", k="f.k"))
def pit_join_no_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, f = _sides(spark, sf_dir)
    return tidy(O.point_in_time_join(r, f, ["value", "k"], seq="_seq"))


@query(_PIT.format(value="CASE WHEN value >= 50 THEN value END", v="round(f.value, 6)", k="f.k"))
def pit_struct_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null in the latest row stays null; an older value does not fill it."""
    r, f = _sides(spark, sf_dir)
    return tidy(O.point_in_time_join(r, f.withColumn("value", F.when(F.col("value") >= 50, F.col("value"))), ["value", "k"], seq="_seq"))


@query(_PIT.format(value="value", v="round(CASE WHEN r.event_ts - f.event_ts <= 86400 THEN f.value END, 6)", k="CASE WHEN r.event_ts - f.event_ts <= 86400 THEN f.k END"))
def pit_join_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point-in-time join with hot keys cut by day."""
    r, f = _sides(spark, sf_dir)
    return tidy(O.point_in_time_join(r, f, ["value", "k"], seq="_seq", ttl_s=86400, bucket_s=86400))


_LATEST = "SELECT user_id AS entity_id, round(max(epoch(ts)), 6) AS event_ts, round(arg_max(value, (ts, event_id)), 6) AS value, arg_max(event_type, (ts, event_id)) AS event_type FROM events {where} GROUP BY user_id"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("user_id").alias("entity_id"), F.col("sec").alias("event_ts"), "event_id", "value", "event_type")


@query(_LATEST.format(where=""))
def latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(O.latest_per_entity(_values(spark, sf_dir), ["value", "event_type"], seq="event_id"))


@query(_LATEST.format(where="WHERE epoch(ts) BETWEEN 1704499200 AND 1705363200"))
def materialize_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(O.materialize(_values(spark, sf_dir), ["value", "event_type"], start=1704499200, end=1705363200, seq="event_id"))


@query(
    f"""
WITH l AS (SELECT user_id, max(epoch(ts)) AS t, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT u.entity_id, round(CASE WHEN {NOW} - l.t <= 172800 THEN l.value END, 6) AS value
FROM (SELECT DISTINCT user_id AS entity_id FROM events) u LEFT JOIN l ON l.user_id = u.entity_id
"""
)
def online_get_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's latest view, where it is at most two days old."""
    e = _values(spark, sf_dir)
    online = O.latest_per_entity(e.where("event_type = 'view'"), ["value"], seq="event_id")
    return tidy(O.online_lookup(e.select("entity_id").distinct(), online, ["value"], now=NOW, ttl_s=172800))


@query(
    f"""
WITH {TRACE_SQL}, w AS (
  SELECT session, event, max(ts) OVER k AS event_ts,
         count(CASE WHEN event = 'turn.end' THEN 1 END) OVER k AS turn_count,
         sum(CASE WHEN event = 'listen.end' THEN ms END) OVER k / nullif(count(CASE WHEN event = 'listen.end' THEN ms END) OVER k, 0) / 1000 AS avg_user_utterance_s,
         sum(response_ms) OVER k / nullif(count(response_ms) OVER k, 0) AS avg_response_ms,
         last_value(CASE WHEN event = 'llm.end' THEN intent END IGNORE NULLS) OVER k AS last_intent,
         last_value(CASE WHEN event = 'stt.end' THEN accent END IGNORE NULLS) OVER k AS accent_profile
  FROM trace WINDOW k AS (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT session, round(event_ts, 6) AS event_ts, turn_count, round(avg_user_utterance_s, 9) AS avg_user_utterance_s, round(avg_response_ms, 9) AS avg_response_ms, last_intent, accent_profile
FROM w WHERE event = 'turn.end'
"""
)
def session_features_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(O.session_features(trace(spark, sf_dir)), digits=9).withColumn("event_ts", F.round("event_ts", 6))
