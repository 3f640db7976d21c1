"""Views over the given tables that queries share, in both dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship_code, spread

#: Tables whose rows take far longer to work on than to move.
TEXTS = ("documents", "conversations", "benchmark")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_code(spark)
    found = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(found) if table in TEXTS else found


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    day = F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("double")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.date_part(F.lit("SECOND"), ts).cast("double")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("sec", epoch(F.col("ts")))


#: Events as trace rows: each type is a stage's end; a purchase ends a turn.
STAGE_OF = {"view": "stt.end", "click": "llm.end", "signup": "listen.end", "error": "playback.end", "purchase": "turn.end"}


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    before = W.partitionBy("user_id").orderBy("sec", "event_id").rowsBetween(W.unboundedPreceding, -1)
    stage = F.create_map(*[F.lit(x) for kv in STAGE_OF.items() for x in kv])
    turn = F.coalesce(F.count(F.when(F.col("event_type") == "purchase", 1)).over(before), F.lit(0)) + 1
    return e.select(
        F.col("user_id").cast("string").alias("session"),
        turn.alias("turn"),
        stage[F.col("event_type")].alias("event"),
        F.col("sec").alias("ts"),
        F.col("event_id").alias("_seq"),
        F.col("value").alias("ms"),
        F.when(F.col("event_type") == "error", F.col("value")).alias("response_ms"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 100), "slow").alias("error"),
        F.get_json_object("props", "$.k").alias("intent"),
        F.get_json_object("props", "$.k").alias("accent"),
        F.col("ts").alias("time"),
    )


TRACE_SQL = """
e AS (SELECT *, epoch(ts) AS sec FROM events),
trace AS (
  SELECT CAST(user_id AS VARCHAR) AS session,
         1 + count(CASE WHEN event_type = 'purchase' THEN 1 END) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turn,
         CASE event_type WHEN 'view' THEN 'stt.end' WHEN 'click' THEN 'llm.end' WHEN 'signup' THEN 'listen.end' WHEN 'error' THEN 'playback.end' WHEN 'purchase' THEN 'turn.end' END AS event,
         sec AS ts, event_id AS seq, value AS ms,
         CASE WHEN event_type = 'error' THEN value END AS response_ms,
         CASE WHEN event_type = 'error' AND value > 100 THEN 'slow' END AS error,
         json_extract_string(props, '$.k') AS intent, json_extract_string(props, '$.k') AS accent, ts AS time
  FROM e)
"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as drift samples: a feature a type, the first half of January against the rest."""
    e = load(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("feature"), F.when(F.dayofmonth("ts") <= 15, "reference").otherwise("current").alias("sample"), "value")


SAMPLES_SQL = "samples AS (SELECT event_type AS feature, CASE WHEN day(ts) <= 15 THEN 'reference' ELSE 'current' END AS sample, value FROM events)"


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
