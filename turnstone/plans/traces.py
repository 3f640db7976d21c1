"""Queries of trace analytics and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators import trace as T
from .catalog import query, tidy
from .tables import SAMPLES_SQL, TRACE_SQL, load, samples, trace

_STAGES = f"WITH {TRACE_SQL}, s AS (SELECT *, regexp_replace(event, '\\.end$', '') AS stage, coalesce(ms, 0) AS d FROM trace WHERE event LIKE '%.end')"


@query(_STAGES + " SELECT stage, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.95), 6) AS p95, count(*) AS n, round(avg(d), 6) AS mean, round(max(d), 6) AS max FROM s GROUP BY stage")
def stage_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(T.stage_percentiles(trace(spark, sf_dir)))


@query(
    _STAGES
    + " SELECT session, turn, stage, count(*) AS n, round(sum(d), 3) AS total_ms, round(arg_min(d, seq), 6) AS first_ms, round(max(d), 6) AS max_ms, min(seq) AS first_seq FROM s GROUP BY session, turn, stage"
)
def turn_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(T.turn_summary(trace(spark, sf_dir)))


@query(
    _STAGES
    + """, g AS (SELECT session, turn, stage, count(*) AS n, sum(d) AS total, arg_min(d, seq) AS first_ms, max(d) AS max_ms, min(seq) AS pos FROM s GROUP BY session, turn, stage)
SELECT session, turn, string_agg(stage || ' ' || n || 'x ' || CAST(floor(total) AS BIGINT) || 'ms' || CASE WHEN n > 1 THEN ' (first ' || CAST(floor(first_ms) AS BIGINT) || ', max ' || CAST(floor(max_ms) AS BIGINT) || ')' ELSE '' END, ' | ' ORDER BY pos) AS line
FROM g GROUP BY session, turn"""
)
def turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn summaries as one line each, in whole milliseconds."""
    # Whole milliseconds are cut from the sum itself: a rounded one may have passed the next of them.
    s = T.turn_summary(trace(spark, sf_dir), digits=None)
    whole = [F.floor(c).cast("double").alias(c) for c in ("total_ms", "first_ms", "max_ms")]
    return T.format_summary(s.select("session", "turn", "stage", "n", "first_seq", *whole))


@query(f"WITH {TRACE_SQL} SELECT session, turn, round(arg_min(response_ms, seq), 6) AS ttfa_ms FROM trace WHERE event = 'playback.end' AND response_ms IS NOT NULL GROUP BY session, turn")
def ttfa_per_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(T.first_audio(trace(spark, sf_dir)))


_TTFA = f"WITH {TRACE_SQL}, f AS (SELECT arg_min(response_ms, seq) AS v FROM trace WHERE event = 'playback.end' AND response_ms IS NOT NULL GROUP BY session, turn)"


@query(_TTFA + " SELECT round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, count(*) AS n, round(avg(v), 6) AS mean FROM f HAVING count(*) > 0")
def ttfa_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(T.ttfa_percentiles(trace(spark, sf_dir)))


_SLI = f"""
WITH {TRACE_SQL}, t AS (
  SELECT session, turn, bool_or(event LIKE '%.end' AND coalesce(error, '') <> '') AS failed,
         arg_min(response_ms, CASE WHEN event = 'playback.end' AND response_ms IS NOT NULL THEN seq END) AS ttfa
  FROM trace GROUP BY session, turn),
o AS (SELECT count(*)::DOUBLE AS n_turns, quantile_cont(ttfa, 0.5) AS p50, quantile_cont(ttfa, 0.95) AS p95, avg(CASE WHEN failed THEN 1.0 ELSE 0.0 END) AS er FROM t),
sli AS (
  SELECT 'n_turns' AS indicator, n_turns AS value FROM o UNION ALL SELECT 'ttfa_p50_ms', p50 FROM o UNION ALL SELECT 'ttfa_p95_ms', p95 FROM o
  UNION ALL SELECT 'error_rate', er FROM o UNION ALL SELECT 'wer', 0.04::DOUBLE)
"""


@query(_SLI + " SELECT indicator, round(value, 6) AS value FROM sli")
def sli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(T.indicators(trace(spark, sf_dir), wer=0.04))


_SLO = """, slo(slo, indicator, objective) AS (VALUES ('ttfa_p95', 'ttfa_p95_ms', 3000.0::DOUBLE), ('error_rate', 'error_rate', 0.01::DOUBLE), ('wer', 'wer', 0.05::DOUBLE), ('cer', 'cer', 0.02::DOUBLE)),
b AS (SELECT slo, indicator, objective, value AS measured, value / objective AS burn FROM slo LEFT JOIN sli USING (indicator))
"""


@query(
    _SLI
    + _SLO
    + " SELECT slo, indicator, round(objective, 6) AS objective, round(measured, 6) AS measured, round(burn, 6) AS burn_rate, round(burn * 0.5, 6) AS consumed, round(1 - burn * 0.5, 6) AS remaining, measured <= objective AS met FROM b"
)
def error_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half a window in: each objective's budget; one indicator was not measured."""
    objectives = T.objective_table(spark, [*T.DEFAULT_OBJECTIVES, T.Objective("cer", "cer", 0.02)])
    return tidy(T.error_budgets(objectives, T.indicators(trace(spark, sf_dir), wer=0.04), 0.5))


_BUCKETS = ", ".join(f"({b}::DOUBLE)" for b in T.BUCKETS_MS)
_HIST = f"""
WITH le(le) AS (VALUES {_BUCKETS}, ('inf'::DOUBLE)), g AS (SELECT event_type AS stage, sum(value) AS s, count(*) AS c FROM events GROUP BY 1),
h AS (SELECT event_type AS stage, le, count(CASE WHEN value <= le THEN 1 END) AS bucket_count FROM events CROSS JOIN le GROUP BY 1, 2)
"""


@query(_HIST + " SELECT h.stage, CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(CAST(le AS BIGINT) AS VARCHAR) END AS le, bucket_count, round(s, 4) AS sum, c AS count FROM h JOIN g ON h.stage = g.stage")
def histogram_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = T.histogram(load(spark, sf_dir, "events").withColumnRenamed("event_type", "stage"), ["stage"], "value")
    return h.select("stage", T.number_text(F.col("le")).alias("le"), "bucket_count", F.round("sum", 4).alias("sum"), "count")


@query(
    _HIST.replace("sum(value)", "sum(floor(value))").replace("value <= le", "floor(value) <= le")
    + """ SELECT 'stage_ms_bucket{stage="' || stage || '",le="' || CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(CAST(le AS BIGINT) AS VARCHAR) END || '"} ' || bucket_count AS line FROM h
UNION ALL SELECT 'stage_ms_sum{stage="' || stage || '"} ' || CAST(s AS BIGINT) FROM g UNION ALL SELECT 'stage_ms_count{stage="' || stage || '"} ' || c FROM g"""
)
def prom_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.floor("value").cast("double").alias("value"))
    return T.exposition(T.histogram(e, ["stage"], "value"), "stage_ms", ["stage"]).select("line")


@query(
    _HIST
    + """, r AS (SELECT h.stage, le, bucket_count AS n, c * 0.95 AS rank FROM h JOIN g ON h.stage = g.stage),
a AS (SELECT stage, min(le) AS le, arg_min(n, le) AS n, any_value(rank) AS rank FROM r WHERE n >= rank GROUP BY stage),
p AS (SELECT stage, max(le) AS le, max(n) AS n FROM r WHERE n < rank GROUP BY stage)
SELECT a.stage, round(CASE WHEN isinf(a.le) THEN coalesce(p.le, 0) ELSE coalesce(p.le, 0) + (a.le - coalesce(p.le, 0)) * (a.rank - coalesce(p.n, 0)) / (a.n - coalesce(p.n, 0)) END, 6) AS value
FROM a LEFT JOIN p ON a.stage = p.stage"""
)
def histogram_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = T.histogram(load(spark, sf_dir, "events").withColumnRenamed("event_type", "stage"), ["stage"], "value")
    return tidy(T.histogram_quantile(h, ["stage"], 0.95))


@query("SELECT event_type, round(sum(value) / count(*), 6) AS mean_ms FROM events GROUP BY event_type")
def stage_mean_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = T.histogram(load(spark, sf_dir, "events"), ["event_type"], "value").where(F.col("le") == float("inf"))
    return h.select("event_type", F.round(F.col("sum") / F.col("count"), 6).alias("mean_ms"))


@query(
    f"""WITH {TRACE_SQL}, le(le) AS (VALUES {_BUCKETS}), t AS (SELECT session, turn, event AS stage, sum(ms) AS ms FROM trace GROUP BY 1, 2, 3)
SELECT stage, CAST(le AS BIGINT) AS le, count(CASE WHEN ms <= le THEN 1 END) AS bucket_count FROM t CROSS JOIN le GROUP BY 1, 2"""
)
def turn_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of turns' stage times."""
    stages = trace(spark, sf_dir).groupBy("session", "turn", "event").agg(F.sum("ms").alias("ms"))
    turns = stages.groupBy("session", "turn").agg(F.map_from_entries(F.collect_list(F.struct("event", "ms"))).alias("stages"))
    return T.turn_metrics(turns).where(F.col("le") != float("inf")).select("stage", F.col("le").cast("bigint").alias("le"), "bucket_count")


@query("SELECT event_type, count(*)::DOUBLE AS value FROM events GROUP BY event_type")
def event_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.counter(load(spark, sf_dir, "events"), ["event_type"])


@query("SELECT event_type, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY event_type")
def event_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(T.gauge(load(spark, sf_dir, "events"), ["event_type"], "value", "event_id"))


def _windows(hours: float, minutes: int) -> str:
    return f"""
SELECT CAST(epoch(w) AS BIGINT) + {int(hours * 3600)} AS window_end, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS bad, count(*) AS total,
       round(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS ratio
FROM (SELECT event_type, unnest(generate_series(time_bucket(INTERVAL '{minutes} minutes', ts) - INTERVAL '{int(hours * 60) - minutes} minutes', time_bucket(INTERVAL '{minutes} minutes', ts), INTERVAL '{minutes} minutes')) AS w FROM events)
GROUP BY w"""


def _ratio(spark: SparkSession, sf_dir: str, window: str, slide: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    r = T.sliding_ratio(e, "ts", F.col("event_type") == "error", F.lit(True), window, slide)
    return r.select(epoch_bigint("window_end").alias("window_end"), "bad", "total", F.round("ratio", 6).alias("ratio"))


def epoch_bigint(name: str):
    from .tables import epoch

    return epoch(F.col(name)).cast("bigint")


@query(_windows(1, 30))
def error_ratio_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ratio(spark, sf_dir, "1 hour", "30 minutes")


@query(_windows(6, 60))
def error_ratio_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ratio(spark, sf_dir, "6 hours", "1 hour")


@query(
    """
WITH x AS (SELECT event_type = 'error' AS bad, ts FROM events),
"""
    + ", ".join(
        f"""w{m} AS (SELECT w + INTERVAL '{m} minutes' AS e, avg(CASE WHEN bad THEN 1.0 ELSE 0.0 END) AS ratio FROM (SELECT bad, unnest(generate_series(time_bucket(INTERVAL '5 minutes', ts) - INTERVAL '{m - 5} minutes', time_bucket(INTERVAL '5 minutes', ts), INTERVAL '5 minutes')) AS w FROM x) GROUP BY w)"""
        for m in (5, 30, 60, 360)
    )
    + """
SELECT 'fast' AS burn, CAST(epoch(a.e) AS BIGINT) AS window_end, round(a.ratio, 6) AS long_ratio, round(b.ratio, 6) AS short_ratio FROM w60 a JOIN w5 b ON a.e = b.e WHERE a.ratio > 14.4::DOUBLE * 0.005::DOUBLE AND b.ratio > 14.4::DOUBLE * 0.005::DOUBLE
UNION ALL
SELECT 'slow', CAST(epoch(a.e) AS BIGINT), round(a.ratio, 6), round(b.ratio, 6) FROM w360 a JOIN w30 b ON a.e = b.e WHERE a.ratio > 6 * 0.005::DOUBLE AND b.ratio > 6 * 0.005::DOUBLE
"""
)
def burn_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.burn_alerts(load(spark, sf_dir, "events"), "ts", F.col("event_type") == "error", F.lit(True))
    return a.select("burn", epoch_bigint("window_end").alias("window_end"), F.round("long_ratio", 6).alias("long_ratio"), F.round("short_ratio", 6).alias("short_ratio"))


_PSI = f"""
WITH {SAMPLES_SQL},
ends AS (SELECT feature, min(value) AS lo, CASE WHEN max(value) = min(value) THEN min(value) + 1 ELSE max(value) END AS hi, count(CASE WHEN sample = 'reference' THEN 1 END) AS nr, count(CASE WHEN sample = 'current' THEN 1 END) AS nc FROM samples GROUP BY feature),
binned AS (SELECT s.feature, sample, least(greatest(CAST(floor((value - lo) / ((hi - lo) / 10)) AS BIGINT), 0), 9) AS bin FROM samples s JOIN ends USING (feature)),
cells AS (SELECT feature, bin, nr, nc FROM ends CROSS JOIN range(10) AS r(bin)),
p AS (SELECT c.feature, greatest(count(CASE WHEN sample = 'reference' THEN 1 END) / any_value(nr)::DOUBLE, 0.0001::DOUBLE) AS e, greatest(count(CASE WHEN sample = 'current' THEN 1 END) / any_value(nc)::DOUBLE, 0.0001::DOUBLE) AS a
      FROM cells c LEFT JOIN binned b ON b.feature = c.feature AND b.bin = c.bin GROUP BY c.feature, c.bin),
psi AS (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM p GROUP BY feature),
steps AS (SELECT feature, value, count(CASE WHEN sample = 'reference' THEN 1 END) AS r, count(CASE WHEN sample = 'current' THEN 1 END) AS c FROM samples GROUP BY feature, value),
ks AS (SELECT feature, max(abs(r - c)) AS ks FROM (
  SELECT feature, sum(r) OVER w / sum(r) OVER (PARTITION BY feature)::DOUBLE AS r, sum(c) OVER w / sum(c) OVER (PARTITION BY feature)::DOUBLE AS c FROM steps WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)) GROUP BY feature)
"""


@query(_PSI + " SELECT feature, round(psi, 6) AS psi FROM psi")
def psi_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(D.psi(samples(spark, sf_dir)))


@query(_PSI + " SELECT feature, round(ks, 6) AS ks FROM ks")
def ks_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(D.ks(samples(spark, sf_dir)))


@query(
    _PSI
    + """ SELECT feature, round(psi, 6) AS psi, round(ks, 6) AS ks, nr AS n_reference, nc AS n_current, round(mr, 6) AS mean_reference, round(mc, 6) AS mean_current, round(mc - mr, 6) AS mean_shift,
concat_ws(',', CASE WHEN psi > 0.2 THEN 'psi' END, CASE WHEN ks > 0.1 THEN 'ks' END) AS reasons, psi > 0.2 OR ks > 0.1 AS drifted
FROM psi JOIN ks USING (feature) JOIN ends USING (feature) JOIN (SELECT feature, avg(CASE WHEN sample = 'reference' THEN value END) AS mr, avg(CASE WHEN sample = 'current' THEN value END) AS mc FROM samples GROUP BY feature) USING (feature)"""
)
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(D.drift_report(samples(spark, sf_dir)))
