"""Queries of spans, counter rates and alert intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import alerting as A
from ..operators import spans as N
from ..operators import trace as T
from .catalog import ORACLE, query, tidy
from .tables import events, load


def _span_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a call in its user's day: a request with a nested model call, a tool call in that, and some that never close.

    A user's days are the turns; a day is one span around all of them. Times follow the values.
    """
    e = events(spark, sf_dir)
    day, k = F.floor(F.col("sec") / 86400).cast("long"), F.col("event_id")
    v = F.col("value") / 1000
    at = lambda stage, kind, place, ts, on=F.lit(True): F.when(on, F.struct(F.lit(f"{stage}.{kind}").alias("event"), F.concat(F.lit(f"{stage}-"), k.cast("string")).alias("span"), (k * 10 + place).alias("_seq"), ts.alias("ts")))
    base = k * 1000.0
    rows = F.array(
        at("request", "start", 1, base), at("llm", "start", 2, base + v), at("tool", "start", 3, base + v * 2, k % 2 == 0), at("tool", "end", 4, base + v * 3, k % 2 == 0),
        at("listen", "start", 5, base + v * 3, k % 7 == 0), at("llm", "end", 6, base + v * 5), at("tts", "end", 7, base + v * 6, k % 11 == 0), at("request", "end", 8, base + v * 9),
    )
    inner = e.select(F.col("user_id").cast("string").alias("session"), day.alias("turn"), F.when(F.col("event_type") == "error", "failed").alias("error"), F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("session", "turn", "error", "r.*")
    days = e.groupBy(F.col("user_id").cast("string").alias("session"), day.alias("turn")).agg(F.min(k).alias("a"), F.max(k).alias("b"))
    outer = F.array(F.struct(F.lit("day.start").alias("event"), (F.col("a") * 10).alias("_seq"), (F.col("a") * 1000.0 - 1).alias("ts")), F.struct(F.lit("day.end").alias("event"), (F.col("b") * 10 + 9).alias("_seq"), (F.col("b") * 1000.0 + 900).alias("ts")))
    outer = days.select("session", "turn", F.lit(None).cast("string").alias("error"), F.explode(outer).alias("r")).select("session", "turn", "error", "r.event", F.lit("day").alias("span"), "r._seq", "r.ts")
    return inner.unionByName(outer)


_SPANS = """
e AS (SELECT event_id AS k, CAST(user_id AS VARCHAR) AS session, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS turn, CASE WHEN event_type = 'error' THEN 'failed' END AS error, value / 1000 AS v FROM events),
i AS (SELECT session, turn, 'request-' || k AS span, 'request' AS stage, k * 10 + 1 AS a, k * 10 + 8 AS b, k * 1000.0::DOUBLE AS t0, k * 1000.0::DOUBLE + v * 9 AS t1, error FROM e
  UNION ALL SELECT session, turn, 'llm-' || k, 'llm', k * 10 + 2, k * 10 + 6, k * 1000.0::DOUBLE + v, k * 1000.0::DOUBLE + v * 5, error FROM e
  UNION ALL SELECT session, turn, 'tool-' || k, 'tool', k * 10 + 3, k * 10 + 4, k * 1000.0::DOUBLE + v * 2, k * 1000.0::DOUBLE + v * 3, error FROM e WHERE k % 2 = 0
  UNION ALL SELECT session, turn, 'listen-' || k, 'listen', k * 10 + 5, NULL, k * 1000.0::DOUBLE + v * 3, NULL, NULL FROM e WHERE k % 7 = 0
  UNION ALL SELECT session, turn, 'day', 'day', min(k) * 10, max(k) * 10 + 9, min(k) * 1000.0::DOUBLE - 1, max(k) * 1000.0::DOUBLE + 900, NULL FROM e GROUP BY session, turn),
-- Every closed span around each span's start; the innermost is the parent.
o AS (SELECT c.session, c.turn, c.span, arg_max(p.span, p.a) AS parent, count(p.span) + 1 AS level FROM i c LEFT JOIN i p ON p.session = c.session AND p.turn = c.turn AND p.b IS NOT NULL AND p.a < c.a AND c.a < p.b GROUP BY c.session, c.turn, c.span),
n AS (SELECT i.*, o.parent, o.level, (i.t1 - i.t0) * 1000 AS ms FROM i JOIN o ON o.session = i.session AND o.turn = i.turn AND o.span = i.span),
s AS (SELECT n.*, n.ms - coalesce((SELECT sum(c.ms) FROM n c WHERE c.session = n.session AND c.turn = n.turn AND c.parent = n.span), 0) AS self_ms FROM n)
"""


@query("WITH " + _SPANS + " SELECT session, turn, span, stage, parent, level, round(ms, 3) AS ms, round(self_ms, 3) AS self_ms, error, b IS NOT NULL AS closed FROM s")
def trace_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.spans(_span_rows(spark, sf_dir))
    return found.select("session", "turn", "span", "stage", "parent", F.col("level").cast("bigint").alias("level"), F.round("ms", 3).alias("ms"), F.round("self_ms", 3).alias("self_ms"), "error", "closed")


@query("WITH " + _SPANS + " SELECT session, turn, round(max(CASE WHEN stage = 'day' THEN ms END), 2) AS root_ms, round(max(CASE WHEN stage = 'day' THEN ms END), 2) AS self_sum_ms FROM s GROUP BY session, turn")
def span_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own times of a turn's spans sum to its root span; the SQL has the root alone."""
    found = N.spans(_span_rows(spark, sf_dir))
    return found.groupBy("session", "turn").agg(F.round(F.max(F.when(F.col("stage") == "day", F.col("ms"))), 2).alias("root_ms"), F.round(F.sum("self_ms"), 2).alias("self_sum_ms"))


@query("WITH " + _SPANS + " SELECT stage, count(*) AS n, round(sum(ms), 1) AS ms, round(sum(self_ms), 1) AS self_ms, count(error) AS errors, count(CASE WHEN b IS NULL THEN 1 END) AS unclosed FROM s GROUP BY stage")
def span_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(N.span_totals(N.spans(_span_rows(spark, sf_dir))), digits=1)


#: Hours between scrapes, hours after which a counter restarts, and the window of its rate.
_EVERY, _RESTART, _WINDOW = 1, 101, 6


def _scrapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram buckets of the event values as two processes would show them, hour by hour, each restarting now and then."""
    e = events(spark, sf_dir).select((F.floor(F.col("sec") / 3600) + 1).cast("long").alias("h"), "event_type", "value", (F.col("event_id") % 2).alias("series"))
    low, high = F.min("h"), F.max("h")
    life = F.floor((F.col("h") + F.col("series") * 50) / _RESTART)
    counted = e.withColumn("life", life).groupBy("series", "event_type", "life", "h").agg(*[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(T.BUCKETS_MS)], F.count("*").alias(f"b{len(T.BUCKETS_MS)}"))
    hours = e.agg(low.alias("a"), high.alias("b")).select(F.explode(F.sequence("a", "b")).alias("h"))
    every = hours.join(F.broadcast(e.select("series", "event_type").distinct()), F.lit(True)).withColumn("life", life)
    run = W.partitionBy("series", "event_type", "life").orderBy("h").rowsBetween(W.unboundedPreceding, 0)
    edges = [*T.BUCKETS_MS, float("inf")]
    shown = every.join(counted, ["series", "event_type", "life", "h"], "left").select("series", "event_type", "h", *[F.sum(F.coalesce(f"b{i}", F.lit(0))).over(run).alias(f"b{i}") for i in range(len(edges))])
    cells = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").cast("double").alias("value")) for i, b in enumerate(edges)])).alias("c")
    return shown.select("series", "event_type", (F.col("h") * 3600).alias("at"), cells).select("series", "event_type", "at", "c.le", "c.value")


_EDGES = ", ".join([f"({b}::DOUBLE)" for b in T.BUCKETS_MS] + ["('inf'::DOUBLE)"])
_RATES = f"""
e AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) + 1 AS h, event_type, value, event_id % 2 AS series FROM events),
le(le) AS (VALUES {_EDGES}),
g AS (SELECT series, event_type, h, le FROM (SELECT DISTINCT series, event_type FROM e), (SELECT unnest(range(min(h), max(h) + 1)) AS h FROM e), le),
c AS (SELECT series, event_type, h, le, count(*) AS n FROM e JOIN le ON value <= le GROUP BY ALL),
x AS (SELECT g.*, coalesce(n, 0) AS n, (h + series * 50) // {_RESTART} AS life FROM g LEFT JOIN c USING (series, event_type, h, le)),
y AS (SELECT series, event_type, le, h, sum(n) OVER (PARTITION BY series, event_type, le, life ORDER BY h ROWS UNBOUNDED PRECEDING)::DOUBLE AS v FROM x),
z AS (SELECT *, coalesce(CASE WHEN v < lag(v) OVER w THEN v ELSE v - lag(v) OVER w END, 0) AS d FROM y WINDOW w AS (PARTITION BY series, event_type, le ORDER BY h)),
-- At each evaluation: the samples of the window, the steps behind its first, and how far it reaches beyond them.
t AS (SELECT q.series, q.event_type, q.le, q.h, count(*) AS n, min(s.h) AS a, max(s.h) AS b, arg_min(s.v, s.h) AS v0, sum(s.d) - arg_min(s.d, s.h) AS grown
      FROM (SELECT DISTINCT series, event_type, le, unnest(range((SELECT min(h) FROM e), (SELECT max(h) FROM e) + {_WINDOW})) AS h FROM y) q JOIN z s ON s.series = q.series AND s.event_type = q.event_type AND s.le = q.le AND s.h > q.h - {_WINDOW} AND s.h <= q.h GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT *, (b - a)::DOUBLE / (n - 1) AS gap, (a - h + {_WINDOW})::DOUBLE AS head, (h - b)::DOUBLE AS tail FROM t),
f AS (SELECT *, CASE WHEN head >= gap * 1.1 THEN gap / 2 ELSE head END AS hd, CASE WHEN tail >= gap * 1.1 THEN gap / 2 ELSE tail END AS tl FROM r),
rate AS (SELECT series, event_type, le, h * 3600 AS tick, grown * ((b - a) + CASE WHEN grown > 0 THEN least(hd, (b - a) * v0 / grown) ELSE hd END + tl) / (b - a) / {_WINDOW * 3600} AS rate FROM f)
"""


@query("WITH " + _RATES + " SELECT series, event_type, tick, round(rate * 3600, 6) AS per_hour FROM rate WHERE isinf(le)")
def counter_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of two processes' counters that restart in mid-window, over six hours at each hour."""
    total = _scrapes(spark, sf_dir).where(F.col("le") == float("inf")).drop("le")
    found = A.counter_rate(total, ["series", "event_type"], _WINDOW * 3600, _EVERY * 3600)
    return found.select("series", "event_type", F.col("at").alias("tick"), F.round(F.col("rate") * 3600, 6).alias("per_hour"))


@query(
    "WITH "
    + _RATES
    + """, s AS (SELECT event_type, tick, le, round(sum(rate), 12) AS n FROM rate GROUP BY ALL), k AS (SELECT *, 0.95 * max(n) OVER (PARTITION BY event_type, tick) AS rank FROM s),
a AS (SELECT event_type, tick, min(le) AS le, arg_min(n, le) AS n, any_value(rank) AS rank FROM k WHERE n >= rank GROUP BY ALL),
p AS (SELECT event_type, tick, max(le) AS le, max(n) AS n FROM k WHERE n < rank GROUP BY ALL)
SELECT a.event_type, a.tick, round(CASE WHEN isinf(a.le) THEN coalesce(p.le, 0) ELSE coalesce(p.le, 0) + (a.le - coalesce(p.le, 0)) * (a.rank - coalesce(p.n, 0)) / (a.n - coalesce(p.n, 0)) END, 3) AS value
FROM a LEFT JOIN p ON p.event_type = a.event_type AND p.tick = a.tick WHERE a.n > 0"""
)
def rate_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile over the rates of both processes' buckets."""
    rates = A.counter_rate(_scrapes(spark, sf_dir), ["series", "event_type", "le"], _WINDOW * 3600, _EVERY * 3600)
    summed = rates.groupBy("event_type", "at", "le").agg(F.round(F.sum("rate"), 12).alias("bucket_count"))
    found = T.histogram_quantile(summed, ["event_type", "at"], 0.95).where(F.col("value").isNotNull())
    return found.select("event_type", F.col("at").alias("tick"), F.round("value", 3).alias("value"))


@query(
    f"""WITH hits AS (SELECT burn AS alert, window_end AS tick FROM ({ORACLE["burn_alerts"]})),
i AS (SELECT *, CASE WHEN tick - lag(tick) OVER (PARTITION BY alert ORDER BY tick) = 300 THEN 0 ELSE 1 END AS fresh FROM hits),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY alert ORDER BY tick ROWS UNBOUNDED PRECEDING) AS run FROM i)
SELECT alert, min(tick) AS pending_at, min(CASE WHEN tick - start >= CASE alert WHEN 'fast' THEN 120 ELSE 900 END THEN tick END) AS firing_at, max(tick) + 300 AS resolved_at, count(*) AS evaluations
FROM (SELECT *, min(tick) OVER (PARTITION BY alert, run) AS start FROM r) GROUP BY alert, run"""
)
def alert_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When both burn alerts were pending, fired and were resolved."""
    hits = T.burn_alerts(load(spark, sf_dir, "events"), "ts", F.col("event_type") == "error", F.lit(True))
    active = hits.select(F.col("burn").alias("alert"), F.unix_timestamp("window_end").alias("at"))
    return A.alert_intervals(active, 300, A.HOLD_S)
