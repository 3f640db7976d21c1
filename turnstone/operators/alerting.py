"""Rates of scraped counters, and alerts that must hold for a while before they fire."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .trace import histogram_quantile

#: Seconds that each burn alert must hold before it fires.
HOLD_S = {"fast": 120, "slow": 900}


def increases(samples: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Adds ``step``: what a counter (labels, at in seconds, value) grew since its series' sample before, null for the first.

    A value below the one before means that the counter restarted from zero. Of samples of one
    series and time the largest counts; null values are no samples.
    """
    once = samples.where(F.col("value").isNotNull()).groupBy(*labels, "at").agg(F.max("value").alias("value"))
    before = F.lag("value").over(W.partitionBy(*labels).orderBy("at"))
    return once.withColumn("step", F.when(F.col("value") >= before, F.col("value") - before).when(before.isNotNull(), F.col("value")))


def counter_rate(samples: DataFrame, labels: Sequence[str], window_s: int, every_s: int) -> DataFrame:
    """(labels, at, rate): growth per second of each series over the ``window_s`` before each evaluation, every ``every_s`` seconds.

    As metric stores compute it: steps between the samples of the window (a restart counts
    from zero), extended to the window's ends by at most half an interval between samples
    where these are far away, and never to before the counter was zero. Windows of fewer
    than two samples have no rate. A sample is copied into the windows that it lies in:
    window over step, whatever the length of the series.
    """
    if window_s <= 0 or every_s <= 0:
        raise ValueError("window and step must be positive")
    steps = increases(samples, labels)
    first = F.ceil(F.col("at") / every_s).cast("long") * every_s
    last = F.ceil((F.col("at") + window_s) / every_s).cast("long") * every_s - every_s
    held = steps.where(last >= first).withColumn("end", F.explode(F.sequence(first, last, F.lit(every_s).cast("long"))))
    by = held.groupBy(*labels, "end").agg(
        F.count("*").alias("n"), F.min("at").alias("a"), F.max("at").alias("b"), F.min_by("value", "at").alias("start"), F.sum("step").alias("steps"), F.min_by(F.coalesce("step", F.lit(0.0)), "at").alias("own")
    )
    # The first sample's own step lies before the window.
    by = by.where("n > 1").withColumn("grown", F.coalesce("steps", F.lit(0.0)) - F.col("own"))
    span = (F.col("b") - F.col("a")).cast("double")
    gap = span / (F.col("n") - 1)
    head, tail = (F.col("a") - F.col("end") + window_s).cast("double"), (F.col("end") - F.col("b")).cast("double")
    reach = lambda d: F.when(d >= gap * 1.1, gap / 2).otherwise(d)
    zero = F.when((F.col("grown") > 0) & (F.col("start") >= 0), span * F.col("start") / F.nullif(F.col("grown"), F.lit(0.0)))
    head = F.least(reach(head), F.coalesce(zero, reach(head)))
    return by.select(*labels, F.col("end").alias("at"), (F.col("grown") * (span + head + reach(tail)) / span / window_s).alias("rate"))


def quantile_of_rates(buckets: DataFrame, labels: Sequence[str], q: float, window_s: int, every_s: int) -> DataFrame:
    """(labels, at, value): the quantile over ``le`` of scraped histogram buckets' rates, summed over what isn't in ``labels``.

    ``buckets`` has series, the labels, le, at and value: cumulative counts of each series.
    """
    rates = counter_rate(buckets, ["series", *labels, "le"], window_s, every_s)
    summed = rates.groupBy(*labels, "at", "le").agg(F.sum("rate").alias("bucket_count"))
    return histogram_quantile(summed, [*labels, "at"], q).where(F.col("value").isNotNull())


def alert_intervals(active: DataFrame, every_s: int, hold_s: dict[str, int], until: int | None = None) -> DataFrame:
    """(alert, pending_at, firing_at, resolved_at, evaluations) of evaluations at which alerts were true (alert, at in seconds).

    Evaluations are ``every_s`` apart; one that is missing was false and ends the interval. An
    alert fires once it has been true for its ``hold_s`` seconds, and is resolved by the first
    false evaluation; with ``until``, the last evaluation, intervals that reach it are open.
    """
    hold = F.coalesce(F.create_map(*[F.lit(x) for kv in hold_s.items() for x in kv])[F.col("alert")], F.lit(0))
    once = active.select("alert", "at").distinct()
    # Consecutive evaluations keep their distance to their number: one row an evaluation in this window.
    runs = once.withColumn("run", F.col("at") - F.row_number().over(W.partitionBy("alert").orderBy("at")) * every_s)
    by = runs.groupBy("alert", "run").agg(F.min("at").alias("pending_at"), F.max("at").alias("last_at"), F.count("*").alias("evaluations"))
    fires = F.col("pending_at") + F.ceil(hold / every_s) * every_s
    resolved = F.col("last_at") + every_s
    return by.select(
        "alert", "pending_at", F.when(fires <= F.col("last_at"), fires).alias("firing_at"), (resolved if until is None else F.when(F.col("last_at") < until, resolved)).alias("resolved_at"), "evaluations"
    )
