"""Trace analytics: turns, stage and first-audio percentiles, indicators, error budgets, metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quantiles import quantiles

# Stages of a turn, histogram buckets in ms, objectives, burn-rate windows.
STAGES = ("listen", "stt", "retrieve", "llm", "segment.emit", "tts", "playback", "turn")
BUCKETS_MS = (10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2000.0, 3000.0, 5000.0, 10000.0)
BURN_ALERTS = (("fast", 3600, 300, 14.4), ("slow", 21600, 1800, 6.0))
ERROR_BUDGET = 0.005
#: Metrics of the platform: name, kind, labels.
METRICS = (
    ("turns_total", "counter", ("status",)),
    ("stage_ms", "histogram", ("stage",)),
    ("ttfa_ms", "histogram", ()),
    ("errors_total", "counter", ("stage",)),
    ("wer", "gauge", ("set",)),
    ("llm_ttft_ms", "histogram", ()),
    ("drift_psi", "gauge", ("feature",)),
    ("edge_bundle_verify_failed_total", "counter", ("device",)),
    ("edge_bundle_info", "gauge", ("version",)),
)


@dataclass(frozen=True)
class Objective:
    name: str
    indicator: str
    objective: float
    window: str = "30d"
    comparator: str = "<="
    description: str = ""

    def __post_init__(self) -> None:
        if self.comparator not in ("<=", ">="):
            raise ValueError(f"unknown comparator: {self.comparator}")


DEFAULT_OBJECTIVES = (Objective("ttfa_p95", "ttfa_p95_ms", 3000.0), Objective("error_rate", "error_rate", 0.01), Objective("wer", "wer", 0.05))


def objectives_from_config(config: dict) -> list[Objective]:
    """From ``{"slo": [{name, indicator, objective, window, comparator}]}``."""
    return [Objective(str(x["name"]), str(x["indicator"]), float(x["objective"]), str(x.get("window", "30d")), str(x.get("comparator", "<=")), str(x.get("description", ""))) for x in config.get("slo", [])]


def objective_table(spark: SparkSession, objectives: Sequence[Objective]) -> DataFrame:
    return spark.createDataFrame([(o.name, o.indicator, o.objective, o.comparator) for o in objectives], "slo string, indicator string, objective double, comparator string")


def turn_keys() -> tuple[Column, Column]:
    """A missing session is the text None, a missing turn 0."""
    return F.coalesce(F.col("session").cast("string"), F.lit("None")).alias("session"), F.coalesce(F.col("turn"), F.lit(0)).cast("long").alias("turn")


def stage_rows(trace: DataFrame) -> DataFrame:
    """End rows with their stage; a missing duration counts as 0."""
    return trace.where(F.endswith("event", F.lit(".end"))).withColumn("stage", F.regexp_replace("event", r"\.end$", "")).withColumn("ms", F.coalesce("ms", F.lit(0.0)))


def stage_percentiles(trace: DataFrame, ps: Sequence[float] = (50, 95)) -> DataFrame:
    """Exact percentiles, number, mean and largest duration of each stage; no task holds a stage's durations."""
    rows = stage_rows(trace)
    totals = rows.groupBy("stage").agg(F.avg("ms").alias("mean"), F.max("ms").alias("max"))
    return quantiles(rows, "ms", ps, ["stage"]).join(totals, "stage").select("stage", *[F.col(f"`p{p:g}`") for p in ps], "n", "mean", "max")


def approx_stage_percentiles(trace: DataFrame, ps: Sequence[float] = (50, 95), accuracy: int = 10000) -> DataFrame:
    """Percentiles in bounded memory, within 1/accuracy of the rank."""
    return stage_rows(trace).groupBy("stage").agg(*[F.percentile_approx("ms", p / 100.0, accuracy).alias(f"p{p:g}") for p in ps], F.count("*").alias("n"))


def turn_summary(trace: DataFrame, seq: str = "_seq", digits: int | None = 3) -> DataFrame:
    """Count, total (rounded to ``digits``, if given), first and largest duration of each stage of a turn, and the stage's place in it."""
    session, turn = turn_keys()
    rows = stage_rows(trace).select(session, turn, "stage", "ms", F.col(seq).alias("_at"))
    by = rows.groupBy("session", "turn", "stage").agg(
        F.count("*").alias("n"), (F.sum("ms") if digits is None else F.bround(F.sum("ms"), digits)).alias("total_ms"), F.min_by("ms", "_at").alias("first_ms"), F.max("ms").alias("max_ms"), F.min("_at").alias("first_seq")
    )
    return by


def format_summary(summary: DataFrame) -> DataFrame:
    """One line per turn: stages in order of appearance with counts and times."""
    ms = lambda c: F.format_string("%.0f", c)
    piece = F.concat(F.col("stage"), F.format_string(" %dx ", F.col("n")), ms(F.col("total_ms")), F.lit("ms"), F.when(F.col("n") > 1, F.concat(F.lit(" (first "), ms(F.col("first_ms")), F.lit(", max "), ms(F.col("max_ms")), F.lit(")"))).otherwise(""))
    rows = F.array_sort(F.collect_list(F.struct("first_seq", piece.alias("piece"))))
    return summary.groupBy("session", "turn").agg(F.array_join(F.transform(rows, lambda r: r["piece"]), " | ").alias("line"))


def first_audio(trace: DataFrame, seq: str = "_seq") -> DataFrame:
    """Time to first audio of each turn: the first response time among its playback ends."""
    session, turn = turn_keys()
    rows = trace.where((F.col("event") == "playback.end") & F.col("response_ms").isNotNull()).select(session, turn, "response_ms", F.col(seq).alias("_at"))
    return rows.groupBy("session", "turn").agg(F.min_by("response_ms", "_at").alias("ttfa_ms"))


def ttfa_percentiles(trace: DataFrame, ps: Sequence[float] = (50, 95), seq: str = "_seq") -> DataFrame:
    """One row, or none without a value."""
    first = first_audio(trace, seq)
    return quantiles(first, "ttfa_ms", ps).withColumn("mean", first.agg(F.avg("ttfa_ms")).scalar()).select(*[F.col(f"`p{p:g}`") for p in ps], "n", "mean")


def indicators(trace: DataFrame, wer: float | None = None, seq: str = "_seq") -> DataFrame:
    """(indicator, value) rows, and the number of turns as one of them.

    A turn fails when an end row carries an error that isn't empty, 0 or false, or when it
    started and never ended. Turns are summed up per turn, then over all.
    """
    session, turn = turn_keys()
    error = F.col("error").cast("string")
    truthy = error.isNotNull() & ~error.isin("", "0", "0.0", "false", "null", "[]", "{}")
    turns = trace.groupBy(session, turn).agg(
        F.coalesce(F.bool_or(F.endswith("event", F.lit(".end")) & truthy), F.lit(False)).alias("failed"),
        F.coalesce(F.bool_or(F.col("event") == "turn.start"), F.lit(False)).alias("started"),
        F.coalesce(F.bool_or(F.col("event") == "turn.end"), F.lit(False)).alias("ended"),
        F.min_by("response_ms", F.when((F.col("event") == "playback.end") & F.col("response_ms").isNotNull(), F.col(seq))).alias("ttfa_ms"),
    )
    bad = F.col("failed") | (F.col("started") & ~F.col("ended"))
    one = turns.agg(F.count("*").cast("double").alias("n_turns"), F.avg(bad.cast("double")).alias("error_rate"))
    one = one.withColumn("wer", F.lit(wer).cast("double")).unpivot([], ["n_turns", "error_rate", "wer"], "indicator", "value")
    first = quantiles(turns, "ttfa_ms", (50, 95)).select(F.col("p50").alias("ttfa_p50_ms"), F.col("p95").alias("ttfa_p95_ms"))
    return one.unionByName(first.unpivot([], ["ttfa_p50_ms", "ttfa_p95_ms"], "indicator", "value")).where("value is not null")


def burn_rate(value: Column, objective: Column, comparator: Column) -> Column:
    """1 is on target. Infinite where nothing may go wrong and something did."""
    inf = F.lit(float("inf"))
    below = F.when(objective == 0, F.when(value > 0, inf).otherwise(0.0)).otherwise(value / F.nullif(objective, F.lit(0.0)))
    allowed = F.lit(1.0) - objective
    above = F.when(allowed <= 0, F.when(value < objective, inf).otherwise(0.0)).otherwise((F.lit(1.0) - value) / F.nullif(allowed, F.lit(0.0)))
    return F.when(comparator == "<=", below).otherwise(above)


def error_budgets(objectives: DataFrame, values: DataFrame, elapsed_fraction: float = 1.0) -> DataFrame:
    """Each objective with its measured value, burn rate, consumed and remaining budget; nulls where nothing was measured."""
    joined = objectives.join(values.select("indicator", F.col("value").alias("measured")), "indicator", "left")
    joined = joined.withColumn("burn_rate", burn_rate(F.col("measured"), F.col("objective"), F.col("comparator")))
    joined = joined.withColumn("burn_rate", F.when(F.col("measured").isNotNull(), F.col("burn_rate")))
    consumed = F.col("burn_rate") * F.lit(float(elapsed_fraction))
    met = F.when(F.col("comparator") == "<=", F.col("measured") <= F.col("objective")).otherwise(F.col("measured") >= F.col("objective"))
    return joined.select("slo", "indicator", "objective", "measured", "burn_rate", consumed.alias("consumed"), (F.lit(1.0) - consumed).alias("remaining"), met.alias("met"))


def alert_rules(objectives: Sequence[Objective], exprs: dict[str, str], prefix: str = "Slo", group: str = "slo", rate_window: str = "5m", for_duration: str = "10m") -> str:
    """Alerting rules as YAML text: one alert an objective, firing where it is broken."""
    quote = lambda t: '"' + t.replace("\\", "\\\\").replace('"', '\\"') + '"'
    out = ["groups:", f"  - name: {group}", "    rules:"]
    for o in objectives:
        expr = exprs.get(o.indicator, o.indicator).replace("{w}", rate_window)
        name = prefix + "".join(p.capitalize() for p in o.name.replace("-", "_").split("_"))
        out += [
            f"      - alert: {name}",
            f"        expr: {quote(f'({expr}) ' + ('>' if o.comparator == '<=' else '<') + f' {o.objective}')}",
            f"        for: {for_duration}",
            "        labels:",
            "          severity: page",
            f"          slo: {o.name}",
            "        annotations:",
            f"          summary: {quote(f'{o.indicator} outside objective ({o.comparator} {o.objective}, window {o.window})')}",
            *([f"          description: {quote(o.description)}"] if o.description else []),
        ]
    return "\n".join(out) + "\n"


def counter(df: DataFrame, labels: Sequence[str], amount: Column | None = None) -> DataFrame:
    """Totals by labels; a negative amount raises."""
    amount = F.lit(1.0) if amount is None else amount.cast("double")
    checked = F.when(amount < 0, F.raise_error(F.lit("a counter cannot go down")).cast("double")).otherwise(amount)
    return df.groupBy(*labels).agg(F.sum(checked).alias("value"))


def gauge(df: DataFrame, labels: Sequence[str], value: str, order: str) -> DataFrame:
    """The last value by labels."""
    return df.groupBy(*labels).agg(F.max_by(value, order).alias("value"))


def histogram(df: DataFrame, labels: Sequence[str], value: str, buckets: Sequence[float] = BUCKETS_MS) -> DataFrame:
    """Cumulative buckets (``le``, +Inf last), with sum and count on every row. Null values are not observed."""
    if not buckets:
        raise ValueError("a histogram needs a bucket")
    edges = sorted(buckets)
    wide = df.where(F.col(value).isNotNull()).groupBy(*labels).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(edges)], F.sum(value).alias("sum"), F.count("*").alias("count"))
    cells = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(edges)]
    cells.append(F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("n")))
    return wide.select(*labels, "sum", "count", F.explode(F.array(*cells)).alias("c")).select(*labels, "c.le", F.col("c.n").alias("bucket_count"), "sum", "count")


def turn_metrics(turns: DataFrame, buckets: Sequence[float] = BUCKETS_MS) -> DataFrame:
    """The stage histogram of turns with ``stages``, a map of durations."""
    return histogram(turns.select(F.explode("stages").alias("stage", "ms")), ["stage"], "ms", buckets)


def round_stages(stages: Column, digits: int = 3) -> Column:
    """Durations rounded half to even."""
    return F.transform_values(stages, lambda k, v: F.bround(v, digits))


def histogram_quantile(hist: DataFrame, labels: Sequence[str], q: float) -> DataFrame:
    """The quantile that cumulative buckets suggest: linear inside the bucket that reaches its rank, the last finite edge beyond."""
    cells = F.array_sort(F.collect_list(F.struct("le", "bucket_count")))
    by = hist.groupBy(*labels).agg(cells.alias("cells"), F.max("bucket_count").alias("total"))
    rank = F.col("total") * F.lit(q)
    at = F.filter("cells", lambda c: c["bucket_count"] >= rank)[0]
    below = F.filter("cells", lambda c: c["bucket_count"] < rank)
    prev = F.when(F.size(below) > 0, F.element_at(below, -1))
    low, base = F.coalesce(prev["le"], F.lit(0.0)), F.coalesce(prev["bucket_count"], F.lit(0))
    inside = low + (at["le"] - low) * (rank - base) / F.nullif(at["bucket_count"] - base, F.lit(0))
    return by.select(*labels, F.when(at["le"] == float("inf"), low).otherwise(inside).alias("value"))


def number_text(value: Column) -> Column:
    """A number as metric text shows it: whole ones without a point."""
    whole = value == F.floor(value)
    return F.when(value == float("inf"), "+Inf").when(value == float("-inf"), "-Inf").when(whole, F.format_string("%d", value.cast("long"))).otherwise(value.cast("string"))


def label_text(*pairs: tuple[str, Column]) -> Column:
    escape = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    if not pairs:
        return F.lit("")
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'{k}="'), escape(v), F.lit('"')) for k, v in pairs]), F.lit("}"))


def exposition(hist: DataFrame, name: str, labels: Sequence[str]) -> DataFrame:
    """Lines of a histogram in the text format, with their order: buckets, sum, count of each label set."""
    own = [(c, F.col(c)) for c in sorted(labels)]
    key = F.struct(*[F.col(c) for c in sorted(labels)]) if labels else F.lit(0)
    buckets = hist.select(key.alias("k"), F.lit(0).alias("part"), "le", F.concat(F.lit(f"{name}_bucket"), label_text(*own, ("le", number_text(F.col("le")))), F.lit(" "), F.col("bucket_count").cast("string")).alias("line"))
    total = hist.where(F.col("le") == float("inf"))
    sums = total.select(key.alias("k"), F.lit(1).alias("part"), "le", F.concat(F.lit(f"{name}_sum"), label_text(*own), F.lit(" "), number_text(F.col("sum"))).alias("line"))
    counts = total.select(key.alias("k"), F.lit(2).alias("part"), "le", F.concat(F.lit(f"{name}_count"), label_text(*own), F.lit(" "), F.col("count").cast("string")).alias("line"))
    return buckets.unionByName(sums).unionByName(counts)


def exposition_values(values: DataFrame, name: str, labels: Sequence[str], kind: str, text: str) -> DataFrame:
    """Lines of a counter or gauge in the text format, with their order: help, type, then a line each label set. ``values`` has the labels and value."""
    head = values.sparkSession.createDataFrame([(0, "", f"# HELP {name} {text}"), (1, "", f"# TYPE {name} {kind}")], "part int, key string, line string")
    own = label_text(*[(c, F.col(c)) for c in sorted(labels)])
    return head.unionByName(values.select(F.lit(2).alias("part"), own.alias("key"), F.concat(F.lit(name), own, F.lit(" "), number_text(F.col("value").cast("double"))).alias("line")))


def sliding_ratio(df: DataFrame, ts: str, bad: Column, total: Column, window: str, slide: str, floor: float = 1e-9) -> DataFrame:
    """Bad over total in sliding windows, batch or stream: (window_end, bad, total, ratio)."""
    by = df.groupBy(F.window(ts, window, slide).alias("w")).agg(F.sum(bad.cast("long")).alias("bad"), F.sum(total.cast("long")).alias("total"))
    return by.select(F.col("w.end").alias("window_end"), "bad", "total", (F.col("bad") / F.greatest(F.col("total").cast("double"), F.lit(floor))).alias("ratio"))


def slide_counts(df: DataFrame, ts: str, bad: Column, total: Column, slide: str) -> DataFrame:
    """(at, bad, total) of tumbling buckets: the start of each in epoch seconds."""
    by = df.groupBy(F.window(ts, slide).alias("w")).agg(F.sum(bad.cast("long")).alias("bad"), F.sum(total.cast("long")).alias("total"))
    return by.select(F.unix_timestamp("w.start").alias("at"), "bad", "total")


def ratio_of_buckets(buckets: DataFrame, window_s: int, slide_s: int, floor: float = 1e-9) -> DataFrame:
    """The sliding ratio over buckets of the slide: (window_end, bad, total, ratio).

    Each bucket is counted into the windows that cover it: window over slide rows a bucket,
    not an event, so events are read and shuffled once whatever the windows.
    """
    covers = F.explode(F.transform(F.sequence(F.lit(1), F.lit(window_s // slide_s)), lambda i: F.col("at") + i * F.lit(slide_s)))
    by = buckets.select(covers.alias("end"), "bad", "total").groupBy("end").agg(F.sum("bad").alias("bad"), F.sum("total").alias("total"))
    return by.select(F.timestamp_seconds("end").alias("window_end"), "bad", "total", (F.col("bad") / F.greatest(F.col("total").cast("double"), F.lit(floor))).alias("ratio"))


def burn_alerts(df: DataFrame, ts: str, bad: Column, total: Column, slide_s: int = 300, budget: float = ERROR_BUDGET) -> DataFrame:
    """Window ends where both the long and the short window burn faster than their factor allows."""
    buckets = slide_counts(df, ts, bad, total, f"{slide_s} seconds")
    out = None
    for name, long, short, factor in BURN_ALERTS:
        a = ratio_of_buckets(buckets, long, slide_s).select("window_end", F.col("ratio").alias("long_ratio"))
        b = ratio_of_buckets(buckets, short, slide_s).select("window_end", F.col("ratio").alias("short_ratio"))
        hit = a.join(b, "window_end").where((F.col("long_ratio") > factor * budget) & (F.col("short_ratio") > factor * budget)).withColumn("burn", F.lit(name))
        out = hit if out is None else out.unionByName(hit)
    return out
