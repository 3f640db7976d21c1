"""Evaluation: error rates, judges, win rates, DPO margins, release gates, regressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.udfs import align_words, digits_for_number_words
from .quantiles import quantiles

LOWER_IS_BETTER = ("wer", "cer", "error_rate", "ttfa_p50_ms", "ttfa_p95_ms")


def align(rows: DataFrame, ref: str = "ref", hyp: str = "hyp", numbers: bool = False) -> DataFrame:
    """Adds hits, substitutions, deletions, insertions, n_ref, n_hyp, wer, cer parts and exact."""
    r, h = X.normalise(F.col(ref)), X.normalise(F.col(hyp))
    if numbers:
        r, h = digits_for_number_words(r), digits_for_number_words(h)
    errors, n, m = X.cer_parts(F.col(ref), F.col(hyp))
    out = rows.withColumn("_a", align_words(r, h)).select(*rows.columns, "_a.*", errors.alias("char_errors"), n.alias("n_ref_chars"), m.alias("n_hyp_chars"))
    wrong = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    return out.withColumn("wer", X.error_rate(wrong, F.col("n_ref"), F.col("n_hyp"))).withColumn("exact", (wrong == 0) & (F.col("n_ref") == F.col("n_hyp")))


def corpus_wer(aligned: DataFrame, by: str | None = None) -> DataFrame:
    """Pooled rates over all rows, and over each value of ``by`` where given (null: all rows)."""
    wrong = F.sum(F.col("substitutions") + F.col("deletions") + F.col("insertions"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    aggs = [
        ratio(wrong, F.sum("n_ref")).alias("wer"),
        ratio(F.sum("char_errors"), F.sum("n_ref_chars")).alias("cer"),
        F.avg(F.col("exact").cast("double")).alias("exact_match"),
        *[F.sum(c).alias(c) for c in ("hits", "substitutions", "deletions", "insertions")],
        F.sum("n_ref").alias("n_ref_words"),
        F.count("*").alias("n"),
    ]
    return aligned.rollup(by).agg(*aggs) if by else aligned.agg(*aggs)


def exact_match_rate(rows: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    return rows.agg(F.avg(X.exact_match(F.col(ref), F.col(hyp)).cast("double")).alias("exact_match"), F.count("*").alias("n"))


def win_rate(rows: DataFrame, policy: str, reference: str) -> DataFrame:
    """Wins, ties, losses of two scores, and the rate with ties as half a win."""
    p, r = F.col(policy), F.col(reference)
    return rows.agg(F.count_if(p > r).alias("wins"), F.count_if(p == r).alias("ties"), F.count_if(p < r).alias("losses"), F.count("*").alias("n")).withColumn(
        "win_rate", F.coalesce((F.col("wins") + 0.5 * F.col("ties")) / F.nullif("n", F.lit(0)), F.lit(0.0))
    )


def dpo_margin(pc: Column, pr: Column, rc: Column, rr: Column, beta: float = 0.1) -> Column:
    return F.lit(beta) * ((pc - rc) - (pr - rr))


def dpo_loss(margin: Column) -> Column:
    """-log sigmoid(margin), without overflow."""
    return F.when(margin > -700, F.log1p(F.exp(-margin))).otherwise(-margin)


def dpo_stats(rows: DataFrame, margin: Column) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(margin.alias("m")).agg(F.count("*").alias("n"), zero(F.avg("m")).alias("mean_margin"), zero(F.avg((F.col("m") > 0).cast("double"))).alias("accuracy"), zero(F.avg(dpo_loss(F.col("m")))).alias("mean_loss"))


def violation_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.select(F.explode(X.spoken_style_violations(F.col(text))).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def violation_rate(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.agg(F.avg((F.size(X.spoken_style_violations(F.col(text))) > 0).cast("double")).alias("rate"), F.count("*").alias("n"))


def model_table(rows: DataFrame, model: str = "model", correct: Column | None = None, ms: str = "ms") -> DataFrame:
    """Correctness and exact latency percentiles of each model; no task holds a model's latencies."""
    ok = (correct if correct is not None else F.col("correct")).cast("long")
    table = rows.groupBy(F.col(model).alias("_model")).agg(F.count("*").alias("n"), F.sum(ok).alias("correct"), F.avg(ok).alias("accuracy"), F.avg(ms).alias("mean"))
    at = quantiles(rows, ms, (50, 95), [model]).drop("n")
    out = table.join(at, F.col("_model").eqNullSafe(F.col(model)), "left")
    return out.select(F.col("_model").alias(model), "n", "correct", "accuracy", "p50", "p95", "mean")


@dataclass(frozen=True)
class Gate:
    metric: str
    min: float | None = None
    max: float | None = None
    required: bool = True


def gates_from_config(config: dict) -> list[Gate]:
    return [Gate(str(g["metric"]), g.get("min"), g.get("max"), bool(g.get("required", True))) for g in config.get("gate", [])]


def gate_table(spark: SparkSession, gates: Sequence[Gate]) -> DataFrame:
    rows = [(g.metric, None if g.min is None else float(g.min), None if g.max is None else float(g.max), g.required) for g in gates]
    return spark.createDataFrame(rows, "metric string, min double, max double, required boolean")


def flatten_metrics(results: DataFrame, order: str = "ord") -> DataFrame:
    """(metric, value) from results (name, metrics map, order): each bare and as name.metric; later results win."""
    cells = results.select("name", F.col(order).alias("_o"), F.explode("metrics").alias("k", "v"))
    both = cells.select(F.col("k").alias("metric"), "v", "_o").unionByName(cells.select(F.concat_ws(".", "name", "k").alias("metric"), "v", "_o"))
    return both.groupBy("metric").agg(F.max_by("v", "_o").alias("value"))


def evaluate_gates(gates: DataFrame, metrics: DataFrame) -> DataFrame:
    """Each rule with its value, whether it passes and why not: missing, above or below. Bounds are inclusive."""
    j = gates.join(metrics.select("metric", "value"), "metric", "left")
    reason = F.when(F.col("value").isNull(), F.when(F.col("required"), "missing").otherwise("skipped")).when(F.col("value") > F.col("max"), "above").when(F.col("value") < F.col("min"), "below").otherwise("ok")
    return j.withColumn("reason", reason).withColumn("passed", F.col("reason").isin("ok", "skipped"))


def decision(evaluated: DataFrame) -> DataFrame:
    """One row: whether all pass; no rule at all passes."""
    return evaluated.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"), F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("failed"))


def no_regression(candidate: DataFrame, baseline: DataFrame, tolerance: float = 0.0, metrics: Sequence[str] | None = None, lower_is_better: Sequence[str] = LOWER_IS_BETTER) -> DataFrame:
    """Shared metrics (or the named ones) with delta and status: FAIL where it moved the worse way by over the tolerance, SKIP where one side lacks it."""
    c = candidate.select("metric", F.col("value").alias("candidate"))
    b = baseline.select("metric", F.col("value").alias("baseline"))
    j = c.join(b, "metric", "full" if metrics is not None else "inner")
    if metrics is not None:
        names = candidate.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
        j = names.join(j, "metric", "left")
    delta = F.col("candidate") - F.col("baseline")
    worse = F.when(F.col("metric").isin(*lower_is_better), delta > tolerance).otherwise(delta < -tolerance)
    return j.withColumn("delta", delta).withColumn("status", F.when(delta.isNull(), "SKIP").when(worse, "FAIL").otherwise("PASS"))


#: Kinds of training plans.
PLAN_KINDS = ("whisper-lora", "sft", "dpo")


def plan_problems(columns: Sequence[str]) -> Column:
    """Names of the fields that keep a row, a training plan, from starting; of the optional fields those that are there count."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    rules = {
        "kind": ~F.col("kind").isin(*PLAN_KINDS) | F.col("kind").isNull(),
        "base_model": blank("base_model"),
        "train": blank("train"),
        "output_dir": blank("output_dir"),
        "seed": F.col("seed").isNull() | (F.col("seed") < 0),
        "epochs": F.col("epochs") <= 0,
        "learning_rate": F.col("learning_rate") <= 0,
        "per_device_batch_size": F.col("per_device_batch_size") < 1,
        "gradient_accumulation": F.col("gradient_accumulation") < 1,
        "max_steps": F.col("max_steps") < 0,
        "beta": (F.col("kind") == "dpo") & (F.col("beta") <= 0),
    }
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items() if name in columns]))
