"""Distribution drift between a reference and a current sample of each feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .positions import running_sums

PSI_LIMIT, KS_LIMIT, BINS, EPSILON = 0.2, 0.1, 10, 1e-4


def psi(samples: DataFrame, bins: int = BINS, epsilon: float = EPSILON) -> DataFrame:
    """Population stability index of each feature over equal-width bins across both samples.

    ``samples`` has feature, sample ('reference' or 'current') and value. Only features
    with rows in both appear. Counts are combined before the shuffle.
    """
    if bins < 1:
        raise ValueError("bins must be at least 1")
    rows = samples.where(F.col("value").isNotNull())
    ends = rows.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_if(F.col("sample") == "reference").alias("n_ref"), F.count_if(F.col("sample") == "current").alias("n_cur"))
    ends = ends.where("n_ref > 0 and n_cur > 0").withColumn("w", (F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise(F.col("hi") - F.col("lo"))) / bins)
    # As many rows as there are features; the planner broadcasts it where that is small.
    placed = rows.join(ends, "feature").withColumn("bin", F.least(F.greatest(F.floor((F.col("value") - F.col("lo")) / F.col("w")), F.lit(0)), F.lit(bins - 1)).cast("int"))
    counts = placed.groupBy("feature", "bin").agg(F.count_if(F.col("sample") == "reference").alias("e"), F.count_if(F.col("sample") == "current").alias("a"))
    cells = ends.select("feature", "n_ref", "n_cur", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).join(counts, ["feature", "bin"], "left")
    e = F.greatest(F.coalesce("e", F.lit(0)) / F.col("n_ref"), F.lit(epsilon))
    a = F.greatest(F.coalesce("a", F.lit(0)) / F.col("n_cur"), F.lit(epsilon))
    return cells.groupBy("feature").agg(F.sum((a - e) * F.ln(a / e)).alias("psi"))


def ks(samples: DataFrame) -> DataFrame:
    """Kolmogorov-Smirnov statistic of each feature: the largest gap of the two distribution functions.

    Equal values meet first; their running sums are made range by range, so a feature of any
    number of different values is spread over tasks.
    """
    rows = samples.where(F.col("value").isNotNull())
    per = rows.groupBy("feature", "value").agg(F.count_if(F.col("sample") == "reference").alias("r"), F.count_if(F.col("sample") == "current").alias("c"))
    run = running_sums(per, ["value"], ["feature"], {"below_r": "r", "below_c": "c"})
    # A row a feature; the last running sums are the totals.
    total = run.groupBy("feature").agg(F.max("below_r").alias("n_r"), F.max("below_c").alias("n_c")).where("n_r > 0 AND n_c > 0").withColumnRenamed("feature", "_feature")
    gap = F.abs(F.col("below_r") / F.col("n_r") - F.col("below_c") / F.col("n_c"))
    return run.join(total, F.col("feature").eqNullSafe(F.col("_feature"))).groupBy("feature").agg(F.max(gap).alias("ks"))


def drift_report(samples: DataFrame, psi_limit: float = PSI_LIMIT, ks_limit: float = KS_LIMIT, bins: int = BINS) -> DataFrame:
    """One row per feature of both samples: sizes, statistics, means, shift, whether and why it drifted."""
    ref, cur = F.col("sample") == "reference", F.col("sample") == "current"
    means = samples.where(F.col("value").isNotNull()).groupBy("feature").agg(
        F.count_if(ref).alias("n_reference"), F.count_if(cur).alias("n_current"), F.avg(F.when(ref, F.col("value"))).alias("mean_reference"), F.avg(F.when(cur, F.col("value"))).alias("mean_current")
    )
    report = psi(samples, bins).join(ks(samples), "feature").join(means, "feature")
    reasons = F.concat_ws(",", F.when(F.col("psi") > psi_limit, "psi"), F.when(F.col("ks") > ks_limit, "ks"))
    return report.withColumn("mean_shift", F.col("mean_current") - F.col("mean_reference")).withColumn("reasons", reasons).withColumn("drifted", F.col("reasons") != "")
