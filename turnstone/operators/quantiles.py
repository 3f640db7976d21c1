"""Exact quantiles by selection: histograms narrow each rank down until few rows are left to sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_path

#: Rows of a rank's range that are sorted; larger ranges are cut into BINS first, PASSES times at most.
LIMIT, BINS, PASSES = 200_000, 1024, 8
#: Rows up to which the ranges travel to the values.
BROADCAST_ROWS = 100_000

_LARGEST = 1.7976931348623157e308


def _level(v: Column) -> Column:
    """Monotonic in v, and even over many orders of magnitude."""
    return F.signum(v) * F.ln(F.lit(1.0) + F.least(F.abs(v), F.lit(_LARGEST)) * 1e9)


def _share(v: Column, lo: Column, hi: Column) -> Column:
    """Where v is between lo and hi, 0 to 1; monotonic, and 0 where they are too near to tell apart."""
    return F.coalesce(F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2), F.lit(0.0))


def quantiles(rows: DataFrame, value: str, ps: Sequence[float], by: Sequence[str] = (), limit: int = LIMIT) -> DataFrame:
    """(by, n, p50, ...): exact, linearly interpolated percentiles ``ps`` (0 to 100) of each group's values.

    Each percentile is a rank. Values are counted into bins, combined before the shuffle; the
    bin that holds the rank is the next range, until a range has at most ``limit`` rows or one
    value: then its different values are sorted. So no task holds a group's values, however
    many they are. Null and NaN values don't count; groups without a value have no row, and
    null is a group. An empty table gives no rows.
    """
    spark = rows.sparkSession
    group = [f"_g{i}" for i in range(len(by))] or ["_g0"]
    keys = [F.col(f"`{c}`").alias(g) for c, g in zip(by, group)] or [F.lit(0).alias("_g0")]
    v = F.col(f"`{value}`").cast("double")
    path = scratch_path(spark, "quantiles")
    kept = rows.select(*keys, v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    kept.write.parquet(f"{path}/values")
    kept = spark.read.schema(kept.schema).parquet(f"{path}/values")

    ends = kept.groupBy(*group).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = (F.col("n") - 1) * F.col("q")
    ranks = ends.withColumn("q", F.explode(F.array(*[F.lit(float(p) / 100.0) for p in sorted(set(ps))])))
    # A range: values lo to hi, ``held`` rows after ``below`` others; ``left`` and ``right`` are the values at the rank and after it, once known.
    ranks = ranks.select(*group, "q", "n", F.floor(place).alias("k"), (place - F.floor(place)).alias("part"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("held"), F.lit(None).cast("double").alias("left"), F.lit(None).cast("double").alias("right"))

    def staged(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    def inside(ranges: DataFrame) -> DataFrame:
        """Each range's values."""
        few = ranges.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        other = ranges.select(*[F.col(g).alias(f"{g}r") for g in group], *[c for c in ranges.columns if c not in group])
        on = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
        for g in group:
            on = on & F.col(g).eqNullSafe(F.col(f"{g}r"))
        return kept.join(F.broadcast(other) if few else other, on)

    ranks = staged(ranks, "ranks0")
    wide = (F.col("held") > limit) & (F.col("lo") < F.col("hi")) & F.col("left").isNull()
    keep = [c for c in ranks.columns if c not in (*group, "q")]
    for step in range(1, PASSES + 1):
        if not ranks.where(wide).limit(1).count():
            break
        lo, hi = F.col("lo"), F.col("hi")
        share = _share(_level(F.col("v")), _level(lo), _level(hi)) if step == 1 else _share(F.col("v"), lo, hi)
        cell = F.least(F.floor(share * BINS), F.lit(BINS - 1))
        bins = inside(ranks.where(wide)).groupBy(*group, "q", cell.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"), *[F.first(c).alias(c) for c in keep])
        own = W.partitionBy(*group, "q").orderBy("bin")
        # A rank's bins, BINS rows at most, meet in this window.
        bins = bins.withColumn("start", F.col("below") + F.sum("c").over(own) - F.col("c")).withColumn("after", F.lead("a").over(own))
        found = bins.where((F.col("start") <= F.col("k")) & (F.col("k") < F.col("start") + F.col("c")))
        last = F.col("k") == F.col("start") + F.col("c") - 1
        found = found.withColumns({"lo": F.col("a"), "hi": F.col("b"), "below": F.col("start"), "held": F.col("c"), "left": F.when(last, F.col("b")), "right": F.when(last, F.coalesce("after", "b"))})
        ranks = staged(ranks.where(~wide).unionByName(found.select(*ranks.columns)), f"ranks{step}")

    known = F.col("left").isNotNull()
    few = inside(ranks.where(~known)).groupBy(*group, "q", "v").agg(F.count("*").alias("c"), *[F.first(c).alias(c) for c in ("n", "k", "part", "below")])
    upto = F.col("below") + F.sum("c").over(W.partitionBy(*group, "q").orderBy("v"))
    few = few.withColumn("upto", upto).groupBy(*group, "q").agg(
        F.first("n").alias("n"), F.first("part").alias("part"), F.min(F.when(F.col("upto") > F.col("k"), F.col("v"))).alias("left"), F.min(F.when(F.col("upto") > F.col("k") + 1, F.col("v"))).alias("right")
    )
    done = few.unionByName(ranks.where(known).select(*few.columns))
    at = F.when(F.col("part") > 0, (F.lit(1.0) - F.col("part")) * F.col("left") + F.col("part") * F.coalesce("right", "left")).otherwise(F.col("left"))
    out = done.groupBy(*group).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("q") == float(p) / 100.0, at)).alias(f"p{p:g}") for p in ps])
    return out.select(*[F.col(g).alias(c) for c, g in zip(by, group)], "n", *[F.col(f"`p{p:g}`") for p in ps])
