"""Quantiles by selection equal sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstone.operators.positions import running_sums
from turnstone.operators.quantiles import quantiles


@pytest.mark.parametrize("limit", [1, 50, 200_000])
def test_any_distribution(spark, limit):
    rng = np.random.default_rng(limit)
    groups = {
        "normal": rng.normal(0, 5, 3000),
        "heavy": np.exp(rng.normal(0, 40, 2001)) * rng.choice([-1, 1], 2001),
        "ties": rng.choice([1.0, 1.0, 1.0, 2.0, -7.5], 2500),
        "near": 1.0 + rng.integers(0, 50, 1500) * 2.0**-52,
        "one": np.array([3.0]),
        "two": np.array([3.0, 4.0]),
        "huge": np.array([1.7e308, -1.7e308, 0.0, 5e-324, 1e300]),
        None: np.arange(777.0),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("normal", None), ("normal", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    ps = (0, 1, 37.5, 50, 95, 99.9, 100)
    got = {r.g: r for r in quantiles(df, "v", ps, ["g"], limit).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g].n == len(xs)
        s = np.sort(xs)
        for p in ps:
            k = (len(s) - 1) * (p / 100)
            lo, part = int(k), k - int(k)
            want = s[lo] if not part else (1 - part) * s[lo] + part * s[min(lo + 1, len(s) - 1)]
            assert got[g][f"p{p:g}"] == pytest.approx(want, rel=1e-12, abs=0), (g, p)


def test_no_groups_and_no_rows(spark):
    df = spark.range(1, 1002).select(F.col("id").cast("double").alias("v"))
    assert [tuple(r) for r in quantiles(df, "v", (50, 95), limit=10).collect()] == [(1001, 501.0, 951.0)]
    assert quantiles(df.limit(0), "v", (50,)).count() == 0


def test_a_large_group_is_narrowed_before_it_is_sorted(spark):
    df = spark.range(2_000_000).select((F.sin("id") * 1000).alias("v"))
    got = quantiles(df, "v", (50, 95), limit=5_000).first()
    want = df.agg(F.percentile("v", 0.5).alias("a"), F.percentile("v", 0.95).alias("b")).first()
    assert (got.p50, got.p95) == (pytest.approx(want.a, abs=1e-9), pytest.approx(want.b))


def test_running_sums(spark):
    n = 50_000
    df = spark.range(n).select((F.col("id") * 7 % n).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("g"), (F.col("id") % 5).alias("x"), F.lit(1).alias("one"))
    got = running_sums(df, ["k"], ["g"], {"sx": "x", "n": "one"}).toPandas().sort_values("k")
    by = got.groupby("g", dropna=False)
    assert len(got) == n and (by["x"].cumsum() == got["sx"]).all() and (by.cumcount() + 1 == got["n"]).all()
