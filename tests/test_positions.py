"""Numbering by position on tables larger than a range sample."""

import pytest
from pyspark.sql import functions as F

from turnstone.operators import corpus as C
from turnstone.operators import positions
from turnstone.operators.positions import number_rows, zip_rows


@pytest.fixture(params=["true", "false"])
def wide(spark, request):
    """200 shuffle partitions, adaptive execution on and off; settings are put back."""
    new = {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.enabled": request.param}
    old = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def shuffled(spark, n):
    """Ids 0 to n-1 in a scattered order, with a wide column."""
    return spark.range(0, n, 1, 16).select((F.col("id") * 7_919 % n).alias("k"), F.repeat(F.lit("x"), 64).alias("pad"))


def test_every_row_gets_its_place(wide):
    n = 400_003
    got = number_rows(shuffled(wide, n), ["k"])
    assert got.agg(F.count("*"), F.count_if(F.col("at") != F.col("k"))).first() == (n, 0)


def test_places_within_groups_and_null_groups(wide):
    n = 120_000
    rows = wide.range(n).select((F.col("id") * 7 % n).alias("k"), F.when(F.col("id") % 3 > 0, (F.col("id") * 7 % n) % 2).alias("g"), F.lit(1).alias("_part"), F.lit(2).alias("_rid"))
    got = number_rows(rows, ["k"], ["g"]).toPandas()
    want = got.sort_values("k").groupby("g", dropna=False).cumcount().sort_index()
    assert len(got) == n and (got["at"] == want).all() and set(got.columns) == {"k", "g", "_part", "_rid", "at"}


def test_default_ids_keep_every_row(wide):
    n = 300_007
    rows = shuffled(wide, n).withColumn("id", F.when(F.col("k") % 5 == 0, F.lit("own")))
    got = C.default_ids(rows, "doc", "k")
    want = F.when(F.col("k") % 5 == 0, F.lit("own")).otherwise(F.format_string("doc-%06d", "k"))
    assert got.agg(F.count("*"), F.count_if(F.col("id") != want)).first() == (n, 0)


def test_zip_refuses_unequal_lengths(spark):
    a = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    b = spark.range(1000).select((F.col("id") + 5).alias("y"))
    got = zip_rows(a, b, ["x"], ["y"])
    assert got.count() == 1000 and got.where("x + 5 <> y").count() == 0
    with pytest.raises(ValueError, match="1000 and 999"):
        zip_rows(a, b.where("y > 5"), ["x"], ["y"])
    with pytest.raises(ValueError, match="both tables"):
        zip_rows(a, a, ["x"], ["x"])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k long, id string")
    assert number_rows(none, ["k"]).count() == 0 and C.default_ids(none, "doc", "k").count() == 0
    assert zip_rows(none, none.toDF("a", "b"), ["k"], ["a"]).count() == 0


@pytest.mark.parametrize("bits", [0, 2, 16])
def test_the_row_that_follows(spark, monkeypatch, bits):
    """Across blocks and ranges, within the groups alone, nulls as a value of their own."""
    monkeypatch.setattr(positions, "BLOCK_BITS", bits)
    rows = [(k, None if k % 5 == 0 else f"g{k % 3 * (k % 7 > 0)}", f"v{k}") for k in range(200)]
    df = spark.createDataFrame(rows, "k int, g string, v string").repartition(7)
    got = {r.k: (r.k2, r.v2) for r in positions.following_rows(df, ["k"], ["g"], {"k2": "k", "v2": "v"}).collect()}
    after = lambda k, g: next(((j, v) for j, h, v in rows if j > k and h == g), (None, None))
    assert got == {k: after(k, g) for k, g, _ in rows}
    assert positions.following_rows(df.limit(0), ["k"], ["g"], {"k2": "k"}).count() == 0
