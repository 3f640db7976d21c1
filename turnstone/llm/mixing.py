"""Mixing sources to target weights by Pareto order sampling.

Every document has an expected number of copies: its source's target over its source's
size, tilted by the document's weight (longer texts weigh more), at most MAX_REPEATS. The
whole part is certain. The fraction is an inclusion probability, which therefore differs
from document to document: documents are ranked by random odds over inclusion odds
(Pareto order sampling) and taken from the front until the words that the certain copies
leave open are filled. The rank is cut without sorting a source: a histogram of the
ranking value finds the bin that holds the cut, and only that bin's rows are sorted.
Nothing but numbers of rows reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.positions import number_rows, running_sums
from ._util import Staging, draw, join_heavy, read, small

MAX_REPEATS = 3
WEIGHTS = (5.0, 2.0, 1.0)
#: Words from which a document weighs one more: short ones carry less, and are repeated less or left out first.
STEPS = (16, 64, 256)
BINS = 4096

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def length_weight(size: Column) -> Column:
    """1 to 4, by the document's words."""
    weight = F.lit(1.0)
    for n in STEPS:
        weight = weight + F.when(size >= n, 1.0).otherwise(0.0)
    return weight


def _filled(cells: DataFrame, by: list[str], order: list[str], weight: str, size: str, budget: Column) -> DataFrame:
    """Adds ``unit``: a cell's share of the budget is weight times unit, but at most MAX_REPEATS times its size.

    Cells are full in order of the unit at which they are; the unit is what the others
    leave, over the weights still open. Null where every cell of a group is full. A group's
    cells, a handful of weights, meet in a window; without groups, cells of any number
    are summed range by range.
    """
    tried = cells.where(F.col(weight) > 0).withColumn("_full", F.col(size) * float(MAX_REPEATS) / F.col(weight)).withColumn("_cap", F.col(size) * float(MAX_REPEATS))
    unit = F.min_by("_unit", "_full").alias("unit")
    if by:
        w = W.partitionBy(*by).orderBy("_full", *order)
        before = F.coalesce(F.sum("_cap").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        tried = tried.withColumn("_unit", (budget - before) / F.sum(weight).over(w.rowsBetween(0, W.unboundedFollowing)))
    else:
        tried = running_sums(tried, ["_full", *order], [], {"_caps": "_cap", "_weights": weight})
        total = tried.agg(F.max("_weights").alias("w")).first().w
        before, open_ = F.col("_caps") - F.col("_cap"), F.lit(total) - F.col("_weights") + F.col(weight)
        tried = tried.withColumn("_unit", (budget - before) / open_)
    return tried.where(F.col("_unit") <= F.col("_full")).groupBy(*by).agg(unit)


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))


def targets(cells: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """(key, source_size, target): sources in code-point order, null last, weigh ``weights`` in turn and share all words.

    Sources are numbered and summed range by range, as there may be one for each web host.
    """
    sizes = cells.groupBy("key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    sizes = number_rows(sizes.withColumn("last", F.col("source").isNull()), ["last", "source"], column="at")
    total = sizes.agg(F.sum("source_size").alias("n")).first().n
    sizes = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("at") % len(weights) + 1).cast("int")))
    sizes = sizes.withColumn("budget", F.lit(float(total or 0)))
    unit = _filled(sizes, [], ["at"], "weight", "source_size", F.col("budget")).first()
    share = F.lit(unit.unit) * F.col("weight") if unit and unit.unit is not None else F.lit(float("inf"))
    return sizes.select("key", "source_size", F.least(F.col("source_size") * float(MAX_REPEATS), share).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, seed: str = "mix", doc_weight: Column | None = None, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame, Staging]:
    """(every row: id, source, size, u, w, key; decisions of every source and weight; scratch tables).

    Decisions: key, w, n, source_size, target, expected, edge, last. A row takes the whole
    part of ``expected`` as certain copies, and one more if its ranking value lies in a bin
    before ``edge`` or is at most ``last`` (see ``copies_of``). A document weighs by its
    length, or ``doc_weight`` (few different values; null and negative ones count as 0 and
    are never taken). Draws depend on seed, id and text, so reruns agree; rows equal in id
    and text share one draw and are taken together. Null text has no words. Other columns
    are ignored; an empty table gives empty results.
    """
    scope = Staging(docs.sparkSession, "mix")
    slim = scope.write(row_draws(docs, seed, doc_weight, id_col), "rows", slim=True)
    cells = scope.write(slim.groupBy("key", "w").agg(F.min("source").alias("source"), F.sum("size").alias("size"), F.count("*").alias("n")), "cells", slim=True)
    goal = scope.write(targets(cells, weights), "targets", slim=True)
    within = cells.join(goal, "key").withColumn("share", F.col("w") * F.col("size"))
    units = _filled(within, ["key"], ["w"], "share", "size", F.col("target"))
    expected = F.least(F.lit(float(MAX_REPEATS)), F.col("w") * F.coalesce("unit", F.lit(float("inf"))))
    plan = scope.write(within.join(units, "key", "left").select("key", "w", "n", "source_size", "target", F.when(F.col("w") > 0, expected).otherwise(0.0).alias("expected")), "plan", slim=True)

    ranked = _ranked(slim, plan)
    sums = scope.write(ranked.groupBy("key", "bin").agg(F.sum("size").alias("words"), F.sum(F.col("certain") * F.col("size")).alias("sure"), F.min("target").alias("target")), "bins", slim=True)
    # At most BINS rows a source meet in a window, whatever its documents number.
    upto = F.sum("words").over(W.partitionBy("key").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    run = sums.withColumn("sure", F.sum("sure").over(W.partitionBy("key"))).where("bin is not null").withColumn("upto", upto)
    run = run.withColumn("rest", F.col("target") - F.col("sure") - (F.col("upto") - F.col("words")))
    inside = (F.col("rest") > 0) & (F.col("rest") <= F.col("words"))
    found = run.groupBy("key").agg(F.min("rest").alias("past"), F.max(F.when(inside, F.col("bin"))).alias("edge"), F.max(F.when(inside, F.col("rest"))).alias("rest"))
    # No bin holds the cut: every open row is taken, or none.
    edges = scope.write(found.select("key", F.coalesce("edge", F.when(F.col("past") > 0, BINS + 1).otherwise(0)).cast("int").alias("edge"), "rest"), "edges", slim=True)
    at = edges.where("rest is not null")
    at = F.broadcast(at) if small(at) else at
    rows = ranked.select("key", "bin", "v", "size").join(at.withColumnRenamed("edge", "bin"), ["key", "bin"])
    # Rows of one draw are taken together: one row a draw, and the words up to it.
    drawn = rows.groupBy("key", "v", "rest").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(W.partitionBy("key").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    before = F.col("upto") - F.col("size")
    nearer = (F.col("upto") <= F.col("rest")) | ((before < F.col("rest")) & (F.col("upto") - F.col("rest") <= F.col("rest") - before))
    last = drawn.withColumn("upto", upto).where(nearer).groupBy("key").agg(F.max("v").alias("last"))
    decisions = plan.join(edges.drop("rest"), "key", "left").join(last, "key", "left")
    decisions = decisions.withColumn("edge", F.coalesce("edge", F.lit(0))).withColumn("last", F.coalesce("last", F.lit(-1.0)))
    return slim, scope.write(decisions, "decisions", slim=True), scope


def row_draws(docs: DataFrame, seed: str, doc_weight: Column | None, id_col: str, *keep: Column) -> DataFrame:
    size = word_count(F.col("text"))
    w = length_weight(size) if doc_weight is None else F.greatest(F.coalesce(doc_weight.cast("double"), F.lit(0.0)), F.lit(0.0))
    source = F.col("source").cast("string")
    return docs.select(F.col(id_col).alias("id"), source.alias("source"), size.alias("size"), draw(seed, F.col(id_col), F.md5("text")).alias("u"), w.alias("w"), _key(source).alias("key"), *keep)


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds what the plan says of a row's source and weight, certain copies, and v in (0, 1): Q / (1 + Q) of the Pareto ranking value Q, with its bin; null where nothing is open."""
    joined = rows.join(F.broadcast(plan.drop("n")), ["key", "w"], "left") if small(plan) else join_heavy(rows, plan, ["key", "w"], "n", rows.count()).drop("n")
    share = F.col("expected") - F.col("certain")
    ranked = joined.withColumn("certain", F.floor(F.col("expected") + F.lit(1e-9))).withColumn("lambda", F.when(share > 1e-9, share))
    ranked = ranked.withColumn("v", F.expr("u * (1 - lambda) / (u * (1 - lambda) + lambda * (1 - u))"))
    return ranked.withColumn("bin", F.floor(F.col("v") * BINS).cast("int"))


def copies_of(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds copies (0 to 3), source_size and target to rows that have key, u and w."""
    one_more = (F.col("bin") < F.col("edge")) | (F.col("v") <= F.col("last"))
    return _ranked(rows, decisions).withColumn("copies", (F.col("certain") + F.when(one_more, 1).otherwise(0)).cast("int"))


def mix_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The mixed documents: each row repeated as often as the mix takes it, with the columns it had, whatever their names.

    Nulls, ties, repeated rows, long texts and empty tables are as in ``mix``; a document
    without words is taken as its expected copies say, and fills nothing.
    """
    _, decisions, _ = mix(docs, **options)
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    rows = row_draws(docs, options.get("seed", "mix"), options.get("doc_weight"), options.get("id_col", "doc_id"), whole)
    taken = copies_of(rows, decisions).where("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, decisions, _ = mix(read(spark, sf_dir, "documents"))
    out = copies_of(rows, decisions)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "source")


#: Water filling in closed form, over sources and then over the weights within a source; then Pareto order within a source.
ORACLE = {
    "op1_mixing": """
WITH b AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '~') || ':' || coalesce(md5(text), '~')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
d AS (SELECT *, 1.0::DOUBLE + (size >= 16)::INT + (size >= 64)::INT + (size >= 256)::INT AS w FROM b),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
c AS (SELECT *, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM s),
r AS (SELECT *, source_size * 3.0::DOUBLE / weight AS full_at,
        (budget - coalesce(sum(source_size * 3.0::DOUBLE) OVER (ORDER BY source_size * 3.0::DOUBLE / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY source_size * 3.0::DOUBLE / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM c),
t AS (SELECT source, source_size, least(source_size * 3.0::DOUBLE, coalesce((SELECT arg_min(unit, full_at) FROM r WHERE unit <= full_at), 'inf'::DOUBLE) * weight) AS target FROM r),
g AS (SELECT d.source, w, sum(size) AS words, w * sum(size) AS share FROM d GROUP BY d.source, w),
h AS (SELECT g.*, t.target, words * 3.0::DOUBLE / share AS full_at,
        (t.target - coalesce(sum(words * 3.0::DOUBLE) OVER (PARTITION BY g.source ORDER BY words * 3.0::DOUBLE / share, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(share) OVER (PARTITION BY g.source ORDER BY words * 3.0::DOUBLE / share, w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit
      FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source WHERE share > 0),
q AS (SELECT source, arg_min(unit, full_at) AS unit FROM h WHERE unit <= full_at GROUP BY source),
e AS (SELECT doc_id, d.source, size, u, source_size, target, least(3.0::DOUBLE, w * coalesce(q.unit, 'inf'::DOUBLE)) AS expected
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN q ON d.source IS NOT DISTINCT FROM q.source),
f AS (SELECT *, floor(expected + 0.000000001::DOUBLE) AS certain FROM e),
v AS (SELECT *, CASE WHEN expected - certain > 0.000000001::DOUBLE THEN u * (1 - (expected - certain)) / (u * (1 - (expected - certain)) + (expected - certain) * (1 - u)) END AS v,
             target - sum(certain * size) OVER (PARTITION BY source) AS rest FROM f),
o AS (SELECT *, CASE WHEN v IS NOT NULL THEN sum(size) OVER (PARTITION BY source, v IS NULL ORDER BY v RANGE UNBOUNDED PRECEDING) END AS upto, sum(size) OVER (PARTITION BY source, v) AS own FROM v),
k AS (SELECT *, certain + CASE WHEN v IS NOT NULL AND rest > 0 AND (upto <= rest OR upto - own < rest AND upto - rest <= rest - (upto - own)) THEN 1 ELSE 0 END AS n FROM o)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(n * size AS BIGINT) AS taken, CAST(n AS INTEGER) AS copies, source FROM k
"""
}
QUERIES = {"op1_mixing": op1_mixing}
