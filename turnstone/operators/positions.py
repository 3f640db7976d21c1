"""Numbering by position: the place of each row in an order, over any number of partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_path

#: Ranges that are numbered by a broadcast join; more are joined by a shuffle.
BROADCAST_RANGES = 100_000
#: Rows of a range, as a power of two, that meet in one window to see the row after each.
BLOCK_BITS = 16


def free_name(columns: Sequence[str], name: str) -> str:
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _placed(rows: DataFrame, order: Sequence[str], by: Sequence[str], path: str | None) -> tuple[DataFrame, str]:
    """The rows dealt by range, sorted and written, with the column of their range and place in it."""
    spark = rows.sparkSession
    path = path or scratch_path(spark, "positions")
    rid = free_name(rows.columns, "_rid")
    keys = [F.col(f"`{c}`") for c in (*by, *order)]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(rid, F.monotonically_increasing_id())
    placed.write.parquet(path)
    return spark.read.schema(placed.schema).parquet(path), rid


def _with_starts(placed: DataFrame, by: Sequence[str], part: str, totals: Sequence[Column], starts: Sequence[tuple[str, Column]]) -> DataFrame:
    """Adds to each row what comes before its range in its group: running sums over one row a range and group."""
    runs = placed.groupBy(*by, part).agg(*totals)
    # One row a range and group meets in these windows, whatever the number of rows.
    before = W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    found = runs.select(*by, F.col(part).alias("_p"), *[c.alias(n) if n.startswith("_at") else F.coalesce(c.over(before), F.lit(0)).alias(n) for n, c in starts])
    if found.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES:
        found = F.broadcast(found)
    same = [f"_by{i}" for i in range(len(by))]
    found = found.select("_p", *[n for n, _ in starts], *[F.col(f"`{b}`").alias(s) for b, s in zip(by, same)])
    on = F.col(part) == F.col("_p")
    for b, s in zip(by, same):
        on = on & F.col(f"`{b}`").eqNullSafe(F.col(s))
    return placed.join(found, on)


def number_rows(rows: DataFrame, order: Sequence[str], by: Sequence[str] = (), column: str = "at", path: str | None = None) -> DataFrame:
    """Adds ``column``: the 0-based place of each row in ``order``, within equal ``by`` columns (null is a value of its own).

    The rows are dealt by range and sorted once, and written with their place in their
    range to ``path`` (by default in the shared scratch folder). Counts and numbers both
    come from that table, so they cannot disagree, whatever a second run of the same plan
    would deal out. The rows before each range are a running sum over one row a range and
    group. Nulls come first; rows that tie in ``order`` are numbered in any order, and
    should be few, as they share a range. An empty table stays empty; a column of the same
    name is replaced.
    """
    rows = rows.drop(column)
    placed, rid = _placed(rows, order, by, path)
    part, first, start = (free_name(rows.columns, n) for n in ("_part", "_at_first", "_start"))
    placed = placed.withColumn(part, F.shiftright(rid, 33))
    found = _with_starts(placed, by, part, [F.count("*").alias("_n"), F.min(rid).alias("_first")], [(first, F.col("_first")), (start, F.sum("_n"))])
    place = (F.col(rid) - F.col(first) + F.col(start)).cast("long")
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], place.alias(column))


def running_sums(rows: DataFrame, order: Sequence[str], by: Sequence[str], sums: dict[str, str], path: str | None = None) -> DataFrame:
    """Adds the running sums of columns (name of the sum: column) up to and with each row in ``order``, within ``by``.

    As in ``number_rows``: ranges are summed side by side, and what comes before a range is
    added. Rows that tie in ``order`` are summed in any order; null counts as 0.
    """
    placed, rid = _placed(rows, order, by, path)
    part = free_name(rows.columns, "_part")
    placed = placed.withColumn(part, F.shiftright(rid, 33))
    names = {s: free_name(rows.columns, f"_before_{i}") for i, s in enumerate(sums)}
    found = _with_starts(placed, by, part, [F.sum(f"`{c}`").alias(f"_s{i}") for i, c in enumerate(sums.values())], [(n, F.sum(f"_s{i}")) for i, n in enumerate(names.values())])
    # A window is a range's rows of one group.
    inside = W.partitionBy(*by, part).orderBy(rid).rowsBetween(W.unboundedPreceding, 0)
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], *[(F.coalesce(F.sum(f"`{c}`").over(inside), F.lit(0)) + F.col(names[s])).alias(s) for s, c in sums.items()])


def following_rows(rows: DataFrame, order: Sequence[str], by: Sequence[str], names: dict[str, str], path: str | None = None) -> DataFrame:
    """Adds columns (name: column) of the row that comes next in ``order`` within equal ``by`` columns, null after the last.

    As in ``number_rows``, the rows are dealt by range and written once; ranges are cut into
    blocks of 2**BLOCK_BITS rows, whose first rows, one a block, complete the block before.
    Rows that tie in ``order`` follow each other in any order.
    """
    placed, rid = _placed(rows, order, by, path)
    block, after = free_name(rows.columns, "_block"), free_name(rows.columns, "_after")
    row = F.struct(*[F.col(f"`{b}`").alias(f"_by{i}") for i, b in enumerate(by)], *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names.values())])
    at = F.shiftright(rid, BLOCK_BITS)
    first = placed.where(F.col(rid) == F.shiftleft(at, BLOCK_BITS)).select(at.alias("_b"), row.alias("_row"))
    # One row a block meets in this window, whatever the number of rows.
    first = first.select("_b", F.lead("_row").over(W.orderBy("_b")).alias("_first"))
    if first.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES:
        first = F.broadcast(first)
    inside = placed.withColumn(block, at).withColumn(after, F.lead(row).over(W.partitionBy(block).orderBy(rid)))
    found = inside.join(first, F.col(block) == F.col("_b"), "left").withColumn(after, F.coalesce(after, "_first"))
    same = F.col(after).isNotNull()
    for i, b in enumerate(by):
        same = same & F.col(f"`{b}`").eqNullSafe(F.col(after)[f"_by{i}"])
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.when(same, F.col(after)[f"_c{i}"]).alias(n) for i, n in enumerate(names)])


def zip_rows(a: DataFrame, b: DataFrame, order_a: Sequence[str], order_b: Sequence[str], column: str = "at") -> DataFrame:
    """The rows of two tables side by side, by their places in their orders; tables of unequal length are refused.

    Columns must have different names. Two empty tables give an empty one.
    """
    clash = {c.lower() for c in a.columns} & {c.lower() for c in b.columns} - {column.lower()}
    if clash:
        raise ValueError(f"columns of both tables: {sorted(clash)}")
    left, right = number_rows(a, order_a, column=column), number_rows(b, order_b, column=column)
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"tables of {n} and {m} rows cannot be zipped")
    return left.join(right, column)

