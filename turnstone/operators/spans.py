"""Spans from the start and end rows of a trace: nesting, own time, errors, spans that never closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .positions import running_sums

KEY = ("session", "turn")


def spans(rows: DataFrame) -> DataFrame:
    """(session, turn, span, stage, parent, level, start_ts, ms, self_ms, error, closed) of trace rows.

    ``rows`` has session, turn, event (``<stage>.start`` or ``<stage>.end``), span (an id,
    the same on both rows), ts in seconds, error and _seq, which orders a turn's rows.
    A span lies in the innermost closed span that is open at its start; level 1 lies in none.
    ``self_ms`` is a span's time without its closed children's. A span without an end row
    has no times and holds no other; an end row without a start is passed over, and of
    repeated rows the first start and the last end count. Rows without session, turn or
    span make no span. Levels are running sums over a turn's points, range by range.
    """
    rows = rows.where(F.col("session").isNotNull() & F.col("turn").isNotNull() & F.col("span").isNotNull())
    started, ended = F.endswith("event", F.lit(".start")), F.endswith("event", F.lit(".end"))
    first, last = F.min_by, F.max_by
    seq = F.col("_seq")
    pairs = rows.where(started | ended).groupBy(*KEY, "span").agg(
        first(F.regexp_replace("event", r"\.(start|end)$", ""), seq).alias("stage"),
        F.min(F.when(started, seq)).alias("a"), F.max(F.when(ended, seq)).alias("b"),
        first("ts", F.when(started, seq)).alias("start_ts"), last("ts", F.when(ended, seq)).alias("end_ts"), last("error", F.when(ended, seq)).alias("error"),
    ).where("a is not null")
    closed = F.coalesce(F.col("b") > F.col("a"), F.lit(False))
    pairs = pairs.withColumn("closed", closed).withColumn("ms", F.when(closed, (F.col("end_ts") - F.col("start_ts")) * 1000)).withColumn("error", F.when(closed, F.col("error")))

    point = lambda at, step: F.struct(F.col(at).alias("at"), step.alias("step"))
    opens, closes = point("a", F.col("closed").cast("int")), F.when(F.col("closed"), point("b", F.lit(-1)))
    points = pairs.withColumn("p", F.explode(F.filter(F.array(opens, closes), lambda p: p.isNotNull()))).withColumns({"at": F.col("p.at"), "step": F.col("p.step")}).drop("p")
    deep = running_sums(points, ["at"], KEY, {"depth": "step"}).where(F.col("at") == F.col("a"))
    # An unclosed span opens nothing: it lies one below what is open around it.
    placed = deep.withColumn("level", F.col("depth") + F.when(F.col("closed"), 0).otherwise(1)).drop("depth", "at", "step")

    # The parent is the last span that closes, one level up, to have started before. Each span asks one level up and,
    # if it closes, stands at its own; rows are read once and carry their columns along, so nothing is joined back.
    place = lambda level, asks: F.struct(level.alias("at_level"), F.lit(asks).alias("asks"))
    both = F.filter(F.array(place(F.col("level") - 1, True), F.when(F.col("closed"), place(F.col("level"), False))), lambda p: p.isNotNull())
    before = W.partitionBy(*KEY, "at_level").orderBy("a").rowsBetween(W.unboundedPreceding, 0)
    asked = placed.withColumn("p", F.explode(both)).withColumns({"at_level": F.col("p.at_level"), "asks": F.col("p.asks")}).drop("p")
    out = asked.withColumn("parent", F.last(F.when(~F.col("asks"), F.col("span")), ignorenulls=True).over(before)).where("asks")
    # A span's row and its closed children's times meet in one grouping; times are summed up before the shuffle.
    own = F.struct("stage", "parent", "level", "start_ts", "ms", "error", "closed")
    node = lambda span, row, ms: F.struct(span.alias("span"), row.alias("own"), ms.alias("inner_ms"))
    nodes = F.array(node(F.col("span"), own, F.lit(None).cast("double")), F.when(F.col("closed") & F.col("parent").isNotNull(), node(F.col("parent"), F.lit(None), F.col("ms"))))
    out = out.select(*KEY, F.explode(F.filter(nodes, lambda x: x.isNotNull())).alias("n")).groupBy(*KEY, F.col("n.span").alias("span")).agg(F.max("n.own").alias("own"), F.sum("n.inner_ms").alias("inner_ms"))
    out = out.select(*KEY, "span", "own.*", "inner_ms")
    return out.select(*KEY, "span", "stage", "parent", "level", "start_ts", "ms", (F.col("ms") - F.coalesce("inner_ms", F.lit(0.0))).alias("self_ms"), "error", "closed")


def span_totals(found: DataFrame) -> DataFrame:
    """(stage, n, ms, self_ms, errors, unclosed): where time goes, stage by stage."""
    return found.groupBy("stage").agg(
        F.count("*").alias("n"), F.sum("ms").alias("ms"), F.sum("self_ms").alias("self_ms"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"), F.count_if(~F.col("closed")).alias("unclosed")
    )
