"""A table as a stream: its rows in order, so many batches of several files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import number_rows



def replay(spark: SparkSession, rows: DataFrame, order: Sequence[str], batches: int, path: str, max_messages: int | None = None) -> DataFrame:
    """A stream of the rows, in ``batches`` micro-batches of about equal size by their places in ``order``.

    The rows are numbered and written once in their order, so that each batch reads its own
    part of them alone, and then batch by batch under ``path``, in a file for each core, of
    rows that follow each other; a file source takes one batch a trigger, oldest first, so a batch scan of ``path`` and the
    stream see the same rows. ``max_messages`` ends the stream after so many rows.
    """
    placed = number_rows(rows, order, column="_at", path=f"{path}/placed")
    placed.write.parquet(f"{path}/numbered")
    placed = rows.sparkSession.read.schema(placed.schema).parquet(f"{path}/numbered")
    n = placed.count() if max_messages is None else min(placed.count(), max_messages)
    size = max(1, -(-n // batches))
    files = min(spark.sparkContext.defaultParallelism, size)
    for i in range(max(1, -(-n // size))):
        low, high = i * size, min(n, (i + 1) * size)
        part = placed.where((F.col("_at") >= low) & (F.col("_at") < high))
        file = F.floor((F.col("_at") - low) * files / max(1, high - low)).cast("int")
        part.repartitionById(files, file).drop("_at").write.mode("append").parquet(f"{path}/rows")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/rows")
