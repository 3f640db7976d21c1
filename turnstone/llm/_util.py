"""Shared plumbing: staged tables, stable hashing, skew-proof joins."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_code, spread

#: Used only on a local master whose session names no ``spark.checkpoint.dir`` (tests, laptops).
FALLBACK_DIR = "/tmp/checkpoints"

#: Files of a slim scratch table for each core of the cluster.
FILES_PER_CORE = 3

#: Rows up to which a table of short keys may be broadcast (tens of bytes a row).
BROADCAST_ROWS = 200_000

_open: list[Staging] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's own setting; only a local master may do without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster needs spark.checkpoint.dir: executors must share the scratch tables")
    return (found or FALLBACK_DIR).rstrip("/")


class Staging:
    """Scratch tables of one operator call, in the shared folder.

    A written table cuts the lineage, is computed once and outlives any executor. Results
    read from these tables, and so does whatever is made from a result; they stay until
    ``close``, the end of a ``scratch`` block around the call, or the driver's end.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship_code(spark)
        self.spark = spark
        self.path = f"{shared_dir(spark)}/turnstone-{name}-{uuid.uuid4().hex}"
        self._n = 0
        jvm = spark._jvm
        self._folder = jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        _open.append(self)

    def write(self, df: DataFrame, name: str = "t", slim: bool = False, codec: str | None = None) -> DataFrame:
        """Writes and rereads a table; ``slim`` ones (ids, keys and counts) get no more files than a few a core."""
        self._n += 1
        path = f"{self.path}/{self._n}-{name}"
        out = df.coalesce(FILES_PER_CORE * self.spark.sparkContext.defaultParallelism) if slim else df
        out.write.parquet(path, compression=codec)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._turnstone_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of this call that no later step reads."""
        self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(df._turnstone_path), True)

    def sweep(self) -> None:
        """Has Spark delete the shuffle files of finished steps now: it does so when the driver's JVM next collects its garbage.

        The last query's plan is held until another one runs, hence the small one.
        """
        gc.collect()
        self.spark.range(1).count()
        self.spark._jvm.System.gc()

    def close(self) -> None:
        """Deletes every table of this call, whoever still reads them."""
        if self in _open:
            _open.remove(self)
            self._files.delete(self._folder, True)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Closes at its end what operators called in the block have staged: for results that were written or collected inside it."""
    before = list(_open)
    try:
        yield
    finally:
        for s in [s for s in _open if s not in before]:
            s.close()


@atexit.register
def _close_all() -> None:
    for s in list(_open):
        with contextlib.suppress(Exception):  # the JVM may be gone before the driver's Python
            s.close()


def fresh(columns: Sequence[str], name: str) -> str:
    """A column name that none of the columns has, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def draw(seed: str, *parts: Column) -> Column:
    """A double in (0, 1) that depends only on seed and parts (52 bits of an md5)."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``limit`` rows; reads no more than that."""
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint, only where the row count is checked; else a shuffled join follows."""
    return F.broadcast(df) if small(df, limit) else df


def join_heavy(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, heavy: int = 1000) -> DataFrame:
    """Left join to a table with one row a key, where ``weight`` is the key's number of left rows.

    Keys of over 1/heavy of the left rows number under ``heavy``, whatever the size:
    these join by broadcast, so that no hot key meets in one task; the rest is shuffled.
    """
    bar = max(1, total // heavy)
    hot = right.where(F.col(weight) > bar).withColumn("_hot", F.lit(True))
    cold = right.where(F.col(weight) <= bar)
    first = left.join(F.broadcast(hot), on, "left")
    extra = [c for c in right.columns if c not in on]
    done = first.where(F.col("_hot").isNotNull()).drop("_hot")
    rest = first.where(F.col("_hot").isNull()).drop("_hot", *extra).join(cold, on, "left")
    return done.unionByName(rest)


def sliced(batches, rows: int = 1000):
    """Record batches cut to few rows, so that what is built from one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release_memory()


def release_memory() -> None:
    """Gives freed memory of a Python worker back: it lives on and shares its executor's limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_code(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
