"""Spark sessions, and shipping this package to Python workers."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).parent


def get_session(app: str = "turnstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; further settings by keyword, dots as two underscores."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship_code(spark: SparkSession) -> None:
    """Sends this package's sources to the workers once a context, so that they need no installation."""
    context = spark.sparkContext
    if getattr(context, "_turnstone_shipped", False):
        return
    folder = tempfile.TemporaryDirectory()
    path = Path(folder.name) / "turnstone_src.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    context.addPyFile(str(path))
    # The context serves the archive to executors that come later; the folder goes with it.
    context._turnstone_shipped = folder


def spread(df: DataFrame) -> DataFrame:
    """A table whose scan gives fewer partitions than half the cores, dealt to all of them; any other stays as it is.

    A file of one row group is one task, however many cores there are. Large tables have
    more partitions than cores and get no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() > cores else df.repartition(cores)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; what is written there goes when the driver ends.

    The folder is the session's ``spark.checkpoint.dir``; only a local master may do without.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster needs spark.checkpoint.dir: executors must share scratch files")
    path = f"{(shared or '/tmp/checkpoints').rstrip('/')}/turnstone-{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def remove() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone before the driver's Python
            files.delete(target, True)

    atexit.register(remove)
    return path
