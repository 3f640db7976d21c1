"""Tables that streams write to: a keyed online table in buckets, and trace sinks that a repeated batch does not change."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import Store


class OnlineTable:
    """The last row of each key, in buckets of keys: a micro-batch rewrites the buckets that it touches, and no others.

    A manifest names the folder of each bucket and the last batch; it is swapped whole, so a
    reader sees all of a batch or nothing of it. A batch whose number is not above the last
    one's changes nothing. Folders that the latest manifests don't name are swept.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, schema: str | T.StructType, buckets: int = 64, keep: int = 2):
        """Opens a table or makes a new one; ``keep`` manifests back stay readable."""
        self.spark, self.store, self.key, self.keep = spark, Store(spark, root), key, max(1, keep)
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        held = self._manifest()
        self.buckets = held.get("buckets", buckets)

    def _manifest(self) -> dict:
        found = self.store.names("manifests")
        found = [n for n in found if n.endswith(".json")]
        return json.loads(self.store.read(f"manifests/{found[-1]}")) if found else {"version": 0, "batch": -1, "folders": {}}

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: dict[str, str]) -> DataFrame:
        """The rows of some buckets; each bucket is a folder of its own."""
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.store.root}/{f}" for f in folders.values()])

    def rows(self) -> DataFrame:
        """All rows, as the latest manifest has them."""
        return self._rows(self._manifest()["folders"])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of these keys; reads the keys' buckets only."""
        wanted = {str(r.b) for r in keys.select(self._bucket().alias("b")).distinct().collect()}
        held = {b: f for b, f in self._manifest()["folders"].items() if b in wanted}
        return self._rows(held).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def upsert(self, batch: DataFrame, batch_id: int, order: str) -> bool:
        """Puts a batch's last row of each key, by ``order``, in place of what was there; false for a batch that was in already. For ``foreachBatch``."""
        held = self._manifest()
        if batch_id <= held["batch"]:
            return False
        names = [f.name for f in self.schema.fields]
        newest = batch.groupBy(self.key).agg(F.max_by(F.struct(*names), order).alias("r")).select("r.*").withColumn("_b", self._bucket())
        folder = f"data/{held['version'] + 1:09}-{uuid.uuid4().hex}"
        # The batch's own rows are written first: they tell the buckets, and are read once more below.
        newest.write.parquet(f"{self.store.root}/{folder}/new")
        newest = self.spark.read.schema(newest.schema).parquet(f"{self.store.root}/{folder}/new")
        touched = sorted(str(r["_b"]) for r in newest.select("_b").distinct().collect())
        old = self._rows({b: f for b, f in held["folders"].items() if b in touched})
        merged = old.join(newest.select(self.key), self.key, "left_anti").withColumn("_b", self._bucket()).unionByName(newest)
        if touched:
            merged.repartition("_b").write.partitionBy("_b").parquet(f"{self.store.root}/{folder}/rows")
        self.store.delete(f"{folder}/new")
        folders = held["folders"] | {b: f"{folder}/rows/_b={b}" for b in touched}
        version = held["version"] + 1
        self.store.write(f"manifests/{version:09}.json", json.dumps({"version": version, "batch": batch_id, "buckets": self.buckets, "folders": folders}))
        self._sweep()
        return True

    def _sweep(self) -> None:
        """Deletes manifests beyond ``keep``, and bucket folders that none of the others names."""
        names = [n for n in self.store.names("manifests") if n.endswith(".json")]
        for name in names[: -self.keep]:
            self.store.delete(f"manifests/{name}")
        live: dict[str, set[str]] = {}
        for name in names[-self.keep :]:
            for f in json.loads(self.store.read(f"manifests/{name}"))["folders"].values():
                batch, _, bucket = f.removeprefix("data/").split("/")
                live.setdefault(batch, set()).add(bucket)
        for batch in self.store.names("data"):
            if batch not in live:
                self.store.delete(f"data/{batch}")
                continue
            for bucket in self.store.names(f"data/{batch}/rows"):
                if bucket.startswith("_b=") and bucket not in live[batch]:
                    self.store.delete(f"data/{batch}/rows/{bucket}")


def finished_spans(rows: DataFrame) -> DataFrame:
    """The exporter's form of trace rows: one span per ``.end`` row, named by its stage, with its attributes; other rows are not sent."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return rows.where(F.endswith("event", F.lit(".end"))).select(
        F.regexp_replace("event", r"\.end$", "").alias("name"),
        text("session").alias("session"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"),
        F.coalesce(F.col("ms").cast("double"), F.lit(0.0)).alias("ms"),
        text("span").alias("span"),
    )


def trace_sink(path: str, exporter: bool = False):
    """A foreachBatch function: trace rows as JSON lines, a folder a batch; ``exporter`` keeps ``.end`` rows in the exporter's form.

    A batch's folder is written under another name by tasks that commit one by one, and put in
    place when all have: a failed task or batch leaves no row, and a batch that is
    written again replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = finished_spans(batch) if exporter else batch
        rows.write.mode("overwrite").json(f"{path}/batch={batch_id:09}")

    return write
