"""Readers and writers: JSON lines, Parquet feature files, text folders, traces, Kafka."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.features import View, in_window

TRACE = "ts double, session string, turn int, event string, span string, seq int, ms double, payload string"
UTTERANCE = "id string, text string, audio_path string, speaker string, duration_s double, meta map<string,string>"


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, limit: int | None = None) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, a broken one fails the query."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df if limit is None else df.limit(limit)


def read_jsonl_checked(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, parsed, problem) of every line that isn't blank; broken lines don't stop the scan."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")
    parsed = F.from_json("line", schema)
    valid = F.try_parse_json("line")
    problem = F.when(valid.isNull(), "invalid JSON").when(F.schema_of_variant(valid).rlike("^OBJECT") == F.lit(False), "not an object")
    return lines.select("file", "line", parsed.alias("parsed"), problem.alias("problem"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_trace(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return trace_columns(reader.schema(TRACE).json(path))


def trace_columns(df: DataFrame) -> DataFrame:
    """The payload's fields that analytics read, as columns."""
    p = F.try_parse_json("payload")
    get = lambda f, t: F.try_variant_get(p, f"$.{f}", t)
    return df.withColumn("response_ms", get("response_ms", "double")).withColumn("intent", get("intent", "string")).withColumn("accent", get("accent", "string")).withColumn("error", get("error", "string"))


def read_kafka(spark: SparkSession, servers: str, topic: str, schema: str = TRACE, bounded: bool = False, fmt: str = "kafka", **options: str) -> DataFrame:
    """JSON values of a topic from its start: a stream, or what is there now. Needs Spark's Kafka package, or another source of ``value`` by ``fmt``."""
    reader = (spark.read if bounded else spark.readStream).format(fmt).option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load().select(F.from_json(F.col("value").cast("string"), schema).alias("v")).select("v.*")


def read_features(spark: SparkSession, path: str, view: View, start: float | None = None, end: float | None = None, fmt: str = "parquet") -> DataFrame:
    """A view's rows in a closed time range; columns that the files lack are null; the range reaches the scan."""
    return in_window(spark.read.schema(view.schema).format(fmt).load(path), start, end)


def append_features(df: DataFrame, path: str, view: View, fmt: str = "parquet") -> None:
    df.select(*view.schema.names).write.mode("append").format(fmt).save(path)


def read_texts(spark: SparkSession, root: str, include: str = "*", exclude: Sequence[str] = ()) -> DataFrame:
    """(id, text, sha, bytes, lines) of the UTF-8 files under a folder, by path below it; names in ``exclude`` hide folders."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", include).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/") + "/"), "^[a-z]+:/*", "/")
    plain = F.regexp_replace("path", "^[a-z]+:/*", "/")
    rel = F.substring(plain, F.length(base) + 1, F.length(plain))
    df = df.withColumn("id", rel)
    for name in exclude:
        df = df.where(~F.array_contains(F.split("id", "/"), name))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    n = F.size(F.split("text", "\n")) - F.when(F.endswith("text", F.lit("\n")) | (F.col("text") == ""), 1).otherwise(0)
    return df.select("id", text.alias("text"), F.sha2("content", 256).alias("sha"), F.col("length").alias("bytes")).where("text is not null").withColumn("lines", n)


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """Numbers between white space."""
    return spark.read.text(path).select(F.explode(F.filter(F.split("value", r"\s+"), lambda x: x != "")).alias("value")).select(F.col("value").cast("double").alias("value"))


def bundle_listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256, size) of the files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def read_manifests(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """(path, manifest, problem) of every JSON file of this name under a folder; one that can't be read is a row with a problem."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return df.select("path", F.from_json(text, schema).alias("manifest"), F.when(F.try_parse_json(text).isNull(), "invalid JSON").alias("problem"))


def load_config(path: str, env: dict[str, str] | None = None, prefix: str = "TURNSTONE_") -> dict:
    """A TOML file; variables PREFIX_A__B=value override a.b."""
    config = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    for k, v in sorted((env or {}).items()):
        if k.startswith(prefix):
            at = config
            *above, last = k[len(prefix) :].lower().split("__")
            for part in above:
                at = at.setdefault(part, {})
            try:
                at[last] = json.loads(v)
            except ValueError:
                at[last] = v
    return config


def merge_config(base: dict, other: dict) -> dict:
    """A deep copy of base with other's values over it."""
    out = {k: merge_config(v, {}) if isinstance(v, dict) else v for k, v in base.items()}
    for k, v in other.items():
        out[k] = merge_config(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


def save_index(tables: dict[str, DataFrame], path: str, dim: int) -> None:
    """The tables of a document index, and a manifest with the vectors' dimension."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(dim, sorted(tables))], "dim int, tables array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_index(spark: SparkSession, path: str, dim: int) -> dict[str, DataFrame]:
    """The tables of an index; another dimension is refused."""
    m = spark.read.schema("dim int, tables array<string>").json(f"{path}/manifest").first()
    if m is None or m.dim != dim:
        raise ValueError(f"the index at {path} has dimension {m.dim if m else None}, not {dim}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in m.tables}


def write_manifest(files: DataFrame, root: str) -> None:
    """A bundle's manifest: one JSON line a file (path, sha256, size), in order of paths, under the bundle's folder."""
    files.select("path", "sha256", "size").orderBy("path").write.mode("overwrite").json(f"{root}/manifest")


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("path string, sha256 string, size long").json(f"{root}/manifest")
