"""Bundles: files copied and hashed by the executors, and a manifest that makes them one."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registry as G
from ..session import ship_code
from .store import Store

#: Bytes of a file held at a time.
BLOCK = 1 << 20
FILE = "path string, sha256 string, size long"
_ARROW = pa.schema([("path", pa.string()), ("sha256", pa.string()), ("size", pa.int64())])


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that every executor can reach, and the folder's path in it."""
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _put(target: fs.FileSystem, to: str, blocks: Iterator[bytes]) -> tuple[str, int]:
    """Writes a file beside its place, moves it there, and gives its hash and size; a task that runs again replaces it."""
    aside = f"{to}.{uuid.uuid4().hex}.writing"
    target.create_dir(to.rsplit("/", 1)[0], recursive=True)
    digest, size = hashlib.sha256(), 0
    with target.open_output_stream(aside) as out:
        for block in blocks:
            out.write(block)
            digest.update(block)
            size += len(block)
    target.move(aside, to)
    return digest.hexdigest(), size


def _blocks(source: fs.FileSystem, at: str) -> Iterator[bytes]:
    with source.open_input_stream(at) as stream:
        while block := stream.read(BLOCK):
            yield block


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Writes files (path below the folder, content) and returns (path, sha256, size); each file is there whole or not at all.

    Paths name each file once. The result is a plan: it writes when it runs, and again when it runs again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = _opened(root)
        for batch in batches:
            # One content at a time leaves the batch.
            rows = [(p, *_put(target, f"{base}/{p}", iter([c.as_py() or b""]))) for p, c in zip(batch.column(0).to_pylist(), batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, _ARROW.types)], schema=_ARROW)

    ship_code(files.sparkSession)
    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, FILE)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256, size) of the files below a folder; contents are hashed block by block on the executors. Checksum files and half-written ones are left out."""
    return _walk(spark, root, None)


def _walk(spark: SparkSession, root: str, copy_to: str | None) -> DataFrame:
    """The folder's files, hashed, and copied if asked. Tasks list what is below its entries; contents never pass Spark's rows."""
    ship_code(spark)
    entries = spark.createDataFrame([(n,) for n in Store(spark, root).names()], "path string")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, base = _opened(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                info = source.get_file_info(f"{base}/{name}")
                found = [info] if info.type == fs.FileType.File else source.get_file_info(fs.FileSelector(f"{base}/{name}", recursive=True))
                names = [x.path[len(base) + 1 :] for x in found if x.type == fs.FileType.File and not x.path.endswith((".crc", ".writing"))]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["path"])

    cores = spark.sparkContext.defaultParallelism
    paths = entries.repartition(cores).mapInArrow(walk, "path string").repartition(cores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, base = _opened(root)
        for batch in batches:
            rows = []
            for p in batch.column(0).to_pylist():
                blocks = _blocks(source, f"{base}/{p}")
                if copy_to is None:
                    digest, size = hashlib.sha256(), 0
                    for block in blocks:
                        digest.update(block)
                        size += len(block)
                    rows.append((p, digest.hexdigest(), size))
                else:
                    target, there = _opened(copy_to)
                    rows.append((p, *_put(target, f"{there}/{p}", blocks)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, _ARROW.types)], schema=_ARROW)

    return paths.mapInArrow(run, FILE)


def write_bundle(spark: SparkSession, source: str, root: str, about: dict, required: list[str] | None = None) -> DataFrame:
    """Copies the files below ``source`` and writes the manifest last; returns its files (path, sha256, size).

    ``about`` is the bundle's name, version, lineage and policy, one small object. The list of
    files is a table beside it. A bundle without ``manifest.json`` was never finished;
    a finished one is not overwritten.
    """
    store = Store(spark, root)
    if "manifest.json" in store.names():
        raise FileExistsError(f"there is a bundle at {root}")
    folder = f"{root}/manifest-{uuid.uuid4().hex}"
    _walk(spark, source, f"{root}/files").write.json(folder)
    store.write("manifest.json", json.dumps(dict(about) | {"schema": 1, "files": folder.rsplit("/", 1)[1], "required": required}))
    return read_bundle(spark, root)[1]


def read_bundle(spark: SparkSession, root: str) -> tuple[dict, DataFrame]:
    """What a finished bundle says of itself, and its files (path, sha256, size)."""
    about = json.loads(Store(spark, root).read("manifest.json"))
    return about, spark.read.schema(FILE).json(f"{root}/{about['files']}")


def verify_bundle(spark: SparkSession, root: str, strict: bool = True) -> DataFrame:
    """(path, problem) of a bundle's files as they are now against its manifest; none if it is whole."""
    about, files = read_bundle(spark, root)
    required = files.select("path") if about["required"] is None else spark.createDataFrame([(p,) for p in about["required"]], "path string")
    return G.verify_files(files, listing(spark, f"{root}/files"), required, strict)
