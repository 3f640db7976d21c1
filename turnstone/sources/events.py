"""A source of JSON-line events of its own: batch scans in byte ranges, and streams with offsets.

``register(spark)``, then ``format("jsonl_events")`` with the options
``path`` (a folder or file that every executor can reach), ``per_batch`` (bytes of a
stream's batch), ``max_messages`` (ends the scan after so many lines) and ``objects_only``.
Rows are (file, value); see ``event_rows`` for columns.
"""

from __future__ import annotations

import io
import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..session import ship_code

#: Bytes of a partition, and of a batch of a stream unless ``per_batch`` says otherwise.
SPLIT, PER_BATCH = 32 << 20, 256 << 20


@dataclass
class Range(InputPartition):
    """The lines of a file that begin from byte ``start`` on and before ``end``."""

    file: str
    start: int
    end: int


def _lines(source: fs.FileSystem, at: Range) -> Iterator[bytes]:
    """Each line belongs to the range that holds its first byte, so ranges cut anywhere give every line once."""
    with io.BufferedReader(source.open_input_file(at.file)) as f:
        place = at.start
        if place:
            # The rest of a line that began before; a range that begins with a line finds its end one byte earlier.
            f.seek(place - 1)
            place += len(f.readline()) - 1
        while place < at.end:
            line = f.readline()
            if not line:
                return
            place += len(line)
            if line.strip():
                yield line.rstrip(b"\r\n")


class _Reader:
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("jsonl_events needs a path")
        self.path = options["path"]
        limit = options.get("max_messages")
        self.limit = None if limit is None else int(limit)
        self.per_batch = int(options.get("per_batch", PER_BATCH))
        self.objects_only = options.get("objects_only", "false").lower() == "true"

    def _opened(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if ":" in self.path.split("/")[0] else (fs.LocalFileSystem(), self.path)

    def _sizes(self) -> dict[str, int]:
        """The files and their sizes, in order of names; hidden ones are none."""
        source, at = self._opened()
        info = source.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else source.get_file_info(fs.FileSelector(at, recursive=True))
        return {x.path: x.size for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))}

    def _rows(self, ranges: list[Range]) -> Iterator[tuple[str, str]]:
        source, _ = self._opened()
        for r in ranges:
            for line in _lines(source, r):
                text = line.decode()
                if self.objects_only and not text.lstrip().startswith("{"):
                    raise ValueError(f"{r.file}: a line that is no object: {text[:80]}")
                yield r.file, text


@dataclass
class Ranges(InputPartition):
    ranges: list[Range]
    limit: int | None = None


def _cut(file: str, start: int, end: int) -> list[Range]:
    return [Range(file, a, min(end, a + SPLIT)) for a in range(start, end, SPLIT)]


class _Batch(_Reader, DataSourceReader):
    def partitions(self) -> list[Ranges]:
        every = [r for f, n in self._sizes().items() for r in _cut(f, 0, n)]
        # A bounded scan is one task that stops: how many lines the others hold isn't known.
        return [Ranges(every, self.limit)] if self.limit is not None else [Ranges([r]) for r in every]

    def read(self, partition: Ranges) -> Iterator[tuple[str, str]]:
        yield from islice(self._rows(partition.ranges), partition.limit)


class _Stream(_Reader, DataSourceStreamReader):
    """Offsets are the bytes of each file that were taken: always whole lines."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        if self.limit is not None:
            raise ValueError("max_messages bounds a batch scan, not a stream")
        self.at: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        left, out = self.per_batch, dict(self.at)
        source, _ = self._opened()
        for name, size in self._sizes().items():
            start = out.get(name, 0)
            if left <= 0 or size <= start:
                continue
            end = self._line_end(source, name, start, min(size, start + left), size)
            left -= end - start
            if end > start:
                out[name] = end
        self.at = out
        return out

    @staticmethod
    def _line_end(source: fs.FileSystem, name: str, start: int, want: int, size: int) -> int:
        """The end of the line that byte ``want - 1`` is in; a last line without its line feed is still being written."""
        with io.BufferedReader(source.open_input_file(name)) as f:
            f.seek(max(start, want - 1))
            rest = f.readline()
        end = max(start, want - 1) + len(rest)
        if rest.endswith(b"\n"):
            return end
        with source.open_input_file(name) as f:
            back = min(size - start, 1 << 20)
            f.seek(size - back)
            cut = f.read(back).rfind(b"\n")
        return start if cut < 0 else max(start, size - back + cut + 1)

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        self.at = {**self.at, **end}
        return [Ranges([r]) for f, b in end.items() for r in _cut(f, start.get(f, 0), b)]

    def read(self, partition: Ranges) -> Iterator[tuple[str, str]]:
        yield from self._rows(partition.ranges)

    def commit(self, end: dict) -> None:
        """Nothing to forget: files are never changed by readers."""


class JsonLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_events"

    def schema(self) -> str:
        return "file string, value string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session. Its code travels with it: the processes that plan a scan have no package of ours."""
    ship_code(spark)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(JsonLines)


def read_events(spark: SparkSession, path: str, schema: str, streaming: bool = False, **options: object) -> DataFrame:
    """The events of JSON-line files as columns, from this source; a stream has as many batches as ``per_batch`` bytes make."""
    register(spark)
    reader = (spark.readStream if streaming else spark.read).format("jsonl_events").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return event_rows(reader.load(), schema)


def event_rows(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of JSON values; a value that is no object of this form fails the query."""
    return rows.select(F.from_json(F.col("value").cast("string"), schema, {"mode": "FAILFAST"}).alias("v")).select("v.*")


def write_events(events: list[dict], path: str) -> None:
    """Events that are held in memory, as one file of the source; for tests and small replays."""
    source, at = _Reader({"path": path})._opened()
    source.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with source.open_output_stream(at) as out:
        out.write("".join(json.dumps(e) + "\n" for e in events).encode())
