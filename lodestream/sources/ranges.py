"""Flat files in byte ranges, as a Spark data source: one large file is read by many tasks, and a stream follows files that grow.

    spark.dataSource.register(ByteRanges)
    spark.read.format("byte_ranges").option("path", folder).option("blockBytes", 1 << 20).load()

Rows are (file, at, data): `at` is the place of the first byte, blocks start at multiples of blockBytes, and only a file's last one is
shorter. A partition is a run of blocks of about partitionBytes. Paths are those that Arrow's file systems open (local, HDFS, S3, GCS).
The stream hands out whole blocks as files grow; the rest of a file comes when it is full, or at once with option tail = true.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at long, data binary"


class Run(InputPartition):
    """Bytes [start, end) of a file."""

    def __init__(self, file: str, start: int, end: int) -> None:
        self.file, self.start, self.end = file, start, end


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def sizes(path: str) -> dict[str, int]:
    """The files under a path with their bytes, without hidden ones."""
    fs, at = _fs(path)
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = fs.get_file_info(at)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return {head + f.path: f.size for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))}


def runs(file: str, start: int, end: int, step: int) -> list[Run]:
    return [Run(file, a, min(a + step, end)) for a in range(start, end, step)]


class _Blocks:
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.block = int(options.get("blockbytes", 1 << 20))
        self.step = max(self.block, int(options.get("partitionbytes", 64 << 20)) // self.block * self.block)
        self.tail = options.get("tail", "false").lower() == "true"

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        fs, at = _fs(run.file)
        with fs.open_input_file(at) as f:
            f.seek(run.start)
            for place in range(run.start, run.end, self.block):
                data = f.read(min(self.block, run.end - place))
                yield pa.RecordBatch.from_arrays([pa.array([run.file]), pa.array([place], pa.int64()), pa.array([data], pa.binary())], ["file", "at", "data"])


class Reader(_Blocks, DataSourceReader):
    def partitions(self) -> list[Run]:
        out = [r for file, size in sorted(sizes(self.path).items()) for r in runs(file, 0, size, self.step)]
        return out or [Run("", 0, 0)]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        return super().read(run) if run.file else iter(())


class StreamReader(_Blocks, DataSourceStreamReader):
    """Offsets are the bytes that were handed out of each file."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": json.dumps({f: n if self.tail else n // self.block * self.block for f, n in sizes(self.path).items()}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Run]:
        a, b = json.loads(start["files"]), json.loads(end["files"])
        return [r for f, n in sorted(b.items()) for r in runs(f, a.get(f, 0), n, self.step)] or [Run("", 0, 0)]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        return super().read(run) if run.file else iter(())

    def commit(self, end: dict) -> None:
        pass


class ByteRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:  # noqa: ANN001
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:  # noqa: ANN001, N802
        return StreamReader(self.options)
