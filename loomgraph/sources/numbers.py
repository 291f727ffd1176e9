"""A data source of the numbers in a stretch of a binary file, read by several tasks as ranges of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that one task reads, and rows of a batch.
RANGE_BYTES, BATCH = 64 << 20, 1 << 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path names, and its path there; a plain path is a local one."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_bytes(path: str, first: int, size: int) -> bytes:
    """size bytes from first on, fewer at the end of the file."""
    system, at = opened(path)
    with system.open_input_file(at) as f:
        return f.read_at(size, first)


def file_size(path: str) -> int:
    system, at = opened(path)
    found = system.get_file_info(at)
    if found.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return found.size


class Stretch(InputPartition):
    """Places first to last - 1."""

    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.kind = options["path"], np.dtype(options["kind"])
        self.offset, self.count, self.bytes = int(options["offset"]), int(options["count"]), int(options["rangebytes"])

    def partitions(self) -> list[InputPartition]:
        each = max(1, self.bytes // self.kind.itemsize)
        return [Stretch(a, min(self.count, a + each)) for a in range(0, self.count, each)] or [Stretch(0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        size = self.kind.itemsize
        system, at = opened(self.path)
        with system.open_input_file(at) as f:
            for a in range(partition.first, partition.last, BATCH):
                n = min(BATCH, partition.last - a)
                raw = f.read_at(n * size, self.offset + a * size)
                if len(raw) < n * size:
                    raise ValueError(f"{self.path} ends before number {a + n}")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), pa.array(np.frombuffer(raw, self.kind).astype(np.int64))], ["at", "value"])


class Numbers(DataSource):
    """Rows (at, value): count numbers of a kind (a numpy type) from byte offset on; at counts from 0."""

    @classmethod
    def name(cls) -> str:
        return "binary_numbers"

    def schema(self) -> str:
        return "at long, value long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def numbers(spark: SparkSession, path: str, kind: str, count: int, offset: int = 0) -> DataFrame:
    """Rows (at, value) of a stretch of a file, whatever its size: each task reads RANGE_BYTES at most."""
    spark.dataSource.register(Numbers)
    return spark.read.format("binary_numbers").options(path=path, kind=kind, offset=offset, count=count, rangebytes=RANGE_BYTES).load()
