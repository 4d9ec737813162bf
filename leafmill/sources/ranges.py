"""Ranged reads: parts of large files without the rest, as a data source for Spark."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class Part(InputPartition):
    path: str
    start: int
    length: int
    size: int


class ByteRanges(DataSource):
    """Files under ``path`` as (path, n_bytes, start, content).

    Without options a row is a whole file. ``start`` and ``length`` choose a range (a negative start counts
    from the end); ``piece`` cuts each file into rows of so many bytes, each with ``overlap`` bytes of the next.
    Each row is read by one task with a seek; paths are those that pyarrow's file systems know.
    """

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, n_bytes long, start long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return RangeReader(self.options)


class RangeReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.suffix = options["path"], options.get("suffix", ".pdf")
        self.start, self.length = int(options.get("start", 0)), int(options.get("length", -1))
        self.piece, self.overlap = int(options.get("piece", 0)), int(options.get("overlap", 0))

    def partitions(self) -> list[Part]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        info = system.get_file_info(base)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=True))
        out = []
        for f in sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix)), key=lambda f: f.path):
            first = max(0, f.size + self.start) if self.start < 0 else min(self.start, f.size)
            last = f.size if self.length < 0 else min(f.size, first + self.length)
            step = self.piece or max(1, last - first)
            places = range(first, last, step) or [first]
            out += [Part(f.path, at, min(step + (self.overlap if self.piece else 0), last - at), f.size) for at in places]
        return out

    def read(self, part: Part) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        with system.open_input_file(part.path) as f:
            yield part.path, part.size, part.start, f.read_at(part.length, part.start)


def read_ranges(spark: SparkSession, path: str, **options: int | str) -> DataFrame:
    """``ByteRanges`` of a folder or file, with its options."""
    spark.dataSource.register(ByteRanges)
    reader = spark.read.format("byte_ranges").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()
