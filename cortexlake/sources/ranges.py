"""Files of fixed-size records as a source of ranges of them, and files of bytes as a sink.

A large file is read by as many tasks as it has ranges. A written file is made by one task from its parts in order, under a temporary name
that only the commit of the whole job turns into its own, so that a failed job leaves none.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a range, about.
RANGE = 1 << 26


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


@dataclass
class _Range(InputPartition):
    path: str
    first: int
    offset: int
    length: int


class _Ranges(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.header, self.record, self.size = (int(options.get(k, d)) for k, d in (("header", 0), ("record", 1), ("range", RANGE)))

    def partitions(self) -> list[InputPartition]:
        fs, root = _filesystem(self.path)
        there = fs.get_file_info(root)
        found = [there] if there.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        each, out = max(1, self.size // self.record), []
        for f in sorted((f for f in found if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern)), key=lambda f: f.path):
            n = max(f.size - self.header, 0) // self.record
            out += [_Range(f.path, k, self.header + k * self.record, min(each, n - k) * self.record) for k in range(0, n, each)]
        return out

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file has a record
            return
        fs, _ = _filesystem(self.path)
        with fs.open_input_file(partition.path) as f:
            head = f.read(self.header)
            f.seek(partition.offset)
            content = f.read(partition.length)
        yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([partition.first]), pa.array([head], pa.binary()), pa.array([content], pa.binary())], ["path", "first", "head", "content"])


class RecordRanges(DataSource):
    """``path, first, head, content``: whole records of ``record`` bytes after ``header`` bytes, from number ``first`` on; a last part of a record goes.

    Options: ``path`` (a file, or a folder with all below it), ``pattern`` of the files' names, ``header``, ``record``, and ``range``, the bytes of a range.
    """

    @classmethod
    def name(cls) -> str:
        return "record_ranges"

    def schema(self) -> str:
        return "path string, first long, head binary, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Ranges(dict(self.options))


def read_ranges(spark: SparkSession, path: str, pattern: str, record: int, header: int = 0, size: int = RANGE) -> DataFrame:
    spark.dataSource.register(RecordRanges)
    return spark.read.format("record_ranges").option("pattern", pattern).option("record", record).option("header", header).option("range", size).load(path)


@dataclass
class _Made(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.job = options["path"], f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _filesystem(self.path)
        task, made, out, now = uuid.uuid4().hex, [], None, None
        fs.create_dir(f"{root}/{self.job}/{task}", recursive=True)
        try:
            for b in iterator:
                for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist()):
                    if name != now:
                        if "/" in name or name in made:
                            raise ValueError(f"not the name of one file: {name!r}")
                        if out is not None:
                            out.close()
                        now, out = name, fs.open_output_stream(f"{root}/{self.job}/{task}/{name}")
                        made.append(name)
                    out.write(content)
        finally:
            if out is not None:
                out.close()
        return _Made([(f"{root}/{self.job}/{task}/{name}", f"{root}/{name}") for name in made])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _filesystem(self.path)
        for m in messages:
            for at, to in m.files if m is not None else ():
                if fs.get_file_info(to).type != pafs.FileType.NotFound:
                    fs.delete_file(to)
                fs.move(at, to)
        self._clean(fs, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean(*_filesystem(self.path))

    def _clean(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.job}")


class ByteFiles(DataSource):
    """A sink for rows ``name, content``: the contents of a name, which lie in one task in their order, are its file in the folder."""

    @classmethod
    def name(cls) -> str:
        return "byte_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def save_files(parts: DataFrame, path: str) -> None:
    """Writes ``name, part, content``: a file for each name, its parts joined in order. A file of that name is replaced once all are made."""
    parts.sparkSession.dataSource.register(ByteFiles)
    dealt = parts.select("name", "part", "content").repartition("name").sortWithinPartitions("name", "part")
    dealt.select("name", "content").write.format("byte_files").mode("append").save(path)
