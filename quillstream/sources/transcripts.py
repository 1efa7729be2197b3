"""A data source of whole text files: ``spark.read.format("transcripts")`` and its stream.

Files under a folder, at any depth, are listed on the driver (names, times and sizes only) and dealt out in groups of
about ``groupBytes`` and at most ``groupFiles``; each group is a partition whose task opens its files and hands their texts on in
batches of a few MB. Parsers for every format follow as DataFrame operators, see ``segments``.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, modified timestamp, size long, text string"
ARROW = pa.schema([("path", pa.string()), ("modified", pa.timestamp("us", "UTC")), ("size", pa.int64()), ("text", pa.string())])
NAME = "transcripts"
#: Bytes of the files of a batch, about.
BATCH_BYTES = 4 << 20


@dataclass(frozen=True, slots=True)
class File:
    """A file by its place in the order of arrival: time of the last change (microseconds), then path."""

    modified: int
    path: str
    size: int


@dataclass
class Group(InputPartition):
    """Files that one task reads."""

    files: tuple[File, ...]


def opened(root: str) -> tuple[Any, str]:
    """File system and path of a folder: local, or of any scheme that Arrow knows."""
    from pyarrow import fs

    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), root.rstrip("/")
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root[5:].strip("/")
    system, path = fs.FileSystem.from_uri(root)
    return system, path.rstrip("/")


def listed(root: str, glob: str) -> list[File]:
    """All files whose name matches, in order of arrival, with paths from the folder; hidden ones are left out."""
    from pyarrow import fs

    system, base = opened(root)
    found = []
    for info in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
        path = info.path[len(base) + 1 :]
        if info.type == fs.FileType.File and fnmatch.fnmatch(info.base_name, glob) and not any(p[:1] in "._" for p in path.split("/")):
            found.append(File((info.mtime_ns or 0) // 1000, path, info.size))
    return sorted(found, key=lambda f: (f.modified, f.path))


def grouped(files: list[File], size: int, count: int) -> list[Group]:
    """Neighbours together up to so many bytes and files; a larger file is a group of its own."""
    groups: list[list[File]] = []
    total = size
    for f in files:
        if total + f.size > size or len(groups[-1]) == count:
            groups.append([])
            total = 0
        groups[-1].append(f)
        total += f.size
    return [Group(tuple(g)) for g in groups]


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class Files:
    """Options that both readers share."""

    def __init__(self, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError("transcripts need a path")
        self.root, self.glob = options["path"], options.get("pathGlob", "*")
        self.size, self.count, self.archive = int(options.get("groupBytes", 64 << 20)), int(options.get("groupFiles", 10_000)), options.get("archive")

    def groups(self, files: list[File]) -> list[Group]:
        return grouped(files, self.size, self.count) or [Group(())]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        """Rows of a group; bytes that are no UTF-8 become replacement characters."""
        system, base = opened(self.root)
        rows: list[tuple] = []
        total = 0
        for f in partition.files:
            with system.open_input_stream(f"{base}/{f.path}") as stream:
                data = stream.read()
            rows.append((f.path, f.modified, f.size, data.decode("utf-8", "replace")))
            total += len(data)
            if total >= BATCH_BYTES:
                yield batch(rows)
                rows, total = [], 0
        if rows:
            yield batch(rows)


class BatchReader(Files, DataSourceReader):
    def partitions(self) -> list[Group]:
        return self.groups(listed(self.root, self.glob))


class StreamReader(Files, DataSourceStreamReader):
    """Offsets are places in the order of arrival. A file that is changed arrives again; one whose time lies before the
    offset (moved here with an old time) is not seen. With ``archive`` files move there once their batch is committed."""

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = listed(self.root, self.glob)
        return {"modified": files[-1].modified, "path": files[-1].path} if files else getattr(self, "last", self.initialOffset())

    def partitions(self, start: dict, end: dict) -> list[Group]:
        self.last = end
        low, high = ((o["modified"], o["path"]) for o in (start, end))
        return self.groups([f for f in listed(self.root, self.glob) if low < (f.modified, f.path) <= high])

    def commit(self, end: dict) -> None:
        if not self.archive:
            return
        (system, base), (_, target) = opened(self.root), opened(self.archive)
        for f in listed(self.root, self.glob):
            if (f.modified, f.path) <= (end["modified"], end["path"]):
                system.create_dir(f"{target}/{f.path}".rpartition("/")[0], recursive=True)
                system.move(f"{base}/{f.path}", f"{target}/{f.path}")


class Transcripts(DataSource):
    """Options: path; pathGlob, for names (all); groupBytes (64 MiB) and groupFiles (10,000) of a partition; archive, of the stream."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return BatchReader(self.options)

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return StreamReader(self.options)


def registered(spark: SparkSession) -> SparkSession:
    """The session, in which the format is known from now on."""
    spark.dataSource.register(Transcripts)
    return spark


def segments(files: DataFrame, thinking: bool = True) -> DataFrame:
    """(path, place, speaker, content_type, content) of files of any format, by the suffix of the path."""
    from ..operators import parsers

    return parsers.parsed(files, thinking=thinking)


def written(files: DataFrame, root: str) -> None:
    """Write (path, text) as one file each under a folder, from the tasks that have them."""

    def write(rows: Iterator[Any]) -> None:
        system, base = opened(root)
        for r in rows:
            system.create_dir(f"{base}/{r['path']}".rpartition("/")[0], recursive=True)
            with system.open_output_stream(f"{base}/{r['path']}") as out:
                out.write(r["text"].encode())

    files.select("path", "text").foreachPartition(write)
