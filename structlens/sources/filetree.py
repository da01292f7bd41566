"""A Spark data source that lists a file tree: spark.read.format("filetree").option("root", ...).load().

Spark's own file sources leave out empty files and dot directories; this one lists every file, without following
links to directories. The tree has to be readable from the driver and the executors. The driver lists names and sizes;
files are dealt to partitions of about option partition_bytes, whatever directories they are in, and only with option
lines are they read, by the executors.

Filters on path, directory and filename (equality, in, beginnings, ends) are taken over: directories that can't fit are
not entered. They need the session's spark.sql.python.filterPushdown.enabled, which read() turns on. As a stream, a batch
holds the files whose modification time lies between two offsets, so each version of a file is seen once; option settle
keeps files out that are younger than so many seconds and may still be written.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

SCHEMA = "path STRING, directory STRING, filename STRING, length BIGINT, lines BIGINT"


def count_lines(path: str) -> int:
    """Lines that end with a newline, a carriage return or both; an unfinished last line counts."""
    n, last, size = 0, 0, 0
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            n += block.count(b"\n") + block.count(b"\r") - block.count(b"\r\n")
            if last == 13 and block[0] == 10:
                n -= 1
            last, size = block[-1], size + len(block)
    return n + (size > 0 and last not in (10, 13))


#: Bytes of a partition, and what a file counts besides its own: opening costs, too.
PARTITION_BYTES, OPEN_BYTES = 128 << 20, 4096
COLUMNS = ("path", "directory", "filename")


class Files(InputPartition):
    """(path below the root, size) of files."""

    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


def walk(root: str, wanted: list[tuple[str, str, tuple]]) -> Iterator[tuple[str, os.stat_result]]:
    """(path below root, status) of all files that fit (column, kind, values), in order; only directories that can hold
    such files are entered."""
    todo = [""]
    while todo:
        directory = todo.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, directory)), key=lambda e: e.name)
        except (FileNotFoundError, PermissionError):
            continue  # gone meanwhile, or not for us
        below = []
        for e in entries:
            path = f"{directory}/{e.name}" if directory else e.name
            if e.is_dir(follow_symlinks=False):
                if all(_may_hold(path, w) for w in wanted):
                    below.append(path)
            elif e.is_file() and all(_fits({"path": path, "directory": directory, "filename": e.name}[c], kind, values) for c, kind, values in wanted):
                yield path, e.stat()
        todo += reversed(below)


def _fits(value: str, kind: str, values: tuple) -> bool:
    return value in values if kind == "in" else value.startswith(values) if kind == "starts" else value.endswith(values)


def _may_hold(directory: str, wanted: tuple[str, str, tuple]) -> bool:
    """Whether files below a directory may fit."""
    column, kind, values = wanted
    if column == "filename" or kind == "ends":
        return True
    here = directory + "/"
    return any(v.startswith(here) or v == directory and column == "directory" or kind == "starts" and (here.startswith(v) or directory.startswith(v)) for v in values)


def packed(files: Iterable[tuple[str, int]], most: int) -> list[Files]:
    """Files in partitions of about so many bytes; a larger one is alone."""
    out, held, size = [], [], 0
    for path, n in files:
        if held and size + n + OPEN_BYTES > most:
            out.append(Files(held))
            held, size = [], 0
        held.append((path, n))
        size += n + OPEN_BYTES
    return [*out, Files(held)] if held or not out else out


def _rows(root: str, partition: Files, with_lines: bool) -> Iterator[tuple]:
    for path, size in partition.files:
        directory, _, name = path.rpartition("/")
        lines = None
        if with_lines:
            try:
                lines = count_lines(os.path.join(root, path))
            except OSError:
                pass  # gone since it was listed, or not for us: still a file of the listing
        yield path, directory, name, size, lines


class TreeReader(DataSourceReader):
    def __init__(self, root: str, with_lines: bool, partition_bytes: int = PARTITION_BYTES):
        self.root, self.with_lines, self.most, self.wanted = os.path.abspath(root), with_lines, partition_bytes, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in COLUMNS and isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)):
                kind = "starts" if isinstance(f, StringStartsWith) else "ends" if isinstance(f, StringEndsWith) else "in"
                values = tuple(v for v in f.value if v is not None) if isinstance(f, In) else (f.value,)
                self.wanted.append((column, kind, values))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return packed(((path, status.st_size) for path, status in walk(self.root, self.wanted)), self.most)

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.root, partition, self.with_lines)


class TreeStream(DataSourceStreamReader):
    """Offsets are modification times in nanoseconds: a batch has the files after one, up to the other."""

    def __init__(self, root: str, with_lines: bool, partition_bytes: int, settle: float):
        self.root, self.with_lines, self.most, self.settle = os.path.abspath(root), with_lines, partition_bytes, settle

    def initialOffset(self) -> dict:  # noqa: N802
        return {"upto": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        limit = time.time_ns() - int(self.settle * 1e9)
        return {"upto": max((s.st_mtime_ns for _, s in walk(self.root, []) if s.st_mtime_ns <= limit), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return packed(((path, s.st_size) for path, s in walk(self.root, []) if start["upto"] < s.st_mtime_ns <= end["upto"]), self.most)

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.root, partition, self.with_lines)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def _arguments(self) -> tuple[str, bool, int]:
        return self.options["root"], self.options.get("lines", "false").lower() == "true", int(self.options.get("partition_bytes", PARTITION_BYTES))

    def reader(self, schema) -> TreeReader:
        return TreeReader(*self._arguments())

    def streamReader(self, schema) -> TreeStream:  # noqa: N802
        return TreeStream(*self._arguments(), float(self.options.get("settle", "1")))


def _options(root: str, lines: bool, partition_bytes: int) -> dict[str, str]:
    return {"root": root, "lines": str(lines).lower(), "partition_bytes": str(partition_bytes)}


def read(spark: SparkSession, root: str, lines: bool = False, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    spark.dataSource.register(FileTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("filetree").options(**_options(root, lines, partition_bytes)).load()


def stream(spark: SparkSession, root: str, lines: bool = False, settle: float = 1, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Files as they appear or change, each version once."""
    spark.dataSource.register(FileTree)
    return spark.readStream.format("filetree").options(**_options(root, lines, partition_bytes), settle=str(settle)).load()


def read_text(root: str, path: str) -> str:
    """A file's text, "ERROR" for a path outside root, "ERROR: " and the kind of failure if it can't be read."""
    from ..operators.files import allowed

    if not allowed(root, path):
        return "ERROR"
    try:
        with open(os.path.join(root, path), encoding="utf-8", newline="") as f:
            return f.read()
    except (OSError, UnicodeDecodeError) as e:
        return f"ERROR: {type(e).__name__}"


def with_text(files: DataFrame, root: str, *keep: str) -> DataFrame:
    """(path, filename, text and the columns in keep) of a listing, read by the executors; unreadable files have read_text()'s
    message."""

    def run(batches):
        for batch in batches:
            yield batch.assign(text=[read_text(root, p) for p in batch.path])

    narrow = files.select("path", "filename", *keep)
    return narrow.mapInPandas(run, T.StructType(narrow.schema.fields + [T.StructField("text", T.StringType())]))


def with_content(files: DataFrame, root: str) -> DataFrame:
    """The rows of a listing with content, their files' bytes, read by the executors; null for unreadable files."""

    def run(batches):
        for batch in batches:
            yield batch.assign(content=[read_bytes(root, p) for p in batch.path])

    return files.mapInPandas(run, T.StructType(files.schema.fields + [T.StructField("content", T.BinaryType())]))


def read_bytes(root: str, path: str) -> bytes | None:
    from ..operators.files import allowed

    try:
        if not allowed(root, path):
            return None
        with open(os.path.join(root, path), "rb") as f:
            return f.read()
    except OSError:
        return None
