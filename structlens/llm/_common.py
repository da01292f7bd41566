"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 regular expression of a run of blanks.
BLANKS = r"[\x20\x09-\x0D]+"
#: Of a word: what stands between blanks.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(text, UPPER, LOWER)


def native_words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    blank = r"' \t\n\x0b\f\r'".encode().decode("unicode_escape")
    trimmed = F.call_function("btrim", text, F.lit(blank[1:-1]))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) > 0, F.split(trimmed, BLANKS)).otherwise(
        F.array().cast("array<string>")
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a temporary one only where none is configured and
    all runs on one machine, as in tests."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there is None:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            there = set_before.get()
    if there is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="structlens-")
        spark.conf.set("spark.checkpoint.dir", there)
        atexit.register(delete, spark, there)
    return there


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/structlens-{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, wherever it lives."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def contents(spark: SparkSession, path: str) -> str:
    """The name of a table's folder, with the number and bytes of its files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at)
    return f"{path} {found.getFileCount()} {found.getLength()}"


def write_once(spark: SparkSession, path: str, text: str) -> str:
    """What a small file holds, which is text if it wasn't there; an empty one counts as lost while it was written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at) and fs.getFileStatus(at).getLen():
        stream = fs.open(at)
        try:
            return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
    stream = fs.create(at, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    return text


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder, wherever it lives."""
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended
        pass


#: With it, Spark deletes the shuffle files of a query when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stored:
    """A table written to the shared folder: it cuts lineage and survives lost executors. The shuffle files that went
    into it are deleted at once."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, new_path(df.sparkSession, name)
        self.schema = df.schema
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(self.path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def stored(df: DataFrame, name: str) -> DataFrame:
    return Stored(df, name).df


def packs(batches, size: int, *names: str):
    """Lists of rows of the named columns, the first of them bytes: about `size` bytes of it in each list, a longer row alone."""
    rows, held = [], 0
    for batch in batches:
        for row in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
            rows.append(row)
            held += len(row[0])
            if held >= size:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def small(df: DataFrame, most: int) -> bool:
    """Whether a table has at most so many rows; counts no further than that."""
    return df.limit(most + 1).count() <= most
