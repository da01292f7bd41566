"""Operators over file listings (path, directory, filename, lines)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import glob_regex


def by_pattern(files: DataFrame, globs: list[str], name: str = "filename") -> DataFrame:
    """files with wildcard, one row for each pattern that a file's name matches; nothing else is compared."""
    fitting = F.filter(F.array(*[F.struct(F.lit(g).alias("glob"), F.lit(glob_regex(g)).alias("re")) for g in globs]), lambda g: F.call_function("rlike", F.col(name), g["re"]))
    return files.withColumn("wildcard", F.explode(F.transform(fitting, lambda g: g["glob"])))


def statistics(matched: DataFrame, lines: str = "lines") -> DataFrame:
    """(wildcard, files, lines) of by_pattern(); patterns without a file are absent."""
    return matched.groupBy("wildcard").agg(F.count("*").alias("files"), F.sum(F.coalesce(lines, F.lit(0))).cast("long").alias("lines"))


def count_by_pattern(matched: DataFrame, *keys: str) -> DataFrame:
    return matched.groupBy(*keys, "wildcard").agg(F.count("*").alias("count"))


def in_directory(files: DataFrame, directory: str) -> DataFrame:
    return files.where(F.col("directory") == directory)


def below(files: DataFrame, directory: str) -> DataFrame:
    """Files of a directory and all below it; "" is the root."""
    if not directory:
        return files
    return files.where((F.col("directory") == directory) | F.col("directory").startswith(directory + "/"))


def listing(files: DataFrame, skip_dot_directories: bool = False) -> DataFrame:
    """(directory, files): the sorted distinct names of each directory; optionally without dot directories and below."""
    kept = files.where(~F.col("directory").rlike(r"(^|/)\.[^/]")) if skip_dot_directories else files
    return kept.groupBy("directory").agg(F.array_sort(F.collect_set("filename")).alias("files"))


def allowed(root: str, path: str) -> bool:
    """Whether a path lies in root after links are followed."""
    base, there = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    return there == base or there.startswith(base + os.sep)


def exists(files: DataFrame, root: str, path: str) -> str:
    """true, false, or ERROR for a path outside root."""
    if not allowed(root, path):
        return "ERROR"
    return "true" if not files.where(F.col("path") == os.path.normpath(path)).limit(1).isEmpty() else "false"
