"""A Spark data sink that writes the CSV reports of all metrics and modules in one job.

df.write.format("reports").option("folder", ...).mode("append").save() takes rows (metric, module, ...) and makes a file
folder/metric/module.csv of each metric and module that has rows, replacing that of an earlier run; the first two columns are
left out of it. Option headers has the headers of single metrics as JSON. write() sorts and deals the rows, so that a file's rows are together, in their order.

A task writes to a draft folder of its own attempt and reports its files; only when all tasks are done does the driver rename
them, each at once. Drafts of attempts that were lost or killed, and of a job that failed, never get a name that a reader
sees, and the commit deletes them. The folder has to be writable from the executors and the driver.
"""

from __future__ import annotations

import csv
import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

DRAFTS = ".drafts"


def file_name(name: str) -> str:
    return re.sub(r"[^\w.-]", "_", name)


@dataclass
class Written(WriterCommitMessage):
    """(draft, the path that it gets) of an attempt's files."""

    files: list[tuple[str, str]]


class ReportWriter(DataSourceWriter):
    def __init__(self, folder: str, header: list[str], headers: dict[str, list[str]] | None = None):
        self.folder, self.header, self.headers, self.job = os.path.abspath(folder), header, headers or {}, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        drafts = os.path.join(self.folder, DRAFTS, self.job, uuid.uuid4().hex)
        files, at, out, handle = [], None, None, None
        try:
            for row in iterator:
                if (row[0], row[1]) != at:
                    if handle:
                        handle.close()
                    at = (row[0], row[1])
                    os.makedirs(drafts, exist_ok=True)
                    draft = os.path.join(drafts, f"{len(files)}.csv")
                    files.append((draft, os.path.join(file_name(row[0]), file_name(row[1]) + ".csv")))
                    handle = open(draft, "w", newline="", encoding="utf-8")  # noqa: SIM115  closed with the next file
                    out = csv.writer(handle)
                    out.writerow(self.headers.get(row[0], self.header))
                out.writerow(row[2:])
        except BaseException:
            shutil.rmtree(drafts, ignore_errors=True)
            raise
        finally:
            if handle:
                handle.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of a metric and module are not together, or two modules have one file name")
        for draft, name in files:
            path = os.path.join(self.folder, name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            os.replace(draft, path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(os.path.join(self.folder, DRAFTS, self.job), ignore_errors=True)


class Reports(DataSource):
    @classmethod
    def name(cls) -> str:
        return "reports"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["folder"], [f.name for f in schema.fields[2:]], json.loads(self.options.get("headers", "{}")))


def write(rows: DataFrame, folder: str, *order: Column, headers: dict[str, list[str]] | None = None) -> None:
    """Writes rows (metric, module, columns of the files), each file's in the given order; order may use other columns."""
    rows.sparkSession.dataSource.register(Reports)
    names = [f"__order{i}" for i in range(len(order))]
    sorted_ = rows.withColumns(dict(zip(names, order, strict=True))).repartition("metric", "module").sortWithinPartitions("metric", "module", *names)
    sorted_.drop(*names).write.format("reports").option("folder", folder).option("headers", json.dumps(headers or {})).mode("append").save()


def write_metrics(metrics: DataFrame, folder: str, numeric: set[str]) -> None:
    """The files of (metric, module, category, value, count): Category, Key, Count by category, then by key, numeric ones by
    number."""
    from ..functions.scalars import CATEGORIES

    number = F.when(F.col("metric").isin(*numeric), F.expr("try_cast(Key as bigint)"))
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("Category"))
    write(metrics.select("metric", "module", F.col("category").alias("Category"), F.col("value").alias("Key"), F.col("count").alias("Count")), folder, place, number, F.col("Key"), headers={m: ["Category", "Value", "Count"] for m in numeric})
