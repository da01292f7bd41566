"""Table functions for SQL: metrics and repairs over any table, as in SELECT * FROM values_of(TABLE(t), 'module', 'size').

register() adds them to a session. Their columns follow from their arguments. Each keeps a bounded amount in a task: a
histogram that grows beyond MOST values is handed on in parts, so what it returns is added up outside by GROUP BY, which
Spark does before and after a shuffle; no partition of the table has to be in one task.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: Values that a task counts before it hands them on.
MOST = 1 << 16


def _columns(table: AnalyzeArgument) -> StructType:
    if not table.isTable:
        raise ValueError("the first argument has to be TABLE(...)")
    return table.dataType


def _known(schema: StructType, *names: str) -> None:
    if missing := [n for n in names if n not in schema.fieldNames()]:
        raise ValueError(f"the table has no column {', '.join(missing)}")


def _constant(argument: AnalyzeArgument) -> str:
    if not argument.isConstantExpression or not isinstance(argument.value, str):
        raise ValueError("names of columns have to be constant strings")
    return argument.value


class ValuesOf:
    """values_of(TABLE(t), key, value): (key, value, count), how often each value of a column occurs for each key; null values
    are left out. To be added up by GROUP BY key, value."""

    def __init__(self):
        self.counts: Counter = Counter()

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, value: AnalyzeArgument) -> AnalyzeResult:
        schema = _columns(table)
        _known(schema, _constant(key), _constant(value))
        return AnalyzeResult(StructType([StructField("key", schema[key.value].dataType), StructField("value", StringType()), StructField("count", LongType())]))

    def eval(self, table: Row, key: str, value: str) -> Iterator[tuple]:
        if table[value] is not None:
            self.counts[table[key], str(table[value])] += 1
            if len(self.counts) >= MOST:
                yield from self.terminate()
                self.counts.clear()

    def terminate(self) -> Iterator[tuple]:
        yield from ((k, v, n) for (k, v), n in self.counts.items())


class PrefixesOf:
    """prefixes_of(TABLE(t), name): the table's columns with segments and prefix, a row for each beginning of a dotted name,
    the shortest first; names that are null have none."""

    @staticmethod
    def analyze(table: AnalyzeArgument, name: AnalyzeArgument) -> AnalyzeResult:
        schema = _columns(table)
        _known(schema, _constant(name))
        return AnalyzeResult(StructType([*schema.fields, StructField("segments", LongType()), StructField("prefix", StringType())]))

    def eval(self, table: Row, name: str) -> Iterator[tuple]:
        parts = (table[name] or "").split(".") if table[name] is not None else []
        for i in range(len(parts)):
            yield (*table, i + 1, ".".join(parts[: i + 1]))


class JsonProblems:
    """json_problems(TABLE(t), text, schema): the table's columns with problems, an array of what is wrong with the JSON in a
    column by a JSON Schema given as text; empty if nothing is, null for a null text."""

    @staticmethod
    def analyze(table: AnalyzeArgument, text: AnalyzeArgument, schema: AnalyzeArgument) -> AnalyzeResult:
        columns = _columns(table)
        _known(columns, _constant(text))
        json.loads(_constant(schema))
        return AnalyzeResult(StructType([*columns.fields, StructField("problems", ArrayType(StringType()))]))

    def __init__(self):
        self.schema = None

    def eval(self, table: Row, text: str, schema: str) -> Iterator[tuple]:
        from ..schemas import problems

        if self.schema is None:
            self.schema = json.loads(schema)
        if table[text] is None:
            yield (*table, None)
            return
        try:
            found = problems(json.loads(table[text]), self.schema)
        except ValueError:
            found = ["no JSON"]
        yield (*table, found)


FUNCTIONS = {"values_of": ValuesOf, "prefixes_of": PrefixesOf, "json_problems": JsonProblems}


def register(spark: SparkSession) -> list[str]:
    """Adds the table functions to a session; their names."""
    for name, handler in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler))
    return list(FUNCTIONS)
