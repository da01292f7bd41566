"""CSV reports and documents. Only results of report size come here; large ones go to Parquet."""

from __future__ import annotations

import csv
import json
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import CATEGORIES


def write_csv(df: DataFrame, directory: str, name: str, header: list[str] | None = None) -> str | None:
    """One CSV file with df's rows in their order; none for no rows. Rows come to the driver one partition at a time."""
    path = os.path.join(directory, re.sub(r"[^\w.-]", "_", name))
    rows = df.toLocalIterator(prefetchPartitions=True)
    first = next(rows, None)
    if first is None:
        return None
    os.makedirs(directory, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(header or df.columns)
        out.writerow(first)
        out.writerows(rows)
    return path


def write_large_csv(df: DataFrame, path: str) -> None:
    """As many CSV files as df has partitions, written by the executors."""
    df.write.mode("overwrite").option("header", True).csv(path)


def by_key(distribution: DataFrame) -> DataFrame:
    return distribution.select(F.col("value").alias("Key"), F.col("count").alias("Count")).orderBy("Key")


def by_number(distribution: DataFrame) -> DataFrame:
    return distribution.select(F.col("value").cast("int").alias("Value"), F.col("count").alias("Count")).orderBy("Value")


def by_category(distribution: DataFrame, numeric: bool = False, *keep: str) -> DataFrame:
    """Category, Key (or Value), Count after the columns keep: in the order of these, production, test, generated, then by key."""
    order = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    key = F.col("value").cast("int") if numeric else F.col("value")
    return distribution.select(*keep, F.col("category").alias("Category"), key.alias("Value" if numeric else "Key"), F.col("count").alias("Count"), order.alias("o")).orderBy(*keep, "o", key).drop("o")


def matrix(edges: DataFrame) -> DataFrame:
    return edges.where("`from` <> `to` and import_count > 0").select(F.col("from").alias("From"), F.col("to").alias("To"), F.col("import_count").alias("ImportCount")).orderBy("From", "To")


def conversation_log(messages: DataFrame, with_system: bool = False) -> DataFrame:
    """(conv_id, log): the messages of each conversation in order, a heading for each; system messages on request."""
    shown = messages if with_system else messages.where("lower(role) <> 'system'")
    line = F.concat(F.lit("== "), F.upper("role"), F.lit("\n"), F.coalesce("text", F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return shown.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("log"))


_TAG = re.compile(r"\{\{\{?\s*(.*?)\s*\}?\}\}", re.S)


class Template:
    """A document template: {{path}}, {{#each}}, {{#if}}, {{#with}}, {{else}}, {{lookup a b}}, {{> part}} and ../ for the
    scope outside. Nothing is escaped."""

    def __init__(self, text: str, parts: dict[str, str] | None = None):
        self.parts = parts or {}
        pieces, at = [], 0
        for m in _TAG.finditer(text):
            pieces += [("text", text[at : m.start()]), ("tag", m[1])]
            at = m.end()
        pieces.append(("text", text[at:]))
        self.nodes, rest = self._block(pieces, 0)
        if rest != len(pieces):
            raise ValueError("a block is closed that isn't open")

    def _block(self, pieces: list, i: int) -> tuple[list, int]:
        nodes: list = []
        while i < len(pieces):
            kind, value = pieces[i]
            if kind == "tag" and (value.startswith("/") or value == "else"):
                return nodes, i
            i += 1
            if kind == "tag" and value.startswith("#"):
                name, _, argument = value[1:].partition(" ")
                then, i = self._block(pieces, i)
                other: list = []
                if i < len(pieces) and pieces[i][1] == "else":
                    other, i = self._block(pieces, i + 1)
                if i >= len(pieces):
                    raise ValueError(f"{name} isn't closed")
                i += 1
                nodes.append((name, argument.strip(), then, other))
            elif kind == "tag":
                nodes.append(("value", value))
            else:
                nodes.append(("text", value))
        return nodes, i

    def render(self, data: object) -> str:
        return self._render(self.nodes, [data], {})

    def _find(self, path: str, scopes: list, local: dict):
        if path.startswith("@"):
            return local.get(path)
        while path.startswith("../"):
            path, scopes = path[3:], scopes[:-1]
        value = scopes[-1] if scopes else None
        for step in re.split(r"[./]", path):
            if step in ("this", ""):
                continue
            value = value.get(step) if isinstance(value, dict) else value[int(step)] if isinstance(value, list) and step.isdigit() and int(step) < len(value) else None
        return value

    def _render(self, nodes: list, scopes: list, local: dict) -> str:
        out = []
        for node in nodes:
            if node[0] == "text":
                out.append(node[1])
            elif node[0] == "value":
                out.append(self._value(node[1], scopes, local))
            else:
                out.append(self._section(node, scopes, local))
        return "".join(out)

    def _value(self, tag: str, scopes: list, local: dict) -> str:
        if tag.startswith("!"):
            return ""
        if tag.startswith(">"):
            return self._render(Template(self.parts[tag[1:].strip()], self.parts).nodes, scopes, local)
        if tag.startswith("lookup "):
            _, base, key = tag.split()
            found, at = self._find(base, scopes, local), self._find(key, scopes, local)
            value = found.get(str(at)) if isinstance(found, dict) else found[at] if isinstance(found, list) and isinstance(at, int) and at < len(found) else None
        else:
            value = self._find(tag, scopes, local)
        if isinstance(value, (dict, list)):
            return json.dumps(value)
        return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)

    def _section(self, node: tuple, scopes: list, local: dict) -> str:
        name, argument, then, other = node
        value = self._find(argument, scopes, local)
        if name == "each":
            items = list(value.items()) if isinstance(value, dict) else list(enumerate(value or []))
            if not items:
                return self._render(other, scopes, local)
            last = len(items) - 1
            return "".join(self._render(then, [*scopes, x], {"@index": i, "@key": k, "@first": i == 0, "@last": i == last}) for i, (k, x) in enumerate(items))
        truth = bool(value)
        if name == "if":
            return self._render(then if truth else other, scopes, local)
        if name == "unless":
            return self._render(other if truth else then, scopes, local)
        if name == "with":
            return self._render(then, [*scopes, value], local) if truth else self._render(other, scopes, local)
        raise ValueError(f"unknown section {name}")
