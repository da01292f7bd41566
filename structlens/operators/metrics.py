"""Metrics of all modules at once.

Every function takes flattened views (structlens.sources.report makes them from module reports) and returns a long table
(module, category, value, count), one shuffle on the group key. A single module's report is a filter of it.
Views and their columns:

classes: module, category, package, unit, class, super_class, n_interfaces, n_fields, n_methods, documented
methods: module, category, class, visibility, is_static, is_final, parameter_count, lines_of_code, complexity, nesting, documented
fields: module, category, class, visibility, is_static, is_final
imports: module, category, package, unit, class, import (null for a class without imports)
annotations: module, category, name
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import CATEGORIES, is_external, prefix

KEYS = ("module", "category")
OUT = ("module", "category", "value", "count")


def histogram(rows: DataFrame, value: Column | str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """How many rows have each value; nulls aren't counted."""
    named = rows.select(*keys, (F.col(value) if isinstance(value, str) else value).cast("string").alias("value"))
    return named.where("value is not null").groupBy(*keys, "value").agg(F.count("*").alias("count"))


def _grid(modules: DataFrame, values: list[str]) -> DataFrame:
    """A row with count 0 for each module, category and value."""
    every = modules.select("module").distinct().withColumn("category", F.explode(F.array(*map(F.lit, CATEGORIES))))
    return every.select(*KEYS, F.explode(F.array(*map(F.lit, values))).alias("value"), F.lit(0).cast("long").alias("count"))


def totals(rows: DataFrame, modules: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """A row for each flag, module and category, also at 0: how many rows have it."""
    counted = rows.groupBy(*KEYS).agg(*[F.count_if(c).alias(n) for n, c in flags.items()])
    each = counted.select(*KEYS, F.inline(F.array(*[F.struct(F.lit(n).alias("value"), F.col(n).alias("count")) for n in flags])))
    return each.unionByName(_grid(modules, list(flags))).groupBy(*KEYS, "value").agg(F.sum("count").alias("count"))


def visibility(members: DataFrame, modules: DataFrame, with_total: bool = False) -> DataFrame:
    """Members by visibility (UNKNOWN without one), and how many are static and final (and all, with_total).

    Members are read and shuffled once: flags are counted beside the visibilities.
    """
    flags = {"STATIC": F.col("is_static"), "FINAL": F.col("is_final")} | ({"TOTAL": F.lit(True)} if with_total else {})
    counted = members.groupBy(*KEYS, F.coalesce("visibility", F.lit("UNKNOWN")).alias("value")).agg(F.count("*").alias("count"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    pairs = F.array(F.struct("value", "count"), *[F.struct(F.lit(n).alias("value"), F.col(n).alias("count")) for n in flags])
    each = counted.select(*KEYS, F.inline(pairs))
    return each.unionByName(_grid(modules, list(flags))).groupBy(*KEYS, "value").agg(F.sum("count").alias("count"))


def field_method_ratio(classes: DataFrame) -> DataFrame:
    """Classes by fields per 100 methods, rounded down; those without methods are left out."""
    return histogram(classes.where("n_methods > 0"), F.expr("(n_fields * 100) div n_methods"))


def coupling(imports: DataFrame) -> DataFrame:
    """Classes by their number of external imports; a class without imports counts with 0."""
    outside = F.count_if(F.coalesce(is_external(F.col("import"), F.col("package")), F.lit(False)))
    return histogram(imports.groupBy(*KEYS, "class").agg(outside.alias("n")), "n")


def module_dependencies(imports: DataFrame) -> DataFrame:
    """External imports by their first two segments; names without a dot are left out."""
    dotted = F.col("import").contains(".") & is_external(F.col("import"), F.col("package"))
    return histogram(imports.where(dotted), prefix(F.col("import")))


def documentation(classes: DataFrame, methods: DataFrame, modules: DataFrame) -> DataFrame:
    """Documented and all classes and methods, also at 0."""
    flags = lambda what: {f"DOCUMENTED_{what}": F.col("documented"), f"TOTAL_{what}": F.lit(True)}
    return totals(classes, modules, flags("CLASSES")).unionByName(totals(methods, modules, flags("METHODS")))


def coverage(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, untested) of (module, category, name): a production name is tested if name + Test or Tests is a test.

    Distinct names; names with Abstract don't count. summary has (module, value, count) for TOTAL, TESTED, UNTESTED and
    COVERAGE_RATIO_PERCENT, rounded down and left out at a total of 0; untested has (module, name).
    """
    distinct = names.select("module", "category", "name").distinct()
    wanted = distinct.where("category = 'production' and not contains(name, 'Abstract')").select("module", "name")
    tests = distinct.where("category = 'test'").select("module", F.col("name").alias("test"))
    subjects = tests.select("module", F.explode(F.array(F.regexp_extract("test", "^(.*)Tests$", 1), F.regexp_extract("test", "^(.*)Test$", 1))).alias("name")).where("name <> ''").distinct()
    marked = wanted.join(subjects.withColumn("tested", F.lit(True)), ["module", "name"], "left")
    return coverage_summary(marked), marked.where("tested is null").select("module", "name")


def coverage_summary(marked: DataFrame) -> DataFrame:
    """(module, value, count) of (module, tested)."""
    counted = marked.groupBy("module").agg(F.count("*").alias("TOTAL"), F.count("tested").alias("TESTED"))
    counted = counted.withColumn("UNTESTED", F.col("TOTAL") - F.col("TESTED"))
    counted = counted.withColumn("COVERAGE_RATIO_PERCENT", F.expr("if(TOTAL > 0, (TESTED * 100) div TOTAL, null)"))
    return counted.unpivot("module", ["TOTAL", "TESTED", "UNTESTED", "COVERAGE_RATIO_PERCENT"], "value", "count").where("count is not null")


def import_diversity(imports: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Imports of build units by their first two segments, labelled (internal) or (external), in all categories and each.

    namespaces has (module, namespace): a prefix is internal if it equals the module's or lies above it.
    """
    used = imports.where("import is not null and not startswith(import, 'static ') and not startswith(import, 'java.lang')")
    counted = used.select("module", "category", prefix(F.col("import")).alias("prefix")).groupBy("module", "category", "prefix").agg(F.count("*").alias("count"))
    inside = F.coalesce((F.col("prefix") == F.col("namespace")) | F.expr("startswith(namespace, prefix)"), F.lit(False))
    named = counted.join(namespaces, "module", "left").withColumn("value", F.concat("prefix", F.when(inside, F.lit(" (internal)")).otherwise(F.lit(" (external)"))))
    return named.select("module", "category", "value", "count")


def all_categories(distribution: DataFrame) -> DataFrame:
    """A distribution summed over categories."""
    return distribution.groupBy("module", "value").agg(F.sum("count").alias("count"))


def namespaces(classes: DataFrame) -> DataFrame:
    """(module, namespace): the most frequent package of a module's classes, ties by name."""
    counted = classes.groupBy("module", "package").agg(F.count("*").alias("n"))
    return counted.groupBy("module").agg(F.min(F.struct((-F.col("n")).alias("n"), "package")).alias("best")).select("module", F.col("best.package").alias("namespace"))


def batch(metrics: dict[str, DataFrame]) -> DataFrame:
    """(metric, module, category, value, count) of several metrics: one plan for all modules and metrics."""
    out = None
    for name, df in metrics.items():
        part = df.select(F.lit(name).alias("metric"), *OUT)
        out = part if out is None else out.unionByName(part)
    return out


def expanded(rows: DataFrame, values: list[tuple[str, Column]], zeros: DataFrame | None = None) -> DataFrame:
    """(metric, module, category, value, count): several histograms by one pass over rows (module, category, ...). values has
    the name of a metric and a value of it, the same name as often as it has values in a row; null values aren't counted.
    zeros (metric, module, category, value) are there with count 0 if no row has them.

    Each row becomes one for each value, and these are added up before they are sent.
    """
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("string").alias("value")) for m, v in values]))
    counted = rows.select(*KEYS, each).where("value is not null").withColumn("count", F.lit(1).cast("long"))
    if zeros is not None:
        counted = counted.unionByName(zeros.withColumn("count", F.lit(0).cast("long")))
    return counted.groupBy("metric", *KEYS, "value").agg(F.sum("count").alias("count"))


def flagged(metric: str, flags: dict[str, Column]) -> list[tuple[str, Column]]:
    """Values of expanded(): the name of each flag that is set."""
    return [(metric, F.when(c, n)) for n, c in flags.items()]


def grid(modules: DataFrame, metric: str, values: list[str]) -> DataFrame:
    """zeros of expanded() for all modules and categories."""
    return _grid(modules, values).select(F.lit(metric).alias("metric"), *KEYS, "value")


def skipped(modules: DataFrame, reports: DataFrame) -> DataFrame:
    """(module, status, reasoning) of modules without a report."""
    gone = modules.select("module").join(reports.select("module").distinct(), "module", "left_anti")
    return gone.select("module", F.lit("ERROR").alias("status"), F.lit("no report of this module").alias("reasoning"))
