"""All metrics of module reports, each as one long table over all modules."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import simple_name
from ..sources import report
from . import coupling, graph, metrics


class Reports:
    """Flattened views of module reports."""

    def __init__(self, reports: DataFrame):
        self.reports = reports

    @cached_property
    def modules(self) -> DataFrame:
        return self.reports.select(F.col("name").alias("module")).distinct()

    @cached_property
    def classes(self) -> DataFrame:
        return report.classes(self.reports)

    @cached_property
    def methods(self) -> DataFrame:
        return report.methods(self.classes)

    @cached_property
    def fields(self) -> DataFrame:
        return report.fields(self.classes)

    @cached_property
    def imports(self) -> DataFrame:
        return report.imports(self.classes)

    @cached_property
    def annotations(self) -> DataFrame:
        return report.annotations(self.classes)


def _listed(found: DataFrame, value: str) -> DataFrame:
    return found.select("module", "category", F.col(value).alias("value"), F.lit(1).cast("long").alias("count"))


def _anywhere(found: DataFrame) -> DataFrame:
    """A table without categories."""
    return found.select("module", F.lit("").alias("category"), "value", F.col("count").cast("long").alias("count"))


def _inheritance(r: Reports) -> DataFrame:
    depth = graph.chain_depth(r.classes.select("module", "class", "super_class")).join(r.classes.select("module", "class", "category"), ["module", "class"])
    return metrics.histogram(depth, F.concat(F.lit("depth "), F.col("depth").cast("string"))).unionByName(metrics.histogram(r.classes, F.concat(F.lit("interfaces "), F.col("n_interfaces").cast("string"))))


def _complexity(r: Reports) -> DataFrame:
    named = lambda what, c: metrics.histogram(r.methods.where(F.col(c).isNotNull()), F.concat(F.lit(f"{what} "), F.col(c).cast("string")))
    return named("parameters", "parameter_count").unionByName(named("statements", "lines_of_code"))


def _cohesion(r: Reports) -> DataFrame:
    fields = metrics.histogram(r.classes, F.concat(F.lit("fields "), F.col("n_fields").cast("string")))
    ratio = metrics.field_method_ratio(r.classes).withColumn("value", F.concat(F.lit("fields per 100 methods "), "value"))
    return fields.unionByName(ratio)


def _coupling(r: Reports) -> DataFrame:
    per_class = metrics.coupling(r.imports).withColumn("value", F.concat(F.lit("external "), "value"))
    return per_class.unionByName(metrics.module_dependencies(r.imports))


def _coverage(r: Reports) -> DataFrame:
    names = r.classes.select("module", "category", simple_name(F.col("class")).alias("name"))
    summary, untested = metrics.coverage(names)
    return _anywhere(summary).unionByName(_anywhere(untested.select("module", F.col("name").alias("value"), F.lit(1).alias("count"))))


def _class_cycles(r: Reports) -> DataFrame:
    # Nodes carry their module: classes of one name in two modules are two nodes.
    imports = r.imports.withColumns({"class": F.concat_ws("\x1f", "module", "class"), "import": F.concat_ws("\x1f", "module", "import")})
    found = graph.strong_components(graph.class_graph(imports, r.classes.withColumn("class", F.concat_ws("\x1f", "module", "class"))))
    return _cycles(found)


def _package_cycles(r: Reports) -> DataFrame:
    edges = graph.package_graph(r.imports, r.classes).select(F.concat_ws("\x1f", "module", "src").alias("src"), F.concat_ws("\x1f", "module", "dst").alias("dst"))
    return _cycles(graph.strong_components(edges))


def _cycles(found: DataFrame) -> DataFrame:
    """A row for each cycle: its members in order, and how many they are."""
    name = F.element_at(F.split("node", "\x1f"), 2)
    rows = found.groupBy(F.element_at(F.split("component", "\x1f"), 1).alias("module"), "component").agg(F.array_join(F.sort_array(F.collect_list(name)), " -> ").alias("value"), F.count("*").alias("count"))
    return _anywhere(rows)


def _diversity(r: Reports) -> DataFrame:
    return metrics.import_diversity(r.imports, metrics.namespaces(r.classes))


#: Names of the metrics as callers know them (fixed values), and what computes them.
METRICS: dict[str, Callable[[Reports], DataFrame]] = {
    "visibility_distribution": lambda r: metrics.visibility(r.methods, r.modules),
    "inheritance": _inheritance,
    "method_complexity": _complexity,
    "method_nesting_depth": lambda r: metrics.histogram(r.methods, "nesting"),
    "cyclomatic_complexity": lambda r: metrics.histogram(r.methods, "complexity"),
    "field_visibility": lambda r: metrics.visibility(r.fields, r.modules, True),
    "class_cohesion": _cohesion,
    "coupling": _coupling,
    "test_coverage": _coverage,
    "circular_dependency": _class_cycles,
    "method_count": lambda r: metrics.histogram(r.classes, "n_methods"),
    "documentation_ratio": lambda r: metrics.documentation(r.classes, r.methods, r.modules),
    "data_class": lambda r: _listed(r.classes.where("is_data_class"), "class"),
    "boolean_parameter": lambda r: _listed(r.methods.where("n_booleans >= 3").withColumn("value", F.concat_ws(".", "class", "name")), "value"),
    "annotation": lambda r: metrics.histogram(r.annotations, "name"),
    "package_tangle": _package_cycles,
    "import_diversity": _diversity,
}


def every(reports: DataFrame) -> DataFrame:
    """(metric, module, category, value, count) of all metrics of all modules."""
    views = Reports(reports)
    return metrics.batch({name: f(views) for name, f in METRICS.items()})


def one(reports: DataFrame, metric: str, modules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(a metric of all modules, largest counts first within module and category; modules (module) without a report)."""
    found = METRICS[metric](Reports(reports)).orderBy("module", "category", F.desc("count"), "value")
    wanted = modules if modules is not None else reports.select(F.col("name").alias("module"))
    return found, metrics.skipped(wanted, reports.select(F.col("name").alias("module")))


def inter_module(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matrix of imports between modules; Ce, Ca and instability, in order of the modules' names); both empty for fewer
    than two modules."""
    views = Reports(reports)
    several = views.modules.limit(2).count() > 1
    edges = coupling.matrix(views.imports, views.classes)
    stability = coupling.instability(edges, views.modules).orderBy("module")
    return (edges, stability) if several else (edges.limit(0), stability.limit(0))
