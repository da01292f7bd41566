"""Findings: fixed thresholds on metrics, evaluated for all modules at once.

Urgency and criticality are this library's own scale: cycles, god classes and untested modules are HIGH; single large
members MEDIUM; conventions LOW.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    aspect: str
    condition: str
    finding: str
    urgency: str = "MEDIUM"
    criticality: str = "MEDIUM"


#: Over methods: one row a method, so conditions that need several measures of the same method are exact.
METHOD_RULES = (
    Rule("complexity", "parameter_count > 7", "more than 7 parameters"),
    Rule("complexity", "lines_of_code > 30", "more than 30 statements"),
    Rule("complexity", "complexity > 10 and parameter_count > 5 and lines_of_code > 30", "complex, long and with many parameters", "HIGH", "HIGH"),
    Rule("complexity", "complexity < 5 and lines_of_code > 40", "long but simple: could be cut", "LOW", "LOW"),
    Rule("nesting", "nesting > 4", "nested more than 4 deep"),
    Rule("nesting", "complexity > 10 and nesting < 3", "many branches side by side", "LOW"),
    Rule("nesting", "complexity < 5 and nesting > 5", "deep nesting of few branches"),
    Rule("nesting", "complexity > 10 and nesting > 5", "complex and deep", "HIGH", "HIGH"),
    Rule("booleans", "n_booleans >= 3", "three or more boolean parameters", "LOW", "LOW"),
)
CLASS_RULES = (
    Rule("fields", "n_fields > 10 and n_methods > 20", "god class", "HIGH", "HIGH"),
    Rule("methods", "n_methods > 20", "more than 20 methods"),
    Rule("fields", "n_open > 0", "public fields that are no constants", "LOW"),
    Rule("inheritance", "depth > 3", "more than 3 superclasses"),
    Rule("inheritance", "n_interfaces > 5", "more than 5 interfaces"),
    Rule("coupling", "n_external > 20", "more than 20 external imports"),
    Rule("data", "is_data_class", "data class", "NONE", "LOW"),
)
#: Over totals of each module's production code; facts.module_facts() makes them.
MODULE_RULES = (
    Rule("visibility", "2 * n_public > n_all", "more than half of the methods are public", "LOW", "LOW"),
    Rule("visibility", "10 * n_public > 8 * n_all and n_private = 0 and n_protected = 0", "nothing is hidden"),
    Rule("visibility", "10 * n_static > 4 * n_all", "more than 40 % of the methods are static", "LOW"),
    Rule("documentation", "2 * n_documented < n_classes", "fewer than half of the classes are documented", "LOW", "LOW"),
    Rule("tests", "n_classes > 0 and n_tests = 0", "no tests", "HIGH", "HIGH"),
    Rule("tests", "coverage < 50", "fewer than half of the classes have a test of their name", "MEDIUM", "HIGH"),
    Rule("coupling", "n_external > 10 * n_classes", "more than 10 external imports a class on average"),
    Rule("inheritance", "n_classes > 0 and max_depth = 0", "no class extends another", "NONE", "NONE"),
)
ANNOTATION_RULES = (
    Rule("annotations", "n_annotations * all_classes > all_annotations * n_classes", "more annotations a class than on average", "LOW", "LOW"),
    Rule("annotations", "n_overridable > 0 and 5 * n_overriding < n_overridable", "fewer than 20 % of the methods that could override are marked", "LOW", "LOW"),
    Rule("annotations", "n_qualified > 0 and 10 * n_framework > 6 * n_annotations", "more than 60 % of the annotations are of one framework", "LOW"),
)
IMPORT_RULES = (
    Rule("imports", "10 * n_external > 8 * n_imports", "more than 80 % of the imports are external", "LOW"),
    Rule("imports", "2 * n_top > n_external", "more than 50 % of the external imports have one prefix", "LOW"),
    Rule("imports", "10 * n_java > 4 * n_external", "more than 40 % of the external imports are of the standard library", "NONE", "NONE"),
)
STABILITY_RULES = (
    Rule("stability", "ce = 0 and ca = 0", "coupled with no other module", "LOW", "LOW"),
    Rule("stability", "ce + ca > 0 and instability < 30", "stable", "NONE", "NONE"),
    Rule("stability", "instability > 70", "unstable", "LOW", "LOW"),
    Rule("stability", "ca > 2 and instability > 70", "unstable but widely used", "HIGH", "HIGH"),
)
CYCLE_RULES = (
    Rule("cycles", "size > 1", "cycle", "HIGH", "HIGH"),
    Rule("cycles", "size > 3", "cycle of more than 3", "HIGH", "HIGH"),
)


def evaluate(rows: DataFrame, rules: tuple[Rule, ...], key: str = "module", *subject: str) -> DataFrame:
    """(module, subject, aspect, finding, urgency, criticality): every rule on every row in one pass; nulls break none."""
    hit = [
        F.when(
            F.coalesce(F.expr(r.condition), F.lit(False)),
            F.struct(F.lit(r.aspect).alias("aspect"), F.lit(r.finding).alias("finding"), F.lit(r.urgency).alias("urgency"), F.lit(r.criticality).alias("criticality")),
        )
        for r in rules
    ]
    found = F.explode(F.filter(F.array(*hit), lambda x: x.isNotNull())).alias("f")
    about = F.concat_ws(".", *subject) if subject else F.lit("")
    return rows.select(F.col(key).cast("string").alias("module"), about.alias("subject"), found).select("module", "subject", "f.*")


def shares(distribution: DataFrame, percent: int, finding: str, aspect: str) -> DataFrame:
    """Findings for modules where one value has more than a share of a distribution."""
    total = distribution.groupBy("module").agg(F.sum("count").alias("total"), F.max_by(F.col("value"), F.struct("count", "value")).alias("top"), F.max("count").alias("most"))
    rule = Rule(aspect, f"most * 100 > total * {percent}", finding, "LOW", "LOW")
    return evaluate(total, (rule,), "module", "top")


def grouped(findings: DataFrame) -> DataFrame:
    """Each finding once, with all modules that share it in order."""
    return findings.groupBy("aspect", "finding", "urgency", "criticality").agg(
        F.array_join(F.array_sort(F.collect_set("module")), ", ").alias("modules"), F.count("*").alias("occurrences")
    )


def unstable_dependencies(edges: DataFrame, stability: DataFrame, low: int = 30, high: int = 70) -> DataFrame:
    """(from, to): stable modules (instability under low) that depend on unstable ones (over high)."""
    stable = stability.where((F.col("ce") + F.col("ca") > 0) & (F.col("instability") < low)).select(F.col("module").alias("from"))
    unstable = stability.where(F.col("instability") > high).select(F.col("module").alias("to"))
    return edges.join(stable, "from", "left_semi").join(unstable, "to", "left_semi").select("from", "to")
