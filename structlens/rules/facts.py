"""What the rules look at: a row for each class or module with all columns that a rule table names.

Everything takes the flattened views of structlens.sources.report and is computed for all modules at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_external, prefix

PRODUCTION = "category = 'production'"


def _external() -> Column:
    return F.coalesce(is_external(F.col("import"), F.col("package")), F.lit(False))


def class_facts(classes: DataFrame, fields: DataFrame, imports: DataFrame, depths: DataFrame) -> DataFrame:
    """(module, category, class, n_fields, n_methods, n_interfaces, is_data_class, n_open, n_external, depth) for CLASS_RULES.

    n_open counts public fields that aren't constants, n_external external imports, depth superclasses (of chain_depth()).
    """
    keys = ["module", "category", "class"]
    constant = F.col("is_static") & F.col("is_final")
    open_ = fields.groupBy(*keys).agg(F.count_if((F.col("visibility") == "PUBLIC") & ~constant).alias("n_open"))
    outside = imports.groupBy(*keys).agg(F.count_if(_external()).alias("n_external"))
    each = classes.select(*keys, "n_fields", "n_methods", "n_interfaces", "is_data_class")
    return each.join(open_, keys, "left").join(outside, keys, "left").join(depths.select("module", "class", "depth"), ["module", "class"], "left").fillna(0, ["n_open", "n_external", "depth"])


def module_facts(classes: DataFrame, methods: DataFrame, class_facts: DataFrame, coverage: DataFrame) -> DataFrame:
    """Totals of each module for MODULE_RULES: methods by visibility, classes, documentation, tests, depth, coupling, and the
    ratio of coverage (module, value, count)."""
    of_methods = methods.where(PRODUCTION).groupBy("module").agg(
        F.count("*").alias("n_all"), F.count_if(F.col("visibility") == "PUBLIC").alias("n_public"), F.count_if(F.col("visibility") == "PRIVATE").alias("n_private"),
        F.count_if(F.col("visibility") == "PROTECTED").alias("n_protected"), F.count_if("is_static").alias("n_static"),
    )
    of_classes = classes.groupBy("module").agg(
        F.count_if(F.expr(PRODUCTION)).alias("n_classes"), F.count_if(F.expr(PRODUCTION) & F.col("documented")).alias("n_documented"), F.count_if(F.col("category") == "test").alias("n_tests")
    )
    of_facts = class_facts.where(PRODUCTION).groupBy("module").agg(F.max("depth").alias("max_depth"), F.sum("n_external").alias("n_external"))
    ratio = coverage.where("value = 'COVERAGE_RATIO_PERCENT'").select("module", F.col("count").alias("coverage"))
    return of_classes.join(of_methods, "module", "left").join(of_facts, "module", "left").join(ratio, "module", "left")


def annotation_facts(classes: DataFrame, methods: DataFrame, annotations: DataFrame) -> DataFrame:
    """(module, n_annotations, n_classes, all_annotations, all_classes, n_overriding, n_overridable, n_qualified, n_framework)
    for ANNOTATION_RULES.

    all_ are sums over all modules. Methods of classes with a superclass or interfaces could override; a framework is the
    first two segments of a qualified annotation, and n_framework the annotations of the most frequent one.
    """
    counted = annotations.groupBy("module").agg(F.count("*").alias("n_annotations"))
    sized = classes.groupBy("module").agg(F.count("*").alias("n_classes")).join(counted, "module", "left").fillna(0, ["n_annotations"])
    whole = sized.agg(F.sum("n_annotations").alias("all_annotations"), F.sum("n_classes").alias("all_classes"))
    heirs = classes.where("super_class is not null or n_interfaces > 0").select("module", "category", "class")
    override = F.exists("annotations", lambda a: a["name"] == "Override")
    overriding = methods.join(heirs, ["module", "category", "class"], "left_semi").groupBy("module").agg(F.count("*").alias("n_overridable"), F.count_if(override).alias("n_overriding"))
    by_framework = annotations.where(F.col("name").contains(".")).groupBy("module", prefix(F.col("name")).alias("framework")).agg(F.count("*").alias("n"))
    top = by_framework.groupBy("module").agg(F.sum("n").alias("n_qualified"), F.max("n").alias("n_framework"))
    return sized.join(F.broadcast(whole)).join(overriding, "module", "left").join(top, "module", "left").fillna(0)


def import_facts(imports: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(module, n_imports, n_external, n_java, n_top) for IMPORT_RULES: all imports, those outside the module's namespace
    (module, namespace), of these the ones of java. and javax., and those of the most frequent prefix."""
    used = imports.where("import is not null").join(namespaces, "module", "left")
    inside = F.coalesce((F.col("import") == F.col("namespace")) | F.col("import").startswith(F.concat("namespace", F.lit("."))), F.lit(False))
    java = F.col("import").startswith("java.") | F.col("import").startswith("javax.")
    counted = used.groupBy("module", prefix(F.col("import")).alias("prefix")).agg(F.count("*").alias("n"), F.count_if(~inside).alias("outside"), F.count_if(~inside & java).alias("java"))
    return counted.groupBy("module").agg(F.sum("n").alias("n_imports"), F.sum("outside").alias("n_external"), F.sum("java").alias("n_java"), F.max("outside").alias("n_top"))


def cycle_facts(components: DataFrame, module: str | Column = "all") -> DataFrame:
    """(module, component, size) of (component, node) for CYCLE_RULES."""
    named = F.lit(module) if isinstance(module, str) else module
    return components.groupBy("component").agg(F.count("*").alias("size")).select(named.alias("module"), "component", "size")
