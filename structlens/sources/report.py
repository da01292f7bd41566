"""Module reports: reading, writing, merging scans, and flattening to the views that metrics take."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import boolean_parameters, category, is_data_class, is_documented, package_of
from ..schemas import MODULE


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """Reports from JSON files, one object each."""
    return spark.read.schema(MODULE).json(list(paths), multiLine=True)


def write(reports: DataFrame, path: str) -> None:
    """Reports as Parquet by module: a module's report is one partition to prune to."""
    reports.withColumn("module", F.col("name")).write.mode("overwrite").partitionBy("module").parquet(path)


def write_json(reports: DataFrame, path: str) -> None:
    """The report of one module as an indented JSON file."""
    text = reports.select(F.to_json(F.struct("name", "packages"))).first()[0]
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(json.loads(text), f, indent=1, ensure_ascii=False)


def report_name(module: str) -> str:
    return "Java_" + module.replace(" ", "_")


def classes(reports: DataFrame) -> DataFrame:
    """A row for each class with its nested members; categories and packages are computed here once."""
    packages = reports.select(F.col("name").alias("module"), F.explode("packages").alias("p"))
    units = packages.select("module", F.col("p.name").alias("package"), F.explode("p.buildUnits").alias("u"))
    each = units.select(
        "module", "package", F.col("u.name").alias("unit"), category(F.col("u.production"), F.col("u.generated")).alias("category"),
        F.coalesce("u.imports", F.array()).alias("unit_imports"), F.explode("u.clazzes").alias("c"),
    )
    fields, methods = F.coalesce("c.fields", F.array()), F.coalesce("c.methods", F.array())
    top = F.when(F.col("c.superClass") != "java.lang.Object", F.col("c.superClass"))
    return each.select(
        "module", "category", "package", "unit", "unit_imports", F.col("c.qualifiedName").alias("class"), top.alias("super_class"),
        F.size(F.array_distinct(F.coalesce("c.interfaces", F.array()))).alias("n_interfaces"), F.size(fields).alias("n_fields"), F.size(methods).alias("n_methods"),
        is_documented(F.col("c.documentation")).alias("documented"), is_data_class(fields, methods).alias("is_data_class"),
        fields.alias("fields"), methods.alias("methods"), F.coalesce("c.annotations", F.array()).alias("annotations"),
    )


def methods(classes: DataFrame) -> DataFrame:
    each = classes.select("module", "category", "class", F.explode("methods").alias("m"))
    return each.select(
        "module", "category", "class", F.col("m.name").alias("name"), F.col("m.visibility").alias("visibility"), F.coalesce("m.isStatic", F.lit(False)).alias("is_static"),
        F.coalesce("m.isFinal", F.lit(False)).alias("is_final"), F.col("m.parameterCount").alias("parameter_count"), F.col("m.linesOfCode").alias("lines_of_code"),
        F.col("m.cyclomaticComplexity").alias("complexity"), F.col("m.nestingDepth").alias("nesting"), is_documented(F.col("m.documentation")).alias("documented"),
        F.coalesce(boolean_parameters(F.col("m.descriptor")), F.lit(0)).alias("n_booleans"), F.coalesce("m.annotations", F.array()).alias("annotations"),
    )


def fields(classes: DataFrame) -> DataFrame:
    each = classes.select("module", "category", "class", F.explode("fields").alias("f"))
    flag = lambda n: F.coalesce(f"f.{n}", F.lit(False))
    return each.select("module", "category", "class", F.col("f.name").alias("name"), F.col("f.visibility").alias("visibility"), flag("isStatic").alias("is_static"), flag("isFinal").alias("is_final"))


def imports(classes: DataFrame) -> DataFrame:
    """A row for each import of a class's build unit, one with a null import for a class without."""
    return classes.select("module", "category", "package", "unit", "class", F.explode_outer("unit_imports").alias("import"))


def annotations(classes: DataFrame) -> DataFrame:
    """Annotations of classes and methods by qualified name, else by simple name."""
    of_methods = methods(classes).select("module", "category", F.explode("annotations").alias("a"))
    both = classes.select("module", "category", F.explode("annotations").alias("a")).unionAll(of_methods)
    return both.select("module", "category", F.coalesce("a.qualifiedName", "a.name").alias("name"))


def merge(scans: DataFrame) -> DataFrame:
    """Reports of (module, package, unit, production, generated, imports, class struct, scan), one row a class and scan.

    Later scans decide flags and replace methods of the same descriptor; a method without a descriptor replaces the one
    of its name if there is just one, else it is dropped. Imports, interfaces and fields are united without repeats.
    """
    flags = scans.groupBy("module", "package", "unit").agg(
        F.max_by("production", "scan").alias("production"), F.max_by("generated", "scan").alias("generated"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("imports")))).alias("imports")
    )
    keys = ["module", "package", "unit", F.col("clazz.qualifiedName").alias("class")]
    method = scans.select(*keys, "scan", F.posexplode("clazz.methods").alias("pos", "m"))
    named = method.where("m.descriptor is not null").groupBy("module", "package", "unit", "class", F.col("m.descriptor").alias("d")).agg(F.max_by("m", F.struct("scan", "pos")).alias("m"))
    loose = method.where("m.descriptor is null").groupBy("module", "package", "unit", "class", F.col("m.name").alias("n")).agg(F.max_by("m", F.struct("scan", "pos")).alias("loose"))
    sole = named.groupBy("module", "package", "unit", "class", F.col("m.name").alias("n")).agg(F.count("*").alias("same"))
    placed = named.withColumn("n", F.col("m.name")).join(sole, ["module", "package", "unit", "class", "n"]).join(loose, ["module", "package", "unit", "class", "n"], "left")
    taken = F.when((F.col("same") == 1) & F.col("loose").isNotNull(), F.col("loose").withField("descriptor", F.col("d"))).otherwise(F.col("m"))
    merged = placed.groupBy("module", "package", "unit", "class").agg(F.array_sort(F.collect_list(F.struct(F.col("d").alias("k"), taken.alias("m"))), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)).alias("ms"))
    last = scans.groupBy(*keys).agg(
        F.max_by("clazz", "scan").alias("c"), F.flatten(F.collect_list("clazz.interfaces")).alias("interfaces"), F.flatten(F.collect_list("clazz.fields")).alias("fields"),
        F.max_by("clazz.superClass", F.when(F.col("clazz.superClass").isNotNull(), F.col("scan"))).alias("superClass"),
    )
    full = last.join(merged, ["module", "package", "unit", "class"], "left")
    by_name = F.array_distinct(F.transform("fields", lambda f: f["name"]))
    first = F.transform(by_name, lambda n: F.element_at(F.filter("fields", lambda f: f["name"] == n), -1))
    clazz = F.col("c").withField("interfaces", F.array_distinct("interfaces")).withField("fields", first).withField("superClass", F.col("superClass")).withField("methods", F.coalesce(F.transform("ms", lambda x: x["m"]), F.expr("filter(c.methods, x -> false)")))
    units = full.groupBy("module", "package", "unit").agg(F.array_sort(F.collect_list(clazz), lambda a, b: F.when(a["qualifiedName"] < b["qualifiedName"], -1).otherwise(1)).alias("clazzes")).join(flags, ["module", "package", "unit"])
    unit = F.struct(F.col("unit").alias("name"), "production", "generated", "imports", "clazzes")
    packages = units.groupBy("module", "package").agg(F.collect_list(unit).alias("buildUnits"))
    return packages.groupBy(F.col("module").alias("name")).agg(F.collect_list(F.struct(F.col("package").alias("name"), "buildUnits")).alias("packages"))


def status(modules: DataFrame, existing: DataFrame) -> DataFrame:
    """(module, status) of (name, languages) modules: ERROR without a name, SKIPPED without Java, REUSED or GENERATED."""
    is_java = F.exists(F.coalesce("languages", F.array()), lambda x: F.lower(x) == "java")
    known = existing.select(F.col("name").alias("module")).distinct().withColumn("there", F.lit(True))
    named = modules.select(F.col("name").alias("module"), is_java.alias("is_java")).join(known, "module", "left")
    kind = F.when(F.coalesce("module", F.lit("")) == "", "ERROR").when(~F.col("is_java"), "SKIPPED").when(F.col("there"), "REUSED").otherwise("GENERATED")
    return named.select("module", kind.alias("status"))


__all__ = ["annotations", "classes", "fields", "imports", "merge", "methods", "package_of", "read", "report_name", "status", "write"]
