"""Longest-prefix ownership and the module dependency matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def longest_prefix(names: DataFrame, owners: DataFrame, name: str = "name", separator: str = ".") -> DataFrame:
    """names with owner and prefix: the owner (owner, prefix) of the longest prefix of whole segments; null without one.

    Every name becomes its prefixes, and those an equality join: no comparison of all names with all prefixes. Ties go
    to the smallest owner. A closing ".*" is no segment.
    """
    plain = F.regexp_replace(name, r"\.\*$", "")
    parts = F.split(plain, F.lit("\\" + separator) if separator in ".|*+?" else F.lit(separator))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))
    distinct = names.select(name).where(F.col(name).isNotNull()).distinct()
    candidates = distinct.select(name, F.explode(prefixes).alias("prefix"))
    known = owners.groupBy("prefix").agg(F.min("owner").alias("owner"))
    best = candidates.join(known, "prefix").groupBy(name).agg(F.max_by(F.struct("owner", "prefix"), F.length("prefix")).alias("best"))
    return names.join(best.select(name, "best.owner", "best.prefix"), name, "left")


def matrix(imports: DataFrame, classes: DataFrame, compat: bool = False) -> DataFrame:
    """(from, to, import_count): imports of each module that another module owns.

    An import of a class that a module has goes to that module; others to the module with the longest owning package.
    The importing module owns its packages, too, and such imports drop out as self edges; with compat it is no
    candidate, and they go to the next owner.
    """
    used = imports.where("import is not null").where("not (startswith(import, 'static ') or startswith(import, 'java.') or startswith(import, 'javax.'))")
    counted = used.groupBy("module", "import").agg(F.count("*").alias("n"))
    exact = classes.groupBy("class").agg(F.collect_set("module").alias("owners"))
    direct = counted.join(exact, counted["import"] == exact["class"], "left")
    others = F.array_except("owners", F.array("module"))
    mine = F.array_contains("owners", F.col("module"))
    to_class = direct.where((F.size(others) > 0) & (F.lit(compat) | ~mine)).select(F.col("module").alias("from"), F.array_min(others).alias("to"), "n")
    rest = direct.where("owners is null" if not compat else "owners is null or size(array_except(owners, array(module))) = 0").select("module", "import", "n")
    packages = classes.select(F.col("module").alias("owner"), F.col("package").alias("prefix")).where("prefix <> ''").distinct()
    if compat:
        parts = F.split(F.regexp_replace("import", r"\.\*$", ""), r"\.")
        prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
        found = rest.withColumn("prefix", F.explode(prefixes)).join(packages, "prefix").where("owner <> module")
        best = found.groupBy("module", "import", "n").agg(F.min(F.struct((-F.length("prefix")).alias("l"), "owner")).alias("b"))
        to_package = best.select(F.col("module").alias("from"), F.col("b.owner").alias("to"), "n")
    else:
        to_package = longest_prefix(rest, packages, "import").where("owner is not null").select(F.col("module").alias("from"), F.col("owner").alias("to"), "n")
    return weights(to_class.unionByName(to_package))


def weights(uses: DataFrame) -> DataFrame:
    """(from, to, import_count) of (from, to, n), without self edges."""
    return uses.where(F.col("from") != F.col("to")).groupBy("from", "to").agg(F.sum("n").alias("import_count"))


def instability(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, ce, ca, instability) of (from, to): distinct targets and sources, and 100 ce / (ce + ca) rounded down;
    0 for modules without either."""
    ce = edges.groupBy(F.col("from").alias("module")).agg(F.countDistinct("to").alias("ce"))
    ca = edges.groupBy(F.col("to").alias("module")).agg(F.countDistinct("from").alias("ca"))
    full = modules.select("module").distinct().join(ce, "module", "left").join(ca, "module", "left").fillna(0, ["ce", "ca"])
    return full.withColumn("instability", F.expr("if(ce + ca > 0, (ce * 100) div (ce + ca), 0)").cast("int"))
