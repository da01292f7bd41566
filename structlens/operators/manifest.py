"""Operators over dependency manifests: components, edges and licences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import component_label, license_label


def components(sbom: DataFrame) -> DataFrame:
    """(ref, label, version, licenses) of each component."""
    each = sbom.select(F.explode("components").alias("c"))
    labels = F.transform("c.licenses", lambda x: F.coalesce(license_label(x["license"]), x["expression"]))
    return each.select(F.col("c.bom-ref").alias("ref"), component_label(F.col("c.group"), F.col("c.name")).alias("label"), F.col("c.version").alias("version"), F.coalesce(F.filter(labels, lambda x: x.isNotNull()), F.array()).alias("licenses"))


def edges(sbom: DataFrame) -> DataFrame:
    return sbom.select(F.explode("dependencies").alias("d")).select(F.col("d.ref").alias("src"), F.explode("d.dependsOn").alias("dst"))


def direct_dependencies(root: DataFrame, edges: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what the root (ref) depends on, as components; its references that no component has)."""
    wanted = edges.join(root.select(F.col("ref").alias("src")), "src", "left_semi").select(F.col("dst").alias("ref")).distinct()
    return components.join(wanted, "ref", "left_semi"), wanted.join(components, "ref", "left_anti")


def licenses(components: DataFrame) -> DataFrame:
    """Distinct licences in order."""
    return components.select(F.explode("licenses").alias("license")).distinct().orderBy("license")


def by_component(components: DataFrame) -> DataFrame:
    """(id, name, version, licenses): licences joined by ", ", "" without one, in order of id."""
    return components.select(F.col("ref").alias("id"), F.col("label").alias("name"), "version", F.array_join("licenses", ", ").alias("licenses")).orderBy("id", "name")


def application(sbom: DataFrame) -> DataFrame:
    c = F.col("metadata.component")
    return sbom.select(F.concat(component_label(c["group"], c["name"]), F.lit(" in version "), c["version"]).alias("application"))
