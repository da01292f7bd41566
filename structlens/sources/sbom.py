"""Dependency manifests in CycloneDX JSON files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..operators import manifest
from ..operators.files import allowed
from ..report import sinks
from ..schemas import SBOM


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """A row for each manifest file; unknown parts of it are left out."""
    return spark.read.schema(SBOM).json(list(paths), multiLine=True)


class Sbom:
    """The manifest that a workspace has loaded."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.data: DataFrame | None = None

    def load(self, filename: str) -> str:
        """OK, or Error for a file that is missing, outside the root, or no manifest."""
        path = os.path.join(self.root, filename)
        if not allowed(self.root, filename) or not os.path.isfile(path):
            return "Error"
        found = read(self.spark, "file://" + os.path.realpath(path))
        try:
            if found.where("metadata is not null or components is not null or dependencies is not null").isEmpty():
                return "Error"
        except Exception:  # noqa: BLE001  a file may be broken in any way
            return "Error"
        self.data = found
        return "OK"

    def loaded(self) -> str:
        return "true" if self.data is not None else "false"

    def _given(self) -> DataFrame:
        if self.data is None:
            raise ValueError("no manifest is loaded")
        return self.data

    def application(self) -> DataFrame:
        found = manifest.application(self._given()).where("application is not null")
        if found.isEmpty():
            raise ValueError("the manifest names no application")
        return found

    def components(self) -> DataFrame:
        return manifest.components(self._given())

    def licenses(self) -> DataFrame:
        return manifest.licenses(self.components())

    def dependencies(self) -> tuple[DataFrame, DataFrame]:
        """(what the application depends on directly, references among these that no component has)."""
        root = self._given().select("metadata.component.bom-ref").toDF("ref")
        return manifest.direct_dependencies(root, manifest.edges(self._given()), self.components())

    def write_reports(self, directory: str) -> list[str]:
        """Two CSV files below a directory: all licences, and every component with its licences. None without rows."""
        licenses = self.licenses().toDF("License")
        each = manifest.by_component(self.components()).toDF("Id", "Name", "Version", "Licenses")
        made = [sinks.write_csv(df, os.path.join(directory, name), f"{name}.csv") for name, df in (("AllLicenses", licenses), ("DependenciesAndLicenses", each))]
        return [p for p in made if p]
