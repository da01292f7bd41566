"""A workspace: a project tree, the state of its analysis, its module reports and the tools over them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions.scalars import DIRECTORY_FLAGS
from .operators import files, suite
from .pipeline.document import StateDocument
from .rules import facts, thresholds
from .session import written
from .sources import classfile, filetree, javasource, report
from .sources.sbom import Sbom
from .tools import Registry

#: Where the state has the modules (fixed value).
MODULES = "/modules/modules"


class Workspace:
    def __init__(self, spark: SparkSession, project: str, directory: str):
        self.spark, self.project, self.directory = spark, os.path.realpath(project), directory
        self.state = StateDocument(os.path.join(directory, "analysis.json"))
        self.sbom = Sbom(spark, self.project)

    # -- module reports -------------------------------------------------------------------------------------------

    def modules(self) -> list[dict]:
        return self.state.at(MODULES) or []

    def report_path(self, module: str) -> str:
        return os.path.join(self.directory, "Java", report.report_name(module) + ".json")

    def _flags(self, module: dict) -> list[tuple[str, bool, bool]]:
        """(directory, production, generated) of a module's special directories that lie in the project, in their order."""
        listed = ((module.get("subdirectories") or {}).get("directories")) or []
        out = []
        for d in listed:
            kind = str(d.get("categoryId", "")).lower()
            if kind not in DIRECTORY_FLAGS:
                raise ValueError(f"unknown kind of directory: {d.get('categoryId')}")
            path = os.path.normpath(os.path.join(module.get("path") or "", d["path"]))
            if files.allowed(self.project, path):
                out.append((path, *DIRECTORY_FLAGS[kind]))
        return out

    def scan(self, module: dict) -> DataFrame:
        """The report of one module, merged from its class files and then its sources."""
        root = os.path.normpath(module.get("path") or ".")
        if not files.allowed(self.project, root):
            raise ValueError(f"{root} lies outside the project")
        tree = filetree.read(self.spark, self.project)
        mine = files.below(tree, "" if root == "." else root)
        production, generated = F.lit(True), F.lit(False)
        for path, is_production, is_generated in reversed(self._flags(module)):
            inside = (F.col("directory") == path) | F.col("directory").startswith(path + "/")
            production, generated = F.when(inside, F.lit(is_production)).otherwise(production), F.when(inside, F.lit(is_generated)).otherwise(generated)
        flagged = mine.select(F.lit(module["name"]).alias("module"), production.alias("production"), generated.alias("generated"), "path", "filename")
        content = filetree.with_content(flagged.where("filename like '%.class'"), self.project)
        texts = filetree.with_text(flagged.where("filename like '%.java'"), self.project, "module", "production", "generated")
        scans = classfile.scan(content.select("module", "production", "generated", "content")).unionByName(javasource.scan(texts.select("module", "production", "generated", "filename", "text")))
        merged = report.merge(written(scans))
        known = merged.select("name").isEmpty()
        return self.spark.createDataFrame([(module["name"], [])], merged.schema) if known else merged

    def generate(self, module: dict) -> str:
        """Scans a module and writes its report; the report's id."""
        path = self.report_path(module["name"])
        report.write_json(self.scan(module), path)
        return report.report_name(module["name"])

    def generate_all(self) -> dict:
        """Reports of all modules: reused, generated, or failed; and modules that are skipped. One failure stops no other."""
        reports, skipped = [], []
        for module in self.modules():
            name = module.get("name")
            languages = ((module.get("programmingLanguages") or {}).get("programmingLanguages")) or []
            if not name:
                skipped.append(_descriptor("unknown", "ERROR", "", "the module has no name"))
            elif not any(str(x.get("name", "")).lower() == "java" for x in languages):
                skipped.append(_descriptor(name, "SKIPPED", "", "the module is not in Java"))
            elif os.path.exists(self.report_path(name)):
                reports.append(_descriptor(name, "REUSED", report.report_name(name), "the report was there"))
            else:
                try:
                    reports.append(_descriptor(name, "GENERATED", self.generate(module), "the report was missing"))
                except Exception as e:  # noqa: BLE001  a module may fail in any way
                    reports.append(_descriptor(name, "ERROR", report.report_name(name), f"{type(e).__name__}: {e}"))
        return {"reports": reports, "skipped": skipped}

    def reports(self, module: str | None = None) -> DataFrame:
        """The reports that are there, of all modules or one; a FileNotFoundError for one without."""
        if module is not None and not os.path.exists(self.report_path(module)):
            raise FileNotFoundError(f"no report of {module}")
        names = [module] if module is not None else [m["name"] for m in self.modules() if m.get("name") and os.path.exists(self.report_path(m["name"]))]
        paths = ["file://" + os.path.realpath(self.report_path(n)) for n in names]
        return report.read(self.spark, *paths) if paths else self.spark.createDataFrame([], report.MODULE)

    def findings(self) -> DataFrame:
        """What the rules say of all modules: the evaluator that needs no model."""
        views = suite.Reports(self.reports())
        depths = graph_depths(views)
        of_classes = facts.class_facts(views.classes, views.fields, views.imports, depths)
        names = views.classes.select("module", "category", F.substring_index("class", ".", -1).alias("name"))
        coverage = suite.metrics.coverage(names)[0]
        found = [
            thresholds.evaluate(views.methods, thresholds.METHOD_RULES, "module", "class", "name"),
            thresholds.evaluate(of_classes, thresholds.CLASS_RULES, "module", "class"),
            thresholds.evaluate(facts.module_facts(views.classes, views.methods, of_classes, coverage), thresholds.MODULE_RULES),
            thresholds.evaluate(facts.annotation_facts(views.classes, views.methods, views.annotations), thresholds.ANNOTATION_RULES),
            thresholds.evaluate(facts.import_facts(views.imports, suite.metrics.namespaces(views.classes)), thresholds.IMPORT_RULES),
            thresholds.evaluate(suite.inter_module(self.reports())[1], thresholds.STABILITY_RULES),
        ]
        cycles = suite.METRICS["circular_dependency"](views).unionByName(suite.METRICS["package_tangle"](views)).select("module", F.col("value").alias("component"), F.col("count").alias("size"))
        found.append(thresholds.evaluate(cycles, thresholds.CYCLE_RULES, "module", "component"))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    # -- tools ----------------------------------------------------------------------------------------------------

    def registry(self) -> Registry:
        """The tools over this workspace, under the names that callers know (fixed values), and those of plug-ins."""
        out = Registry()
        tree = lambda: filetree.read(self.spark, self.project)
        below = lambda path: files.below(tree(), _relative(path)) if files.allowed(self.project, path) else tree().limit(0)
        matched = lambda path, wildcards: files.by_pattern(below(path), wildcards)
        lines = lambda path: files.below(filetree.read(self.spark, self.project, lines=True), _relative(path))
        out.add("info_get_version", lambda: __version__, "the version of this library")
        out.add("filesystem_get_all_files_in_dir", lambda path: files.in_directory(below(path), _relative(path)).select("path").orderBy("path"), "the files directly in a directory")
        out.add("filesystem_get_matching_files_in_dir_recursively", lambda path, wildcards, skip_dot_directories=False: files.listing(matched(path, wildcards), skip_dot_directories), "files by directory that fit one of the wildcards")
        out.add("filesystem_file_exists", lambda path: files.exists(tree(), self.project, path), "true, false, or ERROR for a path outside the project")
        out.add("filesystem_count_per_filetype_and_directory", lambda path, wildcards: files.count_by_pattern(matched(path, wildcards), "directory"), "files by directory and wildcard")
        out.add("FileCountPerFileType", lambda path, wildcards: files.count_by_pattern(matched(path, wildcards)), "files by wildcard")
        out.add("GetFilesCount", lambda path, wildcard="*": str(matched(path, [wildcard or "*"]).count()), "how many files fit a wildcard")
        out.add("filestatistics_matching_files_in_dir_recursively", lambda path, wildcards: files.statistics(files.by_pattern(lines(path), wildcards)), "files and lines by wildcard")
        out.add("fileio_read_file", lambda path: filetree.read_text(self.project, path), "the text of a file")
        out.add("sbom_load_from_file", self.sbom.load, "loads a manifest")
        out.add("sbom_is_already_loaded", self.sbom.loaded, "whether a manifest is loaded")
        out.add("sbom_get_application_info", lambda: self.sbom.application().first()[0], "the application of the manifest")
        out.add("sbom_get_application_dependencies", lambda: self.sbom.dependencies()[0], "what the application depends on directly")
        out.add("sbom_get_dependencies_licenses", self.sbom.licenses, "all licences of the manifest")
        out.add("sbom_write_license_reports", lambda: self.sbom.write_reports(self.directory), "writes the licence reports")
        out.add("java_generate_module_analysis_report", lambda module: self.generate(next((m for m in self.modules() if m.get("name") == module), {"name": module})), "scans a module")
        out.add("java_generate_all_module_analysis_reports", self.generate_all, "scans all modules without a report")
        out.add("java_get_inter_module_dependency_report", lambda: suite.inter_module(self.reports()), "imports between modules and their stability")
        for metric in suite.METRICS:
            single = f"java_get_{metric}_module_report" if metric == "cyclomatic_complexity" else f"java_get_{metric}_report"
            out.add(single, lambda module, m=metric: suite.one(self.reports(module), m)[0], f"{metric} of a module")
            out.add(f"java_get_all_{metric}_reports", lambda m=metric: dict(zip(("reports", "skipped"), suite.one(self.reports(), m, self._wanted()), strict=True)), f"{metric} of all modules")
        out.plug_in()
        return out

    def _wanted(self) -> DataFrame:
        return self.spark.createDataFrame([(m["name"],) for m in self.modules() if m.get("name")], "module STRING")


def graph_depths(views: suite.Reports) -> DataFrame:
    return suite.graph.chain_depth(views.classes.select("module", "class", "super_class"))


def _relative(path: str) -> str:
    path = os.path.normpath(path or ".")
    return "" if path == "." else path


def _descriptor(module: str, status: str, name: str, reasoning: str) -> dict:
    return {"module": module, "status": status, "report": name, "reasoning": reasoning}
