"""Metrics, graphs, coupling, files and manifests on small hand-made inputs."""

import random

import pytest
from pyspark.sql import functions as F

from structlens.functions import scalars
from structlens.operators import coupling, files, graph, manifest, metrics
from structlens.rules import facts, thresholds
from structlens.sources import report


def method(name, descriptor=None, cc=None, visibility=None, loc=None, params=0, nesting=0, doc=None, static=False, final=False, annotations=()):
    return {
        "name": name, "descriptor": descriptor, "documentation": doc, "annotations": [{"name": a.rpartition(".")[2], "qualifiedName": a if "." in a else None} for a in annotations], "cyclomaticComplexity": cc,
        "visibility": visibility, "isStatic": static, "isFinal": final, "parameterCount": params, "linesOfCode": loc, "nestingDepth": nesting,
    }


def clazz(name, methods=(), fields=(), parent=None, interfaces=(), doc=None, annotations=()):
    return {
        "qualifiedName": name, "documentation": doc, "superClass": parent, "interfaces": list(interfaces), "annotations": [{"name": a, "qualifiedName": None} for a in annotations],
        "fields": [{"name": n, "type": "int", "visibility": v, "isStatic": False, "isFinal": False} for n, v in fields], "methods": list(methods),
    }


def unit(name, classes, production=True, generated=False, imports=()):
    return {"name": name, "production": production, "generated": generated, "imports": list(imports), "clazzes": list(classes)}


@pytest.fixture(scope="module")
def reports(spark):
    from structlens.schemas import MODULE

    core = [
        {"name": "a", "buildUnits": [
            unit("a.A", [clazz("a.A", [method("x", "x(IZ)V", 3, "PUBLIC", 10, 2, 2, "says", annotations=["Override"]), method("y", "yZZ(ZZZ)V", None, None, None, 3, 0, "  ")], [("f", "PRIVATE")], None, ["I"], "doc", ["Deprecated"])], imports=["b.B", "java.util.List", "java.lang.String", "static q.R.s", "undotted"]),
            unit("a.ATest", [clazz("a.ATest", [method("t", "t()V", 1, "PUBLIC", 1)])], production=False),
            unit("a.G", [clazz("a.G", [], [("p", "PUBLIC")], "a.A")], generated=True), unit("a.T", [clazz("a.T", [], (), "java.lang.Object")], production=False, generated=True),
        ]},
        {"name": "b", "buildUnits": [unit("b.B", [clazz("b.B", [method("get", "get()I", 1, "PUBLIC", 1)], [("v", "PRIVATE")], "a.G")], imports=["a.A", "b.sub.C", "b.B"]), unit("b.AbstractX", [clazz("b.AbstractX", [], (), "lib.Other")])]},
    ]
    api = [{"name": "c.api", "buildUnits": [unit("c.api.C", [clazz("c.api.C")], imports=["a.A", "a.zzz.Q", "b.*", "javax.x.Y", "c.api.D", "none.N"])]}]
    return spark.createDataFrame([("core", core), ("api", api), ("empty", [])], MODULE)


@pytest.fixture(scope="module")
def views(reports):
    classes = report.classes(reports)
    return classes, report.methods(classes), report.fields(classes), report.imports(classes), reports.select(F.col("name").alias("module"))


def table(df, *columns):
    return {tuple(r) for r in (df.select(*columns) if columns else df).collect()}


def test_categories(views):
    assert table(views[0], "class", "category") == {("a.A", "production"), ("a.ATest", "test"), ("a.G", "generated"), ("a.T", "generated"), ("b.B", "production"), ("b.AbstractX", "production"), ("c.api.C", "production")}


def test_visibility_has_all_totals(views):
    _, methods, fields, _, modules = views
    got = table(metrics.visibility(methods, modules), "module", "category", "value", "count")
    assert ("core", "production", "PUBLIC", 2) in got and ("core", "production", "UNKNOWN", 1) in got
    assert {x for x in got if x[2] in ("STATIC", "FINAL")} == {(m, c, f, 0) for m in ("core", "api", "empty") for c in scalars.CATEGORIES for f in ("STATIC", "FINAL")}
    assert ("core", "production", "TOTAL", 2) in table(metrics.visibility(fields, modules, with_total=True), "module", "category", "value", "count")


def test_histograms(views):
    classes, methods, *_ = views
    assert table(metrics.histogram(methods, "complexity"), "category", "value", "count") == {("production", "3", 1), ("production", "1", 1), ("test", "1", 1)}
    assert table(metrics.field_method_ratio(classes), "category", "value", "count") == {("production", "50", 1), ("production", "100", 1), ("test", "0", 1)}
    total = metrics.histogram(methods, F.lit(1)).agg(F.sum("count")).first()[0]
    assert total == methods.count()


def test_coupling_counts(views):
    imports = views[3]
    got = table(metrics.coupling(imports), "module", "category", "value", "count")
    assert got == {("core", "production", "3", 1), ("core", "test", "0", 1), ("core", "generated", "0", 2), ("core", "production", "1", 1), ("core", "production", "0", 1), ("api", "production", "5", 1)}
    assert ("core", "java.util", 1) in table(metrics.module_dependencies(imports), "module", "value", "count")
    assert "undotted" not in {r.value for r in metrics.module_dependencies(imports).collect()}


def test_documentation(views):
    classes, methods, *_, modules = views
    got = table(metrics.documentation(classes, methods, modules), "module", "category", "value", "count")
    assert ("core", "production", "DOCUMENTED_CLASSES", 1) in got and ("core", "production", "TOTAL_CLASSES", 3) in got and ("core", "production", "DOCUMENTED_METHODS", 1) in got
    assert len(got) == 3 * 3 * 4


def test_coverage(spark):
    rows = [("m", "production", n) for n in ("A", "B", "AbstractC", "A")] + [("m", "test", "ATests"), ("m", "test", "ZTest"), ("n", "test", "Q")]
    summary, untested = metrics.coverage(spark.createDataFrame(rows, "module STRING, category STRING, name STRING"))
    assert table(summary) == {("m", "TOTAL", 2), ("m", "TESTED", 1), ("m", "UNTESTED", 1), ("m", "COVERAGE_RATIO_PERCENT", 50)}
    assert table(untested) == {("m", "B")}


def test_diversity_and_namespaces(views):
    classes, _, _, imports, _ = views
    names = metrics.namespaces(classes)
    assert table(names) == {("core", "a"), ("api", "c.api")}
    got = table(metrics.import_diversity(imports, names), "module", "value", "count")
    assert ("core", "java.util (external)", 1) in got and ("api", "c.api (internal)", 1) in got


def test_batch_equals_single(views):
    _, methods, fields, _, modules = views
    both = metrics.batch({"cc": metrics.histogram(methods, "complexity"), "fields": metrics.visibility(fields, modules)})
    assert table(both.where("metric = 'cc'"), "module", "category", "value", "count") == table(metrics.histogram(methods, "complexity"), "module", "category", "value", "count")
    assert table(metrics.skipped(modules, methods), "module") == {("api",), ("empty",)}


def test_data_classes_and_booleans(views):
    classes, methods, *_ = views
    assert table(classes.where("is_data_class"), "class") == {("a.G",), ("b.B",)}
    assert table(methods, "name", "n_booleans") == {("x", 1), ("y", 3), ("t", 0), ("get", 0)}


def test_boolean_parameters_count_only_parameters(spark):
    rows = spark.createDataFrame([("fooZZ(Z)V", 1), ("f(LZed;[Z[[ZZ)Z", 1), ("f()Z", 0), ("f(IZJZ)V", 2), ("(boolean,Zebra,boolean[],boolean)int", 2), ("(Z)boolean", 1), ("<init>()", 0)], "d STRING, n INT")
    assert rows.where(scalars.boolean_parameters(F.col("d")) != F.col("n")).count() == 0


def test_annotations(views):
    assert table(report.annotations(views[0]).groupBy("name").count()) == {("Override", 1), ("Deprecated", 1)}


def test_strong_components(spark):
    edges = [("a", "b"), ("b", "a"), ("c", "c"), ("d", "e"), ("e", "f"), ("f", "d"), ("f", "a"), ("x", "y"), ("y", "z")]
    got = table(graph.strong_components(spark.createDataFrame(edges, "src STRING, dst STRING")))
    assert got == {("a", "a"), ("a", "b"), ("d", "d"), ("d", "e"), ("d", "f")}
    assert graph.strong_components(spark.createDataFrame([("a", "b")], "src STRING, dst STRING")).count() == 0


def test_chain_depth(spark):
    rows = [("m", "a", None), ("m", "b", "a"), ("m", "c", "b"), ("m", "d", "c"), ("m", "e", "out"), ("m", "f", "e"), ("m", "u", "v"), ("m", "v", "u"), ("m", "w", "u"), ("n", "b", "a"), ("m", "s", "s")]
    got = {(m, c): d for m, c, d in table(graph.chain_depth(spark.createDataFrame(rows, "module STRING, class STRING, super_class STRING")))}
    assert got == {("m", "a"): 0, ("m", "b"): 1, ("m", "c"): 2, ("m", "d"): 3, ("m", "e"): 1, ("m", "f"): 2, ("m", "u"): 1, ("m", "v"): 1, ("m", "w"): 2, ("n", "b"): 1, ("m", "s"): 0}


def test_class_and_package_graphs(views):
    classes, _, _, imports, _ = views
    assert table(graph.class_graph(imports, classes)) == {("a.A", "b.B"), ("b.B", "a.A")}
    assert table(graph.package_graph(imports, classes), "src", "dst") == {("a", "b"), ("b", "a")}


def test_longest_prefix(spark):
    owners = spark.createDataFrame([("m1", "com.x"), ("m2", "com.x.api"), ("m0", "com.x"), ("m3", "com")], "owner STRING, prefix STRING")
    names = spark.createDataFrame([("com.x.api.Foo",), ("com.x.Foo",), ("com.xy.Foo",), ("org.y",), ("com.x.api.*",), (None,)], "name STRING")
    got = {r.name: r.owner for r in coupling.longest_prefix(names, owners).collect()}
    assert got == {"com.x.api.Foo": "m2", "com.x.Foo": "m0", "com.xy.Foo": "m3", "org.y": None, "com.x.api.*": "m2", None: None}


def test_matrix_and_instability(views):
    classes, _, _, imports, modules = views
    edges = coupling.matrix(imports, classes)
    assert table(edges) == {("api", "core", 3)}
    assert table(coupling.instability(edges, modules)) == {("api", 1, 0, 100), ("core", 0, 1, 0), ("empty", 0, 0, 0)}


def test_own_module_owns_its_prefix(spark):
    classes = spark.createDataFrame([("core", "com.x.Core", "com.x"), ("api", "com.x.api.A", "com.x.api")], "module STRING, class STRING, package STRING")
    imports = spark.createDataFrame([("api", "com.x.api.Unknown")], "module STRING, import STRING")
    assert coupling.matrix(imports, classes).count() == 0
    assert table(coupling.matrix(imports, classes, compat=True)) == {("api", "core", 1)}


@pytest.mark.parametrize(("glob", "yes", "no"), [("*.java", ["a.java", ".java"], ["a.jav", "a.java.x"]), ("?.[ch]", ["a.c", "b.h"], ["ab.c", "a.d"]), ("*.{h,hpp,cc}", ["x.hpp", "x.cc"], ["x.c"]), ("[!a]*", ["b"], ["a1"]), ("a+b(c)", ["a+b(c)"], ["aab(c)"])])
def test_globs(spark, glob, yes, no):
    rows = spark.createDataFrame([(n,) for n in yes + no], "n STRING")
    assert {r.n for r in rows.where(scalars.matches_glob(F.col("n"), glob)).collect()} == set(yes)


def test_file_patterns(spark):
    rows = spark.createDataFrame([("src/A.java", "src", "A.java", 3), ("src/b.txt", "src", "b.txt", None), ("src/.git/x.java", "src/.git", "x.java", 1), ("R.md", "", "R.md", 2)], "path STRING, directory STRING, filename STRING, lines LONG")
    matched = files.by_pattern(rows, ["*.java", "*", "A.*", "*.zip"])
    assert table(files.statistics(matched)) == {("*.java", 2, 4), ("*", 4, 6), ("A.*", 1, 3)}
    assert table(files.count_by_pattern(matched, "directory")) >= {("src", "*.java", 1), ("", "*", 1)}
    assert {r.directory: list(r.files) for r in files.listing(rows, skip_dot_directories=True).collect()} == {"src": ["A.java", "b.txt"], "": ["R.md"]}
    assert files.below(rows, "src").count() == 3 and files.in_directory(rows, "src").count() == 2
    assert files.exists(rows, "/tmp", "src/A.java") == "true" and files.exists(rows, "/tmp", "no") == "false" and files.exists(rows, "/tmp", "../x") == "ERROR"


def test_manifest(spark, tmp_path):
    import json

    from structlens.schemas import SBOM

    component = lambda ref, group=None, licenses=None: {"bom-ref": ref, "group": group, "name": f"n{ref}", "version": "1", "licenses": licenses}
    doc = {
        "metadata": {"component": component("root", "g")},
        "components": [component("a", "g", [{"license": {"id": "MIT"}}, {"license": {"id": "x", "name": "Apache"}}]), component("b", None, [{"expression": "MIT OR GPL"}]), component("c")],
        "dependencies": [{"ref": "root", "dependsOn": ["a", "c", "gone"]}, {"ref": "a", "dependsOn": ["b"]}, {"ref": "b"}],
    }
    path = tmp_path / "bom.json"
    path.write_text(json.dumps(doc))
    sbom = spark.read.schema(SBOM).json(str(path), multiLine=True)
    parts, edges = manifest.components(sbom), manifest.edges(sbom)
    root = sbom.select(F.col("metadata.component.bom-ref").alias("ref"))
    direct, unknown = manifest.direct_dependencies(root, edges, parts)
    assert table(direct, "ref") == {("a",), ("c",)} and table(unknown) == {("gone",)}
    assert [r.license for r in manifest.licenses(parts).collect()] == ["Apache", "MIT", "MIT OR GPL"]
    assert [tuple(r) for r in manifest.by_component(parts).collect()] == [("a", "g:na", "1", "MIT, Apache"), ("b", "nb", "1", "MIT OR GPL"), ("c", "nc", "1", "")]
    assert manifest.application(sbom).first()[0] == "g:nroot in version 1"


def test_a_long_cycle_takes_few_rounds(spark):
    """600 nodes in a ring, with shuffled names: rounds follow the logarithm."""
    ring = spark.range(600).select(F.xxhash64("id").alias("src"), F.xxhash64((F.col("id") + 1) % 600).alias("dst"))
    rounds = []
    got = graph.strong_components(ring, rounds)
    assert got.count() == 600 and got.select("component").distinct().count() == 1 and len(rounds) < 80


def test_layers(spark):
    rng = random.Random(8)
    needs = [(i, rng.randrange(i)) for i in range(1, 40) for _ in range(rng.choice([0, 1, 2]))] + [(50, 51), (51, 52), (52, 50), (53, 52), (54, 53), (54, 3), (60, 60), (0, None), (99, None)]
    ahead = {}
    for a, b in needs:
        ahead.setdefault(a, set())
        if b is not None:
            ahead[a].add(b)
            ahead.setdefault(b, set())
    level = {}
    while more := {n for n, bs in ahead.items() if n not in level and all(b in level for b in bs)}:
        level |= {n: max((level[b] + 1 for b in ahead[n]), default=0) for n in more}
    expected = {(n, level.get(n), n in (50, 51, 52, 60)) for n in ahead}
    assert table(graph.layers(spark.createDataFrame(needs, "node INT, needs INT")), "node", "level", "in_cycle") == expected
    assert graph.layers(spark.createDataFrame([], "node INT, needs INT")).count() == 0


def test_strong_components_by_brute_force(spark):
    rng = random.Random(5)
    for n in (20, 45):
        edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(n)] + [(100, 101), (101, 102), (102, 100), (102, 103), (103, 104), (104, 103)]
        reach = {a: {b for x, b in edges if x == a} for e in edges for a in e}
        for _ in reach:
            reach = {a: r.union(*(reach[b] for b in r)) for a, r in reach.items()}
        expected = {(min(b for b in r if a in reach[b]), a) for a, r in reach.items() if any(b != a and a in reach[b] for b in r)}
        assert table(graph.strong_components(spark.createDataFrame(edges, "src INT, dst INT")), "component", "node") == expected
    assert graph.strong_components(spark.createDataFrame([(1, 1), (1, 2)], "src INT, dst INT")).count() == 0
    assert graph.strong_components(spark.createDataFrame([], "src INT, dst INT")).count() == 0


def test_chain_depth_takes_the_smallest_superclass(spark):
    rows = [("m", "a", None), ("m", "b", "a"), ("m", "c", "b"), ("m", "c", "z")]
    assert table(graph.chain_depth(spark.createDataFrame(rows, "module STRING, class STRING, super_class STRING"))) == {("m", "a", 0), ("m", "b", 1), ("m", "c", 2)}


def test_facts_and_rules_of_every_table(views):
    classes, methods, fields, imports, _ = views
    depths = graph.chain_depth(classes.select("module", "class", "super_class"))
    of_classes = facts.class_facts(classes, fields, imports, depths)
    got = {r["class"]: (r.n_open, r.n_external, r.depth, r.is_data_class) for r in of_classes.collect()}
    assert got["a.G"] == (1, 0, 1, True) and got["a.A"] == (0, 3, 0, False) and got["b.B"] == (0, 1, 2, True) and got["b.AbstractX"][2] == 1
    found = table(thresholds.evaluate(of_classes, thresholds.CLASS_RULES, "module", "class"), "subject", "finding")
    assert found == {("a.G", "public fields that are no constants"), ("a.G", "data class"), ("b.B", "data class")}
    names = classes.select("module", "category", scalars.simple_name(F.col("class")).alias("name"))
    of_modules = facts.module_facts(classes, methods, of_classes, metrics.coverage(names)[0])
    found = table(thresholds.evaluate(of_modules, thresholds.MODULE_RULES), "module", "finding")
    assert found == {
        ("core", "more than half of the methods are public"), ("core", "fewer than half of the classes are documented"), ("api", "fewer than half of the classes are documented"), ("api", "no tests"),
        ("api", "fewer than half of the classes have a test of their name"), ("api", "no class extends another"),
    }
    of_annotations = facts.annotation_facts(classes, methods, report.annotations(classes))
    row = {r.module: r for r in of_annotations.collect()}
    assert (row["core"].n_annotations, row["core"].n_classes, row["core"].all_classes, row["core"].n_overridable, row["core"].n_overriding) == (2, 6, 7, 3, 1)
    assert table(thresholds.evaluate(of_annotations, thresholds.ANNOTATION_RULES), "module", "finding") == {("core", "more annotations a class than on average")}
    of_imports = facts.import_facts(imports, metrics.namespaces(classes))
    row = {r.module: tuple(r)[1:] for r in of_imports.collect()}
    assert row["api"] == (6, 5, 1, 1)
    assert ("core", "more than 40 % of the external imports are of the standard library") not in table(thresholds.evaluate(of_imports, thresholds.IMPORT_RULES), "module", "finding")
    cycles = facts.cycle_facts(graph.strong_components(graph.class_graph(imports, classes)))
    assert table(cycles, "component", "size") == {("a.A", 2)} and thresholds.evaluate(cycles, thresholds.CYCLE_RULES).count() == 1
