"""A query for each operator, over the benchmark tables. structlens.plans.sql has the same as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_text, scalars, tables
from ..operators import coupling, discovery, files, graph, manifest, metrics, symbols
from ..pipeline import tasks
from ..report import sinks
from ..rules import facts, thresholds
from ..session import new_path, written
from ..sources import report as reports
from ..streaming import progress, state
from .views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
GLOBS = ["*.html", "*", "[0-9]*", "?????", "{1,2}*"]
LONG = ("module", "category", "value", "count")


def query(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
    return f


@query
def dist_visibility(v: Views) -> DataFrame:
    return metrics.visibility(v.methods(), v.modules())


@query
def dist_inheritance_depth(v: Views) -> DataFrame:
    s = v.table("supplier")
    parent = F.expr("s_suppkey div 3")
    chain = s.select(F.col("s_nationkey").cast("string").alias("module"), F.col("s_suppkey").alias("class"), F.when(parent > 0, parent).alias("super_class"))
    return metrics.histogram(graph.chain_depth(chain), "depth", ("module",))


@query
def dist_global_depth(v: Views) -> DataFrame:
    parent = F.expr("s_suppkey div 3")
    chain = v.table("supplier").select(F.lit("all").alias("module"), F.col("s_suppkey").alias("class"), F.when(parent > 0, parent).alias("super_class"))
    return graph.chain_depth(chain).select("class", "depth")


@query
def dist_interface_count(v: Views) -> DataFrame:
    return metrics.histogram(v.class_counts(), "n_interfaces")


@query
def dist_param_count(v: Views) -> DataFrame:
    return metrics.histogram(v.methods(), "parameter_count")


@query
def dist_loc_null_skip(v: Views) -> DataFrame:
    return metrics.histogram(v.methods(), "lines_of_code")


@query
def dist_nesting(v: Views) -> DataFrame:
    return metrics.histogram(v.methods(), "nesting")


@query
def dist_complexity(v: Views) -> DataFrame:
    return metrics.histogram(v.methods(), "complexity")


@query
def dist_field_visibility(v: Views) -> DataFrame:
    return metrics.visibility(v.methods().where("visibility <> 'A'"), v.modules(), with_total=True)


@query
def dist_field_count(v: Views) -> DataFrame:
    return metrics.histogram(v.class_counts(), "n_fields")


@query
def dist_field_method_ratio(v: Views) -> DataFrame:
    return metrics.field_method_ratio(v.class_counts())


@query
def dist_coupling(v: Views) -> DataFrame:
    return metrics.coupling(v.imports())


@query
def dist_module_deps(v: Views) -> DataFrame:
    return metrics.module_dependencies(v.imports())


def _names(v: Views) -> DataFrame:
    docs = v.table("documents").select(F.coalesce("lang", F.lit("-")).alias("module"), F.lit("production").alias("category"), F.concat(F.lit("C"), F.col("doc_id").cast("string")).alias("name"))
    tests = v.table("labels").join(v.table("documents").select("doc_id", "lang"), "doc_id").select(F.coalesce("lang", F.lit("-")).alias("module"), F.lit("test").alias("category"), F.concat(F.lit("C"), F.col("doc_id").cast("string"), F.when(F.col("quality") == 1, "Test").otherwise("Tests")).alias("name"))
    return docs.unionByName(tests)


@query
def coverage_summary(v: Views) -> DataFrame:
    return metrics.coverage(_names(v))[0]


@query
def coverage_untested(v: Views) -> DataFrame:
    return metrics.coverage(_names(v))[1]


@query
def cycles_class(v: Views) -> DataFrame:
    return graph.strong_components(graph.class_graph(v.supplier_imports(), v.supplier_classes()))


@query
def dist_method_count(v: Views) -> DataFrame:
    return metrics.histogram(v.class_counts(), "n_methods")


@query
def doc_ratio(v: Views) -> DataFrame:
    return metrics.documentation(v.classes(), v.methods(), v.modules())


@query
def data_class_candidates(v: Views) -> DataFrame:
    return v.nested().where("is_data_class").select("module", "category", "class")


@query
def boolean_params(v: Views) -> DataFrame:
    return reports.methods(v.nested()).where("n_booleans >= 3").select("module", "category", "class", "name", "n_booleans")


@query
def dist_annotation(v: Views) -> DataFrame:
    return metrics.histogram(reports.annotations(v.nested()), "name")


@query
def package_tangles(v: Views) -> DataFrame:
    """Edges between packages of a cycle, with the number of class imports behind each."""
    edges = graph.package_graph(v.supplier_imports(), v.supplier_classes()).groupBy("src", "dst").agg(F.count("*").alias("evidence"))
    found = graph.strong_components(edges)
    a, b = found.select(F.col("node").alias("src"), "component"), found.select(F.col("node").alias("dst"), F.col("component").alias("other"))
    return edges.join(a, "src").join(b, "dst").where("component = other").select("component", "src", "dst", "evidence")


@query
def import_diversity(v: Views) -> DataFrame:
    names = v.modules().withColumn("namespace", F.concat(F.lit("Brand#"), (F.length("module") + 8).cast("string"), F.lit(".STANDARD")))
    return metrics.all_categories(metrics.import_diversity(v.imports(), names))


@query
def batch_metrics(v: Views) -> DataFrame:
    """The distributions of all modules at once: members are read and joined once, and each level - members, classes, imports
    - is counted by one pass."""
    modules, classes = v.modules(), v.classes()
    base = written(v.members(with_keys=True).join(classes.select("class", "module", "category"), "class"))
    shown, private = F.col("visibility"), F.col("visibility") == "A"
    static, final = F.col("is_static"), F.col("is_final")
    zeros = [metrics.grid(modules, "dist_visibility", ["STATIC", "FINAL"]), metrics.grid(modules, "dist_field_visibility", ["STATIC", "FINAL", "TOTAL"])]
    zeros += [metrics.grid(modules, "doc_ratio", ["DOCUMENTED_METHODS", "TOTAL_METHODS", "DOCUMENTED_CLASSES", "TOTAL_CLASSES"])]
    of_members = metrics.expanded(
        base,
        [
            ("dist_visibility", shown), *metrics.flagged("dist_visibility", {"STATIC": static, "FINAL": final}),
            ("dist_field_visibility", F.when(~private, shown)), *metrics.flagged("dist_field_visibility", {"STATIC": static & ~private, "FINAL": final & ~private, "TOTAL": ~private}),
            ("dist_param_count", F.col("parameter_count")), ("dist_loc_null_skip", F.col("lines_of_code")), ("dist_nesting", F.col("nesting")), ("dist_complexity", F.col("complexity")),
            *metrics.flagged("doc_ratio", {"DOCUMENTED_METHODS": F.col("documented"), "TOTAL_METHODS": F.lit(True)}), ("dist_annotation", F.col("mark")),
        ],
        reduce(DataFrame.unionByName, zeros),
    )
    part = v.table("part").select("p_partkey", F.concat_ws(".", "p_brand", "p_type", "p_name").alias("import"))
    used = written(base.select("module", "category", "class", F.col("part").alias("p_partkey")).distinct().join(part, "p_partkey").select("module", "category", "class", "import").distinct())
    outside = scalars.is_external(F.col("import"), F.lit("Brand#11"))
    of_imports = metrics.expanded(used, [("dist_module_deps", F.when(F.col("import").contains(".") & outside, scalars.prefix(F.col("import"))))])
    counted = base.groupBy("class").agg(F.count("*").alias("n_methods"), F.count_if(shown == "N").alias("n_fields"), F.countDistinct("visibility").alias("n_interfaces"))
    whole = classes.join(counted, "class", "left").join(used.groupBy("class").agg(F.count_if(outside).alias("n_external")), "class", "left")
    whole = whole.fillna(0, ["n_methods", "n_fields", "n_interfaces", "n_external"])
    of_classes = metrics.expanded(
        whole,
        [
            ("dist_method_count", F.col("n_methods")), ("dist_field_count", F.col("n_fields")), ("dist_interface_count", F.col("n_interfaces")), ("dist_coupling", F.col("n_external")),
            ("dist_field_method_ratio", F.expr("if(n_methods > 0, (n_fields * 100) div n_methods, null)")), ("dist_annotation", F.col("annotation")),
            *metrics.flagged("doc_ratio", {"DOCUMENTED_CLASSES": F.col("documented"), "TOTAL_CLASSES": F.lit(True)}),
        ],
    )
    every = of_members.unionByName(of_classes).unionByName(of_imports)
    return every.groupBy("metric", "module", "category", "value").agg(F.sum("count").alias("count"))


@query
def rollup_metric(v: Views) -> DataFrame:
    return v.methods().rollup("module", "category").agg(F.count("*").alias("count"), F.sum("complexity").alias("complexity"))


@query
def inter_module_matrix(v: Views) -> DataFrame:
    classes = written(v.nested())
    return coupling.matrix(reports.imports(classes), classes)


@query
def inter_module_instability(v: Views) -> DataFrame:
    return coupling.instability(coupling.weights(v.module_surplus()), v.modules())


@query
def longest_prefix_owner(v: Views) -> DataFrame:
    page = v.files().select("page_id", "path")
    prefixes = page.select(F.explode(F.array(F.substring_index("path", "/", 1), F.substring_index("path", "/", 2))).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n")).where("n >= 2")
    owners = prefixes.select(F.concat(F.lit("M:"), F.col("prefix")).alias("owner"), "prefix")
    return coupling.longest_prefix(page.withColumnRenamed("path", "name"), owners, "name", "/").select("page_id", "owner", "prefix")


@query
def file_stats(v: Views) -> DataFrame:
    return files.statistics(files.by_pattern(v.files(), GLOBS))


@query
def files_count(v: Views) -> DataFrame:
    return v.files().where(scalars.matches_glob(F.col("filename"), "*.html")).agg(F.count("*").alias("count"))


@query
def count_per_type(v: Views) -> DataFrame:
    return files.count_by_pattern(files.by_pattern(v.files(), GLOBS))


@query
def count_per_type_dir(v: Views) -> DataFrame:
    return files.count_by_pattern(files.by_pattern(v.files(), GLOBS), "directory")


@query
def list_matching(v: Views) -> DataFrame:
    listed = files.listing(files.by_pattern(v.files(), ["*.html", "*1*"]), skip_dot_directories=True)
    return listed.select("directory", F.array_join("files", ",").alias("files"))


@query
def list_directory(v: Views) -> DataFrame:
    """The files directly in one directory, the first by name."""
    files_ = v.files()
    first = files_.agg(F.min("directory")).first()[0]
    return files.in_directory(files_, first or "").select("directory", "filename", "lines")


#: The files that make a directory of pages a module, and what counts as a language there.
BUILD_FILES, PAGE_KINDS = {"five": ["5"], "page": [".html"], "none": ["none"]}, {"digits": ["[0-9]"], "odd": ["1", "3", "5", "7", "9"], "page": [".html"]}


@query
def module_tree(v: Views) -> DataFrame:
    """Modules with their names, parents, build systems, own and rolled-up files and lines."""
    tree = v.tree()
    found = discovery.modules(tree, "site", BUILD_FILES)
    return found.withColumn("build_systems", F.array_join("build_systems", ",")).join(discovery.totals(tree, found), "module")


@query
def module_languages(v: Views) -> DataFrame:
    tree = v.tree()
    return discovery.languages(tree, discovery.modules(tree, "site", BUILD_FILES), PAGE_KINDS)


@query
def resolve_symbols(v: Views) -> DataFrame:
    """What the names in all orders mean, as classes of their imports, packages and wildcards."""
    names, imports, classes = v.symbols()
    return symbols.resolve(names.distinct(), imports, classes).select("unit", "name", "qualified", "scope", "candidates")


@query
def symbol_imports(v: Views) -> DataFrame:
    """How many orders mean each class."""
    names, imports, classes = v.symbols()
    found = symbols.unit_imports(symbols.resolve(names, imports, classes), imports, classes)
    return found.groupBy("import").agg(F.count("*").alias("units"))


@query
def sql_prefix_counts(v: Views) -> DataFrame:
    """Orders by the beginnings of the names of their parts, all in SQL with table functions."""
    tables.register(v.spark)
    named = v.table("part").selectExpr("p_partkey", "concat_ws('.', p_brand, p_type, replace(p_name, ' ', '.')) AS name")
    return v.spark.sql(
        """
        WITH prefixes AS (SELECT p_partkey, segments, prefix FROM prefixes_of(TABLE({named}), 'name')),
        used AS (SELECT l_returnflag, prefix FROM {lineitem} JOIN prefixes ON l_partkey = p_partkey WHERE segments < 4)
        SELECT key AS returned, value AS prefix, sum(count) AS count FROM values_of(TABLE(SELECT * FROM used), 'l_returnflag', 'prefix') GROUP BY ALL
        """,
        named=named, lineitem=v.table("lineitem"),
    )


@query
def sql_json_problems(v: Views) -> DataFrame:
    """Events whose properties don't fit a schema, by SQL."""
    tables.register(v.spark)
    schema = '{"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 90}}}'
    found = v.spark.sql("SELECT event_id, size(problems) AS problems FROM json_problems(TABLE(SELECT event_id, props FROM {events}), 'props', :schema)", args={"schema": schema}, events=v.table("events"))
    return found.where("problems > 0").withColumn("problems", F.col("problems").cast("long"))


@query
def sbom_direct_deps(v: Views) -> DataFrame:
    """Regions depend on their nations' suppliers; what ASIA depends on."""
    nation, supplier = v.table("nation"), v.table("supplier")
    root = v.table("region").where("r_name = 'ASIA'").select(F.col("r_regionkey").cast("string").alias("ref"))
    edges = nation.join(supplier, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_regionkey").cast("string").alias("src"), F.col("s_name").alias("dst"))
    components = supplier.select(F.col("s_name").alias("ref"), scalars.component_label(F.col("s_nationkey").cast("string"), F.col("s_name")).alias("label"))
    return manifest.direct_dependencies(root, edges, components)[0].select("ref", "label")


@query
def sbom_licenses(v: Views) -> DataFrame:
    return manifest.licenses(manifest.components(v.sbom()))


@query
def sbom_dep_licenses(v: Views) -> DataFrame:
    return manifest.by_component(manifest.components(v.sbom()))


@query
def runnable_tasks(v: Views) -> DataFrame:
    needs = v.table("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("tag"))
    met = v.table("lineitem").where("l_linestatus = 'F'").select(F.col("l_linestatus").alias("tag")).limit(1)
    return tasks.runnable(needs, met)


@query
def task_layers(v: Views) -> DataFrame:
    """The order in which parts can be made: each needs those of half and a third of its number, some pairs each other."""
    return graph.layers(v.part_needs())


@query
def resume_anti_join(v: Views) -> DataFrame:
    items = v.table("lineitem").select(F.col("l_orderkey").cast("string").alias("task_id"), F.col("l_linenumber").alias("index")).distinct()
    state = v.table("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("task_id"), F.array(F.lit(1), F.lit(2)).alias("successful_indices"))
    return tasks.remaining(items, state)


@query
def module_status(v: Views) -> DataFrame:
    docs = v.table("documents").select(F.when(F.length("text") >= 60, F.col("doc_id").cast("string")).alias("name"), F.array(F.when(F.col("lang") == "en", "JAVA").otherwise(F.col("lang"))).alias("languages"))
    return reports.status(docs, v.table("labels").select(F.col("doc_id").cast("string").alias("name")))


@query
def json_pointer_explode(v: Views) -> DataFrame:
    wrapped = v.table("events").select("event_id", F.concat(F.lit('{"m": {"list": ['), F.col("props"), F.lit(", "), F.col("props"), F.lit("]}}")).alias("doc"))
    each = json_text.elements(wrapped, "doc", "$.m.list", "event_id")
    return each.select("event_id", F.col("position").cast("long").alias("position"), F.expr("variant_get(element, '$.k', 'bigint')").alias("k"))


@query
def json_repair(v: Views) -> DataFrame:
    line = F.concat(F.lit('```json{\n"html" : "'), F.regexp_replace("html", r"[\\\n\r\t]", " "), F.lit('",\n"id" : '), F.col("page_id").cast("string"), F.lit("\n}```"))
    fixed = v.table("pages").select("page_id", json_text.repaired(line).alias("fixed"))
    return fixed.select("page_id", F.get_json_object("fixed", "$.id").cast("long").alias("id"), F.length(F.get_json_object("fixed", "$.html")).cast("long").alias("n"))


@query
def schema_violations(v: Views) -> DataFrame:
    schema = {"type": "object", "required": ["k", "z"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 90}, "z": {"type": "string"}}}
    return json_text.violations(v.table("events").select("event_id", "props"), "props", schema, "event_id")


SECTION = "== {{name}}\n{{#each nations}}| {{n_name}} | {{n_nationkey}} |{{#if @last}}{{else}}\n{{/if}}{{/each}}"


@query
def render_table(v: Views) -> DataFrame:
    """A section of a document for each region, from a template; the tables are of the size of a document."""
    nations = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations")
    rows = v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("name")).agg(nations).collect()
    section = sinks.Template(SECTION)
    return v.spark.createDataFrame([(section.render(r.asDict(recursive=True)),) for r in rows], "section STRING")


@query
def last_n_messages(v: Views) -> DataFrame:
    return progress.last_messages(v.table("conversations"), 2).select("conv_id", "turn", "role", "text")


@query
def messages_since(v: Views) -> DataFrame:
    c = v.table("conversations")
    marks = c.where("turn < 2").select("conv_id", "turn")
    return progress.since(c, marks).select("conv_id", "turn", "role")


@query
def conversation_logs(v: Views) -> DataFrame:
    return sinks.conversation_log(v.table("conversations"), with_system=True)


@query
def token_usage(v: Views) -> DataFrame:
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    assistant = F.lower("role") == "assistant"
    usage = v.table("conversations").select("conv_id", F.when(~assistant, n).otherwise(0).alias("input"), F.when(assistant, n).otherwise(0).alias("output"))
    return progress.token_usage(usage, "conv_id")


@query
def loop_progress(v: Views) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "SUCCESSFUL").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("FAILED")
    return progress.loop_progress(v.table("orders").select(F.col("o_custkey").alias("task_id"), kind.alias("status")))


@query
def progress_windows(v: Views) -> DataFrame:
    out = progress.progress_stream(v.table("events"), "1 day", "2 days")
    return out.select("start", "event_type", "n", F.round("total", 2).alias("total"))


@query
def done_indices(v: Views) -> DataFrame:
    """A stream of events as done indices of their users, in two runs over one checkpoint: the second knows what the first
    has seen, and sees some of it again."""
    spark = state.session_for_state(v.spark)
    events = v.table("events").select(F.col("user_id").alias("task_id"), (F.col("event_id") % 5000).alias("index"))
    folder = new_path(spark)
    for part in (F.col("index") < 3000, F.col("index") > 2000):
        events.where(part).write.mode("append").parquet(f"{folder}/in")
        items = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        state.run_to_end(state.new_indices(items), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema("task_id LONG, index LONG").parquet(f"{folder}/out")


@query
def labels(v: Views) -> DataFrame:
    return v.table("orders").select(
        "o_orderkey", scalars.token_label(F.col("o_orderkey")).alias("tokens"), scalars.elapsed_label(F.col("o_orderkey") * 37).alias("elapsed"),
        scalars.task_mark(F.col("o_orderkey") % 3 != 0, F.when(F.col("o_orderstatus") == "F", "SUCCESSFUL").when(F.col("o_orderstatus") == "P", "FAILED")).alias("mark"),
    )


@query
def names(v: Views) -> DataFrame:
    dotted = v.table("part").select("p_partkey", F.concat_ws(".", "p_brand", "p_type", "p_name").alias("q"))
    return dotted.select("p_partkey", scalars.simple_name(F.col("q")).alias("simple"), scalars.package_of(F.col("q")).alias("package"), scalars.prefix(F.col("q")).alias("prefix"), scalars.file_label(F.col("q")).alias("file"))


@query
def tool_filter(v: Views) -> DataFrame:
    part = v.table("part").select("p_partkey", scalars.tool_name(F.concat(F.col("p_type"), F.lit("<x>"))).alias("tool"))
    allowed = scalars.tool_allowed(F.col("tool"), ["STANDARD.*", "PROMO .*"])
    return part.where(allowed & ~scalars.tool_allowed(F.col("tool"), [], [".*BRASS", "PROMO.*"]) | F.col("tool").startswith("ECONOMY"))


@query
def rules_findings(v: Views) -> DataFrame:
    found = thresholds.evaluate(reports.methods(v.nested()), thresholds.METHOD_RULES)
    return found.groupBy("module", "aspect", "finding", "urgency", "criticality").agg(F.count("*").alias("occurrences"))


def _class_facts(v: Views, classes: DataFrame) -> DataFrame:
    depths = graph.chain_depth(classes.select("module", "class", "super_class"))
    return facts.class_facts(classes, reports.fields(classes), reports.imports(classes), depths)


@query
def rules_classes(v: Views) -> DataFrame:
    found = thresholds.evaluate(_class_facts(v, written(v.nested())), thresholds.CLASS_RULES)
    return found.groupBy("module", "aspect", "finding", "urgency", "criticality").agg(F.count("*").alias("occurrences"))


@query
def rules_modules(v: Views) -> DataFrame:
    classes = written(v.nested())
    names = classes.select("module", F.when(F.col("category") == "test", "test").otherwise("production").alias("category"), F.concat(F.expr("concat('C', unit)"), F.when(F.col("category") == "test", "Test").otherwise("")).alias("name"))
    found = facts.module_facts(classes, reports.methods(classes), _class_facts(v, classes), metrics.coverage(names)[0])
    return thresholds.evaluate(found, thresholds.MODULE_RULES).drop("subject")


@query
def rules_annotations(v: Views) -> DataFrame:
    classes = written(v.nested())
    found = facts.annotation_facts(classes, reports.methods(classes), reports.annotations(classes))
    return thresholds.evaluate(found, thresholds.ANNOTATION_RULES).drop("subject")


@query
def rules_imports(v: Views) -> DataFrame:
    classes = written(v.nested())
    found = facts.import_facts(reports.imports(classes), classes.select("module", F.col("package").alias("namespace")).distinct())
    return thresholds.evaluate(found, thresholds.IMPORT_RULES).drop("subject")


@query
def rules_cycles(v: Views) -> DataFrame:
    found = facts.cycle_facts(graph.strong_components(graph.class_graph(v.supplier_imports(), v.supplier_classes())))
    return thresholds.evaluate(found, thresholds.CYCLE_RULES, "module", "component")


def _estate(v: Views) -> dict[str, DataFrame]:
    """The estate with its lines written once; its views read what they need of them."""
    return {name: written(df) if name in ("classes", "methods", "fields", "imports") else df for name, df in v.estate().items()}


def _occurrences(table: str, found: DataFrame) -> DataFrame:
    return found.groupBy("module", "aspect", "finding", "urgency", "criticality").agg(F.count("*").alias("occurrences")).withColumn("rules", F.lit(table))


@query
def rules_estate(v: Views) -> DataFrame:
    """Every rule of every table over large classes of many kinds, with the number of its findings in each module."""
    e = _estate(v)
    depths = graph.chain_depth(e["classes"].select("module", "class", "super_class"))
    of_classes = written(facts.class_facts(e["classes"], e["fields"], e["imports"], depths))
    of_modules = facts.module_facts(e["classes"], e["methods"], of_classes, metrics.coverage(e["names"])[0])
    of_annotations = facts.annotation_facts(e["classes"], e["methods"], e["annotations"])
    stability = coupling.instability(e["edges"], e["modules"])
    found = {
        "methods": thresholds.evaluate(e["methods"], thresholds.METHOD_RULES), "classes": thresholds.evaluate(of_classes, thresholds.CLASS_RULES),
        "modules": thresholds.evaluate(of_modules, thresholds.MODULE_RULES), "annotations": thresholds.evaluate(of_annotations, thresholds.ANNOTATION_RULES),
        "imports": thresholds.evaluate(facts.import_facts(e["imports"], e["namespaces"]), thresholds.IMPORT_RULES), "stability": thresholds.evaluate(stability, thresholds.STABILITY_RULES),
    }
    return reduce(DataFrame.unionByName, [_occurrences(n, df) for n, df in found.items()])


@query
def unstable_estate(v: Views) -> DataFrame:
    """Stable modules (under 30) that depend on unstable ones (over 70)."""
    e = v.estate()
    edges = written(e["edges"])
    return thresholds.unstable_dependencies(edges, coupling.instability(edges, e["modules"]))


@query
def rules_package_cycles(v: Views) -> DataFrame:
    """Cycles of packages, by the imports of all their classes."""
    found = facts.cycle_facts(graph.strong_components(graph.package_graph(v.supplier_imports(), v.supplier_classes())))
    return thresholds.evaluate(found, thresholds.CYCLE_RULES, "module", "component")


@query
def rules_grouped(v: Views) -> DataFrame:
    stability = coupling.instability(coupling.weights(v.module_surplus()), v.modules())
    return thresholds.grouped(thresholds.evaluate(stability, thresholds.STABILITY_RULES))


@query
def unstable_dependencies(v: Views) -> DataFrame:
    edges = coupling.weights(v.module_surplus())
    return thresholds.unstable_dependencies(edges, coupling.instability(edges, v.modules()), low=50, high=50)


@query
def top_prefix_share(v: Views) -> DataFrame:
    parts = v.imports().where("import is not null").groupBy("module", F.substring_index("import", ".", 1).alias("value")).agg(F.count("*").alias("count"))
    return thresholds.shares(parts, 4, "one prefix has more than 4 %", "imports").select("module", "subject")


@query
def csv_by_category(v: Views) -> DataFrame:
    return sinks.by_category(metrics.histogram(v.methods(), "complexity"), True, "module")
