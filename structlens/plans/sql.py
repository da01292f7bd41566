"""The queries of structlens.plans.benchmark as DuckDB SQL."""

from __future__ import annotations

_CLASSES = """classes AS (SELECT n_name AS module, CASE c_mktsegment WHEN 'MACHINERY' THEN 'generated' WHEN 'HOUSEHOLD' THEN 'test' ELSE 'production' END AS category,
  c_custkey AS unit, o_orderkey AS class, o_orderpriority <> '4-NOT SPECIFIED' AS documented, o_orderpriority AS annotation
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
_METHODS = f"""{_CLASSES}, methods AS (SELECT module, category, class, l_returnflag AS visibility, l_linestatus = 'F' AS is_static, l_discount = 0 AS is_final,
  l_linenumber AS params, CASE WHEN l_tax <> 0 THEN CAST(l_quantity AS INTEGER) END AS loc, l_tax > 0 AS documented,
  CASE l_returnflag WHEN 'N' THEN l_linestatus ELSE l_returnflag END AS annotation FROM lineitem JOIN classes ON l_orderkey = class)"""
_COUNTS = f"""{_CLASSES}, counted AS (SELECT l_orderkey AS class, count(*) AS n_methods, count(*) FILTER (l_returnflag = 'N') AS n_fields, count(DISTINCT l_returnflag) AS n_interfaces,
  count(*) FILTER (l_returnflag NOT IN ('A', 'R')) AS n_other FROM lineitem GROUP BY 1),
full_classes AS (SELECT c.*, coalesce(n_methods, 0) AS n_methods, coalesce(n_fields, 0) AS n_fields, coalesce(n_interfaces, 0) AS n_interfaces, n_other FROM classes c LEFT JOIN counted USING (class))"""
_IMPORTS = f"""{_CLASSES}, used AS (SELECT DISTINCT l_orderkey AS class, p_brand || '.' || p_type || '.' || p_name AS import FROM lineitem JOIN part ON l_partkey = p_partkey),
imports AS (SELECT module, category, class, import, import IS NOT NULL AND import <> 'Brand#11' AND NOT starts_with(import, 'Brand#11.') AS outside FROM classes LEFT JOIN used USING (class))"""
_GRID = "grid AS (SELECT n_name AS module, category FROM nation, (VALUES ('production'), ('test'), ('generated')) t(category))"
_EDGES = """suppliers AS (SELECT s_suppkey AS k, s_nationkey AS nation, 'n' || s_nationkey AS package, 'n' || s_nationkey || '.s' || s_suppkey AS class FROM supplier),
edges AS (SELECT a.class AS src, b.class AS dst, a.package AS home, b.package AS "to" FROM suppliers a JOIN suppliers b ON (a.k * 7 + a.nation) % (SELECT count(*) FROM supplier) = b.k)"""
_NESTED = f"""{_CLASSES}, home AS (SELECT n_name AS module, 'pkg.n' || n_nationkey AS package FROM nation),
lines AS (SELECT module, category, package, l_orderkey AS id, l_quantity > 25 AS large, 'org.C' || l_orderkey AS class, l.*,
  CASE l_returnflag WHEN 'N' THEN 'get' WHEN 'A' THEN 'set' ELSE 'run' END || l_partkey AS name,
  CASE WHEN l_linenumber % 2 = 0 THEN 'org.C' || (l_orderkey + l_partkey) ELSE 'pkg.n' || (l_suppkey % 25) || '.X' END AS import
  FROM lineitem l JOIN classes ON l_orderkey = class JOIN home USING (module)),
each_method AS (SELECT *, l_linenumber AS params, CASE WHEN l_tax <> 0 THEN CAST(l_quantity AS INTEGER) * 2 END AS loc, l_linenumber * 3 AS cc, l_linenumber - 1 AS nest, l_linenumber % 5 AS bools FROM lines WHERE NOT large),
each_annotation AS (SELECT module, category, annotation AS name FROM classes UNION ALL SELECT module, category, CASE WHEN l_returnflag = 'N' THEN 'Override' ELSE 'org.frame.Bean' END FROM each_method WHERE l_returnflag = 'N' OR l_tax = 0),
data_classes AS (SELECT class FROM lines GROUP BY class HAVING count(*) FILTER (large) > 0 AND ((bool_and(NOT large OR l_linestatus = 'O') AND bool_and(large OR name NOT LIKE 'run%')) OR (bool_and(NOT large OR l_linestatus <> 'O') AND bool_and(large)))),
full_class AS (SELECT c.module, c.category, package, c.class AS id, 'org.C' || c.class AS class, c.unit, documented, c.class % 8 AS n_interfaces, CASE WHEN c.class % 3 = 0 THEN 'org.C' || (c.class // 3) END AS parent FROM classes c JOIN home USING (module))"""
_USES = f"""{_CLASSES}, uses AS (SELECT c.module AS "from", n_name AS "to", count(*) AS import_count FROM lineitem JOIN classes c ON l_orderkey = class
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE c.module <> n_name GROUP BY ALL),
surplus AS (SELECT a."from", a."to" FROM uses a LEFT JOIN uses b ON a."from" = b."to" AND a."to" = b."from" WHERE a.import_count > coalesce(b.import_count, 0))"""
_STABILITY = f"""{_USES}, stability AS (SELECT n_name AS module, coalesce(ce, 0) AS ce, coalesce(ca, 0) AS ca,
  CAST(CASE WHEN coalesce(ce, 0) + coalesce(ca, 0) > 0 THEN coalesce(ce, 0) * 100 // (coalesce(ce, 0) + coalesce(ca, 0)) ELSE 0 END AS INTEGER) AS instability
  FROM nation LEFT JOIN (SELECT "from" AS module, count(DISTINCT "to") AS ce FROM surplus GROUP BY 1) a ON n_name = a.module
  LEFT JOIN (SELECT "to" AS module, count(DISTINCT "from") AS ca FROM surplus GROUP BY 1) b ON n_name = b.module)"""
_FILES = r"""paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, html FROM pages),
files AS (SELECT page_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, string_split(path, '/')[-1] AS filename,
  length(html) - length(replace(html, chr(10), '')) + CASE WHEN html = '' OR ends_with(html, chr(10)) THEN 0 ELSE 1 END AS lines FROM paths),
globs(wildcard, re) AS (VALUES ('*.html', '^[^/]*\.html$'), ('*', '^[^/]*$'), ('[0-9]*', '^[0-9][^/]*$'), ('?????', '^[^/]{5}$'), ('{1,2}*', '^(?:1|2)[^/]*$')),
matched AS (SELECT * FROM files JOIN globs ON regexp_matches(filename, re))"""
_NAMES = """names AS (SELECT DISTINCT coalesce(lang, '-') AS module, 'C' || doc_id AS name FROM documents),
tests AS (SELECT DISTINCT coalesce(lang, '-') AS module, 'C' || doc_id AS name FROM labels JOIN documents USING (doc_id)),
marked AS (SELECT n.module, n.name, t.name IS NOT NULL AS tested FROM names n LEFT JOIN tests t USING (module, name))"""


def _histogram(ctes: str, rows: str, value: str, keys: str = "module, category") -> str:
    return f"WITH {ctes} SELECT {keys}, CAST({value} AS VARCHAR) AS value, count(*) AS count FROM {rows} WHERE {value} IS NOT NULL GROUP BY ALL"


def _totals(rows: str, flags: dict[str, str]) -> str:
    each = [f"SELECT g.module, g.category, '{n}' AS value, count(r.module) AS count FROM grid g LEFT JOIN (SELECT * FROM {rows} WHERE {c}) r ON r.module = g.module AND r.category = g.category GROUP BY ALL" for n, c in flags.items()]
    return " UNION ALL ".join(each)


def _reach(edges: str) -> str:
    return f"""{edges}, reach AS (SELECT src, dst FROM kept UNION SELECT reach.src, kept.dst FROM reach JOIN kept ON reach.dst = kept.src),
scc AS (SELECT a.src AS node, least(a.src, min(a.dst)) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src)"""


_RULES = [
    ("complexity", "params > 7", "more than 7 parameters", "MEDIUM", "MEDIUM"),
    ("complexity", "loc > 30", "more than 30 statements", "MEDIUM", "MEDIUM"),
    ("complexity", "cc > 10 AND params > 5 AND loc > 30", "complex, long and with many parameters", "HIGH", "HIGH"),
    ("complexity", "cc < 5 AND loc > 40", "long but simple: could be cut", "LOW", "LOW"),
    ("nesting", "nest > 4", "nested more than 4 deep", "MEDIUM", "MEDIUM"),
    ("nesting", "cc > 10 AND nest < 3", "many branches side by side", "LOW", "MEDIUM"),
    ("nesting", "cc < 5 AND nest > 5", "deep nesting of few branches", "MEDIUM", "MEDIUM"),
    ("nesting", "cc > 10 AND nest > 5", "complex and deep", "HIGH", "HIGH"),
]
_STABLE = [
    ("ce = 0 AND ca = 0", "coupled with no other module", "LOW", "LOW"),
    ("ce + ca > 0 AND instability < 30", "stable", "NONE", "NONE"),
    ("instability > 70", "unstable", "LOW", "LOW"),
    ("ca > 2 AND instability > 70", "unstable but widely used", "HIGH", "HIGH"),
]

_CLASS_RULES = [
    ("fields", "n_fields > 10 AND n_methods > 20", "god class", "HIGH", "HIGH"),
    ("methods", "n_methods > 20", "more than 20 methods", "MEDIUM", "MEDIUM"),
    ("fields", "n_open > 0", "public fields that are no constants", "LOW", "MEDIUM"),
    ("inheritance", "depth > 3", "more than 3 superclasses", "MEDIUM", "MEDIUM"),
    ("inheritance", "n_interfaces > 5", "more than 5 interfaces", "MEDIUM", "MEDIUM"),
    ("coupling", "n_external > 20", "more than 20 external imports", "MEDIUM", "MEDIUM"),
    ("data", "is_data_class", "data class", "NONE", "LOW"),
]
_MODULE_RULES = [
    ("visibility", "2 * n_public > n_all", "more than half of the methods are public", "LOW", "LOW"),
    ("visibility", "10 * n_public > 8 * n_all AND n_private = 0 AND n_protected = 0", "nothing is hidden", "MEDIUM", "MEDIUM"),
    ("visibility", "10 * n_static > 4 * n_all", "more than 40 % of the methods are static", "LOW", "MEDIUM"),
    ("documentation", "2 * n_documented < n_classes", "fewer than half of the classes are documented", "LOW", "LOW"),
    ("tests", "n_classes > 0 AND n_tests = 0", "no tests", "HIGH", "HIGH"),
    ("tests", "coverage < 50", "fewer than half of the classes have a test of their name", "MEDIUM", "HIGH"),
    ("coupling", "n_external > 10 * n_classes", "more than 10 external imports a class on average", "MEDIUM", "MEDIUM"),
    ("inheritance", "n_classes > 0 AND max_depth = 0", "no class extends another", "NONE", "NONE"),
]
_ANNOTATION_RULES = [
    ("annotations", "n * all_classes > all_n * n_classes", "more annotations a class than on average", "LOW", "LOW"),
    ("annotations", "n_overridable > 0 AND 5 * n_overriding < n_overridable", "fewer than 20 % of the methods that could override are marked", "LOW", "LOW"),
    ("annotations", "n_framework > 0 AND 10 * n_framework > 6 * n", "more than 60 % of the annotations are of one framework", "LOW", "MEDIUM"),
]
_IMPORT_RULES = [
    ("imports", "10 * n_external > 8 * n_imports", "more than 80 % of the imports are external", "LOW", "MEDIUM"),
    ("imports", "2 * n_top > n_external", "more than 50 % of the external imports have one prefix", "LOW", "MEDIUM"),
    ("imports", "false", "more than 40 % of the external imports are of the standard library", "NONE", "NONE"),
]


def _found(rows: str, rules: list[tuple]) -> str:
    """Occurrences of each rule in each module."""
    return " UNION ALL ".join(f"SELECT module, '{a}' AS aspect, '{f}' AS finding, '{u}' AS urgency, '{k}' AS criticality, count(*) AS occurrences FROM {rows} WHERE {c} GROUP BY module" for a, c, f, u, k in rules)


def _of_modules(rows: str, rules: list[tuple]) -> str:
    return " UNION ALL ".join(f"SELECT module, '{a}' AS aspect, '{f}' AS finding, '{u}' AS urgency, '{k}' AS criticality FROM {rows} WHERE {c}" for a, c, f, u, k in rules)


SQL: dict[str, str] = {
    "dist_visibility": f"WITH {_METHODS}, {_GRID} SELECT module, category, coalesce(visibility, 'UNKNOWN') AS value, count(*) AS count FROM methods GROUP BY ALL UNION ALL "
    + _totals("methods", {"STATIC": "is_static", "FINAL": "is_final"}),
    "dist_inheritance_depth": """WITH RECURSIVE c AS (SELECT s_nationkey AS module, s_suppkey AS class, CASE WHEN s_suppkey // 3 > 0 THEN s_suppkey // 3 END AS up FROM supplier),
d AS (SELECT c.module, c.class, CASE WHEN c.up IS NULL THEN 0 ELSE 1 END AS depth FROM c LEFT JOIN c p ON p.module = c.module AND p.class = c.up WHERE p.class IS NULL
      UNION ALL SELECT c.module, c.class, d.depth + 1 FROM d JOIN c ON c.module = d.module AND c.up = d.class)
SELECT CAST(module AS VARCHAR) AS module, CAST(depth AS VARCHAR) AS value, count(*) AS count FROM d GROUP BY ALL""",
    "dist_global_depth": """WITH RECURSIVE d AS (SELECT s_suppkey AS class, 0 AS depth FROM supplier WHERE s_suppkey // 3 = 0 OR s_suppkey // 3 NOT IN (SELECT s_suppkey FROM supplier)
      UNION ALL SELECT s_suppkey, d.depth + 1 FROM d JOIN supplier ON s_suppkey // 3 = d.class WHERE s_suppkey // 3 > 0)
SELECT class, CAST(CASE WHEN class // 3 > 0 AND class // 3 NOT IN (SELECT s_suppkey FROM supplier) THEN depth + 1 ELSE depth END AS INTEGER) AS depth FROM d""",
    "dist_interface_count": _histogram(_COUNTS, "full_classes", "n_interfaces"),
    "dist_param_count": _histogram(_METHODS, "methods", "params"),
    "dist_loc_null_skip": _histogram(_METHODS, "methods", "loc"),
    "dist_nesting": _histogram(_METHODS, "methods", "(params - 1)"),
    "dist_complexity": _histogram(_METHODS, "methods", "params"),
    "dist_field_visibility": f"WITH {_METHODS}, fields AS (SELECT * FROM methods WHERE visibility <> 'A'), {_GRID} SELECT module, category, visibility AS value, count(*) AS count FROM fields GROUP BY ALL UNION ALL "
    + _totals("fields", {"STATIC": "is_static", "FINAL": "is_final", "TOTAL": "true"}),
    "dist_field_count": _histogram(_COUNTS, "full_classes", "n_fields"),
    "dist_field_method_ratio": f"WITH {_COUNTS} SELECT module, category, CAST(n_fields * 100 // n_methods AS VARCHAR) AS value, count(*) AS count FROM full_classes WHERE n_methods > 0 GROUP BY ALL",
    "dist_coupling": f"WITH {_IMPORTS}, n AS (SELECT module, category, class, count(*) FILTER (outside) AS n FROM imports GROUP BY ALL) SELECT module, category, CAST(n AS VARCHAR) AS value, count(*) AS count FROM n GROUP BY ALL",
    "dist_module_deps": f"WITH {_IMPORTS} SELECT module, category, string_split(import, '.')[1] || '.' || string_split(import, '.')[2] AS value, count(*) AS count FROM imports WHERE outside GROUP BY ALL",
    "coverage_summary": f"""WITH {_NAMES}, c AS (SELECT module, count(*) AS total, count(*) FILTER (tested) AS tested FROM marked GROUP BY 1)
SELECT module, 'TOTAL' AS value, total AS count FROM c UNION ALL SELECT module, 'TESTED', tested FROM c UNION ALL SELECT module, 'UNTESTED', total - tested FROM c
UNION ALL SELECT module, 'COVERAGE_RATIO_PERCENT', tested * 100 // total FROM c WHERE total > 0""",
    "coverage_untested": f"WITH {_NAMES} SELECT module, name FROM marked WHERE NOT tested",
    "cycles_class": f"WITH RECURSIVE {_reach(_EDGES + ', kept AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst)')} SELECT component, node FROM scc",
    "dist_method_count": _histogram(_COUNTS, "full_classes", "n_methods"),
    "doc_ratio": f"WITH {_METHODS}, {_GRID} " + _totals("classes", {"DOCUMENTED_CLASSES": "documented", "TOTAL_CLASSES": "true"}) + " UNION ALL " + _totals("methods", {"DOCUMENTED_METHODS": "documented", "TOTAL_METHODS": "true"}),
    "data_class_candidates": f"WITH {_NESTED} SELECT module, category, class FROM full_class WHERE class IN (SELECT class FROM data_classes)",
    "boolean_params": f"WITH {_NESTED} SELECT module, category, class, name, bools AS n_booleans FROM each_method WHERE bools >= 3",
    "dist_annotation": f"WITH {_NESTED} SELECT module, category, name AS value, count(*) AS count FROM each_annotation GROUP BY ALL",
    "package_tangles": "WITH RECURSIVE "
    + _reach(_EDGES + """, lifted AS (SELECT home AS src, "to" AS dst, count(DISTINCT (src, dst)) AS evidence FROM edges WHERE home <> "to" GROUP BY ALL), kept AS (SELECT src, dst FROM lifted)""")
    + " SELECT a.component, l.src, l.dst, l.evidence FROM lifted l JOIN scc a ON a.node = l.src JOIN scc b ON b.node = l.dst AND a.component = b.component",
    "import_diversity": f"""WITH {_IMPORTS}, p AS (SELECT module, string_split(import, '.')[1] || '.' || string_split(import, '.')[2] AS prefix, 'Brand#' || (length(module) + 8) || '.STANDARD' AS ns FROM imports WHERE import IS NOT NULL)
SELECT module, prefix || CASE WHEN prefix = ns OR starts_with(ns, prefix) THEN ' (internal)' ELSE ' (external)' END AS value, count(*) AS count FROM p GROUP BY ALL""",

    "rollup_metric": f"WITH {_METHODS} SELECT module, category, count(*) AS count, CAST(sum(params) AS BIGINT) AS complexity FROM methods GROUP BY ROLLUP (module, category)",
    "inter_module_matrix": f"""WITH {_NESTED}, used AS (SELECT module AS "from", import FROM lines),
to_class AS (SELECT "from", f.module AS "to" FROM used JOIN full_class f ON f.class = import),
to_package AS (SELECT "from", h.module AS "to" FROM used JOIN home h ON import = h.package || '.X' WHERE h.package IN (SELECT package FROM full_class))
SELECT "from", "to", count(*) AS import_count FROM (SELECT * FROM to_class UNION ALL SELECT * FROM to_package) WHERE "from" <> "to" GROUP BY ALL""",
    "inter_module_instability": f"WITH {_STABILITY} SELECT * FROM stability",
    "longest_prefix_owner": f"""WITH {_FILES}, one AS (SELECT string_split(path, '/')[1] AS p1, array_to_string(string_split(path, '/')[1:2], '/') AS p2 FROM files),
known AS (SELECT prefix FROM (SELECT p1 AS prefix FROM one UNION ALL SELECT p2 FROM one) GROUP BY 1 HAVING count(*) >= 2),
best AS (SELECT page_id, max_by(prefix, length(prefix)) AS prefix FROM files JOIN known ON path = prefix OR starts_with(path, prefix || '/') GROUP BY 1)
SELECT page_id, 'M:' || prefix AS owner, prefix FROM files LEFT JOIN best USING (page_id)""",
    "file_stats": f"WITH {_FILES} SELECT wildcard, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines FROM matched GROUP BY 1",
    "files_count": f"WITH {_FILES} SELECT count(*) AS count FROM files WHERE filename LIKE '%.html'",
    "count_per_type": f"WITH {_FILES} SELECT wildcard, count(*) AS count FROM matched GROUP BY 1",
    "count_per_type_dir": f"WITH {_FILES} SELECT directory, wildcard, count(*) AS count FROM matched GROUP BY ALL",
    "list_matching": rf"WITH {_FILES} SELECT directory, array_to_string(list_sort(list_distinct(list(filename))), ',') AS files FROM files WHERE (filename LIKE '%.html' OR filename LIKE '%1%') AND NOT regexp_matches(directory, '(^|/)\.[^/]') GROUP BY 1",
    "list_directory": f"WITH {_FILES} SELECT directory, filename, lines FROM files WHERE directory = (SELECT min(directory) FROM files)",
    "sbom_direct_deps": "SELECT DISTINCT s_name AS ref, n_nationkey || ':' || s_name AS label FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE r_name = 'ASIA'",
    "sbom_licenses": "SELECT p_brand AS license FROM part UNION SELECT p_type FROM part WHERE p_size > 25",
    "sbom_dep_licenses": "SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size % 2 = 0 THEN p_brand || ':' ELSE '' END || p_name AS name, CAST(p_partkey AS VARCHAR) AS version, p_brand || CASE WHEN p_size > 25 THEN ', ' || p_type ELSE '' END AS licenses FROM part",
    "runnable_tasks": "SELECT l_orderkey AS id FROM lineitem GROUP BY 1 HAVING bool_and(l_linestatus = 'F')",
    "resume_anti_join": "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS task_id, l_linenumber AS index FROM lineitem WHERE NOT (l_linenumber IN (1, 2) AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))",
    "module_status": """SELECT CASE WHEN length(text) >= 60 THEN CAST(doc_id AS VARCHAR) END AS module, CASE WHEN length(text) < 60 OR text IS NULL THEN 'ERROR' WHEN lang IS DISTINCT FROM 'en' THEN 'SKIPPED'
WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'REUSED' ELSE 'GENERATED' END AS status FROM documents""",
    "json_pointer_explode": "SELECT event_id, CAST(p AS BIGINT) AS position, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events, (VALUES (0), (1)) t(p)",
    "schema_violations": """WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, '/z' AS path, 'required' AS rule FROM e UNION ALL SELECT event_id, '/k', 'minimum' FROM e WHERE k < 10 UNION ALL SELECT event_id, '/k', 'maximum' FROM e WHERE k > 90
UNION ALL SELECT event_id, '/k', 'required' FROM e WHERE k IS NULL""",
    "render_table": "SELECT '== ' || r_name || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS section FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "last_n_messages": "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2",
    "messages_since": "SELECT conv_id, turn, role FROM conversations WHERE lower(role) <> 'system' AND turn > coalesce((SELECT max(m.turn) FROM conversations m WHERE m.conv_id = conversations.conv_id AND m.turn < 2), -1)",
    "conversation_logs": "SELECT conv_id, string_agg('== ' || upper(role) || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) AS log FROM conversations GROUP BY 1",
    "token_usage": """SELECT conv_id, CAST(sum(CASE WHEN lower(role) <> 'assistant' THEN coalesce(length(text), 0) ELSE 0 END) AS BIGINT) AS input, CAST(sum(CASE WHEN lower(role) = 'assistant' THEN coalesce(length(text), 0) ELSE 0 END) AS BIGINT) AS output,
CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS total FROM conversations GROUP BY ROLLUP (conv_id)""",
    "loop_progress": "SELECT o_custkey AS task_id, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS failed, count(*) FILTER (o_orderstatus = 'O') AS running, count(*) AS total FROM orders GROUP BY 1",
    "progress_windows": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "labels": """WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderkey * 37 AS ms FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey < 1000 THEN CAST(o_orderkey AS VARCHAR) ELSE (o_orderkey + 50) // 1000 || '.' || (o_orderkey + 50) // 100 % 10 || 'K' END AS tokens,
  CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN (ms // 1000) || 's' ELSE printf('%d:%02d', ms // 60000, ms // 1000 % 60) END AS elapsed,
  CASE WHEN o_orderkey % 3 = 0 THEN '/' WHEN o_orderstatus = 'F' THEN 'x' WHEN o_orderstatus = 'P' THEN '-' ELSE ' ' END AS mark FROM o""",
    "names": r"""WITH q AS (SELECT p_partkey, p_brand || '.' || p_type || '.' || p_name AS q, p_brand || '.' || p_type AS b FROM part)
SELECT p_partkey, string_split(q, '.')[-1] AS simple, regexp_extract(q, '^(.*)\.[^.]*$', 1) AS package, array_to_string(string_split(q, '.')[1:2], '.') AS prefix, regexp_replace(q, '[^\w.-]', '_', 'g') AS file FROM q""",
    "tool_filter": "SELECT p_partkey, p_type AS tool FROM part WHERE ((p_type LIKE 'STANDARD%' OR p_type LIKE 'PROMO %') AND (p_type LIKE '%BRASS' OR p_type LIKE 'PROMO%')) OR p_type LIKE 'ECONOMY%'",
    "rules_findings": f"WITH {_NESTED} " + _found("each_method", [*_RULES, ("booleans", "bools >= 3", "three or more boolean parameters", "LOW", "LOW")]),
    "rules_classes": f"""WITH RECURSIVE {_NESTED}, up AS (SELECT c.module, c.class, c.parent FROM full_class c),
depth AS (SELECT u.module, u.class, CASE WHEN u.parent IS NULL THEN 0 ELSE 1 END AS depth FROM up u LEFT JOIN up p ON p.module = u.module AND p.class = u.parent AND p.class <> u.class WHERE p.class IS NULL AND NOT (u.parent = u.class AND u.parent IS NOT NULL)
  UNION ALL SELECT u.module, u.class, d.depth + 1 FROM depth d JOIN up u ON u.module = d.module AND u.parent = d.class AND u.class <> d.class),
counted AS (SELECT class, count(*) FILTER (large) AS n_fields, count(*) FILTER (NOT large) AS n_methods, count(*) FILTER (large AND l_linestatus <> 'O' AND NOT (l_discount = 0 AND l_tax = 0)) AS n_open,
  count(*) FILTER (import <> package AND NOT starts_with(import, package || '.')) AS n_external FROM lines GROUP BY class),
f AS (SELECT c.module, c.class, coalesce(n_fields, 0) AS n_fields, coalesce(n_methods, 0) AS n_methods, coalesce(n_open, 0) AS n_open, coalesce(n_external, 0) AS n_external, n_interfaces, coalesce(depth, 0) AS depth,
  c.class IN (SELECT class FROM data_classes) AS is_data_class FROM full_class c LEFT JOIN counted USING (class) LEFT JOIN depth ON depth.class = c.class) """
    + _found("f", _CLASS_RULES),
    "rules_grouped": f"WITH {_STABILITY}, f AS ("
    + " UNION ALL ".join(f"SELECT module, '{f}' AS finding, '{u}' AS urgency, '{k}' AS criticality FROM stability WHERE {c}" for c, f, u, k in _STABLE)
    + ") SELECT 'stability' AS aspect, finding, urgency, criticality, string_agg(module, ', ' ORDER BY module) AS modules, count(*) AS occurrences FROM f GROUP BY ALL",
    "unstable_dependencies": f"""WITH {_STABILITY} SELECT "from", "to" FROM surplus WHERE "from" IN (SELECT module FROM stability WHERE ce + ca > 0 AND instability < 50) AND "to" IN (SELECT module FROM stability WHERE instability > 50)""",
    "top_prefix_share": f"""WITH {_IMPORTS}, p AS (SELECT module, string_split(import, '.')[1] AS value, count(*) AS n FROM imports WHERE import IS NOT NULL GROUP BY ALL),
t AS (SELECT module, sum(n) AS total, max(n) AS most, arg_max(value, (n, value)) AS subject FROM p GROUP BY 1) SELECT module, subject FROM t WHERE most * 100 > total * 4""",
    "csv_by_category": f"""WITH {_METHODS} SELECT module, category AS "Category", params AS "Value", count(*) AS "Count" FROM methods GROUP BY ALL""",
}
_DEPTHS = SQL["rules_classes"].split("SELECT module, 'fields' AS aspect", 1)[0].rstrip()
SQL["rules_modules"] = f"""{_DEPTHS}, m AS (SELECT module, count(*) AS n_all, count(*) FILTER (l_returnflag = 'N') AS n_public, count(*) FILTER (l_returnflag = 'A') AS n_private, 0 AS n_protected,
  count(*) FILTER (l_linestatus = 'F') AS n_static FROM each_method WHERE category = 'production' GROUP BY 1),
k AS (SELECT module, count(*) FILTER (category = 'production') AS n_classes, count(*) FILTER (category = 'production' AND documented) AS n_documented, count(*) FILTER (category = 'test') AS n_tests FROM full_class GROUP BY 1),
d AS (SELECT f.module, max(depth) AS max_depth, sum(n_external) AS n_external FROM f JOIN full_class c USING (class) WHERE c.category = 'production' GROUP BY 1),
p AS (SELECT DISTINCT module, unit FROM full_class WHERE category <> 'test'), t AS (SELECT DISTINCT module, unit FROM full_class WHERE category = 'test'),
cov AS (SELECT p.module, count(t.unit) * 100 // count(*) AS coverage FROM p LEFT JOIN t USING (module, unit) GROUP BY 1),
all_facts AS (SELECT * FROM k LEFT JOIN m USING (module) LEFT JOIN d USING (module) LEFT JOIN cov USING (module)) {_of_modules("all_facts", _MODULE_RULES)}"""
SQL["rules_annotations"] = f"""WITH {_NESTED}, n AS (SELECT module, count(*) AS n, count(*) FILTER (name = 'org.frame.Bean') AS n_framework FROM each_annotation GROUP BY 1),
k AS (SELECT module, count(*) AS n_classes FROM full_class GROUP BY 1),
o AS (SELECT module, count(*) AS n_overridable, count(*) FILTER (l_returnflag = 'N') AS n_overriding FROM each_method WHERE id % 3 = 0 OR id % 8 > 0 GROUP BY 1),
whole AS (SELECT *, sum(n) OVER () AS all_n, sum(n_classes) OVER () AS all_classes FROM n JOIN k USING (module) LEFT JOIN o USING (module)) {_of_modules("whole", _ANNOTATION_RULES)}"""
SQL["rules_imports"] = f"""WITH {_NESTED}, p AS (SELECT module, array_to_string(string_split(import, '.')[1:2], '.') AS prefix, count(*) AS n, count(*) FILTER (NOT starts_with(import, package || '.')) AS outside FROM lines GROUP BY ALL),
i AS (SELECT module, sum(n) AS n_imports, sum(outside) AS n_external, max(outside) AS n_top FROM p GROUP BY 1) {_of_modules("i", _IMPORT_RULES)}"""
SQL["rules_cycles"] = f"""{SQL["cycles_class"].rsplit(" SELECT component, node FROM scc", 1)[0]}, sized AS (SELECT component, count(*) AS size FROM scc GROUP BY 1)
SELECT 'all' AS module, component AS subject, 'cycles' AS aspect, 'cycle' AS finding, 'HIGH' AS urgency, 'HIGH' AS criticality FROM sized
UNION ALL SELECT 'all', component, 'cycles', 'cycle of more than 3', 'HIGH', 'HIGH' FROM sized WHERE size > 3"""
_BATCH = (
    "dist_visibility", "dist_interface_count", "dist_param_count", "dist_loc_null_skip", "dist_nesting", "dist_complexity", "dist_field_visibility", "dist_field_count",
    "dist_field_method_ratio", "dist_coupling", "dist_module_deps", "dist_method_count", "doc_ratio", "dist_annotation",
)
SQL["batch_metrics"] = " UNION ALL ".join(f"SELECT '{name}' AS metric, module, category, value, count FROM ({SQL[name]})" for name in _BATCH)
SQL["json_repair"] = r"""
WITH p AS (SELECT page_id, html, regexp_replace(html, '[\\\n\r\t]', ' ', 'g') AS plain FROM pages),
c AS (SELECT *, regexp_extract(plain || '",', '(?s)^(.*?)"[ \t\n\x0b\f\r]*(?:[,}]|$)', 1) = plain AS whole FROM p)
SELECT page_id, CASE WHEN whole THEN page_id END AS id, CASE WHEN whole THEN length(html) END AS n FROM c
"""
SQL["task_layers"] = """
WITH RECURSIVE need AS (SELECT DISTINCT node, n.p_partkey AS needs FROM (SELECT p_partkey AS node, unnest([p_partkey // 2, p_partkey // 3, CASE p_partkey % 64 WHEN 40 THEN p_partkey + 1 WHEN 41 THEN p_partkey - 1 END]) AS k FROM part) JOIN (SELECT p_partkey FROM part) n ON n.p_partkey = k AND k > 0),
reach AS (SELECT node, needs FROM need UNION SELECT r.node, n.needs FROM reach r JOIN need n ON n.node = r.needs),
core AS (SELECT DISTINCT node FROM reach WHERE node = needs),
stuck AS (SELECT node FROM core UNION SELECT r.node FROM reach r JOIN core c ON c.node = r.needs),
walk AS (SELECT p_partkey AS node, 0 AS level FROM part WHERE p_partkey NOT IN (SELECT node FROM need)
  UNION SELECT n.node, level + 1 FROM walk w JOIN need n ON n.needs = w.node WHERE n.node NOT IN (SELECT node FROM stuck)),
high AS (SELECT node, max(level) AS level FROM walk GROUP BY 1)
SELECT p_partkey AS node, level, p_partkey IN (SELECT node FROM core) AS in_cycle FROM part LEFT JOIN high ON node = p_partkey
"""
_TREE = _FILES.split("globs(wildcard", 1)[0] + r"""deep AS (SELECT rtrim(regexp_replace(path, '([0-9])', '\1/', 'g'), '/') AS path, lines FROM files),
tree AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, string_split(path, '/')[-1] AS filename, lines FROM deep),
here AS (SELECT directory AS path, string_agg(DISTINCT CASE filename WHEN '5' THEN 'five' ELSE 'page' END, ',' ORDER BY CASE filename WHEN '5' THEN 'five' ELSE 'page' END) AS build_systems FROM tree WHERE filename IN ('5', '.html') GROUP BY 1),
inside AS (SELECT h.path, a.path AS around FROM here h JOIN here a ON h.path = a.path OR starts_with(h.path, a.path || '/')),
short AS (SELECT path, string_agg(string_split(around, '/')[-1], '.' ORDER BY length(around)) AS short, max(around) FILTER (around <> path) AS parent FROM inside GROUP BY 1),
mods AS (SELECT CASE WHEN count(*) OVER (PARTITION BY short) > 1 THEN 'site.' || replace(path, '/', '.') ELSE short END AS module, path, false AS root, parent, build_systems FROM short JOIN here USING (path)),
owned AS (SELECT t.*, m.module, m.path = max(m.path) OVER (PARTITION BY t.rowid) AS own FROM (SELECT *, row_number() OVER () AS rowid FROM tree) t JOIN mods m ON t.directory = m.path OR starts_with(t.directory, m.path || '/'))"""
SQL["module_tree"] = f"""WITH {_TREE}, sums AS (SELECT module, count(*) FILTER (own) AS files, CAST(coalesce(sum(lines) FILTER (own), 0) AS BIGINT) AS lines, count(*) AS all_files, CAST(sum(lines) AS BIGINT) AS all_lines FROM owned GROUP BY 1)
SELECT * FROM mods JOIN sums USING (module)"""
SQL["module_languages"] = f"""WITH {_TREE}, kinds(language, re) AS (VALUES ('digits', '^[0-9]$'), ('odd', '^[13579]$'), ('page', '^\\.html$'))
SELECT module, language, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines FROM owned JOIN kinds ON regexp_matches(filename, re) WHERE own GROUP BY ALL"""
_SYMBOLS = """part_class AS (SELECT p_partkey, 'b' || substr(p_brand, 7) AS of, replace(p_name, ' ', '_') AS simple FROM part),
used AS (SELECT 'o' || o_orderkey AS unit, 'b' || (o_custkey % 30) AS package, of, simple, l_linenumber AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part_class ON p_partkey = l_partkey),
known AS (SELECT DISTINCT of, simple FROM part_class),
named AS (SELECT DISTINCT unit, package, of, simple, n = 7 AS dotted FROM used),
found AS (SELECT unit, x.simple, 2 AS rank, s.of || '.' || x.simple AS qualified FROM named x JOIN used s USING (unit) WHERE s.n = 1 AND s.simple = x.simple AND NOT dotted
  UNION SELECT unit, x.simple, 3, k.of || '.' || k.simple FROM named x JOIN known k ON k.of = x.package AND k.simple = x.simple WHERE NOT dotted
  UNION SELECT unit, x.simple, 4, k.of || '.' || k.simple FROM named x JOIN used w USING (unit) JOIN known k ON k.of = w.of AND k.simple = x.simple WHERE w.n IN (2, 3) AND NOT dotted),
ranked AS (SELECT unit, simple, rank, count(*) AS candidates, min(qualified) AS qualified FROM found GROUP BY ALL),
best AS (SELECT unit, simple, min_by(struct_pack(rank, candidates, qualified), rank) AS b FROM ranked GROUP BY ALL),
resolved AS (SELECT DISTINCT unit, x.simple AS name, CASE WHEN b.candidates = 1 THEN b.qualified END AS qualified, CASE WHEN b.candidates = 1 THEN ['import', 'package', 'wildcard'][b.rank - 1] END AS scope, coalesce(b.candidates, 0) AS candidates
  FROM named x LEFT JOIN best USING (unit, simple) WHERE NOT dotted
  UNION SELECT DISTINCT unit, of || '.' || simple, of || '.' || simple, 'qualified', 1 FROM named WHERE dotted)"""
SQL["resolve_symbols"] = f"WITH {_SYMBOLS} SELECT * FROM resolved"
SQL["symbol_imports"] = f"""WITH {_SYMBOLS}, u AS (SELECT unit, qualified AS import FROM resolved WHERE qualified IS NOT NULL UNION SELECT unit, of || '.' || simple FROM used WHERE n = 1)
SELECT import, count(*) AS units FROM u GROUP BY 1"""
_ESTATE = """cust AS (SELECT c_custkey AS k, CASE WHEN c_custkey < 16 THEN c_custkey ELSE c_custkey >> CAST(length(bin(c_custkey)) - 4 AS BIGINT) END AS m FROM customer),
cu AS (SELECT k, m, 'M' || m AS module, CASE WHEN k % 5 = 0 AND m % 4 <> 1 THEN 'test' ELSE 'production' END AS category FROM cust),
ln AS (SELECT module, m, category, k, l_quantity > 40 AS is_field,
  CASE WHEN m % 5 = 0 OR (m % 5 = 1 AND l_linenumber <= 5) OR l_returnflag = 'N' THEN 'PUBLIC' WHEN l_returnflag = 'A' THEN 'PRIVATE' ELSE 'PROTECTED' END AS vis,
  CASE WHEN m % 3 = 0 THEN l_linestatus = 'F' ELSE l_discount = 0 END AS stat, l_discount = 0 AS fin, l_linenumber + CAST(floor(l_quantity) AS INTEGER) % 4 AS params,
  CASE WHEN l_tax <> 0 THEN CAST(floor(l_quantity) AS INTEGER) * 2 END AS loc, l_partkey % 25 AS cc, l_suppkey % 8 AS nest, l_linenumber % 5 AS bools,
  CASE WHEN l_returnflag = 'N' AND (m % 2 = 0 OR l_linenumber = 7) THEN 'Override' WHEN l_tax = 0 OR m % 6 = 1 THEN 'org.frame.Bean' END AS mark,
  CASE WHEN m % 4 = 3 THEN 'org.lib.P' || l_partkey WHEN m % 4 = 1 THEN CASE WHEN l_linenumber % 2 = 1 THEN 'java.util.P' || l_partkey ELSE 'com.v' || (l_partkey % 5) || '.Q' END
       WHEN l_linenumber > 1 THEN 'pkg.m' || m || '.C' || l_partkey ELSE 'org.x' || (l_partkey % 9) || '.Y' END AS import, l_partkey AS part
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN cu ON k = o_custkey),
each_line AS (SELECT *, NOT starts_with(import, 'pkg.m' || m || '.') AS outside FROM ln),
sums AS (SELECT k, count(*) FILTER (is_field) AS n_fields, count(*) FILTER (NOT is_field) AS n_methods, count(*) FILTER (is_field AND vis = 'PUBLIC' AND NOT (stat AND fin)) AS n_open, count(*) FILTER (outside) AS n_external FROM each_line GROUP BY 1),
cl AS (SELECT cu.*, coalesce(n_fields, 0) AS n_fields, coalesce(n_methods, 0) AS n_methods, coalesce(n_open, 0) AS n_open, coalesce(n_external, 0) AS n_external, k % 8 AS n_interfaces, k % 7 = 0 AS is_data_class,
  m % 2 = 0 OR k % 3 = 0 AS documented, CASE WHEN k % 4 <> 3 AND m <> 8 AND k >= 16 THEN k // 2 END AS parent FROM cu LEFT JOIN sums USING (k)),
chain AS (SELECT k AS class, parent AS up, CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS depth FROM cl UNION ALL SELECT class, c.parent, depth + 1 FROM chain JOIN cl c ON c.k = up WHERE c.parent IS NOT NULL),
cf AS (SELECT cl.*, d.depth FROM cl JOIN (SELECT class, max(depth) AS depth FROM chain GROUP BY 1) d ON class = k),
mm AS (SELECT module, count(*) AS n_all, count(*) FILTER (vis = 'PUBLIC') AS n_public, count(*) FILTER (vis = 'PRIVATE') AS n_private, count(*) FILTER (vis = 'PROTECTED') AS n_protected, count(*) FILTER (stat) AS n_static
  FROM ln WHERE NOT is_field AND category = 'production' GROUP BY 1),
mk AS (SELECT module, count(*) FILTER (category = 'production') AS n_classes, count(*) FILTER (category = 'production' AND documented) AS n_documented, count(*) FILTER (category = 'test') AS n_tests,
  max(depth) FILTER (category = 'production') AS max_depth, sum(n_external) FILTER (category = 'production') AS n_external FROM cf GROUP BY 1),
cov AS (SELECT p.module, count(t.k) * 100 // count(*) AS coverage FROM cl p LEFT JOIN cl t ON t.category = 'test' AND t.module = p.module AND t.k + 1 = p.k WHERE p.category = 'production' GROUP BY 1),
mf AS (SELECT * FROM mk LEFT JOIN mm USING (module) LEFT JOIN cov USING (module)),
an AS (SELECT module, count(*) AS n, count(*) FILTER (mark = 'org.frame.Bean') AS n_framework FROM ln WHERE mark IS NOT NULL AND NOT is_field GROUP BY 1),
heirs AS (SELECT l.module, count(*) AS n_overridable, count(*) FILTER (mark = 'Override') AS n_overriding FROM ln l JOIN cl USING (k) WHERE NOT is_field AND (parent IS NOT NULL OR n_interfaces > 0) GROUP BY 1),
sized AS (SELECT module, count(*) AS n_classes, coalesce(max(n), 0) AS n, coalesce(max(n_framework), 0) AS n_framework FROM cl LEFT JOIN an USING (module) GROUP BY 1),
af AS (SELECT s.*, coalesce(n_overridable, 0) AS n_overridable, coalesce(n_overriding, 0) AS n_overriding, sum(n) OVER () AS all_n, sum(n_classes) OVER () AS all_classes FROM sized s LEFT JOIN heirs USING (module)),
ip AS (SELECT module, array_to_string(string_split(import, '.')[1:2], '.') AS prefix, count(*) AS n, count(*) FILTER (outside) AS outside, count(*) FILTER (outside AND starts_with(import, 'java.')) AS java FROM each_line GROUP BY ALL),
imf AS (SELECT module, sum(n) AS n_imports, sum(outside) AS n_external, sum(java) AS n_java, max(outside) AS n_top FROM ip GROUP BY 1),
edges AS (SELECT module AS "from", 'M' || (part % 16) AS "to", count(*) AS n FROM ln WHERE (m <> 5 AND part % 16 <> 5 AND part % 16 < m) OR (m = 1 AND part % 16 = 15) GROUP BY ALL),
st AS (SELECT module, ce, ca, CASE WHEN ce + ca > 0 THEN ce * 100 // (ce + ca) ELSE 0 END AS instability FROM (SELECT DISTINCT module, (SELECT count(DISTINCT "to") FROM edges WHERE "from" = module) AS ce, (SELECT count(DISTINCT "from") FROM edges WHERE "to" = module) AS ca FROM cu))"""
_IMPORT_RULES_OF_ALL = [(a, "10 * n_java > 4 * n_external" if c == "false" else c, *rest) for a, c, *rest in _IMPORT_RULES]
_TABLES = {
    "methods": ("(SELECT * FROM ln WHERE NOT is_field)", [*_RULES, ("booleans", "bools >= 3", "three or more boolean parameters", "LOW", "LOW")]), "classes": ("cf", _CLASS_RULES), "modules": ("mf", _MODULE_RULES),
    "annotations": ("af", _ANNOTATION_RULES), "imports": ("imf", _IMPORT_RULES_OF_ALL), "stability": ("st", [("stability", *r) for r in _STABLE]),
}
SQL["rules_estate"] = f"WITH RECURSIVE {_ESTATE} " + " UNION ALL ".join(f"SELECT *, '{n}' AS rules FROM ({_found(rows, rules)})" for n, (rows, rules) in _TABLES.items())
SQL["unstable_estate"] = f"""WITH RECURSIVE {_ESTATE} SELECT e."from", e."to" FROM edges e JOIN st a ON a.module = e."from" JOIN st b ON b.module = e."to" WHERE a.ce + a.ca > 0 AND a.instability < 30 AND b.instability > 70"""
SQL["rules_package_cycles"] = SQL["package_tangles"].rsplit(" SELECT a.component, l.src", 1)[0] + """, sized AS (SELECT component, count(*) AS size FROM scc GROUP BY 1)
SELECT 'all' AS module, component AS subject, 'cycles' AS aspect, 'cycle' AS finding, 'HIGH' AS urgency, 'HIGH' AS criticality FROM sized
UNION ALL SELECT 'all', component, 'cycles', 'cycle of more than 3', 'HIGH', 'HIGH' FROM sized WHERE size > 3"""
SQL["sql_prefix_counts"] = """
WITH named AS (SELECT p_partkey, string_split(p_brand || '.' || p_type || '.' || replace(p_name, ' ', '.'), '.') AS parts FROM part),
prefixes AS (SELECT p_partkey, array_to_string(parts[1:i], '.') AS prefix FROM named, generate_series(1, 3) t(i) WHERE i <= len(parts))
SELECT l_returnflag AS returned, prefix, count(*) AS count FROM lineitem JOIN prefixes ON l_partkey = p_partkey GROUP BY ALL
"""
SQL["sql_json_problems"] = "SELECT event_id, 1::BIGINT AS problems FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 90"
SQL["done_indices"] = "SELECT DISTINCT user_id AS task_id, event_id % 5000 AS index FROM events WHERE event_id IS NOT NULL"
