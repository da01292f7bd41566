"""JSON text, schemas, sinks, templates, rules, tasks, scheduling and streams."""

import random

import pytest
from pyspark.sql import functions as F

from structlens import schemas
from structlens.functions import json_text, scalars
from structlens.pipeline import scheduler, tasks
from structlens.report import sinks
from structlens.rules import thresholds
from structlens.streaming import progress


@pytest.mark.parametrize(("text", "fixed"), [
    ('{"a": 1}', '{"a": 1}'), ('```json{"a": "b"}```', '{"a": "b"}'), ('  "key" : "say "hi" to all",', '  "key" : "say \\"hi\\" to all",'), ('"k": "a \\"b\\" c"', '"k": "a \\"b\\" c"'),
    ('"k": "end" }', '"k": "end" }'), ("no pair", "no pair"), (' ```json{}', ' ```json{}'), ('"k": "x "y"",', '"k": "x \\"y\\"",'), (None, None),
])
def test_repair(text, fixed):
    assert json_text.fix(text) == fixed


def test_repaired_column(spark):
    rng = random.Random(8)
    texts = ['```json\n"k" : "a "b" c"\n```', None, "", '"k": "' + 'x" y ' * 20_000 + '"', '"k": "a \\\\" b"', '"k": "\\', '"k": "\ue000b" \ue000a"', '"a" : "b" , "c": "d"', "```json```"]
    texts += ["".join(rng.choices(['"', "\\", ",", "}", " ", "\n", ":", "a", '"k": "', "\t", "\ue000", "b", "😀", "é"], k=rng.randrange(40))) for _ in range(400)]
    got = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", json_text.repaired(F.col("t")).alias("f")).collect()
    assert [r.f for r in got] == [json_text.fix(t) for t in texts]


SCHEMA = {"title": "Thing", "type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "kind": {"enum": ["A", "B"]}, "parts": {"type": "array", "items": {"title": "Part", "type": "object", "required": ["n"], "properties": {"n": {"type": "string"}}}}}}


def test_schema():
    assert schemas.from_json_schema(SCHEMA).simpleString() == "struct<id:bigint,kind:string,parts:array<struct<n:string>>>"
    assert schemas.describe(SCHEMA) == "{id: integer, kind: A|B, parts: array of Part {n: string}}"
    assert schemas.schema_name(SCHEMA) == "Thing" and schemas.schema_name({}) == "Result"


def test_violations(spark):
    rows = [(1, '{"id": 1, "kind": "A"}'), (2, '{"kind": "C"}'), (3, "oops"), (4, '{"id": 4, "parts": [{"n": "x"}, {}]}'), (5, None), (6, '{"id": "6", "parts": {}}'), (7, "[1]"), (8, '{"id": null}'), (9, '{"id": 1.5}')]
    got = {tuple(r) for r in json_text.violations(spark.createDataFrame(rows, "k INT, t STRING"), "t", SCHEMA, "k").collect()}
    assert got == {(2, "/id", "required"), (2, "/kind", "enum"), (3, "", "json"), (4, "/parts/*/n", "required"), (5, "", "json"), (6, "/id", "type"), (6, "/parts", "type"), (7, "", "json"), (8, "/id", "required"), (9, "/id", "type")}
    good = spark.createDataFrame(rows[:1], "k INT, t STRING")
    assert json_text.validated(good, "t", SCHEMA, "k") is good
    with pytest.raises(ValueError, match="/id breaks required"):
        json_text.validated(spark.createDataFrame(rows[1:2], "k INT, t STRING"), "t", SCHEMA, "k")


def test_elements_and_properties(spark):
    docs = spark.createDataFrame([(1, '{"m": {"l": [{"a": 1}, {"a": 2}]}}'), (2, "{}")], "id INT, text STRING")
    assert [(r.id, r.position) for r in json_text.elements(docs, "text", "$.m.l", "id").collect()] == [(1, 0), (1, 1)]
    results = spark.createDataFrame([(1, 1, '{"x": true}')], "id INT, position INT, value STRING")
    assert json_text.with_property(docs, results, "$.m.l", "r", "id").first().entries == '[{"a":1},{"a":2,"r":{"x":true}}]'


def test_labels(spark):
    row = spark.range(1).select(scalars.token_label(F.lit(999)), scalars.token_label(F.lit(1500)), scalars.elapsed_label(F.lit(950)), scalars.elapsed_label(F.lit(61_000)), scalars.task_mark(F.lit(True), F.lit(None).cast("string")), scalars.file_label(F.lit("a b/c.x"))).first()
    assert tuple(row) == ("999", "1.5K", "950ms", "1:01", " ", "a_b_c.x")


def test_tool_filter(spark):
    rows = spark.createDataFrame([("sbom_load",), ("java_x",), ("java_y",)], "n STRING")
    names = lambda *a: {r.n for r in rows.where(scalars.tool_allowed(F.col("n"), *a)).collect()}
    assert names() == {"sbom_load", "java_x", "java_y"} and names(["java_.*"]) == {"java_x", "java_y"} and names([], ["java"]) == {"sbom_load", "java_x", "java_y"}
    assert names([], [".*"]) == set() and names(["java_x"], ["java_.*"]) == {"java_x", "sbom_load"}


def test_csv(spark, tmp_path):
    rows = spark.createDataFrame([("m", "test", "2", 1), ("m", "production", "10", 3), ("m", "production", "9", 4)], "module STRING, category STRING, value STRING, count LONG")
    path = sinks.write_csv(sinks.by_category(rows, numeric=True), str(tmp_path / "new"), "cc of m.csv")
    assert open(path).read().splitlines() == ["Category,Value,Count", "production,9,4", "production,10,3", "test,2,1"] and path.endswith("cc_of_m.csv")
    assert sinks.write_csv(rows.limit(0), str(tmp_path / "none"), "x.csv") is None and not (tmp_path / "none").exists()
    assert [tuple(r) for r in sinks.by_key(rows.where("category = 'production'")).collect()] == [("10", 3), ("9", 4)]
    edges = spark.createDataFrame([("b", "a", 2), ("a", "a", 5), ("a", "b", 0)], "from STRING, to STRING, import_count LONG")
    assert [tuple(r) for r in sinks.matrix(edges).collect()] == [("b", "a", 2)]


def test_template():
    text = "{{#each modules}}{{@index}} {{name}} of {{../title}}{{#if root}}!{{else}}?{{/if}}{{#each files}} {{this}}{{/each}}\n{{else}}none{{/each}}{{> end}}{{lookup names key}}"
    data = {"title": "<T>", "modules": [{"name": "a", "root": True, "files": ["x", "y"]}, {"name": "b"}], "names": {"k": "v"}, "key": "k"}
    assert sinks.Template(text, {"end": "{{#with names}}[{{k}}]{{/with}}"}).render(data) == "0 a of <T>! x y\n1 b of <T>?\n[v]v"
    assert sinks.Template("{{#each x}}.{{else}}none{{/each}}").render({}) == "none"
    with pytest.raises(ValueError):
        sinks.Template("{{#if a}}")


def test_findings(spark):
    rows = spark.createDataFrame([("m", "A.f", 8, 31, 12, 1, 0), ("n", "B.g", 8, None, None, 9, 0)], "module STRING, class STRING, parameter_count INT, lines_of_code INT, complexity INT, nesting INT, n_booleans INT")
    found = thresholds.evaluate(rows, thresholds.METHOD_RULES, "module", "class")
    got = {(r.module, r.finding) for r in found.collect()}
    assert got == {("m", "more than 7 parameters"), ("m", "more than 30 statements"), ("m", "complex, long and with many parameters"), ("m", "many branches side by side"), ("n", "more than 7 parameters"), ("n", "nested more than 4 deep")}
    assert {(r.finding, r.modules) for r in thresholds.grouped(found).collect()} >= {("more than 7 parameters", "m, n")}


TASKS = """
# tasks
id: A
name: "First one"
tags: [a]
---
id: B
dependsOn:
  - a
tags: [b]
---
id: C
dependsOn: [a, b]
toolWhitelist: [java_.*]
---
id: D
active: true
loopOn: /modules
---
id: E
active: false
tags: [e]
"""


def test_tasks(spark):
    found = tasks.parse(TASKS)
    assert [t.id for t in found] == list("ABCDE") and found[0].name == "First one" and found[1].depends_on == ("a",) and not found[4].active
    assert tasks.problems(found) == [] and tasks.frame(spark, found).count() == 5
    bad = [tasks.Task("x", tags=("t",), depends_on=("u",)), tasks.Task("y", tags=("u",), depends_on=("t",)), tasks.Task("y"), tasks.Task("z", depends_on=("none",))]
    assert tasks.problems(bad) == ["task y is defined twice", "task z depends on unknown tag none", "task x depends on itself", "task y depends on itself"] or tasks.cyclic(bad[:2]) == ["x", "y"]


def test_scheduler(tmp_path):
    found = tasks.parse(TASKS)
    state = tasks.StateTable(str(tmp_path / "state.json"))
    assert [t.id for t in scheduler.ready(found, state)] == ["A", "D"]
    done, broken = [], {("D", 1)}

    def work(task, index):
        done.append((task.id, index))
        if (task.id, index) in broken:
            raise RuntimeError("no")
        return {}

    got = scheduler.run(found, work, state, size=lambda t: 3, parallel=1)
    assert got == {"A": "SUCCESSFUL", "B": "SUCCESSFUL", "C": "SUCCESSFUL", "D": "FAILED", "E": "SKIPPED"}
    assert [t for t, _ in done if t in "ABC"] == ["A", "B", "C"]
    broken.clear()
    done.clear()
    again = tasks.StateTable(str(tmp_path / "state.json"))
    assert again.indices("D") == {0, 2}
    assert scheduler.run(found, work, again, size=lambda t: 3)["D"] == "SUCCESSFUL" and done == [("D", 1)]


def test_failure_blocks_dependents_only(tmp_path):
    found = tasks.parse(TASKS)
    got = scheduler.run(found, lambda t, i: None if t.id == "A" else 1, tasks.StateTable(str(tmp_path / "s.json")), size=lambda t: 1)
    assert got == {"A": "FAILED", "B": "BLOCKED", "C": "BLOCKED", "D": "SUCCESSFUL", "E": "SKIPPED"}
    with pytest.raises(ValueError):
        scheduler.run([tasks.Task("x", depends_on=("gone",))], lambda t, i: 1, tasks.StateTable(str(tmp_path / "t.json")))


@pytest.mark.parametrize("attempt", range(5))
def test_state_survives_many_threads(tmp_path, attempt):
    found = [tasks.Task(f"t{i}", loop_on="/x", tags=(f"g{i}",), depends_on=(f"g{i - 4}",) if i >= 4 else ()) for i in range(8)]
    path = str(tmp_path / "state.json")
    got = scheduler.run(found, lambda t, i: None if (t.id, i) == ("t7", 3) else i + 1, tasks.StateTable(path), size=lambda t: 12, parallel=4, loop_parallel=4)
    assert got == {f"t{i}": "FAILED" if i == 7 else "SUCCESSFUL" for i in range(8)}
    again = tasks.StateTable(path)
    assert [len(again.indices(t.id)) for t in found] == [12] * 7 + [11] and list(tmp_path.iterdir()) == [tmp_path / "state.json"]


def test_runnable_and_remaining(spark):
    needs = spark.createDataFrame([("B", "a"), ("C", "a"), ("C", "b")], "id STRING, tag STRING")
    assert {r.id for r in tasks.runnable(needs, spark.createDataFrame([("a",), ("a",)], "tag STRING")).collect()} == {"B"}
    items = spark.createDataFrame([("t", 0), ("t", 1), ("u", 0)], "task_id STRING, index INT")
    state = spark.createDataFrame([("t", [1])], "task_id STRING, successful_indices ARRAY<INT>")
    assert {tuple(r) for r in tasks.remaining(items, state).collect()} == {("t", 0), ("u", 0)}


def test_conversations(spark):
    rows = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", None)], "conv_id LONG, turn LONG, role STRING, text STRING")
    assert sinks.conversation_log(rows).first().log == "== USER\nu\n== ASSISTANT\n"
    assert progress.last_messages(rows, 2).count() == 2
    assert [r.turn for r in progress.since(rows, rows.where("turn = 1")).collect()] == [2]


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:10:00", "x", 1.0), (2, "2024-01-01 00:20:00", "x", 2.0), (3, "2024-01-02 00:00:00", "y", 3.0)], "event_id LONG, ts STRING, event_type STRING, value DOUBLE").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "events"))
    stream = progress.progress_stream(progress.read_events(spark, str(tmp_path / "events"), events.schema))
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.event_type, r.n, r.total) for r in spark.table("windows").collect()} == {("x", 2, 3.0), ("y", 1, 3.0)}
    done = str(tmp_path / "done")
    items = spark.createDataFrame([("t", 0), ("t", 0), ("t", 1)], "task_id STRING, index INT")
    progress.new_indices(items, done)
    progress.new_indices(items, done)
    assert spark.read.parquet(done).count() == 2
