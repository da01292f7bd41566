"""Workspaces: config, state, module reports, tools, manifests and the command line."""

import json
import os

import pytest

from structlens import cli, config, schemas
from structlens.operators import suite
from structlens.pipeline.document import StateDocument
from structlens.sources.sbom import Sbom
from structlens.tools import Answer, Call, Registry, UnknownTool, converse
from structlens.workspace import Workspace

GOOD = {"modelProvider": "ollama", "modelURL": "http://localhost", "modelName": "m", "projectDirectory": "p", "analysisDirectory": "a", "properties": {"x": "y"}}


def test_config(tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps(GOOD))
    found = config.load(str(tmp_path))
    assert (found.chatWindowSize, found.taskParallelism, found.loopParallelism, found.properties) == (50, 2, 1, {"x": "y"})
    assert config.load(config.store(found, str(tmp_path))) == found
    path.write_text(json.dumps(GOOD | {"modelProvider": "other", "requestTimeout": 0, "mcpServers": [{"type": "http"}]}))
    with pytest.raises(ValueError, match="modelProvider.*requestTimeout.*mcpServers/0"):
        config.load(str(path))
    path.write_text("no json")
    with pytest.raises(ValueError):
        config.load(str(path))


def test_schema_problems():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": ["integer", "null"], "maximum": 3}, "b": {"type": "array", "minItems": 1, "items": {"type": "string", "minLength": 2}}}}
    assert schemas.problems({"a": None, "b": ["xx"]}, schema) == []
    assert schemas.problems({"a": 4, "b": []}, schema) == ["/a: is more than 3", "/b: has fewer than 1 entries"]
    assert schemas.problems({"a": True, "b": ["x", 1], "c": 0}, schema) == ["/a: is no integer or null", "/b/0: is shorter than 2", "/b/1: is no string", "/c: is unknown"]
    assert schemas.problems([], schema) == ["/: is no object"] and schemas.problems({}, schema) == ["/: has no a"]


def test_state_document(spark, tmp_path):
    path = str(tmp_path / "analysis.json")
    state = StateDocument(path)
    state.set("modules", {"modules": [{"name": "a"}, {"name": "b", "x/y": [1, 2]}]})
    assert state.size("/modules/modules") == 2 and state.at("/modules/modules/1/x~1y/1") == 2 and state.at("/none/0") is None
    copied = state.element("/modules/modules", 0)
    copied["name"] = "changed"
    state.set_element("/modules/modules", 0, "purpose", {"text": "ü"})
    state.save()
    again = StateDocument(path)
    assert again.data == {"modules": {"modules": [{"name": "a", "purpose": {"text": "ü"}}, {"name": "b", "x/y": [1, 2]}]}}
    for wrong in ("/none", "/modules"):
        with pytest.raises(ValueError):
            again.loop(wrong)
    assert again.structure()[:3] == ["/: object", "/modules: object", "/modules/modules: array"]
    assert [r.name for r in again.frame(spark).collect()] == ["modules"]
    for text in ("[1]", "broken", ""):
        with open(path, "w") as f:
            f.write(text)
        assert StateDocument(path).data == {}


SBOM = {
    "metadata": {"component": {"bom-ref": "root", "group": "g", "name": "app", "version": "1"}},
    "components": [
        {"bom-ref": "b", "group": "org", "name": "lib", "version": "2", "licenses": [{"license": {"id": "MIT"}}, {"license": {"name": "Own", "id": "X"}}, {"expression": "A OR B"}]},
        {"bom-ref": "a", "name": "plain", "version": "3"},
    ],
    "dependencies": [{"ref": "root", "dependsOn": ["b", "gone"]}, {"ref": "b", "dependsOn": ["a"]}],
}


def test_sbom(spark, tmp_path):
    (tmp_path / "bom.json").write_text(json.dumps(SBOM))
    (tmp_path / "broken.json").write_text("{")
    bom = Sbom(spark, str(tmp_path))
    assert bom.loaded() == "false" and bom.load("none.json") == bom.load("broken.json") == bom.load("../x.json") == "Error"
    with pytest.raises(ValueError):
        bom.licenses()
    assert bom.load("bom.json") == "OK" and bom.loaded() == "true"
    assert bom.application().first()[0] == "g:app in version 1"
    direct, unknown = bom.dependencies()
    assert [r.label for r in direct.collect()] == ["org:lib"] and [r.ref for r in unknown.collect()] == ["gone"]
    assert [r.license for r in bom.licenses().collect()] == ["A OR B", "MIT", "Own"]
    paths = bom.write_reports(str(tmp_path / "out"))
    assert [os.path.relpath(p, tmp_path) for p in paths] == ["out/AllLicenses/AllLicenses.csv", "out/DependenciesAndLicenses/DependenciesAndLicenses.csv"]
    assert open(paths[1]).read().splitlines() == ["Id,Name,Version,Licenses", "a,plain,3,", 'b,org:lib,2,"MIT, Own, A OR B"']


def test_registry():
    tools = Registry()
    tools.add("add", lambda a, b=1: a + b, "adds", a="a number")
    tools.add("fail", lambda: 1 / 0)
    assert tools.tools["add"].parameters == {"a": "a number", "b": ""}
    with pytest.raises(ValueError):
        tools.add("add", lambda: 0)
    got = tools.call_all([Call("add<x>", {"a": 1}), Call("fail"), Call("add", {"c": 1})])
    assert [(r.text.split(":")[0], r.is_error) for r in got] == [("2", False), ("ERROR", True), ("ERROR", True)] and "ZeroDivision" in got[1].text
    with pytest.raises(UnknownTool):
        tools.call_all([Call("add", {"a": 1}), Call("none")])
    assert tools.names(["a.*"]) == ["add"] and tools.names([], ["a.*"]) == ["fail"] and tools.names(["add"], ["add"]) == ["add", "fail"]


def test_conversation():
    tools, seen = Registry(), []
    tools.add("double", lambda n: 2 * n)

    def model(messages):
        seen.append([m["role"] for m in messages])
        last = messages[-1]
        return Answer("done " + last["text"], tokens=(1, 2)) if last["role"] == "tool" else Answer("", (Call("double", {"n": 4}),), (3, 4))

    text, messages, tokens = converse(model, tools, [{"role": "system", "text": "s"}, {"role": "user", "text": "a"}, {"role": "user", "text": "b"}], window=2)
    assert text == "done 8" and tokens == (4, 6) and seen == [["system", "user", "user"], ["system", "assistant", "tool"]] and len(messages) == 6


JAVA = "package {p}; import {i}; /** doc */ @Deprecated public class {c} {{ private int f; public int getF(boolean a, boolean b, boolean c) {{ if (a && b) {{ return f; }} return 0; }} }}"


@pytest.fixture
def project(tmp_path):
    for path, p, i, c in (("core/src/a/A.java", "a", "b.B", "A"), ("core/src/b/B.java", "b", "a.A", "B"), ("core/test/a/ATest.java", "a", "a.A", "ATest"), ("api/src/c/C.java", "c.api", "a.A", "C")):
        at = tmp_path / "project" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(JAVA.format(p=p, i=i, c=c))
    (tmp_path / "project" / "core" / "src" / "X.class").write_bytes(b"broken")
    (tmp_path / "work").mkdir()
    java = {"programmingLanguages": [{"name": "java"}]}
    directories = {"directories": [{"path": "test", "categoryId": "TestSrc"}, {"path": "../../elsewhere", "categoryId": "Src"}]}
    modules = [{"name": "core", "path": "core", "programmingLanguages": java, "subdirectories": directories}, {"name": "api", "path": "api", "programmingLanguages": java}, {"name": "docs", "path": "docs"}, {"path": "x"}]
    modules.append({"name": "bad", "path": "..", "programmingLanguages": java})
    (tmp_path / "work" / "analysis.json").write_text(json.dumps({"modules": {"modules": modules}}))
    return tmp_path


def test_workspace(spark, project):
    space = Workspace(spark, str(project / "project"), str(project / "work"))
    made = space.generate_all()
    assert [(r["module"], r["status"]) for r in made["reports"]] == [("core", "GENERATED"), ("api", "GENERATED"), ("bad", "ERROR")]
    assert [(r["module"], r["status"]) for r in made["skipped"]] == [("docs", "SKIPPED"), ("unknown", "ERROR")]
    assert [r["status"] for r in space.generate_all()["reports"]] == ["REUSED", "REUSED", "ERROR"]
    rows = {tuple(r) for r in suite.every(space.reports()).collect()}
    assert {r[0] for r in rows} == set(suite.METRICS)
    assert {("circular_dependency", "core", "", "a.A -> b.B", 2), ("package_tangle", "core", "", "a -> b", 2), ("boolean_parameter", "api", "production", "c.api.C.getF", 1), ("data_class", "core", "test", "a.ATest", 1)} <= rows
    assert {("test_coverage", "core", "", "COVERAGE_RATIO_PERCENT", 50), ("cyclomatic_complexity", "core", "test", "3", 1), ("class_cohesion", "core", "production", "fields per 100 methods 100", 2)} <= rows
    edges, stability = suite.inter_module(space.reports())
    assert [tuple(r) for r in edges.collect()] == [("api", "core", 1)] and [tuple(r) for r in stability.collect()] == [("api", 1, 0, 100), ("core", 0, 1, 0)]
    found = {(r.module, r.finding) for r in space.findings().collect()}
    assert {("core", "cycle"), ("api", "no tests"), ("api", "unstable"), ("core", "stable"), ("core", "three or more boolean parameters")} <= found
    tools = space.registry()
    assert len(tools.names(["java_.*"])) == 37 and len(tools.tools) == 52
    call = lambda name, **a: tools.call(Call(name, a))
    assert call("GetFilesCount", path="core", wildcard="*.java").text == "3" and call("GetFilesCount", path="../..").text == "0"
    assert call("filesystem_file_exists", path="core/src/a/A.java").text == "true" and call("filesystem_file_exists", path="../work").text == "ERROR"
    assert json.loads(call("java_get_method_count_report", module="core").text)[0] == {"module": "core", "category": "production", "value": "1", "count": 2}
    every = json.loads(call("java_get_all_method_count_reports").text)
    assert len(every["reports"]) == 3 and {r["module"] for r in every["skipped"]} == {"docs", "bad"}
    assert call("java_get_method_count_report", module="docs").is_error and "FileNotFoundError" in call("java_get_method_count_report", module="docs").text


def test_commands(project, capsys):
    work = str(project / "work")
    arguments = ["workspace", "init", work, "--project", str(project / "project"), "--analysis", str(project), "--url", "http://x", "--model", "m"]
    assert cli.main(arguments) == 0 and cli.main(["config", "validate", work]) == 0
    assert cli.main([*arguments[:4], str(project / "nowhere"), *arguments[5:]]) == 1 and "does not exist" in capsys.readouterr().err
    assert cli.main(["tools", "dump", work, "--allow", "sbom_.*"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 6
    assert cli.main(["tools", "call", work, "fileio_read_file", '{"path": "../secret"}']) == 0 and capsys.readouterr().out.strip() == "ERROR"
    assert cli.main(["analyse", str(project / "project"), str(project / "out"), "--module", "whole"]) == 0
    lines = open(project / "out" / "cyclomatic_complexity" / "whole.csv").read().splitlines()
    assert lines[0] == "Category,Value,Count" and sum(int(x.rsplit(",", 1)[1]) for x in lines[1:]) == 4
    (project / "broken.json").write_text("{}")
    assert cli.main(["config", "validate", str(project / "broken.json")]) == 1
