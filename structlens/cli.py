"""Command line: python -m structlens.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import os
import sys

from . import config
from .pipeline import tasks


def _state(args) -> int:
    table = tasks.StateTable(args.file)
    if args.action == "dump":
        print(json.dumps(list(table.rows.values()), indent=1))
    elif args.action == "drop":
        table.drop(*args.task)
    else:
        table.drop()
    return 0


def _check(args) -> int:
    with open(args.file, encoding="utf-8") as f:
        found = tasks.problems(tasks.parse(f.read()))
    print("\n".join(found) or "no problems")
    return int(bool(found))


#: Metrics whose values are numbers: their CSV is in numeric order.
NUMERIC = {"method_nesting_depth", "cyclomatic_complexity", "method_count"}


def _write(reports, out: str) -> None:
    """A CSV of each metric in a folder of its own, one file a module, all by one job."""
    from .operators import suite
    from .report import csvfiles

    csvfiles.write_metrics(suite.every(reports), out, NUMERIC)


def _analyse(args) -> int:
    """Scans the sources and class files of a tree as one module, and writes its report and each metric's CSV."""
    from .session import session, written
    from .sources import report
    from .workspace import Workspace

    os.makedirs(args.out, exist_ok=True)
    space = Workspace(session(master=args.master), args.root, args.out)
    merged = written(space.scan({"name": args.module}))
    report.write_json(merged, space.report_path(args.module))
    _write(merged, args.out)
    return 0


def _workspace(args) -> int:
    """Writes the config of a new workspace."""
    found = [config.unusable(args.project, "Project"), config.unusable(args.analysis, "Analysis"), config.unusable(args.directory, "Workspace", True)]
    if wrong := [x for x in found if x]:
        print("\n".join(wrong), file=sys.stderr)
        return 1
    made = config.Config(
        projectDirectory=args.project, analysisDirectory=args.analysis, modelProvider=args.provider, modelURL=args.url, modelName=args.model, apiKey=args.key, chatWindowSize=args.window, nativeJSON=args.native_json
    )
    print(config.store(made, args.directory))
    return 0


def _config(args) -> int:
    try:
        config.load(args.file)
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    print("no problems")
    return 0


def _space(args):
    from .session import session
    from .workspace import Workspace

    return Workspace(session(master=args.master), config.load(args.directory).projectDirectory, args.directory)


def _tools(args) -> int:
    """Lists the tools, or calls one with JSON arguments."""
    from .tools import Call

    registry = _space(args).registry()
    if args.action == "dump":
        for name in registry.names(args.allow, args.forbid):
            tool = registry.tools[name]
            print(f"- {name}({', '.join(tool.parameters)}): {tool.description}")
        return 0
    result = registry.call(Call(args.name, json.loads(args.arguments)))
    print(result.text)
    return int(result.is_error)


def _reports(args) -> int:
    """Generates the missing reports of all modules of a workspace and writes each metric's CSV."""
    space = _space(args)
    print(json.dumps(space.generate_all(), indent=1))
    _write(space.reports(), args.directory)
    return 0


def _render(args) -> int:
    from .report.sinks import Template

    with open(args.template, encoding="utf-8") as f, open(args.data, encoding="utf-8") as d:
        print(Template(f.read()).render(json.load(d)))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="structlens", description=__doc__)
    commands = parser.add_subparsers(required=True)
    p = commands.add_parser("analyse", help="scan a tree of Java sources and class files and write its report and metrics")
    p.add_argument("root"), p.add_argument("out"), p.add_argument("--module", default="root"), p.add_argument("--master", default=None)
    p.set_defaults(run=_analyse)
    p = commands.add_parser("reports", help="generate the missing module reports of a workspace and write all metrics")
    p.add_argument("directory"), p.add_argument("--master", default=None)
    p.set_defaults(run=_reports)
    p = commands.add_parser("state", help="show, drop or clear task states")
    p.add_argument("action", choices=["dump", "drop", "clear"]), p.add_argument("file"), p.add_argument("task", nargs="*")
    p.set_defaults(run=_state)
    p = commands.add_parser("check", help="check a task file")
    p.add_argument("file")
    p.set_defaults(run=_check)
    p = commands.add_parser("tools", help="list the tools of a workspace, or call one")
    p.add_argument("action", choices=["dump", "call"]), p.add_argument("directory"), p.add_argument("name", nargs="?"), p.add_argument("arguments", nargs="?", default="{}")
    p.add_argument("--allow", action="append", default=[]), p.add_argument("--forbid", action="append", default=[]), p.add_argument("--master", default=None)
    p.set_defaults(run=_tools)
    p = commands.add_parser("workspace", help="set up a workspace")
    p.add_argument("action", choices=["init"]), p.add_argument("directory"), p.add_argument("--project", required=True), p.add_argument("--analysis", required=True)
    p.add_argument("--provider", default="ollama"), p.add_argument("--url", required=True), p.add_argument("--model", required=True), p.add_argument("--key"), p.add_argument("--window", type=int, default=50), p.add_argument("--native-json", action="store_true")
    p.set_defaults(run=_workspace)
    p = commands.add_parser("config", help="check a config file")
    p.add_argument("action", choices=["validate"]), p.add_argument("file")
    p.set_defaults(run=_config)
    p = commands.add_parser("document", help="render a template over a JSON document")
    p.add_argument("template"), p.add_argument("data")
    p.set_defaults(run=_render)
    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
