"""A registry of named tools: what a caller, or a model in a loop, can ask of a workspace."""

from __future__ import annotations

import inspect
import json
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from importlib.metadata import entry_points

from pyspark.sql import DataFrame

#: Plug-ins name a function that takes a registry and adds to it.
PLUGINS = "structlens.tools"


@dataclass(frozen=True)
class Tool:
    name: str
    run: Callable
    description: str
    parameters: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Call:
    name: str
    arguments: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Result:
    call: Call
    text: str
    is_error: bool = False


class UnknownTool(KeyError):
    """A call of a tool that isn't there."""


class Registry:
    def __init__(self):
        self.tools: dict[str, Tool] = {}

    def add(self, name: str, run: Callable, description: str = "", **parameters: str) -> None:
        if name in self.tools:
            raise ValueError(f"tool {name} is there already")
        known = [p for p in inspect.signature(run).parameters]
        self.tools[name] = Tool(name, run, description, {p: parameters.get(p, "") for p in known})

    def plug_in(self) -> list[str]:
        """Adds the tools of installed plug-ins; the names of these."""
        found = sorted(entry_points(group=PLUGINS), key=lambda e: e.name)
        for e in found:
            e.load()(self)
        return [e.name for e in found]

    def names(self, whitelist: list[str] = (), blacklist: list[str] = ()) -> list[str]:
        """Tools whose whole name fits the whitelist, if there is one, or none of the blacklist, if there is one."""
        fits = lambda name, patterns: any(re.fullmatch(p, name) for p in patterns)
        plain = not whitelist and not blacklist
        return sorted(n for n in self.tools if plain or fits(n, whitelist) or (blacklist and not fits(n, blacklist)))

    def find(self, name: str) -> Tool:
        """The tool of a name, of which models may have appended something after <."""
        plain = name.split("<", 1)[0]
        if plain not in self.tools:
            raise UnknownTool(plain)
        return self.tools[plain]

    def call(self, call: Call) -> Result:
        """A tool's result as text; an error's text if the arguments don't fit or it fails. An unknown tool raises."""
        tool = self.find(call.name)
        try:
            inspect.signature(tool.run).bind(**call.arguments)
            return Result(call, as_text(tool.run(**call.arguments)))
        except Exception as e:  # noqa: BLE001  a tool may fail in any way
            return Result(call, f"ERROR: {type(e).__name__}: {e}", True)

    def call_all(self, calls: list[Call], parallel: int = 4) -> list[Result]:
        """Results in the order of the calls, several at a time."""
        for c in calls:
            self.find(c.name)
        with ThreadPoolExecutor(max(1, parallel)) as pool:
            return list(pool.map(self.call, calls))


def as_text(value) -> str:
    """Text as it is, tables as a JSON array of their rows, all else as JSON."""
    if isinstance(value, str):
        return value
    if isinstance(value, DataFrame):
        return "[" + ",".join(value.toJSON().collect()) + "]"
    if isinstance(value, tuple):
        return "[" + ",".join(map(as_text, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{as_text(v) if not isinstance(v, str) else json.dumps(v)}" for k, v in value.items()) + "}"
    return json.dumps(value)


@dataclass(frozen=True)
class Answer:
    """What a model says: calls to make first, or a final text; and the tokens that it took."""

    text: str = ""
    calls: tuple[Call, ...] = ()
    tokens: tuple[int, int] = (0, 0)


def converse(model: Callable[[list[dict]], Answer], registry: Registry, messages: list[dict], window: int = 50, parallel: int = 4) -> tuple[str, list[dict], tuple[int, int]]:
    """(final text, all messages, tokens in and out): asks the model until it has no more calls to make.

    The model sees the system messages and the last `window` others. Results of calls become messages of the role tool.
    """
    out, used = list(messages), [0, 0]
    while True:
        system, others = [m for m in out if m["role"] == "system"], [m for m in out if m["role"] != "system"]
        answer = model([*system, *others[-window:]])
        used = [a + b for a, b in zip(used, answer.tokens, strict=True)]
        out.append({"role": "assistant", "text": answer.text})
        if not answer.calls:
            return answer.text, out, tuple(used)
        out += [{"role": "tool", "text": r.text, "tool": r.call.name} for r in registry.call_all(list(answer.calls), parallel)]
