"""Task definitions, their checks, their state, and which of them can run."""

from __future__ import annotations

import json
import os
import threading
import uuid
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TASK, TASK_STATE


@dataclass(frozen=True)
class Task:
    id: str
    name: str = ""
    active: bool = True
    prompt: str | None = None
    loop_on: str | None = None
    tags: tuple[str, ...] = ()
    depends_on: tuple[str, ...] = ()
    whitelist: tuple[str, ...] = ()
    blacklist: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)


#: Keys of task files and the fields they fill (fixed values).
KEYS = {"id": "id", "name": "name", "active": "active", "prompt": "prompt", "loopOn": "loop_on", "tags": "tags", "dependsOn": "depends_on", "toolWhitelist": "whitelist", "toolBlacklist": "blacklist"}


def _scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    return {"true": True, "false": False, "": None, "null": None, "~": None}.get(text, text)


def _value(text: str):
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    return _scalar(text)


def parse(text: str) -> list[Task]:
    """Tasks of a file of YAML documents with scalars, lists (in line or with dashes) and comments."""
    out = []
    for document in [d for d in _documents(text) if d]:
        fields: dict = {}
        key = None
        for line in document:
            bare = line.strip()
            if bare.startswith("- ") and key:
                if not isinstance(fields.get(key), list):
                    fields[key] = []
                fields[key].append(_scalar(bare[2:]))
            else:
                key, _, rest = bare.partition(":")
                fields[key] = _value(rest)
        known = {KEYS[k]: (tuple(v) if isinstance(v, list) else v) for k, v in fields.items() if k in KEYS and v is not None}
        for k in ("tags", "depends_on", "whitelist", "blacklist"):
            if isinstance(known.get(k), str):
                known[k] = (known[k],)
        out.append(Task(**known, extra={k: v for k, v in fields.items() if k not in KEYS}))
    return out


def _documents(text: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for line in text.splitlines():
        if line.strip() == "---":
            out.append([])
        elif line.strip() and not line.lstrip().startswith("#"):
            out[-1].append(line)
    return out


def frame(spark: SparkSession, tasks: list[Task]) -> DataFrame:
    rows = [(t.id, t.active, t.name, t.loop_on, list(t.tags), list(t.depends_on), list(t.whitelist), list(t.blacklist)) for t in tasks]
    return spark.createDataFrame(rows, TASK)


def problems(tasks: list[Task]) -> list[str]:
    """What keeps a list of tasks from running: missing or repeated ids, unknown tags, cycles."""
    out = [f"task {i + 1} has no id" for i, t in enumerate(tasks) if not t.id]
    ids = [t.id for t in tasks]
    out += [f"task {x} is defined twice" for x in sorted({x for x in ids if ids.count(x) > 1})]
    known = {tag for t in tasks for tag in t.tags}
    out += [f"task {t.id} depends on unknown tag {d}" for t in tasks for d in t.depends_on if d not in known]
    out += [f"task {x} depends on itself" for x in cyclic(tasks)]
    return out


def cyclic(tasks: list[Task]) -> list[str]:
    """Tasks that depend on themselves, directly or over others."""
    needs = {t.id: {o.id for o in tasks if set(o.tags) & set(t.depends_on)} for t in tasks}
    reach = {k: set(v) for k, v in needs.items()}
    changed = True
    while changed:
        changed = False
        for k in reach:
            more = set().union(*(reach[x] for x in reach[k] if x in reach)) - reach[k] if reach[k] else set()
            if more:
                reach[k] |= more
                changed = True
    return sorted(k for k in reach if k in reach[k])


def runnable(needs: DataFrame, met: DataFrame) -> DataFrame:
    """Relational division: the ids of (id, tag) whose tags are all in met (tag)."""
    marked = needs.join(met.select("tag").distinct().withColumn("met", F.lit(1)), "tag", "left")
    return marked.groupBy("id").agg(F.count("*").alias("needed"), F.count("met").alias("met")).where("needed = met").select("id")


class StateTable:
    """Task states in a JSON file, rewritten whole by a rename. Threads share a table; one at a time changes it."""

    def __init__(self, path: str):
        self.path = path
        self.rows: dict[str, dict] = {}
        self._lock = threading.RLock()
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                self.rows = {r["task_id"]: r for r in json.load(f)}

    def mark(self, task: str, state: str, index: int | None = None) -> None:
        """FAILED keeps the indices that were done; they are not run again."""
        with self._lock:
            row = self.rows.setdefault(task, {"task_id": task, "successful_indices": []})
            row["last_execution"], row["state"] = datetime.now(timezone.utc).isoformat(), state
            if index is not None and index not in row["successful_indices"]:
                row["successful_indices"] = sorted([*row["successful_indices"], index])
            self._save()

    def drop(self, *tasks: str) -> None:
        with self._lock:
            for t in tasks or list(self.rows):
                self.rows.pop(t, None)
            self._save()

    def done(self, task: Task) -> bool:
        with self._lock:
            return task.active and self.rows.get(task.id, {}).get("state") == "SUCCESSFUL"

    def indices(self, task: str) -> set[int]:
        with self._lock:
            return set(self.rows.get(task, {}).get("successful_indices", ()))

    def frame(self, spark: SparkSession) -> DataFrame:
        with self._lock:
            rows = [(r["task_id"], datetime.fromisoformat(r["last_execution"]), r["successful_indices"], r["state"]) for r in self.rows.values()]
        return spark.createDataFrame(rows, TASK_STATE)

    def _save(self) -> None:
        """Called with the lock held. The draft's own name keeps tables of other processes from renaming it."""
        draft = f"{self.path}.{uuid.uuid4().hex}"
        try:
            with open(draft, "w", encoding="utf-8") as f:
                json.dump(list(self.rows.values()), f, indent=1)
            os.replace(draft, self.path)
        finally:
            if os.path.exists(draft):
                os.remove(draft)


def remaining(items: DataFrame, state: DataFrame) -> DataFrame:
    """(task_id, index) of items that state (task_id, successful_indices) doesn't name: what a resumed run still does."""
    done = state.select("task_id", F.explode("successful_indices").alias("index"))
    return items.join(done, ["task_id", "index"], "left_anti")


__all__ = ["StateTable", "Task", "asdict", "cyclic", "frame", "parse", "problems", "remaining", "runnable"]
