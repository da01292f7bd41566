"""The analysis state: one JSON object with a property for each task's result."""

from __future__ import annotations

import copy
import json
import os
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StateDocument:
    """A JSON object in a file, shared by threads. A missing file, or one that holds no object, is an empty state."""

    def __init__(self, path: str):
        self.path, self._lock = path, threading.RLock()
        self.data: dict = {}
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                try:
                    found = json.load(f)
                except ValueError:
                    found = None
            self.data = found if isinstance(found, dict) else {}

    def at(self, pointer: str):
        """The value at a JSON pointer such as /modules/modules/0; None if there is none."""
        with self._lock:
            value = self.data
            for step in pointer.split("/")[1:]:
                step = step.replace("~1", "/").replace("~0", "~")
                if isinstance(value, dict):
                    value = value.get(step)
                elif isinstance(value, list) and step.isdigit() and int(step) < len(value):
                    value = value[int(step)]
                else:
                    return None
            return value

    def loop(self, pointer: str) -> list:
        """The array at a pointer; a ValueError if there is none, or something else."""
        found = self.at(pointer)
        if found is None:
            raise ValueError(f"nothing at {pointer} to loop on")
        if not isinstance(found, list):
            raise ValueError(f"what is at {pointer} is no array")
        return found

    def size(self, pointer: str) -> int:
        return len(self.loop(pointer))

    def element(self, pointer: str, index: int):
        """A copy of an element of the array at a pointer: work on it doesn't change the state."""
        with self._lock:
            return copy.deepcopy(self.loop(pointer)[index])

    def set(self, name: str, value) -> None:
        """Sets a property of the state."""
        with self._lock:
            self.data[name] = value

    def set_element(self, pointer: str, index: int, name: str, value) -> None:
        """Sets a property of an element of the array at a pointer."""
        with self._lock:
            self.loop(pointer)[index][name] = value

    def save(self) -> None:
        """Writes the whole state, indented, by a rename."""
        draft = f"{self.path}.{uuid.uuid4().hex}"
        with self._lock:
            with open(draft, "w", encoding="utf-8") as f:
                json.dump(self.data, f, indent=2, ensure_ascii=False)
            os.replace(draft, self.path)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(name, value): a row for each property, its value a VARIANT."""
        with self._lock:
            rows = [(k, json.dumps(v)) for k, v in self.data.items()]
        return spark.createDataFrame(rows, "name STRING, value STRING").select("name", F.parse_json("value").alias("value"))

    def structure(self) -> list[str]:
        """Pointers to all values with their kinds, in order: what the log shows of a state."""
        out: list[str] = []

        def walk(value, at: str) -> None:
            kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")
            out.append(f"{at or '/'}: {kind}")
            for k, v in sorted(value.items()) if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
                walk(v, f"{at}/{k}")

        with self._lock:
            walk(self.data, "")
        return out
