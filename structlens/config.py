"""Settings of a workspace: a JSON file, checked strictly before anything runs."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from .schemas import problems

FILE = "config.json"
_TEXT, _FLAG, _COUNT = {"type": "string"}, {"type": "boolean"}, {"type": "integer", "minimum": 1}
#: JSON Schema of the file. Providers and servers are kept for callers that bring a model; nothing here connects to any.
SCHEMA = {
    "title": "Config",
    "type": "object",
    "properties": {
        "modelProvider": {"type": "string", "enum": ["ollama", "openai", "localai"]}, "modelURL": _TEXT, "modelName": _TEXT, "apiKey": _TEXT, "chatWindowSize": _COUNT, "requestTimeout": _COUNT,
        "maximumTokens": _COUNT, "loopParallelism": _COUNT, "taskParallelism": _COUNT, "nativeJSON": _FLAG, "logRequests": _FLAG, "logResponses": _FLAG, "executionTrace": _FLAG,
        "executionTraceSystem": _FLAG, "projectDirectory": _TEXT, "analysisDirectory": _TEXT,
        "mcpServers": {"type": "array", "items": {
            "type": "object", "required": ["type", "name"],
            "properties": {"type": {"type": "string", "enum": ["http", "stdio"]}, "name": _TEXT, "url": _TEXT, "command": {"type": "array", "minItems": 1, "items": _TEXT}, "environment": {"type": "object", "additionalProperties": _TEXT}},
        }},
        "properties": {"type": "object", "additionalProperties": _TEXT},
    },
    "required": ["modelProvider", "modelURL", "modelName", "projectDirectory", "analysisDirectory"],
}


@dataclass
class Config:
    """Names as in the file; defaults are fixed values."""

    projectDirectory: str = ""
    analysisDirectory: str = ""
    modelProvider: str = "ollama"
    modelURL: str = ""
    modelName: str = ""
    apiKey: str | None = None
    chatWindowSize: int = 50
    requestTimeout: int = 120
    maximumTokens: int = 65536
    loopParallelism: int = 1
    taskParallelism: int = 2
    nativeJSON: bool = False
    logRequests: bool = False
    logResponses: bool = False
    executionTrace: bool = True
    executionTraceSystem: bool = False
    mcpServers: list = field(default_factory=list)
    properties: dict = field(default_factory=dict)


def load(path: str) -> Config:
    """The config of a file, or of a workspace folder; a ValueError that names all that is wrong with it."""
    if os.path.isdir(path):
        path = os.path.join(path, FILE)
    with open(path, encoding="utf-8") as f:
        try:
            found = json.load(f)
        except ValueError as e:
            raise ValueError(f"{path} is no JSON: {e}") from e
    if wrong := problems(found, SCHEMA):
        raise ValueError(f"{path}: " + "; ".join(wrong))
    return Config(**{k: v for k, v in found.items() if k in Config.__dataclass_fields__})


def store(config: Config, path: str) -> str:
    """Writes a config to a file, or into a workspace folder."""
    if os.path.isdir(path):
        path = os.path.join(path, FILE)
    with open(path, "w", encoding="utf-8") as f:
        json.dump({k: v for k, v in asdict(config).items() if v is not None}, f, indent=2)
    return path


def unusable(path: str, what: str, to_write: bool = False) -> str | None:
    """Why a directory can't be used; None if it can."""
    if not os.path.exists(path):
        return f"{what} directory '{path}' does not exist"
    if not os.path.isdir(path):
        return f"{what} directory '{path}' is no directory"
    if not os.access(path, os.W_OK if to_write else os.R_OK):
        return f"{what} directory '{path}' cannot be {'written to' if to_write else 'read'}"
    return None
