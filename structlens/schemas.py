"""Row types of module reports, dependency manifests and tasks, and a compiler from JSON Schema."""

from __future__ import annotations

from pyspark.sql import types as T

_ANNOTATIONS = "ARRAY<STRUCT<name: STRING, qualifiedName: STRING>>"
METHOD = f"STRUCT<name: STRING, descriptor: STRING, documentation: STRING, annotations: {_ANNOTATIONS}, cyclomaticComplexity: INT, visibility: STRING, isStatic: BOOLEAN, isFinal: BOOLEAN, parameterCount: INT, linesOfCode: INT, nestingDepth: INT>"
FIELD = "STRUCT<name: STRING, type: STRING, visibility: STRING, isStatic: BOOLEAN, isFinal: BOOLEAN>"
CLASS = f"STRUCT<qualifiedName: STRING, documentation: STRING, superClass: STRING, interfaces: ARRAY<STRING>, annotations: {_ANNOTATIONS}, fields: ARRAY<{FIELD}>, methods: ARRAY<{METHOD}>>"
UNIT = f"STRUCT<name: STRING, production: BOOLEAN, generated: BOOLEAN, imports: ARRAY<STRING>, clazzes: ARRAY<{CLASS}>>"
#: A module report: packages, build units, classes, members.
MODULE = f"name STRING, packages ARRAY<STRUCT<name: STRING, buildUnits: ARRAY<{UNIT}>>>"
_COMPONENT = "STRUCT<`bom-ref`: STRING, `group`: STRING, name: STRING, version: STRING, licenses: ARRAY<STRUCT<license: STRUCT<id: STRING, name: STRING>, expression: STRING>>>"
#: A CycloneDX manifest.
SBOM = f"metadata STRUCT<component: {_COMPONENT}>, components ARRAY<{_COMPONENT}>, dependencies ARRAY<STRUCT<ref: STRING, dependsOn: ARRAY<STRING>>>"
TASK = "id STRING, active BOOLEAN, name STRING, loop_on STRING, tags ARRAY<STRING>, depends_on ARRAY<STRING>, whitelist ARRAY<STRING>, blacklist ARRAY<STRING>"
TASK_STATE = "task_id STRING, last_execution TIMESTAMP, successful_indices ARRAY<INT>, state STRING"
FINDING = "module STRING, aspect STRING, finding STRING, urgency STRING, criticality STRING"

_SCALARS = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}


def from_json_schema(schema: dict) -> T.DataType:
    """The Spark type of a JSON Schema (draft 2020-12): objects, arrays, scalars and enums of scalars.

    A list of types is that of its first entry other than null. Properties that aren't required are nullable.
    """
    kind = schema.get("type")
    if isinstance(kind, list):
        kind = next((k for k in kind if k != "null"), "string")
    if kind == "object" or "properties" in schema:
        required = set(schema.get("required", ()))
        return T.StructType([T.StructField(n, from_json_schema(s), n not in required) for n, s in schema.get("properties", {}).items()])
    if kind == "array":
        return T.ArrayType(from_json_schema(schema.get("items", {})))
    return _SCALARS.get(kind or "string", T.StringType())


def describe(schema: dict) -> str:
    """A JSON Schema as text for people: nested objects in braces, arrays by the title of their items, enums by values."""
    if "enum" in schema:
        return "|".join(str(x) for x in schema["enum"])
    kind = schema.get("type", "object" if "properties" in schema else "string")
    if kind == "object":
        return "{" + ", ".join(f"{n}: {describe(s)}" for n, s in schema.get("properties", {}).items()) + "}"
    if kind == "array":
        items = schema.get("items", {})
        return f"array of {items['title'] + ' ' if 'title' in items else ''}{describe(items)}"
    return kind if isinstance(kind, str) else "|".join(kind)


def schema_name(schema: dict) -> str:
    return schema.get("title") or "Result"


_KINDS = {"string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,), "object": (dict,), "array": (list,), "null": (type(None),)}


def problems(value, schema: dict, path: str = "") -> list[str]:
    """What is wrong with a value under a JSON Schema: types, enums, bounds, lengths, required and additional properties."""
    here, kinds = path or "/", schema.get("type")
    if kinds is not None:
        allowed = [k for name in ([kinds] if isinstance(kinds, str) else kinds) for k in _KINDS[name]]
        if not isinstance(value, tuple(allowed)) or (isinstance(value, bool) and bool not in allowed):
            return [f"{here}: is no {kinds if isinstance(kinds, str) else ' or '.join(kinds)}"]
    out = [f"{here}: is none of {', '.join(map(str, schema['enum']))}"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{here}: is less than {schema['minimum']}"] if value < schema.get("minimum", value) else []
        out += [f"{here}: is more than {schema['maximum']}"] if value > schema.get("maximum", value) else []
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append(f"{here}: is shorter than {schema['minLength']}")
    if isinstance(value, list):
        out += [f"{here}: has fewer than {schema['minItems']} entries"] if len(value) < schema.get("minItems", 0) else []
        for i, x in enumerate(value):
            out += problems(x, schema.get("items", {}), f"{path}/{i}")
    if isinstance(value, dict):
        out += [f"{here}: has no {n}" for n in schema.get("required", ()) if n not in value]
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        for k, v in value.items():
            if k in known:
                out += problems(v, known[k], f"{path}/{k}")
            elif more is False:
                out.append(f"{path}/{k}: is unknown")
            elif isinstance(more, dict):
                out += problems(v, more, f"{path}/{k}")
    return out
