"""JSON in free text: taking it out of fences, repairing quotes, and checking it against a schema."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import from_json_schema

_LINE = re.compile(r'^(\s*"(?:[^"\\]|\\.)*"\s*:\s*")(.*)$', re.S)


def fix_line(line: str) -> str:
    """Escapes bare quotes inside the string value of a line that reads "key": "value.

    A quote ends the value if the line ends after it, or if only blanks stand before a following comma or brace; any
    other bare quote belongs to the value.
    """
    m = _LINE.match(line)
    if not m:
        return line
    head, rest = m.groups()
    out, i = [], 0
    while i < len(rest):
        c = rest[i]
        if c == "\\" and i + 1 < len(rest):
            out.append(rest[i : i + 2])
            i += 2
            continue
        if c == '"':
            tail = rest[i + 1 :].lstrip(" \t\n\x0b\f\r")
            if not tail or tail[0] in ",}":
                return head + "".join(out) + rest[i:]
            c = '\\"'
        out.append(c)
        i += 1
    return head + "".join(out)


def fix(text: str | None) -> str | None:
    """A JSON text without its fence and with every line's quotes repaired; null for null."""
    if text is None:
        return None
    text = text.removeprefix("```json").removesuffix("```")
    return "\n".join(fix_line(x) for x in text.split("\n"))


#: Marks what is no bare quote while a line is repaired; where a text has it, it is marked itself.
_MARK = "\ue000"


def repaired(text: Column) -> Column:
    """fix() of a column, by regular expressions: escaped characters are marked first, so that a bare quote is one
    without a mark before it, and what stands before the first one that can close the value is the value."""

    def once(value: Column, body: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), body)[0]

    def line(x: Column) -> Column:
        head = F.regexp_extract(x, r'(?s)^(\s*"(?:[^"\\]++|\\.)*+"\s*:\s*")', 1)
        return once(head, lambda h: F.when(F.length(h) > 0, F.concat(h, once(F.substring(x, F.length(h) + 1, F.length(x)), value))).otherwise(x))

    def value(rest: Column) -> Column:
        marked = F.regexp_replace(F.replace(rest, F.lit(_MARK), F.lit(_MARK + "a")), r"(?s)\\(.)", _MARK + "b$1")
        return once(marked, closed)

    def closed(x: Column) -> Column:
        parts = F.split(x, rf'(?<!{_MARK}b)"[ \t\n\x0b\f\r]*(?:[,}}]|\z)', 2)
        return once(parts, lambda p: plain(F.when(F.size(p) > 1, F.concat(bare(p[0]), F.substring(x, F.length(p[0]) + 1, F.length(x)))).otherwise(bare(x))))

    def bare(x: Column) -> Column:
        return F.regexp_replace(x, rf'(?<!{_MARK}b)"', r'\\"')

    def plain(x: Column) -> Column:
        return F.replace(F.replace(x, F.lit(_MARK + "b"), F.lit("\\")), F.lit(_MARK + "a"), F.lit(_MARK))

    return F.array_join(F.transform(F.split(unfenced(text), "\n"), line), "\n")


def unfenced(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\A```json", ""), r"```\z", "")


def conditions(schema: dict, value: Column, path: str = "") -> list[tuple[str, str, Column]]:
    """(path, rule, is broken) for required properties, enums and bounds of an object; lists are checked as a whole."""
    out = []
    for name, part in schema.get("properties", {}).items():
        at, here = value[name], f"{path}/{name}"
        if name in schema.get("required", ()):
            out.append((here, "required", at.isNull()))
        if "enum" in part:
            out.append((here, "enum", at.isNotNull() & ~at.isin(*part["enum"])))
        if "minimum" in part:
            out.append((here, "minimum", at < part["minimum"]))
        if "maximum" in part:
            out.append((here, "maximum", at > part["maximum"]))
        if "minLength" in part:
            out.append((here, "minLength", F.length(at) < part["minLength"]))
        if part.get("type") == "object":
            out += [(p, r, at.isNotNull() & c) for p, r, c in conditions(part, at, here)]
        if part.get("type") == "array" and part.get("items", {}).get("type") == "object":
            for p, r, _ in conditions(part["items"], F.lit(None).cast(from_json_schema(part["items"])), here + "/*"):
                out.append((p, r, F.coalesce(F.exists(at, _breaks(part["items"], here + "/*", p, r)), F.lit(False))))
    return out


#: Kinds of JSON values as Spark names those of variants (fixed values).
_KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}


def _types(schema: dict, path: str = "", at: str = "$") -> list[tuple[str, str, str]]:
    """(path, JSON path, pattern of its kind) of the typed properties of an object and of objects in it."""
    out = []
    for name, part in schema.get("properties", {}).items():
        kinds = part.get("type")
        if kinds:
            out.append((f"{path}/{name}", f"{at}['{name}']", "|".join(_KINDS[k] for k in ([kinds] if isinstance(kinds, str) else kinds) if k in _KINDS)))
        if kinds == "object":
            out += _types(part, f"{path}/{name}", f"{at}['{name}']")
    return out


def _breaks(items: dict, path: str, where: str, rule: str) -> Callable[[Column], Column]:
    """Whether an entry of a list breaks one of its conditions."""
    return lambda x: next(c for p, r, c in conditions(items, x, path) if (p, r) == (where, rule))


def violations(rows: DataFrame, text: str, schema: dict, key: str) -> DataFrame:
    """(key, path, rule) of what is wrong with a JSON column; a text that is no JSON object breaks ("", "json").

    A value of another kind than its type breaks "type" and nothing else. Rows are judged in one pass; nothing is dropped
    from them.
    """
    parsed = rows.withColumns({"__v": F.from_json(text, from_json_schema(schema), {"mode": "PERMISSIVE"}), "__j": F.expr(f"try_parse_json({text})")})
    is_object = F.coalesce(F.expr("schema_of_variant(__j)").startswith("OBJECT"), F.lit(False))
    kinds = {p: F.expr(f'schema_of_variant(try_variant_get(__j, "{at}", "variant"))') for p, at, _ in _types(schema)}
    wrong = {p: F.coalesce((kinds[p] != "VOID") & ~kinds[p].rlike(f"^({pattern})$"), F.lit(False)) for p, _, pattern in _types(schema)}
    mark = lambda c, p, r: F.when(c, F.struct(F.lit(p).alias("path"), F.lit(r).alias("rule")))
    checks = [mark(~is_object, "", "json")]
    checks += [mark(is_object & c, p, "type") for p, c in wrong.items()]
    for p, r, c in conditions(schema, F.col("__v")):
        checks.append(mark(is_object & ~wrong.get(p, F.lit(False)) & F.coalesce(c, F.lit(False)), p, r))
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return parsed.select(key, F.explode(found).alias("f")).select(key, "f.path", "f.rule")


def validated(rows: DataFrame, text: str, schema: dict, key: str) -> DataFrame:
    """The strict reading of violations(): the rows as they are, or a ValueError that names the first few of them."""
    found = violations(rows, text, schema, key).limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r[0]}: {r.path or '/'} breaks {r.rule}" for r in found))
    return rows


def elements(docs: DataFrame, text: str, path: str, *keep: str) -> DataFrame:
    """(keep, position, element): the entries of the array at a path like $.modules.modules of a JSON column."""
    array = F.expr(f"try_variant_get(try_parse_json({text}), '{path}', 'array<variant>')")
    return docs.select(*keep, F.posexplode(array).alias("position", "element"))


def with_property(docs: DataFrame, results: DataFrame, path: str, name: str, key: str, text: str = "text") -> DataFrame:
    """docs with results (key, position, value as JSON text) set as a property of the array entries at path."""
    entries = docs.select(key, F.posexplode(F.expr(f"try_variant_get(try_parse_json({text}), '{path}', 'array<map<string,variant>>')")).alias("position", "entry"))
    joined = entries.join(results, [key, "position"], "left")
    plain = F.map_filter("entry", lambda k, v: (k != name) | F.col("value").isNull())
    merged = F.when(F.col("value").isNotNull(), F.map_concat(plain, F.create_map(F.lit(name), F.expr("try_parse_json(value)")))).otherwise(plain)
    listed = joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", F.to_json(merged).alias("json")))).alias("all"))
    return listed.select(key, F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["json"]), ","), F.lit("]")).alias("entries"))
