"""Java source files as rows of a module scan, from their tokens.

scan() makes report rows: imports are the file's own single imports, names that these don't have are of its package. names()
makes a row for each name as it is written, and operators.symbols finds the classes that these mean, over all files. Measures of methods:
complexity is 1 and one for each if, for with a header of semicolons, while, do, catch, ?:, case, && and ||; nesting is
that of blocks of if, for, while, do, switch and try; statements are those directly in the body.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

TOKEN = re.compile(
    r'(?P<doc>/\*\*.*?\*/)|(?P<skip>/\*.*?\*/|//[^\n\r]*|\s+)|(?P<text>"""(?:\\.|.)*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\')'
    r"|(?P<word>[\w$]+)|(?P<op>&&|\|\||->|::|\.\.\.|.)",
    re.S,
)
MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "default", "native", "synchronized", "transient", "volatile", "strictfp", "sealed"}
NESTING = {"if", "for", "while", "do", "switch", "try"}
CLOSING = {"(": ")", "[": "]", "{": "}", "<": ">"}


@dataclass
class Tokens:
    items: list[tuple[str, str]] = field(default_factory=list)
    at: int = 0

    def peek(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.items[i][1] if i < len(self.items) else ""

    def next(self) -> str:
        value = self.peek()
        self.at += 1
        return value

    def group(self) -> list[str]:
        """What stands between the bracket here and the one that closes it; moves past that."""
        start, opening = self.at, self.next()
        closing, depth = CLOSING[opening], 1
        while depth and self.at < len(self.items):
            t = self.next()
            depth += (t == opening) - (t == closing)
        return [v for _, v in self.items[start + 1 : self.at - 1]]


def tokens(text: str) -> Tokens:
    kept, doc = [], None
    for m in TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "doc":
            doc = m[0]
        elif kind != "skip":
            kept.append((doc if doc else kind, m[0]))
            doc = None
    return Tokens(kept)


def complexity(body: list[str]) -> int:
    n = 1
    for i, t in enumerate(body):
        if t in ("if", "while", "catch", "&&", "||", "do", "case") or t == "?" and body[i - 1] not in ("<", ","):
            n += 1
        elif t == "for" and ";" in _header(body, i + 1):
            n += 1
    # The while that ends a do isn't a loop of its own.
    return n - sum(1 for i, t in enumerate(body) if t == "do")


def _header(body: list[str], i: int) -> list[str]:
    depth, out = 0, []
    for t in body[i:]:
        depth += (t == "(") - (t == ")")
        out.append(t)
        if not depth:
            break
    return out


def _statement(body: list[str], i: int) -> tuple[int, int]:
    """(index after the statement at i, its nesting)."""
    if i >= len(body):
        return i, 0
    t = body[i]
    if t == "{":
        i, deepest = i + 1, 0
        while i < len(body) and body[i] != "}":
            i, d = _statement(body, i)
            deepest = max(deepest, d)
        return i + 1, deepest
    if _is_word(t) and i + 1 < len(body) and body[i + 1] == ":":  # a label
        return _statement(body, i + 2)
    if t == "if":
        # A chain of else-ifs is walked, as it may be long; each deepens by one.
        deepest = chain = 0
        while True:
            i, d = _statement(body, _after(body, i + 1, "(", ")"))
            deepest, chain = max(deepest, chain + d + 1), chain + 1
            if i >= len(body) or body[i] != "else":
                return i, deepest
            i += 1
            if i >= len(body) or body[i] != "if":
                i, d = _statement(body, i)
                return i, max(deepest, chain + d)
    if t in ("for", "while", "switch", "synchronized"):
        i = _after(body, i + 1, "(", ")")
        if t == "switch":
            end = _after(body, i, "{", "}")
            return end, 1 + _cases(body[i + 1 : end - 1])
        i, d = _statement(body, i)
        return i, d + (t != "synchronized")
    if (end := _local_type(body, i)) is not None:
        return end, 0
    if t == "do":
        i, d = _statement(body, i + 1)
        return _to_semicolon(body, i), d + 1
    if t == "try":
        i += 1
        if i < len(body) and body[i] == "(":
            i = _after(body, i, "(", ")")
        i, deepest = _statement(body, i)
        while i < len(body) and body[i] in ("catch", "finally"):
            if body[i] == "catch":
                i = _after(body, i + 1, "(", ")")
            else:
                i += 1
            i, d = _statement(body, i)
            deepest = max(deepest, d)
        return i, deepest + 1
    return _to_semicolon(body, i), 0


def _is_word(t: str) -> bool:
    return bool(re.fullmatch(r"[\w$]+", t)) and t not in ("case", "default")


def _local_type(body: list[str], i: int) -> int | None:
    """The index after a class, interface, enum or record declared at i; None if there is none."""
    while i < len(body) and (body[i] in MODIFIERS or body[i] == "@"):
        if body[i] == "@":
            i += 2
            while i + 1 < len(body) and body[i] == ".":
                i += 2
            if i < len(body) and body[i] == "(":
                i = _after(body, i, "(", ")")
        else:
            i += 1
    if i + 2 >= len(body) or body[i] not in ("class", "interface", "enum", "record") or not _is_word(body[i + 1]) or body[i + 2] not in ("{", "<", "(", "extends", "implements", "permits"):
        return None
    while i < len(body) and body[i] != "{":
        i += 1
    return _after(body, i, "{", "}")


def _cases(body: list[str]) -> int:
    i, deepest = 0, 0
    while i < len(body):
        if body[i] in ("case", "default"):
            while i < len(body) and body[i] not in (":", "->"):
                i += 1
            i += 1
        else:
            i, d = _statement(body, i)
            deepest = max(deepest, d)
    return deepest


def _after(body: list[str], i: int, opening: str, closing: str) -> int:
    depth = 0
    while i < len(body):
        depth += (body[i] == opening) - (body[i] == closing)
        i += 1
        if not depth:
            break
    return i


def _to_semicolon(body: list[str], i: int) -> int:
    depth = 0
    while i < len(body):
        t = body[i]
        depth += (t in "({[") - (t in ")}]") if len(t) == 1 else 0
        i += 1
        if t == ";" and depth <= 0:
            break
    return i


def statements(body: list[str]) -> tuple[int, int]:
    """(statements directly in a body, deepest nesting in it)."""
    i, n, deepest = 0, 0, 0
    while i < len(body):
        i, d = _statement(body, i)
        n, deepest = n + 1, max(deepest, d)
    return n, deepest


def _types(parameters: list[str]) -> list[str]:
    """The types of a parameter list, without annotations, modifiers and type arguments."""
    out, depth, now = [], 0, []
    for t in [*parameters, ","]:
        depth += (t in ("<", "(")) - (t in (">", ")"))
        if t == "," and not depth:
            if now:
                words = [w for w in now if w not in ("final",)]
                while words and words[0] == "@":
                    words = words[2:]
                kind = "".join(w for w in words[:-1])
                out.append(re.sub(r"<.*>", "", kind))
            now = []
        else:
            now.append(t)
    return out


def _visibility(modifiers: set[str], inside_interface: bool) -> str:
    for m in ("public", "protected", "private"):
        if m in modifiers:
            return m.upper()
    return "PUBLIC" if inside_interface else "PACKAGE_PRIVATE"


def parse(text: str) -> dict:
    """(package, imports, classes) of a source file; a file that breaks off keeps what was read before."""
    ts = tokens(text)
    out: dict = {"package": "", "imports": [], "wildcards": [], "classes": []}
    try:
        while ts.peek():
            if ts.peek() == "package":
                ts.next()
                out["package"] = _name(ts)
            elif ts.peek() == "import":
                ts.next()
                static = ts.peek() == "static" and ts.next()
                name = _name(ts)
                if not name.endswith("*"):
                    out["imports"].append(f"static {name}" if static else name)
                elif not static:
                    out["wildcards"].append(name[:-2])
            else:
                _declaration(ts, out, out["package"], None)
    except (IndexError, KeyError, ValueError, RecursionError):
        pass
    return out


def _name(ts: Tokens) -> str:
    parts = []
    while ts.peek() and ts.peek() != ";":
        parts.append(ts.next())
    ts.next()
    return "".join(parts)


def _declaration(ts: Tokens, out: dict, prefix: str, owner: dict | None, in_interface: bool = False) -> None:
    """One member or type at the reader's place."""
    doc, annotations, modifiers = None, [], set()
    while True:
        if ts.at < len(ts.items) and ts.items[ts.at][0].startswith("/**"):
            doc = ts.items[ts.at][0][3:-2].strip(" *\n\r\t")
        t = ts.peek()
        if t == "@" and ts.peek(1) != "interface":
            ts.next()
            name = ts.next()
            while ts.peek() == ".":
                name += ts.next() + ts.next()
            annotations.append({"written": name, "name": name.rpartition(".")[2], "qualifiedName": name if "." in name else next((i for i in out["imports"] if i.endswith("." + name)), None)})
            if ts.peek() == "(":
                ts.group()
        elif t in MODIFIERS:
            modifiers.add(ts.next())
        else:
            break
    t = ts.peek()
    if t in ("class", "interface", "enum", "record") and ts.items[ts.at + 1][0] == "word":
        _type(ts, out, prefix, t, doc, annotations)
    elif t == "@":
        ts.next(), ts.next(), ts.next()
        ts.group()
    elif t == "{":
        ts.group()
    elif t in (";", "}"):
        ts.next()
    elif owner is None:
        ts.next()
    else:
        _member(ts, owner, doc, annotations, modifiers, in_interface)


def _type(ts: Tokens, out: dict, prefix: str, kind: str, doc: str | None, annotations: list[dict]) -> None:
    ts.next()
    name = ts.next()
    qualified = f"{prefix}.{name}" if prefix else name
    found = {"qualifiedName": qualified, "documentation": doc, "superClass": None, "interfaces": [], "annotations": annotations, "fields": [], "methods": []}
    found["names"] = [("annotation", None, None, a["written"]) for a in annotations]
    part, words = "", []

    def resolved(parts: list[str]) -> list[str]:
        joined = re.sub(r"<[^<>]*(?:<[^<>]*>[^<>]*)*>", "", "".join(parts))
        role = "super" if part == "extends" and kind == "class" else "interface" if part in ("extends", "implements") else None
        found["names"] += [(role, None, None, n) for n in joined.split(",") if n and role]
        known = {i.rpartition(".")[2]: i for i in out["imports"]}
        return [known.get(n, n if "." in n or not out["package"] else f"{out['package']}.{n}") for n in joined.split(",") if n]

    while ts.peek() != "{":
        t = ts.next()
        if t == "(":
            ts.at -= 1
            ts.group()
        elif t in ("extends", "implements", "permits") or not t:
            _heritage(found, kind, part, resolved(words))
            part, words = t, []
            if not t:
                raise ValueError("no body")
        else:
            words.append(t)
    _heritage(found, kind, part, resolved(words))
    ts.next()
    if kind in ("class", "interface"):
        out["classes"].append(found)
    if kind == "enum":
        while ts.peek() not in (";", "}", ""):
            ts.group() if ts.peek() in "({" else ts.next()
    while ts.peek() and ts.peek() != "}":
        _declaration(ts, out, qualified, found, kind == "interface")
    ts.next()


def _heritage(found: dict, kind: str, part: str, names: list[str]) -> None:
    if part == "extends" and kind == "class":
        found["superClass"] = names[0] if names else None
    elif part in ("extends", "implements"):
        found["interfaces"] += names


def _member(ts: Tokens, owner: dict, doc: str | None, annotations: list[dict], modifiers: set[str], in_interface: bool) -> None:
    words: list[str] = []
    while ts.peek() not in ("(", ";", "=", "{", "}", ""):
        if ts.peek() == "<":
            ts.group()
        else:
            words.append(ts.next())
    visibility = _visibility(modifiers, in_interface)
    if ts.peek() == "(" and words:
        parameters = ts.group()
        types = _types(parameters)
        while ts.peek() not in ("{", ";", ""):
            ts.next()
        if ts.peek() == ";":
            ts.next()
            return
        body = ts.group()
        simple = owner["qualifiedName"].rpartition(".")[2]
        constructor = len(words) == 1 and words[0] == simple
        if not body and not constructor:
            return
        n, deepest = statements(body)
        at = f"{len(owner['methods'])}"
        owner["names"] += [("variable", at, name, kind) for kind, name in [*_parameters(parameters), *_variables(body)]]
        owner["names"] += [("use", at, name, None) for name in sorted(_used(body))]
        result = "void" if constructor else "".join(words[:-1])
        owner["methods"].append({
            "name": "<init>" if constructor else words[-1], "descriptor": f"({','.join(types)}){result}" if not constructor else f"<init>({','.join(types)})",
            "documentation": None if constructor else doc, "annotations": [] if constructor else annotations, "cyclomaticComplexity": None if constructor else complexity(body),
            "visibility": visibility, "isStatic": "static" in modifiers and not constructor, "isFinal": "final" in modifiers and not constructor,
            "parameterCount": len(types), "linesOfCode": n, "nestingDepth": deepest,
        })
        return
    if ts.peek() == "{":
        ts.group()
        return
    kind = "".join(words[:-1])
    if len(words) > 1:
        names = [words[-1]]
        if "," in words:
            first = words.index(",")
            kind, names = "".join(words[: first - 1]), [words[first - 1], *[w for w in words[first + 1 :] if w != ","]]
        static, final = ("static" in modifiers or in_interface), ("final" in modifiers or in_interface)
        owner["names"] += [("field", None, n, _bare(kind)) for n in names]
        owner["fields"] += [{"name": n, "type": kind, "visibility": visibility, "isStatic": static, "isFinal": final} for n in names]
    if not ts.peek():
        raise ValueError("no end")
    while ts.peek() not in (";", ""):
        ts.group() if ts.peek() in ("(", "{", "[") else ts.next()
    ts.next()


#: Words that are no names; fixed values of the language.
KEYWORDS = MODIFIERS | NESTING | {
    "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class", "const", "continue", "double", "else", "enum", "extends", "false", "finally", "float",
    "goto", "implements", "import", "instanceof", "int", "interface", "long", "new", "null", "package", "return", "short", "super", "this", "throw", "throws", "true", "var",
    "void", "yield",
}
#: Types that are no classes.
PRIMITIVE = {"boolean", "byte", "char", "double", "float", "int", "long", "short", "void", "var"}


def _is_name(t: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z_$\u0080-\uffff][\w$]*", t)) and t not in KEYWORDS


def _bare(kind: str) -> str | None:
    """A type's name without type arguments and brackets; null for one that is no class."""
    name = re.sub(r"<.*>|\[\]|\.\.\.", "", kind)
    return None if name in PRIMITIVE or not name else name


def _type_at(body: list[str], i: int) -> tuple[str, int] | None:
    """(a type's name, the index after it with type arguments and brackets) if one may begin at i."""
    if i >= len(body) or not (_is_name(body[i]) or body[i] in PRIMITIVE) or (i and body[i - 1] == "."):
        return None
    parts = [body[i]]
    i += 1
    while i + 1 < len(body) and body[i] == "." and _is_name(body[i + 1]):
        parts.append(body[i + 1])
        i += 2
    if i < len(body) and body[i] == "<":
        i = _after(body, i, "<", ">")
    while i + 1 < len(body) and body[i] == "[" and body[i + 1] == "]":
        i += 2
    return ".".join(parts), i


def _variables(body: list[str]) -> list[tuple[str | None, str]]:
    """(type, name) of the variables that a body declares: a type, a name, and what may follow a declaration."""
    out = []
    for i in range(len(body)):
        found = _type_at(body, i)
        if found and found[1] + 1 < len(body) and _is_name(body[found[1]]) and body[found[1] + 1] in ("=", ";", ":", ")", ","):
            out.append((_bare(found[0]), body[found[1]]))
    return out


def _parameters(tokens_: list[str]) -> list[tuple[str | None, str]]:
    return _variables([*(t for t in tokens_ if t not in ("final", ".")) , ";"] if "..." in tokens_ else [*tokens_, ";"])


def _used(body: list[str]) -> set[str]:
    """Names in expressions that may be variables: not behind a dot, no calls."""
    return {t for i, t in enumerate(body) if _is_name(t) and (not i or body[i - 1] not in (".", "::", "@", "new")) and (i + 1 == len(body) or body[i + 1] != "(")}


NAMES = "module STRING, unit STRING, package STRING, class STRING, kind STRING, method STRING, name STRING, type STRING"


def names(files: DataFrame) -> DataFrame:
    """Names as written in (module, filename, text): a row for each class (kind class), single import, wildcard import (its
    package as name), super class, interface, annotation (type as written), field, variable (name and type) and use."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for f in batch.itertuples():
                found = parse(f.text if isinstance(f.text, str) else "")
                stem = f.filename.removesuffix(".java")
                unit = f"{found['package']}.{stem}" if found["package"] else stem
                at = (f.module, unit, found["package"])
                rows += [(*at, None, "import", None, None, n.removeprefix("static ")) for n in found["imports"] if not n.startswith("static ")]
                rows += [(*at, None, "wildcard", None, None, n) for n in found["wildcards"]]
                for c in found["classes"]:
                    rows.append((*at, c["qualifiedName"], "class", None, None, None))
                    rows += [(*at, c["qualifiedName"], *n) for n in c["names"]]
            yield pd.DataFrame(rows, columns=["module", "unit", "package", "class", "kind", "method", "name", "type"])

    return files.mapInPandas(run, NAMES)


def scan(files: DataFrame) -> DataFrame:
    """A row for each class of (module, production, generated, filename, text): the shape that report.merge() takes, scan 1."""
    from ..schemas import CLASS

    kinds = f"module STRING, package STRING, unit STRING, production BOOLEAN, generated BOOLEAN, imports ARRAY<STRING>, clazz {CLASS}, scan INT"

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for f in batch.itertuples():
                found = parse(f.text if isinstance(f.text, str) else "")
                stem = f.filename.removesuffix(".java")
                unit = f"{found['package']}.{stem}" if found["package"] else stem
                rows += [(f.module, found["package"], unit, f.production, f.generated, found["imports"], c, 1) for c in found["classes"]]
            yield pd.DataFrame(rows, columns=["module", "package", "unit", "production", "generated", "imports", "clazz", "scan"])

    return files.mapInPandas(run, kinds)
