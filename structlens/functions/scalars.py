"""Scalar functions and predicates as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CATEGORIES = ("production", "test", "generated")
VISIBILITIES = ("PUBLIC", "PROTECTED", "PACKAGE_PRIVATE", "PRIVATE")
#: Directory category to (production, generated); fixed values.
DIRECTORY_FLAGS = {
    "src": (True, False),
    "obj": (True, False),
    "gensrc": (True, True),
    "testsrc": (False, False),
    "testobj": (False, False),
    "testgensrc": (False, True),
}


def category(production: Column, generated: Column) -> Column:
    """generated code first, whether of tests or not; then production and test."""
    return F.when(generated, "generated").when(production, "production").otherwise("test")


def simple_name(qualified: Column) -> Column:
    return F.substring_index(qualified, ".", -1)


def package_of(qualified: Column) -> Column:
    """All before the last dot; "" without one."""
    return F.regexp_extract(qualified, r"^(.*)\.[^.]*$", 1)


def prefix(name: Column, segments: int = 2) -> Column:
    """The first dotted segments; names of fewer stay whole."""
    return F.substring_index(name, ".", segments)


def is_external(name: Column, package: Column) -> Column:
    """An import that counts as coupling: no static import, none of java.lang, of the own package or below it."""
    return ~(name.startswith("static ") | name.startswith("java.lang") | (name == package) | ((package != "") & name.startswith(F.concat(package, F.lit(".")))))


def is_documented(doc: Column) -> Column:
    return F.coalesce(F.length(F.trim(F.regexp_replace(doc, r"\s", " "))) > 0, F.lit(False))


def glob_regex(glob: str) -> str:
    """A regular expression for a file-name glob with *, ?, [..], [!..], {a,b} and \\ escapes."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        elif c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def matches_glob(name: Column, glob: str) -> Column:
    return name.rlike(glob_regex(glob))


def boolean_parameters(descriptor: Column) -> Column:
    """How many parameters of a method are boolean, by the descriptor of its byte code, name(params)result, or by its types
    as written in the source, (boolean,int)void; letters elsewhere don't count."""
    inside = F.regexp_extract(descriptor, r"\(([^)]*)\)", 1)
    plain = F.regexp_replace(F.regexp_replace(inside, r"L[^;]*;", ""), r"\[+.", "")
    coded = F.length(plain) - F.length(F.replace(plain, F.lit("Z"), F.lit("")))
    written = F.size(F.filter(F.split(inside, ","), lambda t: F.trim(t) == "boolean"))
    return F.when(inside.rlike(r"^(\[*([BCDFIJSZ]|L[^;]+;))*$"), coded).otherwise(written)


def is_data_class(fields: Column, methods: Column) -> Column:
    """Fields all private with only accessors, or all public with only the object methods; constructors are free."""
    made = lambda m: m["name"].isin("<init>", "<clinit>")
    accessor = lambda m: made(m) | m["name"].rlike("^(get|set|is)")
    basic = lambda m: made(m) | m["name"].isin("toString", "hashCode", "equals")
    private = F.forall(fields, lambda f: F.coalesce(f["visibility"], F.lit("")) == "PRIVATE") & F.forall(methods, accessor)
    public = F.forall(fields, lambda f: F.coalesce(f["visibility"], F.lit("")) == "PUBLIC") & F.forall(methods, basic)
    return (F.size(fields) > 0) & (private | public)


def token_label(count: Column) -> Column:
    """Up to 999 plain, above in thousands with one digit."""
    return F.when(count < 1000, count.cast("string")).otherwise(F.format_string("%.1fK", count / 1000.0))


def elapsed_label(millis: Column) -> Column:
    """Milliseconds below a second, seconds below a minute, then minutes and seconds."""
    seconds = F.floor(millis / 1000).cast("long")
    return (
        F.when(millis < 1000, F.concat(millis.cast("string"), F.lit("ms")))
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .otherwise(F.format_string("%d:%02d", F.floor(seconds / 60).cast("long"), F.pmod(seconds, F.lit(60))))
    )


def task_mark(active: Column, state: Column) -> Column:
    """/ for an inactive task, x for a done one, blank for one without state, - for others."""
    return F.when(~active, "/").when(state == "SUCCESSFUL", "x").when(state.isNull(), " ").otherwise("-")


def tool_allowed(name: Column, whitelist: list[str] = (), blacklist: list[str] = ()) -> Column:
    """Whole-name regular expressions: any of the whitelist, if there is one, or none of the blacklist, if there is one."""
    fits = lambda patterns: [name.rlike(f"^(?:{p})$") for p in patterns]
    allowed = F.lit(not whitelist and not blacklist)
    for x in fits(whitelist):
        allowed = allowed | x
    if blacklist:
        none = F.lit(True)
        for x in fits(blacklist):
            none = none & ~x
        allowed = allowed | none
    return allowed


def tool_name(raw: Column) -> Column:
    """What models append after < is cut."""
    return F.substring_index(raw, "<", 1)


def license_label(license: Column) -> Column:
    return F.coalesce(license["name"], license["id"])


def component_label(group: Column, name: Column) -> Column:
    return F.when(group.isNotNull() & (group != ""), F.concat_ws(":", group, name)).otherwise(name)


def file_label(text: Column) -> Column:
    """Characters that file names of reports don't keep become underscores."""
    return F.regexp_replace(text, r"[^\w.-]", "_")
