"""Java class files as rows of a module scan: names, members and the classes that the constant pool refers to."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame

#: Access flags and constant-pool tags of the class file format (fixed values).
PUBLIC, PRIVATE, PROTECTED, STATIC, FINAL, BRIDGE, ABSTRACT, SYNTHETIC = 1, 2, 4, 8, 16, 0x40, 0x400, 0x1000
TAG_SIZES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, fmt: str) -> tuple:
        out = struct.unpack_from(">" + fmt, self.data, self.at)
        self.at += struct.calcsize(">" + fmt)
        return out

    def u2(self) -> int:
        return self.take("H")[0]

    def skip(self, n: int) -> None:
        self.at += n


def _visibility(flags: int) -> str:
    return "PUBLIC" if flags & PUBLIC else "PRIVATE" if flags & PRIVATE else "PROTECTED" if flags & PROTECTED else "PACKAGE_PRIVATE"


def parameters(descriptor: str) -> int:
    """How many parameters a method descriptor has."""
    n, i = 0, descriptor.index("(") + 1
    while descriptor[i] != ")":
        while descriptor[i] == "[":
            i += 1
        i = descriptor.index(";", i) + 1 if descriptor[i] == "L" else i + 1
        n += 1
    return n


def unit_name(qualified: str) -> str:
    """The build unit of a class: nested classes belong to what stands before the last $."""
    return qualified.rpartition("$")[0] or qualified


def parse(data: bytes) -> dict:
    """A class file as a dictionary in the shape of a module report's class, with package, unit and imports."""
    r = _Reader(data)
    magic, _, _, count = r.take("IHHH")
    if magic != 0xCAFEBABE:
        raise ValueError("not a class file")
    pool: list = [None] * count
    i = 1
    while i < count:
        (tag,) = r.take("B")
        if tag == 1:
            n = r.u2()
            pool[i] = r.data[r.at : r.at + n].decode("utf-8", "replace")
            r.skip(n)
        elif tag == 7:
            pool[i] = ("class", r.u2())
        else:
            pool[i] = (tag, r.at)
            r.skip(TAG_SIZES[tag])
        i += 2 if tag in (5, 6) else 1
    name_of = lambda k: pool[pool[k][1]].replace("/", ".") if k else None
    _, this, parent, n_interfaces = r.take("HHHH")
    own, top = name_of(this), name_of(parent)
    interfaces = [name_of(r.u2()) for _ in range(n_interfaces)]

    def members() -> Iterator[tuple[int, str, str, set[str]]]:
        for _ in range(r.u2()):
            flags, name, kind, n = r.take("HHHH")
            found = set()
            for _ in range(n):
                attribute, size = r.take("HI")
                found.add(pool[attribute])
                r.skip(size)
            yield flags, pool[name], pool[kind], found

    fields = [{"name": n, "type": d, "visibility": _visibility(f), "isStatic": bool(f & STATIC), "isFinal": bool(f & FINAL)} for f, n, d, _ in members() if not f & SYNTHETIC]
    methods = [
        {"name": n, "descriptor": n + d, "visibility": _visibility(f), "isStatic": bool(f & STATIC), "isFinal": bool(f & FINAL), "parameterCount": parameters(d), "nestingDepth": 0, "annotations": []}
        for f, n, d, a in members()
        if not f & (BRIDGE | SYNTHETIC | ABSTRACT) and "Code" in a
    ]
    used = {pool[x[1]].lstrip("[") for x in pool if isinstance(x, tuple) and x[0] == "class"}
    plain = {(u[1:-1] if u.startswith("L") and u.endswith(";") else u).replace("/", ".") for u in used}
    imports = sorted(u for u in plain if u != own and len(u) > 1)
    return {
        "package": own.rpartition(".")[0], "unit": unit_name(own), "imports": imports,
        "clazz": {"qualifiedName": own, "superClass": None if top == "java.lang.Object" else top, "interfaces": interfaces, "annotations": [], "fields": fields, "methods": methods},
    }


def scan(files: DataFrame) -> DataFrame:
    """A row for each class of (module, production, generated, content): the shape that report.merge() takes, scan 0.

    Files that aren't class files, or are corrupt or null, give no row.
    """
    from ..schemas import CLASS

    kinds = f"module STRING, package STRING, unit STRING, production BOOLEAN, generated BOOLEAN, imports ARRAY<STRING>, clazz {CLASS}, scan INT"

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for f in batch.itertuples():
                try:
                    found = parse(bytes(f.content))
                except (ValueError, IndexError, KeyError, TypeError, AttributeError, struct.error):  # whatever a corrupt pool leads to
                    continue
                clazz = found["clazz"] | {"documentation": None}
                clazz["methods"] = [m | {"documentation": None, "cyclomaticComplexity": None, "linesOfCode": None} for m in clazz["methods"]]
                rows.append((f.module, found["package"], found["unit"], f.production, f.generated, found["imports"], clazz, 0))
            yield pd.DataFrame(rows, columns=["module", "package", "unit", "production", "generated", "imports", "clazz", "scan"])

    return files.mapInPandas(run, kinds)
