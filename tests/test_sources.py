"""File trees, Java sources, class files, merging and module status."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from structlens.sources import classfile, filetree, javasource, report

SOURCE = '''
package com.x; // c
import java.util.List; import static a.B.c; import org.y.*;
/** Doc of A */
@Deprecated
public class A extends Base<T> implements I, java.io.Serializable {
  private static final int N = 3;
  public List<String> names = new ArrayList<>();
  public A(int x) { this.x = x; }
  /** adds */
  @Override public int add(int a, final boolean b) {
    for (int i = 0; i < 3; i++) { if (a > 2 && b) { a++; } else if (a < 0) { while (b) { a--; } } }
    for (String s : names) { a++; }
    try { x(); } catch (Exception e) { y("}"); }
    switch (a) { case 1: return 2; default: break; }
    do { a--; } while (a > 0);
    return b ? 1 : 0;
  }
  abstract void none();
  void empty() {}
  static class Inner { int z; }
}
enum E { X, Y { void q() { if (a) {} } }; int n; }
interface J extends K, L { int C = 1; default boolean is(String s) { return s != null; } }
'''


def test_java_source():
    found = javasource.parse(SOURCE)
    assert (found["package"], found["imports"]) == ("com.x", ["java.util.List", "static a.B.c"])
    a, inner, j = found["classes"]
    assert (a["qualifiedName"], a["documentation"], a["superClass"], a["interfaces"]) == ("com.x.A", "Doc of A", "com.x.Base", ["com.x.I", "java.io.Serializable"])
    assert [m["name"] for m in a["methods"]] == ["<init>", "add"] and [f["name"] for f in a["fields"]] == ["N", "names"]
    add = a["methods"][1]
    assert (add["cyclomaticComplexity"], add["linesOfCode"], add["nestingDepth"], add["parameterCount"], add["descriptor"]) == (10, 6, 4, 2, "(int,boolean)int")
    assert add["documentation"] == "adds" and add["annotations"][0]["name"] == "Override" and add["visibility"] == "PUBLIC"
    assert a["methods"][0]["cyclomaticComplexity"] is None
    assert inner["qualifiedName"] == "com.x.A.Inner"
    assert j["interfaces"] == ["com.x.K", "com.x.L"] and j["superClass"] is None and j["methods"][0]["visibility"] == "PUBLIC"


def test_broken_source_keeps_what_came_before():
    found = javasource.parse("package p; class A { void f() { g(); } } class B { void")
    assert [c["qualifiedName"] for c in found["classes"]][0] == "p.A"


def class_bytes() -> bytes:
    pool, index = [], {}

    def utf(s):
        if s not in index:
            pool.append(b"\x01" + struct.pack(">H", len(s)) + s.encode())
            index[s] = len(pool)
        return index[s]

    def ref(s):
        n = utf(s)
        pool.append(b"\x07" + struct.pack(">H", n))
        return len(pool)

    this, top, face, used = ref("p/Outer$In"), ref("java/lang/Object"), ref("p/Face"), ref("[Lq/Other;")
    assert used
    pool.append(b"\x05" + struct.pack(">q", 1))
    pool.append(None)
    code, name, kind, field, z = utf("Code"), utf("run"), utf("([IZLjava/lang/String;)V"), utf("f"), utf("Z")
    body = struct.pack(">HHHH", 1, this, top, 1) + struct.pack(">H", face)
    body += struct.pack(">H", 1) + struct.pack(">HHHH", 0x1A, field, z, 0)
    body += struct.pack(">H", 2) + struct.pack(">HHHH", 9, name, kind, 1) + struct.pack(">HI", code, 0) + struct.pack(">HHHH", 0x401, name, kind, 0)
    return struct.pack(">IHHH", 0xCAFEBABE, 0, 65, len(pool) + 1) + b"".join(p for p in pool if p) + body


def test_class_file():
    found = classfile.parse(class_bytes())
    c = found["clazz"]
    assert (found["package"], found["unit"], c["qualifiedName"], c["superClass"], c["interfaces"]) == ("p", "p.Outer", "p.Outer$In", None, ["p.Face"])
    assert set(found["imports"]) == {"java.lang.Object", "p.Face", "q.Other"}
    assert [(m["descriptor"], m["parameterCount"], m["isStatic"]) for m in c["methods"]] == [("run([IZLjava/lang/String;)V", 3, True)]
    assert c["fields"] == [{"name": "f", "type": "Z", "visibility": "PRIVATE", "isStatic": True, "isFinal": True}]


def test_scans_and_merge(spark):
    text = "package p; class A { /** d */ int f(int a) { return a; } int g; }"
    sources = spark.createDataFrame([("m", True, False, "A.java", text)], "module STRING, production BOOLEAN, generated BOOLEAN, filename STRING, text STRING")
    one = javasource.scan(sources)
    old = one.withColumn("scan", F.lit(0)).withColumn("generated", F.lit(True)).withColumn("imports", F.array(F.lit("z.Z")))
    merged = report.merge(old.unionByName(one))
    row = report.classes(merged).first()
    assert (row["class"], row.category, row.n_fields, row.n_methods, row.unit_imports) == ("p.A", "production", 1, 1, ["z.Z"])
    assert report.methods(report.classes(merged)).first().documented
    binary = spark.createDataFrame([("m", True, False, bytearray(class_bytes())), ("m", True, False, bytearray(b"junk"))], "module STRING, production BOOLEAN, generated BOOLEAN, content BINARY")
    assert [r.unit for r in classfile.scan(binary).collect()] == ["p.Outer"]


def test_reports_round_trip(spark, tmp_path):
    text = "package p; class A { int f(int a) { return a; } }"
    sources = spark.createDataFrame([("my module", True, False, "A.java", text)], "module STRING, production BOOLEAN, generated BOOLEAN, filename STRING, text STRING")
    merged = report.merge(javasource.scan(sources))
    report.write(merged, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).where("module = 'my module'").count() == 1
    merged.write.json(str(tmp_path / "j"))
    again = report.read(spark, str(tmp_path / "j" / "*.json"))
    assert report.classes(again).first()["class"] == "p.A" and report.report_name("my module") == "Java_my_module"


def test_status(spark):
    modules = spark.createDataFrame([("core", ["java"]), ("api", ["Java", "Kotlin"]), ("docs", ["Python"]), (None, ["Java"])], "name STRING, languages ARRAY<STRING>")
    existing = spark.createDataFrame([("api",)], "name STRING")
    assert {(r.module, r.status) for r in report.status(modules, existing).collect()} == {("core", "GENERATED"), ("api", "REUSED"), ("docs", "SKIPPED"), (None, "ERROR")}


def test_file_tree(spark, tmp_path):
    for path, data in {"a.txt": b"a\nb\r\nc\rd", "empty": b"", ".git/config": b"x\n", "src/p/A.java": b"1\n2\n", "src/p/B.java": b"\r\n\r\n"}.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_bytes(data)
    os.symlink(tmp_path / "src", tmp_path / "link")
    got = {r.path: (r.directory, r.filename, r.length, r.lines) for r in filetree.read(spark, str(tmp_path), lines=True).collect()}
    assert got == {
        "a.txt": ("", "a.txt", 8, 4), "empty": ("", "empty", 0, 0), ".git/config": (".git", "config", 2, 1), "src/p/A.java": ("src/p", "A.java", 4, 2), "src/p/B.java": ("src/p", "B.java", 4, 2),
    }
    assert filetree.read_text(str(tmp_path), "a.txt") == "a\nb\r\nc\rd"
    texts = filetree.with_text(filetree.read(spark, str(tmp_path)).where("directory = ''"), str(tmp_path))
    assert {(r.filename, r.text) for r in texts.collect()} == {("a.txt", "a\nb\r\nc\rd"), ("empty", "")}
    assert filetree.read_text(str(tmp_path), "../x") == "ERROR" and filetree.read_text(str(tmp_path), "no") == "ERROR: FileNotFoundError"


@pytest.mark.parametrize(("body", "statements", "nesting"), [
    ("int a = 1; outer: for (int i = 0; i < 3; i++) { for (;;) { if (a > 1) { break outer; } } } g();", 3, 3),
    ("final class L extends Q { void x() { if (a) { } } } g(); h();", 3, 0), ("class L<T> { } g();", 2, 0), ("@SuppressWarnings(\"x\") class B { } z();", 2, 0),
    ("if (a) b(); else if (c) { if (d) e(); } else { for (;;) x(); }", 1, 3), ("switch (a) { case 1: f(); break; default: if (b) { c(); } } z();", 2, 2), ("x = a ? b : c; y();", 2, 0),
    ("if (x == 1) y(); " + " ".join(f"else if (x == {i}) y();" for i in range(1500)), 1, 1501),
])
def test_statements_and_nesting(body, statements, nesting):
    method = javasource.parse(f"class A {{ void f() {{ {body} }} }}")["classes"][0]["methods"][0]
    assert (method["linesOfCode"], method["nestingDepth"]) == (statements, nesting)


def test_no_file_fails_a_scan(spark):
    deep = "class A { void f() { " + "{" * 5000 + "}" * 5000 + " } }"
    rows = [("m", True, False, "A.java", t) for t in (None, "", "class", "class A {", deep, "class B { int x; }", "\x00 class ) ( {")]
    found = javasource.scan(spark.createDataFrame(rows, "module STRING, production BOOLEAN, generated BOOLEAN, filename STRING, text STRING"))
    assert "B" in {r.clazz.qualifiedName for r in found.collect()}
    rng = random.Random(4)
    head = bytes.fromhex("cafebabe00000034")
    rows = [("m", True, False, bytes(c)) for c in (b"", b"\xca\xfe", head, head + b"\x00\x02\x07\x00\x09" + b"\x00" * 40, *[head + rng.randbytes(60) for _ in range(200)])] + [("m", True, False, None)]
    assert classfile.scan(spark.createDataFrame(rows, "module STRING, production BOOLEAN, generated BOOLEAN, content BINARY")).count() >= 0
