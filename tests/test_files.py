"""The file tree as a source with filters and as a stream, and CSV reports as a sink."""

import csv
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringEndsWith, StringStartsWith

from structlens.report import csvfiles
from structlens.sources import filetree


@pytest.fixture
def tree(tmp_path):
    for path in ("a.txt", "src/A.java", "src/x/B.java", "src/x/y/C.kt", "src2/D.java", ".git/config", "docs/a.txt"):
        at = tmp_path / "root" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(path + "\n")
    return str(tmp_path / "root")


FILTERS = [
    ("directory = 'src/x'", {"src/x/B.java"}),
    ("directory like 'src/%'", {"src/x/B.java", "src/x/y/C.kt"}),
    ("startswith(path, 'src/x/')", {"src/x/B.java", "src/x/y/C.kt"}),
    ("startswith(path, 'sr')", {"src/A.java", "src/x/B.java", "src/x/y/C.kt", "src2/D.java"}),
    ("filename like '%.java' and directory in ('src', 'src2')", {"src/A.java", "src2/D.java"}),
    ("filename = 'a.txt'", {"a.txt", "docs/a.txt"}),
    ("path = 'a.txt' or path = 'docs/a.txt'", {"a.txt", "docs/a.txt"}),
    ("directory = ''", {"a.txt"}),
    ("filename like '%a%' and length > 5", {"src/A.java", "docs/a.txt", "src/x/B.java", "src2/D.java", "a.txt"}),
]


@pytest.mark.parametrize("where,expected", FILTERS)
def test_filters_prune_the_walk(spark, tree, where, expected):
    got = filetree.read(spark, tree).where(where)
    assert {r.path for r in got.collect()} == expected


def test_pushed_filters_are_not_in_the_plan_again(spark, tree):
    plan = filetree.read(spark, tree).where("directory = 'src/x' and filename like '%.java'")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters" in plan and "src/x" in plan
    entered = []
    real = os.scandir

    def scandir(path):
        entered.append(os.path.relpath(path, tree))
        return real(path)

    reader = filetree.TreeReader(tree, False)
    left = list(reader.pushFilters([EqualTo(("directory",), "src/x"), StringEndsWith(("filename",), ".java"), EqualTo(("length",), 3)]))
    assert len(left) == 1
    filetree.os.scandir, before = scandir, filetree.os.scandir
    try:
        assert [f for p in reader.partitions() for f, _ in p.files] == ["src/x/B.java"]
    finally:
        filetree.os.scandir = before
    assert set(entered) == {".", "src", "src/x"}
    both = filetree.TreeReader(tree, False)
    assert list(both.pushFilters([In(("path",), ("src/A.java", None)), StringStartsWith(("directory",), "src")])) == []
    assert [f for p in both.partitions() for f, _ in p.files] == ["src/A.java"]


def test_partitions_go_by_bytes_not_by_directories(spark, tree):
    for i in range(40):
        Path(tree, "src", f"f{i}.bin").write_bytes(b"x" * 6000)
    parts = filetree.TreeReader(tree, False, 50_000).partitions()
    assert 8 <= len(parts) <= 12 and max(len(p.files) for p in parts) < 20
    assert filetree.read(spark, tree, lines=True, partition_bytes=50_000).where("lines > 0").count() == 47


def test_a_stream_sees_each_file_once(spark, tree, tmp_path):
    def run():
        out = filetree.stream(spark, tree, settle=0).select("path", "length").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check")
        out.trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    first = run()
    assert len(first) == 7 and run() == first
    Path(tree, "new.txt").write_text("1234")
    Path(tree, "a.txt").write_text("longer now")
    assert run() == sorted([*first, ("new.txt", 4), ("a.txt", 10)])


def read(path):
    with open(path, newline="", encoding="utf-8") as f:
        return list(csv.reader(f))


def test_reports_of_all_metrics_by_one_job(spark, tmp_path):
    rows = [("count", "m 1", "test", "9", 2), ("count", "m 1", "production", "10", 1), ("count", "m 1", "production", "9", 3), ("names", "m 1", "", "a,b", 1), ("names", "ä", "", 'q"', 1)]
    df = spark.createDataFrame(rows * 1, "metric STRING, module STRING, category STRING, value STRING, count LONG").repartition(3)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("reports", "reports")
    csvfiles.write_metrics(df, str(tmp_path / "out"), {"count"})
    assert len(jobs.getJobIdsForGroup("reports")) <= 3  # one, and those of its exchanges by adaptive execution
    spark.sparkContext._jsc.sc().clearJobGroup()
    assert read(tmp_path / "out/count/m_1.csv") == [["Category", "Value", "Count"], ["production", "9", "3"], ["production", "10", "1"], ["test", "9", "2"]]
    assert read(tmp_path / "out/names/m_1.csv") == [["Category", "Key", "Count"], ["", "a,b", "1"]]
    assert sorted(p.name for p in (tmp_path / "out/names").iterdir()) == ["m_1.csv", "ä.csv"]
    csvfiles.write_metrics(df.limit(0), str(tmp_path / "none"), set())
    assert not (tmp_path / "none").exists() or not [p for p in (tmp_path / "none").rglob("*.csv")]


def test_a_failing_job_leaves_the_reports_as_they_were(spark, tmp_path):
    good = spark.createDataFrame([("m", "a", 1)], "metric STRING, module STRING, n LONG")
    csvfiles.write(good, str(tmp_path))
    bad = spark.createDataFrame([("m", f"x{i}", i) for i in range(9)] + [("m", "a", 5)], "metric STRING, module STRING, n LONG")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        csvfiles.write(bad.withColumn("n", F.expr("1 div (n - 5)")), str(tmp_path))
    assert read(tmp_path / "m/a.csv") == [["n"], ["1"]] and [p.name for p in (tmp_path / "m").iterdir()] == ["a.csv"]


def test_a_killed_attempt_is_not_seen(tmp_path):
    """An attempt that dies without a word, one that fails, and the one that goes through."""
    writer = csvfiles.ReportWriter(str(tmp_path), ["n"])

    def dying():
        yield ("m", "a", 1)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writer.write(dying())
    lost = writer.write(iter([("m", "a", 7)]))  # its message never reaches the driver
    assert not (tmp_path / "m").exists()
    writer.commit([writer.write(iter([("m", "a", 1), ("m", "b", 2)])), None, writer.write(iter([]))])
    assert read(tmp_path / "m/a.csv") == [["n"], ["1"]] and read(tmp_path / "m/b.csv") == [["n"], ["2"]]
    assert not os.path.exists(lost.files[0][0]) and not os.listdir(tmp_path / csvfiles.DRAFTS)
    again = csvfiles.ReportWriter(str(tmp_path), ["n"])
    with pytest.raises(ValueError):
        again.commit([again.write(iter([("m", "a", 1)])), again.write(iter([("m", "a", 2)]))])
    assert read(tmp_path / "m/a.csv") == [["n"], ["1"]]
