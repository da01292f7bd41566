"""The queries use every row, and the whole of each text."""

import os

import duckdb
import pytest

from structlens.plans import benchmark, sql

SF = "/root/testdata/sf0.01"


def connected(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con


@pytest.fixture(scope="module")
def tables():
    return connected(SF)


def test_json_repair_takes_whole_pages(spark, tmp_path):
    pages = [
        (1, '<a href="/x">short</a>'), (2, "a" * 399 + '"b" ' * 200 + "end"), (3, "\n\t\\" * 300 + '<p class="c" id="d">é😀</p>'), (4, '"' * 1000 + "."), (5, ""), (6, None),
    ]
    spark.createDataFrame(pages, "page_id LONG, html STRING").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.id, r.n) for r in benchmark.QUERIES["json_repair"](spark, str(tmp_path)).collect()}
    # No quote of these stands before a comma or brace, so all belong to the value: escaped for it, one character in it.
    assert got == {i: (None, None) if html is None else (i, len(html)) for i, html in pages}


def same(got, expected):
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(expected.columns)].itertuples(index=False))
    return rows(got) == rows(expected)


def test_package_tangles_lift_every_edge(spark, tables):
    got = benchmark.QUERIES["package_tangles"](spark, SF).toPandas()
    crossing = "SELECT count(*) FROM supplier a JOIN supplier b ON (a.s_suppkey * 7 + a.s_nationkey) % (SELECT count(*) FROM supplier) = b.s_suppkey WHERE a.s_nationkey <> b.s_nationkey"
    assert same(got, tables.sql(sql.SQL["package_tangles"]).df()) and 0 < got.evidence.sum() <= tables.sql(crossing).fetchall()[0][0]


@pytest.mark.parametrize("name", ["inter_module_matrix", "inter_module_instability", "rules_grouped", "unstable_dependencies"])
def test_module_uses_count_every_lineitem(spark, name):
    """The matrix has all uses; the others take each pair's surplus instead of its uses. Of unstable dependencies there
    are none before sf0.1."""
    folder = "/root/testdata/sf0.1" if name == "unstable_dependencies" else SF
    got, expected = benchmark.QUERIES[name](spark, folder).toPandas(), connected(folder).sql(sql.SQL[name]).df()
    assert len(got) and same(got, expected)


def test_csv_has_the_rows_of_every_module(spark, tables):
    got = benchmark.QUERIES["csv_by_category"](spark, SF).toPandas()
    assert got.module.nunique() == 25 and got.Count.sum() == tables.sql("SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey").fetchall()[0][0]


def test_every_rule_finds_something(spark):
    from structlens.rules import thresholds

    sf = "/root/testdata/sf0.01"
    got = {(r.rules, r.finding) for r in benchmark.QUERIES["rules_estate"](spark, sf).collect()}
    tables = {"methods": thresholds.METHOD_RULES, "classes": thresholds.CLASS_RULES, "modules": thresholds.MODULE_RULES, "annotations": thresholds.ANNOTATION_RULES}
    tables |= {"imports": thresholds.IMPORT_RULES, "stability": thresholds.STABILITY_RULES}
    assert got == {(name, r.finding) for name, rules in tables.items() for r in rules}
    assert {r.finding for r in benchmark.QUERIES["rules_package_cycles"](spark, sf).collect()} == {r.finding for r in thresholds.CYCLE_RULES}
    assert benchmark.QUERIES["unstable_estate"](spark, sf).count() > 0
