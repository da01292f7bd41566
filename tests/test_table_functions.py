"""Table functions in SQL, and state across runs of a stream."""

import pytest

from structlens.functions import tables


@pytest.fixture(scope="module")
def t(spark):
    assert tables.register(spark) == ["values_of", "prefixes_of", "json_problems"]
    rows = [(1, "a", "x.y.Z", '{"k": 1}'), (2, "a", None, "{"), (3, None, "x.y.W", None), (4, "b", "", '{"k": "1"}'), (5, "b", "x", "{}")]
    spark.createDataFrame(rows, "id LONG, g STRING, name STRING, doc STRING").repartition(3).createOrReplaceTempView("t")


def result(spark, text):
    return {tuple(r) for r in spark.sql(text).collect()}


def test_values_of(spark, t, monkeypatch):
    assert result(spark, "SELECT key, value, sum(count) FROM values_of(TABLE(t), 'g', 'name') GROUP BY ALL") == {("a", "x.y.Z", 1), (None, "x.y.W", 1), ("b", "", 1), ("b", "x", 1)}
    monkeypatch.setattr(tables, "MOST", 2)
    one = tables.ValuesOf()
    rows = [{"g": "a", "n": i % 3} for i in range(10)]
    parts = [x for r in rows for x in one.eval(r, "g", "n") or ()] + list(one.terminate())
    assert sum(n for *_, n in parts) == 10 and all(len([p for p in parts if p[1] == v]) > 1 for v in "012")


def test_prefixes_of(spark, t):
    got = result(spark, "SELECT id, segments, prefix FROM prefixes_of(TABLE(SELECT id, name FROM t), 'name')")
    assert got == {(1, 1, "x"), (1, 2, "x.y"), (1, 3, "x.y.Z"), (3, 1, "x"), (3, 2, "x.y"), (3, 3, "x.y.W"), (4, 1, ""), (5, 1, "x")}


def test_json_problems(spark, t):
    schema = '{"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}}'
    got = {r.id: r.problems for r in spark.sql(f"SELECT id, problems FROM json_problems(TABLE(t), 'doc', '{schema}')").collect()}
    assert got == {1: [], 2: ["no JSON"], 3: None, 4: ["/k: is no integer"], 5: ["/: has no k"]}


@pytest.mark.parametrize("call", ["values_of(TABLE(t), 'g', 'nothing')", "prefixes_of(1, 'name')", "prefixes_of(TABLE(t), concat('na', id))", "json_problems(TABLE(t), 'doc', '{')"])
def test_wrong_arguments_are_refused_when_the_query_is_analysed(spark, t, call):
    with pytest.raises(Exception, match="(?i)column|TABLE|constant|Expecting|UNRESOLVED"):
        spark.sql(f"SELECT * FROM {call}").schema  # noqa: B018


def test_done_indices_survive_restarts(spark, tmp_path):
    import random

    from structlens.streaming import state

    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([0, 1, 4095, 4096, 9000, rng.randrange(20_000), None, -1])) for _ in range(300)]
    other = state.session_for_state(spark)
    for i in range(3):
        # Each run sees some rows that earlier ones saw, too.
        other.createDataFrame(rows[80 * i : 80 * i + 140], "task_id STRING, index LONG").write.mode("append").parquet(f"{tmp_path}/in")
        stream = other.readStream.schema("task_id STRING, index LONG").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
        state.run_to_end(state.new_indices(stream), f"{tmp_path}/out", f"{tmp_path}/check")
        got = [tuple(r) for r in other.read.parquet(f"{tmp_path}/out").collect()]
        assert len(got) == len(set(got)) and set(got) == {r for r in rows[: 80 * i + 140] if r[1] is not None and r[1] >= 0}
