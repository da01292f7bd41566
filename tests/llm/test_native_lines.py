"""Line dedup is DataFrame operations only: no Python runs on the executors."""

import random

from pyspark.sql import functions as F

from structlens.llm import lines


def test_line_dedup_runs_no_python(spark, documents, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("Python on the executors")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(documents), name, refused)
    plan = lines.decisions(documents)
    assert plan.agg(F.sum(F.size("removed"))).first()[0] > 0
    assert not any(x in plan._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))


def test_hashes_in_spark_are_of_whole_shingles_and_similar_lines_meet(spark):
    rng = random.Random(44)
    texts = ["", "short", "ninechars", "ten chars!", "漢字かな交じり文に空白はない", "a😀b𝒳" * 5, "ab" * 30]
    for _ in range(150):
        a = "".join(rng.choices("abcdefgh é", k=rng.choice([30, 90, 300])))
        at = rng.randrange(len(a))
        texts += [a, a[:at] + "Z" + a[at + 1 :]]
    sets = [{t[i : i + lines.SHINGLE] for i in range(max(1, len(t) - lines.SHINGLE + 1))} for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "id LONG, line STRING")
    found = {r.id: r.all for r in rows.select("id", lines.shingle_hashes(F.col("line")).alias("all")).collect()}
    assert [len(found[i]) for i in range(len(texts))] == [len(s) for s in sets]
    keys: dict[int, set] = {}
    for r in lines.band_keys(rows).collect():
        keys.setdefault(r.id, set()).add(r.bucket)
    like = [(i, i + 1) for i in range(7, len(texts), 2) if 100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1])]
    assert len(like) > 60 and all(keys[i] & keys[j] for i, j in like)
    assert all(len(set(found[i]) & set(found[j])) == len(sets[i] & sets[j]) for i, j in like)
