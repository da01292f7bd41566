"""Mixing, URL filters, sharding, quality rules, secrets, WARC packages and the pipeline."""

import hashlib
import itertools
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from structlens.llm import mixing, quality, queries, secrets, sharding, url_filter, warc
from structlens.llm._common import native_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words(documents):
    for r in documents.select("text", native_words(F.col("text")).alias("w")).collect():
        assert r.w == WORD.findall(r.text or "")


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in full]
        if not free:
            return {n: float(v) for n, v in full.items()}
        level = (total - sum(full.values())) / sum(w[n] for n in free)
        over = [n for n in free if w[n] * level > 3 * sizes[n]]
        if not over:
            return {n: float(full[n]) if n in full else w[n] * level for n in names}
        full |= {n: 3 * sizes[n] for n in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100, None: 7}, {"a": 5, "b": 1000}, {"x": 10}, {"a": 3, "b": 4, "c": 500, "d": 60, "é": 9}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source STRING, source_size LONG")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix(documents):
    out = mixing.mix(documents, slice_rows=7).collect()
    again = mixing.mix(documents.repartition(5), slice_rows=3).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)
    sizes = Counter()
    taken = Counter()
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.taken >= r.epochs * r.size
    target = brute_targets(sizes)
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert len(out) == documents.count()


def test_mix_edges(spark, empty):
    assert mixing.mix(empty).count() == 0
    rows = spark.createDataFrame([(1, None, None), (2, "", "a"), (None, "a b", "a"), (None, "a b", "a")], "doc_id LONG, text STRING, source STRING")
    assert sorted(r.taken for r in mixing.mix(rows).collect()) == [0, 0, 2, 2]
    assert mixing.mixture(rows.withColumn("size", F.lit(3))).count() == 2


def test_url_filter(spark):
    urls = [
        (1, "https://www.Example.org/es/1"), (2, "http://a.example.org/en/12?q"), (3, "https://x.org"), (4, "https://x.org/"), (5, "https://x.com/fr/a"), (6, "https://x.com/de/a"),
        (7, "https://shop.net/a/?utm_source=x#top"), (8, "http://www.shop.net:80/a"), (9, "https://shop.net/a?k=1"), (10, None), (11, "no scheme"), (12, "://"), (13, "http://xorg/"), (13, "http://xorg/"),
    ]
    pages = spark.createDataFrame([(*u, "extra") for u in urls], "page_id LONG, url STRING, verdict STRING")
    listed = spark.createDataFrame([("http://shop.net/a",), (None,), ("zzz",)], "url STRING")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, listed, queries.RULES).collect()}
    assert got == {
        1: ("www.example.org", "/es/1", "example.org/es/", "block"), 2: ("a.example.org", "/en/12", "example.org/en/1", "block"), 3: ("x.org", "", None, "allow"), 4: ("x.org", "/", "org/", "allow"),
        5: ("x.com", "/fr/a", "com/fr/", "allow"), 6: ("x.com", "/de/a", "com/de/", "block"), 7: ("shop.net", "/a/", None, "block"), 8: ("www.shop.net:80", "/a", None, "block"),
        9: ("shop.net", "/a", None, "allow"), 10: ("", "", None, "allow"), 11: ("", "", None, "allow"), 12: ("", "", None, "allow"), 13: ("xorg", "/", None, "allow"),
    }
    assert url_filter.filter_urls(pages, listed.limit(0), queries.RULES).count() == len(urls)
    assert url_filter.filter_urls(pages.limit(0), listed, queries.RULES).count() == 0


def test_many_rules_decide_like_few(spark, monkeypatch):
    rng = random.Random(61)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "xa.com", "org", "x.org", "A.com", ""]
    paths = ["", "/", "/en", "/en/", "/en/1", "/en/12", "/de/1"]
    rules = [(rng.choice(["allow", "block"]), h.lower() + p) for h in hosts[:6] for p in paths[1:] if rng.random() < 0.6]
    rules += [(rng.choice(["allow", "block"]), r) for _, r in rules[:5]]
    urls = [f"http://{h}{p}{q}" for h in hosts for p in paths for q in ("", "?x=/en/1", "#y")] + [None, "none"]
    pages = spark.createDataFrame([(i, u, "kept", "kept") for i, u in enumerate(urls)], "page_id LONG, url STRING, canon STRING, salt STRING")
    listed = spark.createDataFrame([("http://x.org/de/1",)], "url STRING")
    few = {tuple(r) for r in url_filter.filter_urls(pages, listed, rules).collect()}
    monkeypatch.setattr(url_filter, "MOST_RULES", 3)
    many = url_filter.filter_urls(pages, listed, rules)
    assert many.columns == ["page_id", "url", "canon", "salt", "host", "path", "rule", "verdict"] and {tuple(r) for r in many.collect()} == few and len(few) == len(urls)
    first = {r: v for v, r in reversed(rules)}
    table = spark.createDataFrame([(v, r) for r, v in first.items()], "verdict STRING, rule STRING")
    assert {tuple(r) for r in url_filter.filter_urls(pages, listed, table).collect()} == few
    assert {r.verdict for r in url_filter.filter_urls(pages, listed, table.limit(0)).collect()} == {"allow", "block"}


def test_a_listed_url_that_most_pages_have(spark, monkeypatch):
    """Cut into parts, by a hash join without a broadcast."""
    monkeypatch.setattr(url_filter, "LEAST_PART", 20)
    urls = ["http://hot.net/x"] * 500 + [f"http://a.net/{i}" for i in range(60)] + ["http://b.net/1"] * 25 + [None, "no"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id LONG, url STRING").repartition(4)
    listed = spark.createDataFrame([("https://www.hot.net/x/",), ("http://a.net/7",), ("http://b.net/1",)], "url STRING")
    out = url_filter.filter_urls(pages, listed, [])
    got = {r.page_id: r.verdict for r in out.collect()}
    blocked = {i for i, u in enumerate(urls) if u in ("http://hot.net/x", "http://a.net/7", "http://b.net/1")}
    assert len(got) == len(urls) and {i for i, v in got.items() if v == "block"} == blocked
    assert "ShuffledHashJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_shards(spark, documents, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=60_000, fanout=3)
    assert store.version() == 0
    for i in range(4):
        store.append(documents.where(F.pmod("doc_id", F.lit(4)) == i))
    before = store.shards()
    assert store.version() == 4 and len(before) >= 4
    assert store.compact() == store.version() > 4
    after = store.shards()
    assert len(after) < len(before) and sum(s.rows for s in after) == documents.count() and store.plan(after) == []
    same = lambda df: sorted(map(str, df.select(*documents.columns).collect()))
    assert same(store.read()) == same(documents) == same(store.read(4))
    with pytest.raises(sharding.Conflict):
        store._commit(3, [], [], documents.schema.json())
    with pytest.raises(ValueError):
        store.append(documents.select("doc_id"))
    assert store.vacuum() == 0 and store.vacuum(age=0) > 0 and same(store.read()) == same(documents)


def test_versions_build_on_snapshots(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=5000, fanout=3)
    rows = spark.range(1).select("id", F.repeat(F.lit("x"), 50).alias("text")).coalesce(1)
    for _ in range(2 * sharding.SNAPSHOT + 3):
        store.append(rows)
    assert len(store.shards()) == store.read().count() == store.version() == 2 * sharding.SNAPSHOT + 3
    assert [len(store.shards(v)) for v in store.versions()] == store.versions()
    store.compact()
    newest = store.version()
    store.vacuum(keep=2, age=0)
    assert store.read().count() == store.read(newest - 1).count() == 2 * sharding.SNAPSHOT + 3
    assert store.versions()[0] == 2 * sharding.SNAPSHOT + 1


def test_the_second_writer_tries_again(spark, tmp_path):
    rows = spark.range(10).select("id").coalesce(1)
    store, other = (sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=100_000, fanout=2) for _ in range(2))
    store.append(rows)
    real, calls = store._commit, []

    def late(*args):
        calls.append(args[0])
        if len(calls) == 1:
            other.append(rows)
        return real(*args)

    store._commit = late
    store.append(rows)
    assert calls == [1, 2] and store.version() == 3 and store.read().count() == 30
    # Merges of shards that another writer has merged meanwhile are void.
    store._commit = lambda *args: (other.compact(), real(*args))[1]
    store.compact()
    assert store.read().count() == 30 and len(store.shards()) == 1 and store.shards() == other.shards()
    files = [f for _, _, names in os.walk(f"{tmp_path}/store/shards") for f in names if f.endswith(".parquet")]
    assert len(files) == 4


def test_plan_merges_similar_sizes(spark):
    store = sharding.ShardStore(spark, "file:///nowhere", target_bytes=1000, fanout=4)
    make = lambda sizes: [sharding.Shard(f"{i}", n, 1, store._tier(n)) for i, n in enumerate(sizes)]
    assert store.plan(make([1000, 2000, 500])) == []
    runs = store.plan(make([100] * 25 + [1500] + [300] * 3))
    assert [len(r) for r in runs] == [10, 10, 5] and all(s.bytes == 100 for r in runs for s in r)
    assert all(sum(s.bytes for s in r) <= 1000 for r in runs)


def test_arrivals_are_merged_by_tiers(spark, tmp_path):
    rows = spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text")).repartition(16)
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=200_000, fanout=4)
    for i in range(4):
        store.append(rows.where(F.col("id") % 4 == i), f"part {i}")
        store.compact()
    assert store.append(rows, "part 2") == store.version() and store.arrivals() == [f"part {i}" for i in range(4)]
    sizes, versions = [s.bytes for s in store.shards()], store.versions()
    assert versions[-1] > 4 and max(sizes) <= 200_000 and len(sizes) < 16 and store.plan(store.shards()) == []
    held = [len(store.shards(v)) for v in versions]
    assert any(b < a for a, b in zip(held, held[1:])) and sorted(r.id for r in store.read().collect()) == list(range(4000))


def test_shard_query(spark, documents, empty):
    rows = documents.withColumn("shard", F.lit("clash")).withColumn("shard_", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("shard_bytes", F.lit(None).cast("int"))
    rows = rows.unionByName(rows.limit(1))
    got = sharding.shard(rows).collect()
    texts = Counter((r.doc_id, None if r.text is None else hashlib.sha256(r.text.encode()).hexdigest()) for r in rows.collect())
    assert Counter((r.doc_id, r.text_sha256) for r in got) == texts and all(r.shard for r in got)
    assert sharding.shard(empty).count() == 0


class Lost(Exception):
    pass


def losing(monkeypatch, at, when):
    """Makes the at-th commit end the run: before its draft, with a draft that isn't renamed, or once it is done."""
    real, calls = sharding.ShardStore._commit, []

    def commit(self, *args):
        calls.append(args)
        if len(calls) != at:
            return real(self, *args)
        if when == "draft":
            draft, fs = self._hadoop(f"{self.folder}/manifests/.draft-lost")
            fs.create(draft, True).close()
        if when == "after":
            real(self, *args)
        raise Lost

    monkeypatch.setattr(sharding.ShardStore, "_commit", commit)
    return calls


@pytest.mark.parametrize("when", ["before", "draft", "after"])
def test_lost_runs_of_shard_are_completed(spark, documents, tmp_path, monkeypatch, when):
    """The run is lost at each commit in turn, also at those of compactions, and run again as it is."""
    docs = documents.unionByName(documents.limit(7)).repartition(4).cache()
    texts = Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    with monkeypatch.context() as m:
        whole = losing(m, 0, when)
        sharding.shard(docs, 60_000, f"file://{tmp_path}/whole")
    assert len(whole) > 4
    for at in range(1, len(whole) + 1):
        folder = f"file://{tmp_path}/lost-{at}"
        with monkeypatch.context() as m:
            losing(m, at, when)
            with pytest.raises(Lost):
                sharding.shard(docs, 60_000, folder)
        if when == "draft" and at == 1:
            with pytest.raises(ValueError):
                sharding.ShardStore(spark, folder).read()
        out = sharding.shard(docs, 60_000, folder)
        store = sharding.ShardStore(spark, folder, 60_000)
        assert Counter((r.doc_id, r.text) for r in store.read().select("doc_id", "text").collect()) == texts
        assert store.arrivals() == [f"{i} of 4" for i in range(1, 5)] and store.plan(store.shards()) == []
        assert {(r.shard, r.shard_bytes) for r in out.collect()} == {("/".join(x.path.split("/")[-2:]), x.bytes) for x in store.shards() if x.rows}
        version = store.version()
        sharding.shard(docs, 60_000, folder)
        assert store.version() == version


def brute_quality(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(covered)


def test_quality_statistics(spark, documents):
    extra = spark.createDataFrame([(1, "a b c d e a b c d e f", None, None, 0), (2, "# $ x\n\n x\n# $ x", "en", "a", 0), (4, "z " * 50, "en", "a", 0)], documents.schema)
    rows = documents.unionByName(extra).withColumn("kept", F.lit(1))
    for r in quality.statistics(rows).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(r.text)
    judged = {r.doc_id: r for r in quality.judge(rows).collect()}
    for r in rows.collect():
        n, *_, repeated = brute_quality(r.text)
        assert judged[r.doc_id].base_failed == (n < 10 or 100 * repeated > 20 * n)
        assert not (judged[r.doc_id].base_failed and judged[r.doc_id].kept)
    assert len(judged) == rows.count()


def test_quality_outliers(spark, empty):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randrange(2, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(12, 900))), "en", "s", 0) for i in range(200)]
    rows += [(1000 + i, " ".join(word() + rng.choice(["$$$", "%%%", "###"]) for _ in range(150)), "en", "s", 0) for i in range(8)]
    docs = spark.createDataFrame(rows, empty.schema)
    kept = {r.doc_id for r in quality.good(docs).collect()}
    assert kept >= {r[0] for r in rows if r[0] < 1000 and brute_quality(r[1])[4] == 0} and not kept & set(range(1000, 1008))
    assert quality.judge(empty).count() == 0


def brute_estimate(x):
    """Centre and covariance of one group by the definitions: three starts, concentration steps, the least determinant."""
    d, floors = x.shape[1], np.diag(np.square(quality.FLOORS))
    cov = lambda y, factor: (y.T @ y / len(y) - np.outer(y.mean(0), y.mean(0))) * factor + floors

    def quantile(column, q):
        bins = np.sort(np.floor(np.rint(column * quality.SCALE) / 10))
        return next(b for b in bins if (bins <= b).sum() >= len(bins) * q) * 10 / quality.SCALE

    middle = np.array([quantile(x[:, i], 0.5) for i in range(d)])
    spread = np.array([(quantile(x[:, i], 0.75) - quantile(x[:, i], 0.25)) / 1.349 for i in range(d)])
    now = {"quartiles": (middle, np.diag(spread**2) + floors), "half": (middle, np.diag(spread**2) + floors), "moments": (x.mean(0), cov(x, 1.0))}
    det = lambda e: np.linalg.slogdet(e[1])[1]

    def settled(name, now):
        for step in itertools.count():
            m, c = now
            away = x - m
            bins = np.floor(np.log1p(np.einsum("ij,jk,ik->i", away, np.linalg.inv(c), away)) * 64)
            share = 0.5 if name == "half" and step == 0 else quality.CORE
            core = x[[(bins < b).sum() < len(x) * share for b in bins]]
            after = core.mean(0), cov(core, quality.CONSISTENCY)
            if step >= quality.FREE_STEPS and not det(after) < det(now) - quality.SETTLED:
                return after if det(after) <= det(now) else now
            now = after

    return min((settled(name, start) for name, start in now.items()), key=det)


def brute_distances(rows):
    """{doc_id: squared distance} of (doc_id, lang, source, vector)."""
    by = lambda key: {k: np.array([r[3] for r in rows if key(r) == k]) for k in {key(r) for r in rows}}
    mix = lambda n, e, parent: tuple((n * a + quality.PRIOR * b) / (n + quality.PRIOR) for a, b in zip(e, parent))
    whole = brute_estimate(np.array([r[3] for r in rows]))
    lang = {k: mix(len(x), brute_estimate(x), whole) for k, x in by(lambda r: r[1]).items()}
    own = {k: mix(len(x), brute_estimate(x), lang[k[0]]) for k, x in by(lambda r: r[1:3]).items()}
    away = {r[0]: (r[3] - own[r[1:3]][0], np.linalg.inv(own[r[1:3]][1])) for r in rows}
    return {k: a @ i @ a for k, (a, i) in away.items()}


def test_another_language_changes_no_estimate_of_a_group(spark):
    rng = random.Random(32)
    vectors = [[rng.gauss(7000 if i < 90 else 9000, 900), *[int(abs(rng.gauss(300, 200))) for _ in range(4)]] for i in range(130)]
    rows = [([1, 0], *[int(v) for v in x]) for x in vectors]
    other = [([2, 0], *[rng.randrange(5000) for _ in range(5)]) for _ in range(100)]
    schema = "levels ARRAY<LONG>, " + ", ".join(f"x{i} LONG" for i in range(5))
    alone, both = ({r.group: tuple(r)[1:] for r in quality.estimates(spark.createDataFrame(x, schema)).collect()} for x in (rows, rows + other))
    assert alone[1] == both[1] and alone[0] != both[0] and quality.estimates(spark.createDataFrame([], schema)).count() == 0


def test_distances_by_brute_force(spark, empty):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("aeioubcdlmnrst#") for _ in range(rng.randrange(2, 9)))
    rows = [(i, "\n".join(" ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(rng.randrange(1, 6))), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", None]), 0) for i in range(150)]
    rows += [(200, "$ " * 30 + "a b c d e f g h i j k l m", "en", "a", 0), (201, "x" * 4000 + " a" * 12, "fr", "z", 0)]
    judged = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, empty.schema)).collect()}
    vectors = quality.statistics(spark.createDataFrame(rows, empty.schema)).select("doc_id", "lang", "source", *quality.vector()).collect()
    fit = [(r.doc_id, r.lang, r.source, np.array(r[3:]) / quality.SCALE) for r in vectors if not judged[r.doc_id].base_failed]
    expected = brute_distances(fit)
    assert len(expected) > 100 and {k: judged[k].distance for k in expected} == pytest.approx(expected, rel=1e-6)
    assert all(judged[k].kept == (d <= quality.CUTOFF) for k, d in expected.items()) and not judged[200].kept


def test_good_keeps_clashing_columns(spark, documents, empty):
    clash = ("n_words", "kept", "group", "row", "levels", "x0", "m0", "distance", "base_failed", "bin")
    rows = documents.select("*", *[F.lit(f"own {c}").alias(c) for c in clash])
    got = quality.good(rows)
    assert got.columns == rows.columns and got.count() == quality.good(documents).count() > 0
    assert got.select(*clash).distinct().collect() == [tuple(f"own {c}" for c in clash)]
    assert quality.good(empty).count() == 0 and quality.judge(empty.withColumn("kept", F.lit(1))).count() == 0


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets(spark, empty):
    rng = random.Random(6)
    blob = lambda n, a="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/": "".join(rng.choice(a) for _ in range(n))
    key = blob(44)
    texts = [
        None, "", "ü😀 password = 'hunter22!' and TOKEN:short token=token:abcdefgh", "api_key=" + blob(20) + " apikey: x", "AKIA" + blob(16, "ABC123") + " AKIA" + blob(3, "ABC"),
        "x" + blob(30, "0123456789abcdef") + "😀" + blob(24, "abc") + " secret secret=abcdef", f"see {key} here", "an antidisestablishmentarianismically long word and some/path/to/a/file-name_of_words",
        "secret: " * 300 + "secret: " + "f" * 3000,
    ]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id LONG, text STRING, spans INT")
    for r in secrets.report(rows).collect():
        t = texts[r.doc_id] or ""
        base = brute_secrets(t)
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x[3] for x in base) for k in ("assign", "access", "hex"))
        added = [s for s in r.spans.split(",") if s.startswith("random")]
        assert added == ([f"random:{t.index(key)}:{t.index(key) + len(key)}"] if r.doc_id == 6 else [])
    assert secrets.report(empty).count() == 0


def brute_battery(token):
    """Encoding, z-scores and tenths of -log10 p as the definitions have them."""
    name, _, _, s2, s3, classes = next(e for e in secrets.ENCODINGS if re.search(e[1], token))
    n, codes = len(token), [ord(c) for c in token]
    pairs = sum(k * (k - 1) for k in Counter(token).values())
    uniform = (n * (n - 1) * s2 - pairs) / (2 * n * (n - 1) * (s2 + 2 * (n - 2) * s3 - (2 * n - 3) * s2 * s2)) ** 0.5
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" for c in token if c.isalnum()]
    m = max(1, len(kind) - 1)
    runs = (sum(a != b for a, b in zip(kind, kind[1:])) - m * secrets.CHANGE) / (m * secrets.CHANGE * (1 - secrets.CHANGE)) ** 0.5 if classes else None
    mean = sum(codes) / n
    spread = sum((c - mean) ** 2 for c in codes)
    r = sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:])) / spread if spread > 0.5 else None
    serial = -(n**0.5) if r is None else (-abs(r) - secrets.SERIAL) * n**0.5
    scores = [x for x in (uniform, runs, serial) if x is not None]
    z = sum(scores) / len(scores) ** 0.5
    tail = math.erfc(z / 2**0.5) / 2
    return name, uniform, runs, serial, min(400, math.floor(-10 * math.log10(max(tail, 1e-300)))) if z > 0 else 0


ALPHABETS = {"decimal": "0123456789", "hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "abcdefghijklmnopqrstuvwxyz0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}


def test_battery(spark):
    rng = random.Random(21)
    tokens = ["".join(rng.choices(a, k=n)) for a in ALPHABETS.values() for n in (20, 33, 60, 150)] + ["x" * 20, "++++////____----====", "antidisestablishmentarianism", "some/path/to/a/file-name", "getTheUserNameFromRequest2"]
    rows = spark.createDataFrame([(t,) for t in tokens], "hit STRING")
    for r in secrets.battery(rows).collect():
        name, uniform, runs, serial, tenths = brute_battery(r.hit)
        assert r.encoding == name and (r.uniform, r.serial) == pytest.approx((uniform, serial), abs=1e-6) and (r.runs == runs if runs is None else r.runs == pytest.approx(runs))
        assert abs(r.bin - tenths) <= 1 + 3 * (tenths < 10) or r.bin > 290  # the tail is an upper bound, within a few per cent


def test_names_keep_to_the_null_and_random_tokens_do_not(spark):
    rng = random.Random(22)
    syllables = ["er", "con", "tion", "ment", "al", "pre", "data", "user", "get", "list", "ing", "ly", "post", "form", "able", "sub", "re", "time", "key", "work"]
    name = lambda: "".join(s.capitalize() if rng.random() < 0.3 else s for s in rng.choices(syllables, k=9))[:40]
    names = [t for t in (name() for _ in range(600)) if len(t) >= 20]
    keys = ["".join(rng.choices(ALPHABETS["base64"], k=40)) for _ in range(60)]
    texts = [f"see {t} now" for t in names + keys]
    found = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING"))
    got = {r.doc_id for r in found.collect() if r.added}
    assert len(got & set(range(len(names)))) <= 1 and len(got - set(range(len(names)))) >= 55


def test_discoveries_are_those_of_the_step_up_procedure(spark):
    rng = random.Random(23)
    make = lambda n: "".join(rng.choices(ALPHABETS["base64"], k=n))
    tokens = [make(rng.choice([20, 24, 30, 40, 70])) for _ in range(80)] + ["".join(rng.choices("abcde", k=rng.choice([20, 40, 70]))) for _ in range(80)]
    bins = {r.hit: r.bin for r in secrets.battery(spark.createDataFrame([(t,) for t in tokens], "hit STRING")).collect()}
    expected = set()
    for band in {len(t).bit_length() for t in tokens}:
        own = sorted((t for t in tokens if len(t).bit_length() == band), key=lambda t: -bins[t])
        passing = [bins[t] for t in own if 10 ** (-bins[t] / 10) <= 0.01 * sum(bins[o] >= bins[t] for o in own) / len(own)]
        expected |= {t for t in own if passing and bins[t] >= min(passing)}
    rows = spark.createDataFrame(list(enumerate(tokens)), "doc_id LONG, text STRING")
    got = {tokens[r.doc_id] for r in secrets.scan(rows, rate=0.01).collect() if r.added}
    assert got == expected and 20 < len(got) < 120


def test_secrets_overlaps(spark):
    key = "Zk3+q9LmX2vTb7Rw0PyHs5Nd8Gf1JcUaEoKi"
    texts = [f"password={key}", f"{key} password={key}", f"x{'0a1b2c3d' * 4}{key}", f"{key} token: short"] * 2
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    got = {r.doc_id: ([x.kind for x in r.base], [x.start for x in r.added]) for r in secrets.scan(rows).collect()}
    assert [got[i] for i in range(8)] == [(["assign"], []), (["assign"], [0]), (["hex"], []), ([], [0])] * 2


@pytest.mark.parametrize("wide", [False, True])
def test_zip_packages(wide):
    members = [("a/b", b"hello" * 100), ("empty", b""), ("ü", bytes(range(256)))]
    package = warc.ZipPackage(warc.Bytes(warc.zip_bytes(members, wide)))
    assert {n: package.read(n) for n in package.members} == dict(members)
    assert list(package.ranges("ü", [(0, 10), (10, 5), (200, 56)])) == [members[2][1][:10], members[2][1][10:15], members[2][1][200:]]
    with pytest.raises(ValueError):
        warc.ZipPackage(warc.Bytes(b"no archive"))


def test_zip_packages_as_other_tools_read_them():
    import io
    import zipfile

    for wide in (False, True):
        with zipfile.ZipFile(io.BytesIO(warc.zip_bytes([("a", b"x" * 50), ("b", b"y")], wide))) as z:
            assert z.testzip() is None and z.read("a") == b"x" * 50 and z.read("b") == b"y"


def test_warc(spark):
    long = "x" * 100
    rows = [(5, "http://a/ü\r\nb", long, 0), (3, None, long, 0), (9, "http://c", "short", 0), (8, "http://c", "short", 0), (1, "u", None, 0), (2, "u", "é" * 60_000, 0), (None, "u", long, 0), (3, None, long, 0)]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING, digest INT")
    got = Counter(tuple(r) for r in warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    expected = Counter()
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        revisit = html == long and page_id != 3
        expected[(page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None)] += 1
    assert got == expected
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_packages_roll_over(spark, tmp_path):
    pages = spark.range(200).selectExpr("id AS page_id", "'u' AS url", "cast(repeat(md5(cast(id as string)), 40) AS binary) AS payload").coalesce(1)
    ready = pages.selectExpr("*", "sha2(payload, 256) AS digest", "cast(null AS long) AS refers_to", "false AS revisit")
    packages = warc.write(ready, f"file://{tmp_path}", zip64=True, package_bytes=5000).cache()
    assert packages.count() > 3
    back = {r.page_id: bytes(r.payload) for r in warc.read(packages, f"file://{tmp_path}").collect()}
    assert back == {r.page_id: bytes(r.payload) for r in pages.collect()}


def test_pipeline(spark, documents, tmp_path):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "abcdefghij" for b in ("lo", "mi", "sta", "ne", "ru")]
    clean = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40, 200))), "en", rng.choice("ab"), 0) for i in range(80)]
    item = " ".join(rng.choice(words) for _ in range(20))
    rows = clean + [(500, clean[3][1] + " tail", "en", "a", 0), (501, "few words", "en", "a", 0), (502, item, "en", "b", 0)]
    spark.createDataFrame(rows, documents.schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id LONG, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        assert i == 4 or out.columns == docs.columns
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    everyone = set(range(80))
    assert ids[0] == everyone | {500, 502} and ids[1] == everyone | {502} and ids[2] == everyone
    assert ids[3] <= everyone and ids[4] == ids[3]
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in again.collect()) == sorted(r.doc_id for r in docs.collect())


def test_pipeline_edges(spark, documents, empty, tmp_path):
    item = " ".join(f"b{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id LONG, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    rng = random.Random(51)
    word = lambda: "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randrange(2, 9)))
    texts = [" ".join(word() for _ in range(rng.randrange(20, 200))) for _ in range(40)]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["a", None]), 0) for i, t in enumerate(texts)] + [(90, None, "en", "a", 0), (91, "", None, None, 0), (3, texts[3], "en", "a", 0), (92, "long " + "x" * 200_000, "en", "a", 0)]
    clash = ("n_words", "kept", "node", "mark", "label", "__row", "__copy", "shard", "shard_", "group", "size", "taken", "items")
    docs = spark.createDataFrame(rows, documents.schema).select("*", *[F.lit(c).alias(c) for c in clash])
    for source in (docs, docs.limit(0)):
        held = source
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, held, str(tmp_path))
            path = f"{tmp_path}/{name}-{source is docs}"
            out.write.parquet(path)
            if name != "sharding":
                assert out.columns == docs.columns
                held = spark.read.schema(out.schema).parquet(path)
                assert all(tuple(r) == clash for r in held.select(*clash).distinct().collect())
        assert (spark.read.parquet(path).count() > 20) == (source is docs)


def test_pipeline_resumes_and_keeps_its_product(spark, documents, tmp_path, monkeypatch):
    rng = random.Random(52)
    word = lambda: "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randrange(2, 9)))
    rows = [(i, " ".join(word() for _ in range(60)), "en", "a", 0) for i in range(30)]
    spark.createDataFrame(rows, documents.schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "none of these")], "item_id LONG, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    output, real = f"file://{tmp_path}/product", list(corpus_pipeline.STAGES)
    spark.conf.set(corpus_pipeline.OUTPUT, output)
    try:
        ran = []

        def counted(name, stage, broken=False):
            def run(*args):
                if broken:
                    raise RuntimeError("lost")
                ran.append(name)
                return stage(*args)

            return name, run

        monkeypatch.setattr(corpus_pipeline, "STAGES", [counted(n, f, n == "decontamination") for n, f in real])
        with pytest.raises(RuntimeError):
            corpus_pipeline.run(spark, str(tmp_path))
        monkeypatch.setattr(corpus_pipeline, "STAGES", [counted(n, f) for n, f in real])
        # Lost again, in the last stage: at each commit of its arrivals.
        for at in range(1, 5):
            with monkeypatch.context() as m, pytest.raises(Lost):
                losing(m, 1, "draft" if at == 1 else "before" if at == 3 else "after")
                corpus_pipeline.run(spark, str(tmp_path))
        first = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
        mixed = spark.read.parquet(f"{output}/source_mixing")
        assert [r[0] for r in first] == sorted(r.doc_id for r in mixed.select("doc_id").collect()) and len(first) > 20
        assert ran == [n for n, _ in real] + ["sharding"] * 4
        assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == first
        assert sharding.ShardStore(spark, f"{output}/shards").read().columns == documents.columns
        spark.createDataFrame(rows[:5], documents.schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        with pytest.raises(ValueError):
            corpus_pipeline.run(spark, str(tmp_path))
    finally:
        spark.conf.unset(corpus_pipeline.OUTPUT)


def test_copies_of_rows_are_mixed_as_often_as_they_are_taken(spark, empty):
    rows = [(1, "a b c d", "en", "x", 0)] * 5 + [(i, "a b c d", "en", "x", 0) for i in range(2, 12)] + [(100 + i, "a b c d e f", "en", "y", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, empty.schema)
    taken = sum(r.taken for r in mixing.mix(docs).collect() if r.source == "y")
    out = mixing.mixture(docs).collect()
    words = Counter()
    for r in out:
        words[r.source] += len(r.text.split())
    targets = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    assert abs(words["x"] - targets["x"]) <= 8 and abs(words["y"] - targets["y"]) <= 6 and abs(taken - targets["y"]) <= 1
