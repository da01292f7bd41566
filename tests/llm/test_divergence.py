"""Divergence of sources against exact sums over all terms."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from structlens.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, top=200):
    docs = [(lang or "", source or "", Counter(TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for _, _, c in mine for t in c)
        kept = [t for t, n in seen.items() if n >= 3]
        count = {s: Counter() for _, s, _ in mine}
        for _, s, c in mine:
            count[s].update({t: n for t, n in c.items() if t in set(kept)})
        whole = sum(count.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        p = {s: {t: share(c, t) for t in kept} for s, c in count.items()}
        q = {t: share(whole, t) for t in kept}
        for s in count:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in count if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(ordered, 1)}
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(200)] + ["Été", "été", "naïve", "ß", "日本", "a", "A"]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "a", "b", "ü", "z", None, ""])
        some = rng.sample(words, 40) if rng.random() < 0.5 else words
        rows.append((rng.choice([None, "", "12 ..."]) if rng.random() < 0.1 else rng.choice([" ", "-", "3"]).join(rng.choice(some) for _ in range(rng.randrange(80))), lang, source))
    return rows + [(None, "no", "x"), ("one two", "only", "x"), ("one two", "only", "x"), ("one two", "only", "x"), ("y" * 100_000, "en", "a")] + rows[:3]


def result(spark, rows):
    df = spark.createDataFrame(rows, "text STRING, lang STRING, source STRING").repartition(3)
    for clash in ("term", "count", "value", "n", "v", "base"):
        df = df.withColumn(clash, F.lit("x"))
    out = [tuple(r) for r in divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_whole_audit(spark, monkeypatch):
    rows = corpus(1, 120)
    assert result(spark, rows) == brute(rows)
    monkeypatch.setattr(divergence, "HELD", 10)
    assert result(spark, []) == set()
    assert result(spark, [(None, None, None)]) == brute([(None, None, None)]) == set()
    rows = [("tokens in many places", "en", s) for s in "abc"] + [("", "en", "d"), ("x", "fr", "a"), ("x", "fr", "b")]
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("top,settled,bits", [(5, 0, 2), (20, 3, 4), (200, 1000, 12)])
def test_selection_by_radix(spark, monkeypatch, top, settled, bits):
    """Heavy tails, many equal values, terms with long common beginnings, groups smaller than what is wanted."""
    monkeypatch.setattr(divergence, "BITS", bits)
    rng = random.Random(top)
    rows = [("l", "ties", t, 7) for t in {f"{'p' * rng.choice([3, 60])}{rng.choice('aéz')}{rng.randrange(400)}" for _ in range(500)}]
    rows += [("l", "tail", f"t{i}", int(2 ** (rng.random() * 60))) for i in range(1500)]
    rows += [("l", "zero", f"t{i}", rng.choice([0, 0, 0, 1])) for i in range(300)] + [("l", "few", f"t{i}", i % 2) for i in range(4)]
    rows += [("l", "prefixes", "q" * i, 3) for i in range(1, 300)] + [("l", "all", f"t{i}", (1 << 62) - i % 3) for i in range(300)]
    got = divergence.highest(spark.createDataFrame(rows, "lang STRING, source STRING, term STRING, value LONG"), top, settled).collect()
    want = []
    for source in {r[1] for r in rows}:
        ordered = sorted((r for r in rows if r[1] == source), key=lambda r: (-r[3], r[2].encode()))[:top]
        want += [(*r, i) for i, r in enumerate(ordered, 1)]
    assert sorted((r["lang"], r["source"], r["term"], r["value"], r["rank"]) for r in got) == sorted(want)


def test_counts_travel_in_packs():
    """A batch makes a row for each part of the hashes at most, not for each term of a group; packs hold every count."""
    rows = [(t or "", lang or "", source or "") for t, lang, source in corpus(3, 60)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in (1, 2, 0)], ["lang", "source", "text"])
    packs = divergence._packs(batch, [10, 20, 30, 40])
    assert packs.column("part").to_pylist() == [10, 20, 30, 40]
    tables = [pa.ipc.read_record_batch(d.as_buffer(), divergence._PACK) for d in packs.column("data")]
    places = [{(r["lang"], r["term"]) for r in t.to_pylist()} for t in tables]
    assert sum(map(len, places)) == len(set().union(*places))
    want, documents = Counter(), Counter()
    for text, lang, source in rows:
        words = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        want.update((lang, source, w) for w in words)
        documents.update((lang, source, w) for w in set(words))
    got = [(r["lang"], r["source"], r["term"], r["count"], r["documents"]) for t in tables for r in t.to_pylist()]
    assert sorted(got) == sorted((*k, n, documents[k]) for k, n in want.items())


def test_packs_of_all_sizes_add_up(spark, monkeypatch):
    rows = corpus(4, 80)
    for held, documents, added in ((1, 1, 1), (500, 3, 7), (1 << 20, 1 << 14, 50)):
        for name, value in (("HELD", held), ("DOCUMENTS", documents), ("ADDED", added)):
            monkeypatch.setattr(divergence, name, value)
        assert result(spark, rows) == brute(rows)
