"""Decontamination, substring dedup, near-duplicates and line dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from structlens.llm import _buckets, _graph, _hashing, _link, decontaminate, lines, minhash, substring
from structlens.llm._graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def least(links, nodes):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_hashes_of_equal_runs_are_equal():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bb", "c" * 70]) for _ in range(rng.randrange(40))).encode() for _ in range(20)] + [b"", b" x "]
    starts, (h,) = _hashing.words(texts)
    flat = [w for t in texts for w in t.split()]
    assert list(np.diff(starts)) == [len(t.split()) for t in texts]
    for n in (1, 2, 5, 10, 20):
        seen = {}
        for i, x in enumerate(_hashing.rolling(h, n)):
            assert seen.setdefault(tuple(flat[i : i + n]), x) == x
        assert len(set(seen.values())) == len(seen)


def brute_hits(docs, items, size=13):
    out = {}
    windows = []
    for item, text in items:
        w = BENCH_WORD.findall(lower(text))
        if w:
            windows += [(item, w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    for doc, text in docs:
        w = BENCH_WORD.findall(lower(text))
        hit, found = set(), set()
        for item, x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    if item is not None:
                        found.add(str(item))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("blocks", [1 << 20, 1])
def test_decontamination(spark, documents, monkeypatch, blocks):
    """Also with a filter of one block, which lets all pass."""
    monkeypatch.setattr(decontaminate, "MOST_BLOCKS", blocks)
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    rng = random.Random(2)
    long = [t for _, t in docs if t and len(t.split()) > 40]
    items = [(i, " ".join(t.split()[k : k + n])) for i, (t, k, n) in enumerate((rng.choice(long), rng.randrange(5), rng.choice([1, 6, 13, 25])) for _ in range(12))]
    items += [(90, None), (91, ""), (92, "--- !!"), (7, items[0][1]), (None, items[1][1])]
    benchmark = spark.createDataFrame(items, "item_id LONG, text STRING")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.judge(documents, benchmark).collect()}
    assert got == brute_hits(docs, items)
    kept = {r.doc_id for r in decontaminate.clean(documents, benchmark).collect()}
    assert kept == {d for d, x in got.items() if not x[4]}


def test_decontamination_of_repeated_rows_and_null_ids(spark):
    item = " ".join(f"b{i}" for i in range(15))
    rows = [(1, item + " tail", "k"), (1, item + " tail", "k"), (None, "x " + item, "k"), (2, "B0, b1! b2", "k"), (3, "b0 b1", "k"), (4, None, "k"), (5, item * 2, "k")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, mark STRING")
    benchmark = spark.createDataFrame([(7, item), (8, "b0 b1 b2"), (9, "b0"), (10, "b0 zz")], "item_id LONG, text STRING")
    got = sorted(((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in decontaminate.judge(docs, benchmark).collect()))
    expected = brute_hits([(d, t) for d, t, _ in rows], [(7, item), (8, "b0 b1 b2"), (9, "b0"), (10, "b0 zz")])
    assert got == sorted((d or 0, *expected[d][:3]) for d, _, _ in rows)
    left = decontaminate.clean(docs, benchmark)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [4]


@pytest.mark.parametrize("most", [4096, 3])
def test_common_items_and_shared_windows(spark, monkeypatch, most):
    """One-word items that every document has many times, items that share a window, very long items; also with parts so
    small that codes and places are cut. A one-word item's places are one row a document, without words around."""
    monkeypatch.setattr(decontaminate, "LEAST_PART", most)
    rng = random.Random(83)
    words = ["the", "of", "a", *[f"w{i}" for i in range(50)]]
    docs = [(i, " ".join(rng.choices(words, weights=[30, 20, 10, *[1] * 50], k=rng.randrange(5, 120)))) for i in range(120)]
    shared = " ".join(f"s{i}" for i in range(13))
    docs += [(500 + i, f"the {shared} of") for i in range(5)]
    items = [(1, "the"), (2, "of the"), (3, "The"), (4, "the of a the of"), (5, docs[3][1] + " more " * 3000), (6, " ".join(docs[7][1].split()[:6]))]
    items += [(100 + i, f"{shared} t{i}") for i in range(300)]
    benchmark = spark.createDataFrame(items, "item_id LONG, text STRING")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.judge(spark.createDataFrame(docs, "doc_id LONG, text STRING").repartition(3), benchmark).collect()}
    assert got == brute_hits(docs, items) and got[500][2] == 302
    if most > 5:
        plain = decontaminate._plain(spark.createDataFrame(docs, "doc_id LONG, text STRING"))
        one = decontaminate.windows(benchmark.where("item_id = 1")).withColumn("window", F.lit(0).cast("long"))
        prefixes = decontaminate._prefixes(one, plain, [1]).cache()
        sent = decontaminate._positions(plain, prefixes, [1], 12, {}).where("code is not null")
        assert sent.where("whole").count() == sent.count() == sum("the" in t.split() for _, t in docs)


def test_decontamination_without_rows(spark, documents, empty):
    none = spark.createDataFrame([], "item_id LONG, text STRING")
    assert decontaminate.judge(documents, none).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.judge(empty, none).count() == 0


def brute_substring(rows):
    first, out = {}, {}
    texts = sorted({(d, t or "") for d, t in rows})
    for d, t in texts:
        w = WORD.findall(t)
        for i in range(len(w) - 19):
            first.setdefault(tuple(w[i : i + 20]), (d, i))
    for d, t in texts:
        w = WORD.findall(t)
        gone = set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] != (d, i):
                gone |= set(range(i, i + 20))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_substring_dedup(spark, documents):
    extra = spark.createDataFrame([(9001, "z " * 70), (9000, " ".join(f"q{i % 23}" for i in range(90)))], "doc_id LONG, text STRING")
    rows = documents.select("doc_id", "text").unionByName(extra)
    rows = rows.unionByName(rows.where("doc_id = 9000"))
    got = substring.dedup(rows, digest_only=True).collect()
    assert len(got) == rows.count()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute_substring([tuple(r) for r in rows.collect()])
    assert any(r.n_removed for r in got)


def test_substring_dedup_edges(spark, empty):
    assert substring.dedup(empty).count() == 0
    passage = " ".join(f"p{i}" for i in range(40))
    rows = spark.createDataFrame([(None, passage, 1), (4, passage, 2)], "doc_id LONG, text STRING, kept INT")
    got = {r.doc_id: r.n_removed for r in substring.dedup(rows).collect()}
    assert got == {None: 40, 4: 0}


def brute_near(rows, size, percent=80):
    sets = {}
    for d, t in rows:
        w = WORD.findall(lower(t))
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label = least(links, ids)
    return {d: (len(sets[d]), label[d], label[d] == d) for d in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(documents, size):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.components(documents, shingle=size).collect()}
    assert got == brute_near(rows, size)
    assert sum(not x[2] for x in got.values()) > 3


def family(rng, n, edits):
    """Texts that come from one by replacing words, some of them too many to be like the others."""
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(*edits)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("rows_a_block", [3, 20])
def test_blocks_lose_no_link(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(_link, "BLOCK_ROWS", rows_a_block)
    rng = random.Random(41)
    texts = family(rng, 70, (0, 14)) + family(rng, 30, (4, 9)) + family(rng, 30, (0, 3))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.components(docs, shingle=2).collect()}
    expected = brute_near(rows, 2)
    assert got == expected and 5 < sum(x[2] for x in got.values()) < 100
    found = {r.doc_id: (r.n_lines, list(r.removed)) for r in lines.decisions(docs).collect()}
    assert found == brute_lines(rows) and any(x[1] for x in found.values())


def test_packed_buckets(spark, monkeypatch):
    rng = random.Random(42)
    nodes = [(hashlib.md5(str(i % 90).encode()).digest(), i % 90 * 100, rng.sample(range(60), 3) if i < 90 else None) for i in range(120)]
    nodes = [(n, b, k or nodes[i % 90][2]) for i, (n, b, k) in enumerate(nodes)] + [(hashlib.md5(f"hot{i}".encode()).digest(), 10, [7, 1000 + i, 2000 + i]) for i in range(300)]
    spread = lambda k: (k * 0x9E3779B97F4A7C15) % (1 << 64)
    rows = [(n, b, np.array([spread(x) for x in k], np.uint64).tobytes()) for n, b, k in nodes]
    by_key = {}
    for n, _, k in nodes:
        for x in k:
            by_key.setdefault(spread(x), set()).add(n)
    for part, chunk in ((1 << 30, 1 << 20), (2000, 50)):
        monkeypatch.setattr(_buckets, "PART_BYTES", part)
        monkeypatch.setattr(_buckets, "CHUNK", chunk)
        got = _buckets.shared(spark.createDataFrame(rows, "node BINARY, bytes LONG, bands BINARY").repartition(4), 3).collect()
        assert len({(r.bucket, bytes(r.node)) for r in got}) == len(got) and len({(r.bucket, bytes(r.a)) for r in got}) == len({r.bucket for r in got})
        found = {}
        for r in got:
            found.setdefault(r.bucket % (1 << 64), set()).update((bytes(r.a), bytes(r.node)))
        assert found == {k: v for k, v in by_key.items() if len(v) > 1}
    assert _buckets.shared(spark.createDataFrame([], "node BINARY, bytes LONG, bands BINARY"), 3).count() == 0


def test_near_duplicates_edges(spark, empty):
    assert minhash.components(empty).count() == 0
    rows = spark.createDataFrame([(5, "a b c", 1), (5, "a b c", 1), (None, "a b c", 2), (9, None, 3), (2, "A B C", 0)], "doc_id LONG, text STRING, kept INT")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in minhash.components(rows).collect())
    assert got == [(0, 2, False), (2, 2, True), (5, 2, False), (5, 2, False), (9, 9, True)]
    left = sorted(r.doc_id for r in minhash.one_each(rows).collect())
    assert left == [2, 9]


def test_signatures_of_similar_lines_meet():
    rng = random.Random(43)
    pairs = []
    for _ in range(2000):
        size = rng.choice([12, 30, 80, 300])
        a = "".join(rng.choices("abcdefgh ", k=size))
        b = list(a)
        for _ in range(max(1, size // 150)):
            b[rng.choice([0, 1, size - 1, size - 2, rng.randrange(size)])] = "Z"
        pairs.append((a, "".join(b)))
    x, y = (lines.signatures([p[i].encode() for p in pairs]) for i in (0, 1))
    sets = [[{t[i : i + 9] for i in range(max(1, len(t) - 8))} for t in p] for p in pairs]
    like = [100 * len(a & b) >= 80 * len(a | b) for a, b in sets]
    met = (x == y).any(axis=1)
    assert sum(like) > 300 and sum(m for m, s in zip(met, like) if s) >= 0.999 * sum(like)
    assert x.shape == (2000, lines.BANDS) and (lines.signatures([p[0].encode() for p in reversed(pairs)])[::-1] == x).all()
    assert lines.signatures([b"", b"a", "ü".encode()]).shape == (3, lines.BANDS)


def test_estimates_are_near_the_similarity():
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    b = np.unique(np.concatenate((a[:900], rng.integers(0, 1 << 63, 100, dtype=np.uint64))))
    x, y = minhash.minima(a), minhash.minima(b)
    assert abs((x == y).mean() - 900 / 1100) < 0.1
    assert (minhash.bands(x) == minhash.bands(x)).all() and (minhash.bands(x) == minhash.bands(y)).any()
    assert len(minhash.planes(x)) == minhash.BITS * 5


def brute_lines(rows, percent=80):
    def shingles(line):
        return {line[i : i + 9] for i in range(max(1, len(line) - 8))}

    every = sorted((d, i, line) for d, t in rows for i, line in enumerate((t or "").split("\n")) if WORD.search(line))
    distinct = sorted({x[2] for x in every})
    sets = {x: shingles(x) for x in distinct}
    links = [(a, b) for a in distinct for b in distinct if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label = least(links, distinct)
    seen, gone = set(), {}
    for d, i, line in every:
        if label[line] in seen:
            gone.setdefault(d, []).append(i)
        seen.add(label[line])
    counts = Counter(d for d, _, _ in every)
    return {d: (counts[d], sorted(gone.get(d, []))) for d, _ in rows}


def test_line_dedup(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: (r.n_lines, list(r.removed)) for r in lines.decisions(documents).collect()}
    assert got == brute_lines(rows)
    left = {r.doc_id: r.text for r in lines.dedup(documents).collect()}
    for d, t in rows:
        expected = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in got[d][1])
        assert left[d] == expected


def test_line_dedup_edges(spark, empty):
    assert lines.decisions(empty).count() == 0
    rows = spark.createDataFrame([(1, "a\nb\na", "x"), (None, "a", "y"), (1, "a\nb\na", "z")], "doc_id LONG, text STRING, line STRING")
    got = sorted((r.doc_id or 0, r.n_lines, list(r.removed)) for r in lines.decisions(rows).collect())
    assert got == [(0, 1, [0]), (1, 3, [2]), (1, 3, [2])]


@pytest.mark.parametrize("chunk", [1 << 20, 25])
def test_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(_graph, "CHUNK", chunk)
    rng = random.Random(8)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    nodes = {x for p in links if p[0] != p[1] for x in p}
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a LONG, b LONG")).df.collect()}
    assert got == {n: v for n, v in least(links, {x for p in links for x in p}).items() if n in nodes}
    assert components(spark.createDataFrame([], "a BINARY, b BINARY")).df.count() == 0


def exact_pairs(sets, percent):
    """All pairs of sets with at least this similarity, from an index of every element."""
    index, pairs = {}, set()
    for i, s in enumerate(sets):
        met = Counter()
        for x in s:
            met.update(index.setdefault(x, []))
            index[x].append(i)
        pairs |= {(j, i) for j, n in met.items() if 100 * n >= percent * (len(s) + len(sets[j]) - n)}
    return pairs


def test_recall_of_near_copies(spark):
    """Every pair of five-word shingle sets of 0.8 or more is in one component, and of copies with so many changed words
    those are found whose similarity reaches it."""
    rng = random.Random(81)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    words = [f"w{i}" for i in range(2000)]
    for changes in range(1, 7):
        for _ in range(60):
            base = [rng.choice(words) for _ in range(rng.randrange(60, 400))]
            near = list(base)
            for at in rng.sample(range(len(base)), changes):
                near[at] = rng.choice(words)
            docs += [(10_000 + len(docs), " ".join(base)), (10_001 + len(docs), " ".join(near))]
    texts = [WORD.findall(lower(t)) for _, t in docs]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in texts]
    pairs = exact_pairs(sets, 80)
    got = {r.doc_id: r.component_id for r in minhash.components(spark.createDataFrame(docs, "doc_id LONG, text STRING")).collect()}
    found = sum(got[docs[i][0]] == got[docs[j][0]] for i, j in pairs)
    assert len(pairs) > 250 and found == len(pairs)
    assert [got[d] for d, _ in docs] == [docs[k][0] for k in (lambda label: [label[i] for i in range(len(docs))])(least(pairs, range(len(docs))))]
