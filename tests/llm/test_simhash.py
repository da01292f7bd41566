"""SimHash links against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from structlens.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def least(values, ids):
    """The least id that links of at most three differing bits reach."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(values):
        for j in range(i):
            if (x ^ values[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    of = {}
    for i, n in enumerate(ids):
        if n is not None:
            of[find(i)] = min(n, of.get(find(i), n))
    return [of.get(find(i)) for i in range(len(values))]


def clusters(seed, n):
    """Numbers some of which differ by few bits, in chains and dense groups, also with bits at the ends of both halves."""
    rng = random.Random(seed)
    out = [0, 1, 3, (1 << 64) - 1, (1 << 63) | 1, 0xFFFFFFFF, 0xFFFFFFFF << 32]
    while len(out) < n:
        x = rng.getrandbits(64) if rng.random() < 0.5 else rng.choice(out)
        for _ in range(rng.choice([0, 1, 2, 3, 3, 3, 4])):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("block,pairs", [(4096, 1 << 21), (5, 40)])
def test_links_join_what_three_bits_join(spark, monkeypatch, block, pairs):
    """Also with blocks and arrays so small that cells are cut."""
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    values = clusters(block, 500)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "bits LONG"), block).collect()
    assert all(0 < ((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in found)
    place = {v: i for i, v in enumerate(signed)}
    root = list(range(len(values)))
    for a, b in found:
        x, y = root[place[a]], root[place[b]]
        root = [min(x, y) if r in (x, y) else r for r in root]
    assert root == least(values, range(len(values)))


def test_a_dense_cell_gives_a_forest(spark):
    """All pairs of 300 numbers of one cell's neighbourhood are links or nearly so; their rows grow with the numbers."""
    rng = random.Random(2)
    signed = list({sum(1 << k for k in rng.sample(range(40), 2)) for _ in range(300)})
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "bits LONG")).count()
    assert found <= 34 * len(signed)


def test_documents(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    rows += [(-5, rows[9][1]), (rows[9][0], rows[9][1]), (None, rows[9][1]), (None, "only one " * 9), (7000, ""), (7001, "A b"), (7002, "a\tB")]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING").withColumn("bits", F.lit(1)).withColumn("label", F.lit("x"))
    values = [brute(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], [f"{v:016x}" for v in values], least(values, [i for i, _ in rows]), strict=True), key=str)
    assert sorted((tuple(r) for r in simhash.components(df).collect()), key=str) == want


def test_long_texts_and_empty_tables(spark, empty, monkeypatch):
    rng = random.Random(3)
    text = " ".join(rng.choice(["ab", "Éa", "x"]) for _ in range(5000))
    assert simhash.fingerprint(text) == brute(text)
    monkeypatch.setattr(simhash, "SHINGLES", 7)
    assert simhash.fingerprint(text) == brute(text) and simhash.fingerprint("a b") == brute("a b") and simhash.fingerprint(None) == 0
    assert simhash.components(empty).count() == 0
