"""Line dedup makes no rows of pairs that are no links, and hashes of shingles don't depend on the rest of a line."""

import random

from pyspark.sql import functions as F

from structlens.llm import lines


def edited(line, places, rng):
    for at in places:
        line = line[:at] + rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") + line[at + 1 :]
    return line


def whole(line):
    return {line[i : i + lines.SHINGLE] for i in range(len(line) - lines.SHINGLE + 1)}


def test_pairs_just_below_the_similarity_become_no_rows(spark, monkeypatch):
    rng = random.Random(71)
    base = "".join(rng.choices("abcdefghijkl ", k=300))
    # Two places of each line: of any two lines, 256 or somewhat more of 328 shingles are shared.
    places = [(20 + 2 * i % 110, 150 + (2 * i + 3 * (i // 55)) % 130) for i in range(120)]
    texts = [edited(base, p, rng) for p in places]
    texts.append(edited(texts[7], [290], rng))
    sets = [whole(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    up = list(range(len(texts)))
    for i, j in pairs:
        a, b = max(up[i], up[j]), min(up[i], up[j])
        up = [b if x == a else x for x in up]
    sizes = []

    class Counted(lines.Stored):
        def __init__(self, df, name):
            super().__init__(df, name)
            sizes.append((self.df.count(), name))

    monkeypatch.setattr(lines, "Stored", Counted)
    found = lines.decisions(spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")).collect()
    assert {r.doc_id: bool(list(r.removed)) for r in found} == {i: x != i for i, x in enumerate(up)}
    assert max(sizes)[0] <= lines.BANDS * len(texts) + len(pairs), sorted(sizes)[-3:]


def test_shingles_of_wide_and_narrow_lines_are_equal(spark):
    narrow = "Größe und Maß: çà et là, ÿ" * 3
    texts = [narrow, narrow[:40] + "漢" + narrow[41:], narrow[:20] + "😀" + narrow[20:], "é" * 4, "漢é"]
    rows = spark.createDataFrame([(t,) for t in texts], "line STRING").select("line", lines.shingle_hashes(F.col("line")).alias("all"))
    got = {r.line: set(r.all) for r in rows.collect()}
    for a in texts[:3]:
        for b in texts[:3]:
            assert len(got[a] & got[b]) == len(whole(a) & whole(b))
    assert len(got["é" * 4] & got["漢é"]) == 0 and len(got["漢é"]) == 1
