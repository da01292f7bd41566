"""Line dedup takes its shingles from every character of a line."""

import random

import numpy as np

from structlens.llm import lines


def whole_shingles(line):
    return {line[i : i + lines.SHINGLE] for i in range(max(1, len(line) - lines.SHINGLE + 1))}


def test_line_shingles_start_at_every_character():
    texts = ["", "short", "ninechars", "ten chars!", "no-blank-in-here", "漢字かな交じり文に空白はない", "a😀b𝒳" * 5, " two\t words \r here", "aaaaaaaaaaaaaaaaaaaaaa", "ab" * 30]
    got = lines.shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in got] == [len(whole_shingles(t)) for t in texts]
    met = lambda i, j: len(np.intersect1d(got[i], got[j]))
    assert all(met(i, j) == len(whole_shingles(a) & whole_shingles(b)) for i, a in enumerate(texts) for j, b in enumerate(texts))


def test_line_dedup_keeps_lines_without_blanks_that_differ(spark):
    rng = random.Random(12)
    make = lambda head, k: head + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=k))
    texts = [f"2024-01-1{i}T0{i}:1{i}:5{i}Z" for i in range(5)] + [make("https://w", 30) for _ in range(5)] + [make("", 120) for _ in range(8)]
    texts += [t[:60] + "#" + t[61:] for t in texts[-8:]] + ["日本語の文章は空白なしで書かれる。これは一つ目", "日本語の文章は空白なしで書く。別の内容の行です"]
    found = lines.decisions(spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")).collect()
    sets = [whole_shingles(t) for t in texts]
    similar = [any(100 * len(a & b) >= 80 * len(a | b) for b in sets[:i]) for i, a in enumerate(sets)]
    assert sum(similar) == 8 and {r.doc_id: bool(list(r.removed)) for r in found} == dict(enumerate(similar))
