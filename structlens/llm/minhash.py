"""Near-duplicate documents by b-bit MinHash.

Every text becomes the set of its word shingles; documents with equal sets are one node from then on. Bands of minima
propose candidates. Of the minima only the low BITS bits are kept, packed in bit planes; counts of equal bits, corrected
for chance collisions, estimate the similarity of a candidate, and those that may reach the threshold are confirmed on
the full sets. With 52 bands of 5, a pair at exactly 0.8 shares no band with probability 1e-9.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _hashing
from ._common import Stored, packs
from ._link import Measure, link
from .substring import LAST

SHINGLE, PERCENT = 5, 80
BANDS, ROWS, BITS = 52, 5, 2
#: Standard deviations below the threshold at which an estimate rejects a candidate.
MARGIN = 5
PACK_BYTES = 1 << 20
_RANDOM = np.random.default_rng(7)
_TIMES = _RANDOM.integers(0, 1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64)
_BAND = _RANDOM.integers(0, 1 << 63, size=(BANDS, 1), dtype=np.uint64)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of `size` words of each text, A-Z lower-cased; of a shorter text,
    its whole word sequence; empty without words."""
    starts, (h,) = _hashing.words([t.lower() for t in texts])
    run = _hashing.rolling(h, size)
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(run[a : b - size + 1]))
        elif b > a:
            whole = _hashing.rolling(h[a:b], int(b - a)) ^ np.uint64(b - a)
            out.append(whole)
        else:
            out.append(h[:0])
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the BANDS * ROWS hash functions."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[i : i + 2048] * _TIMES + _PLUS).min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for the minima of each band."""
    key = _BAND[:, 0].copy()
    for column in least.reshape(BANDS, ROWS).T:
        key = _hashing.join(key, column)
    return key.view(np.int64)


def planes(least: np.ndarray) -> np.ndarray:
    """Bits 32 and up of the minima, as BITS planes of 64-bit numbers: low bits of these hashes are less random."""
    bits = [np.packbits(((least >> np.uint64(32 + b)) & np.uint64(1)).astype(np.uint8)) for b in range(BITS)]
    lanes = -(-BANDS * ROWS // 64)
    return np.concatenate([np.pad(b, (0, lanes * 8 - len(b))) for b in bits]).view(np.int64)


def node_of(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, mark, n, node, planes, bands) of (text, doc_id, mark); node, planes and bands are null without words."""

    def run(batches):
        for rows in packs(batches, PACK_BYTES, "text", "doc_id", "mark"):
            sets = shingle_sets([r[0] for r in rows], shingle)
            out = []
            for (_, doc_id, mark), s in zip(rows, sets, strict=True):
                if len(s):
                    least = minima(s)
                    out.append((doc_id, mark, len(s), node_of(s), planes(least), bands(least).tobytes()))
                else:
                    out.append((doc_id, mark, 0, None, None, None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "mark", "n", "node", "planes", "bands"])

    return docs.select("text", "doc_id", "mark").mapInArrow(run, "doc_id long, mark long, n long, node binary, planes array<long>, bands binary")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two arrays of planes: the share of equal minima, less what chance makes equal."""
    lanes = -(-BANDS * ROWS // 64)
    differ = [reduce(Column.bitwiseOR, [F.get(a, F.lit(p * lanes + i)).bitwiseXOR(F.get(b, F.lit(p * lanes + i))) for p in range(BITS)]) for i in range(lanes)]
    unequal = reduce(Column.__add__, [F.bit_count(x) for x in differ])
    chance = 0.5**BITS
    return (1 - unequal / (BANDS * ROWS) - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    chance, j = 0.5**BITS, percent / 100
    equal = j + (1 - j) * chance
    return j - MARGIN * (equal * (1 - equal) / (BANDS * ROWS)) ** 0.5 / (1 - chance)


def likely(sketch: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sketches in others allow the threshold, by the same estimate."""
    a, b, lanes = sketch.view(np.uint64), others.view(np.uint64), -(-BANDS * ROWS // 64)
    differ = np.bitwise_or.reduce([a[p * lanes : (p + 1) * lanes] ^ b[:, p * lanes : (p + 1) * lanes] for p in range(BITS)])
    chance = 0.5**BITS
    return (1 - np.bitwise_count(differ).sum(axis=1) / (BANDS * ROWS) - chance) / (1 - chance) >= least_estimate(percent)


def full_sets(docs: DataFrame, where: DataFrame, shingle: int) -> DataFrame:
    """(node, data): the shingle sets of the documents in where (node, doc_id, mark), one of each node, as bytes."""
    found = docs.join(where, ["doc_id", "mark"]).groupBy("doc_id", "mark", "node").agg(F.min("text").alias("text"))

    def run(batches):
        for rows in packs(batches, PACK_BYTES, "text", "node"):
            data = [s.tobytes() for s in shingle_sets([r[0] for r in rows], shingle)]
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.binary()), pa.array(data, pa.binary())], ["node", "data"])

    return found.select("text", "node").mapInArrow(run, "node binary, data binary")


def components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id, kept) for each row of docs (doc_id, text); mark is a hash of the text.

    component_id is the smallest doc_id reachable over links, pairs of documents whose sets have a similarity of
    percent or more; kept is doc_id = component_id. Null, empty and wordless texts have empty sets and are linked with
    nothing. A null doc_id is larger than any other and is kept only if it is alone with others like it. Repeated
    rows are linked like any equal texts. No rows give no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("text"))
    held = Stored(sketches(source, shingle), "sketches")
    full = held.df.where("n > 0")
    nodes = Stored(
        full.groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("at"), F.max("n").alias("n"), F.min_by(F.struct("planes", "bands"), F.struct("doc_id", "mark")).alias("s")).select("node", "at.doc_id", "at.mark", "n", "s.planes", "s.bands"),
        "nodes",
    )
    facts = nodes.df.select("node", "n", "planes")

    def screen(pairs: DataFrame) -> DataFrame:
        a, b = (facts.select(*[F.col(c).alias(f"{side}_{c}") for c in facts.columns]) for side in "ab")
        both = pairs.join(a, F.col("a") == F.col("a_node")).join(b, F.col("b") == F.col("b_node"))
        fits = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent
        return both.where(fits & (estimate(F.col("a_planes"), F.col("b_planes")) >= least_estimate(percent))).select("a", "b", "bytes")

    measure = Measure(lambda data: [np.frombuffer(x, np.uint64) for x in data], percent, lambda a, b: likely(a, b, percent))
    labels = link(
        nodes.df.select("node", (F.col("n") * 8).alias("bytes"), "bands"),
        BANDS,
        lambda wanted: full_sets(source, nodes.df.select("node", "doc_id", "mark").join(wanted, "node"), shingle),
        measure,
        nodes.df.select("node", F.col("planes").alias("sketch")),
        screen,
    )
    placed = nodes.df.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    firsts = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    known = Stored(placed.join(firsts, "label").select("node", "component_id"), "components")
    named = full.join(known.df, "node").select("doc_id", "mark", "n", "component_id")
    alone = held.df.where("n = 0").select("doc_id", "mark", "n", F.col("doc_id").alias("component_id"))
    out = named.unionByName(alone)
    null = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    return out.select(null("doc_id"), "mark", F.col("n").alias("n_shingles"), null("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def one_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs but near-duplicates of others: of each component the document with the smallest id stays."""
    gone = components(docs, shingle, percent).where("not kept").select(F.coalesce("doc_id", F.lit(LAST)).alias("__id"), F.col("mark").alias("__mark"))
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) == F.col("__id")) & (mark == F.col("__mark"))
    return docs.join(gone, same, "left_anti")
