"""Near-duplicates by 64-bit fingerprints of words: a grid join over bit counts of segments, then exact distances.

A fingerprint is embedded as the bit counts of its 32 segments of two bits. The Manhattan distance of two embeddings never
exceeds the number of differing bits, and if DISTANCE bits differ, one half of the fingerprint has at most one of them.
So the counts of each half are a cell of a grid, and a range join at Manhattan distance 1 - a fingerprint is at home in its
own cell and visits those with one count more - has every pair that can be linked, each half's cells apart. Within a cell,
only fingerprints whose bit counts of the other half are in reach are compared, by their differing bits.

No pair becomes a row: a task compares whole cells, or two blocks of a cell with many members, as arrays, and emits a
spanning forest of the links. Blocks lose no pair: every block meets every other one, in a task of its own.

Documents with equal fingerprints are one node of the graph, whatever their number, before anything is joined. A null text
is empty; texts without words have fingerprint zero and are linked like any other. Rows that repeat stay. The id of a
component is its least doc_id, null if all are. Columns besides doc_id and text are ignored; empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Stored
from ._graph import components as graph_components

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Members of a block of a cell; pairs that are compared at once; shingles whose bits are counted at once.
BLOCK, PAIRS, SHINGLES = 4096, 1 << 21, 1 << 15
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits that over half of the XXH64 hashes of a text's shingles have, repeated ones counted as often as they occur."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, last = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:last].tolist()
    ends = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    one, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, last, SHINGLES):
        hashes = [one(joined[a:b], SEED) for a, b in zip(starts[i : i + SHINGLES], ends[i : i + SHINGLES], strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, bits): the fingerprint of each document as a signed number."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "bits"])

    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {dict(docs.dtypes)['doc_id']}, bits long")


def cells(bits: Column) -> Column:
    """Array of (cell, visits): the two cells of a fingerprint, and those that have one bit more in one segment."""
    out = []
    for half in (0, 1):
        own = F.shiftrightunsigned(bits, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        counts = own - F.shiftright(own, 1).bitwiseAND(F.lit(0x55555555))
        cell = counts.bitwiseOR(F.lit(half << 32))
        out.append(F.struct(cell.alias("cell"), F.lit(False).alias("visits")))
        for k in range(16):
            free = F.shiftright(counts, 2 * k).bitwiseAND(F.lit(3)) < 2
            out.append(F.when(free, F.struct((cell + F.lit(1 << 2 * k)).alias("cell"), F.lit(True).alias("visits"))))
    return F.array_compact(F.array(*out))


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links of distinct fingerprints (bits), of each cell or pair of blocks a spanning forest."""
    met = Stored(nodes.select("bits", F.explode(cells(F.col("bits"))).alias("at")).select("bits", "at.cell", "at.visits"), "cells")
    large = met.df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("long").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    own = F.pmod(F.xxhash64("bits"), F.col("parts"))
    dealt = met.df.join(large, "cell", "left").withColumn("parts", parts).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    # Bits of the half that isn't the cell's.
    half = F.when(F.shiftright("cell", 32) == 0, F.shiftrightunsigned("bits", 32)).otherwise(F.col("bits").bitwiseAND(F.lit(0xFFFFFFFF)))
    sent = dealt.select("cell", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "visits", F.bit_count(half).cast("long").alias("rest"), "bits")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            size += len(held[-1][0])
            if size >= 1 << 16:
                whole = [np.concatenate([h[i] for h in held]) for i in range(len(names))]
                new = _begins(whole)
                last = int(np.flatnonzero(new)[-1])
                yield _batch(_links([c[:last] for c in whole], new[:last]))
                held, size = [[c[last:] for c in whole]], len(new) - last
        if size:
            whole = [np.concatenate([h[i] for h in held]) for i in range(len(names))]
            yield _batch(_links(whole, _begins(whole)))

    names = ["cell", "p", "q", "own", "visits", "rest", "bits"]
    keys = ["cell", "p", "q"]
    return sent.repartition(*keys).sortWithinPartitions(*keys, "visits", "rest").mapInArrow(meet, "a long, b long")


def _begins(columns: list[np.ndarray]) -> np.ndarray:
    """Where a new cell or pair of blocks begins."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]) | (columns[2][1:] != columns[2][:-1])
    return new


def _links(columns: list[np.ndarray], new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in whole cells; rows come by cell, those at home first, these by their rest."""
    _, p, q, own, visits, rest, bits = columns
    group = np.cumsum(new) - 1
    home = np.flatnonzero(~visits.astype(bool))
    key = group[home] * 128 + rest[home]
    low, high = (np.searchsorted(key, group * 128 + rest + d, side) for d, side in ((-DISTANCE, "left"), (DISTANCE, "right")))
    low[home] = np.maximum(low[home], np.arange(len(home)) + 1)
    # A range may reach into the neighbouring cells where the counts run out.
    first = np.searchsorted(home, np.flatnonzero(new))
    last = np.concatenate((first[1:], [len(home)]))
    low, high = np.maximum(low, first[group]), np.minimum(high, last[group])
    many = np.maximum(high - low, 0)
    root = np.arange(len(bits))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    total, begin = np.cumsum(many), 0
    while begin < len(many):
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + PAIRS, "right")))
        n = many[begin:end]
        x = np.repeat(np.arange(begin, end), n)
        y = home[np.repeat(low[begin:end], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        near = np.bitwise_count((bits[x] ^ bits[y]).view(np.uint64)) <= DISTANCE
        near &= (p[x] == q[x]) | (own[x] != own[y])
        out.append(_joining(x[near], y[near], root))
        begin = end
    if not out:
        return bits[:0], bits[:0]
    return bits[np.concatenate([o[0] for o in out])], bits[np.concatenate([o[1] for o in out])]


def _joining(x: np.ndarray, y: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those links that join components; root is brought up to date."""
    found = []
    while len(x):
        a, b = root[x], root[y]
        open_ = a != b
        x, y, a, b = x[open_], y[open_], np.maximum(a, b)[open_], np.minimum(a, b)[open_]
        if not len(x):
            break
        # Every root with a smaller neighbour moves below the least of them: no circles, and each time roots are fewer.
        order = np.lexsort((b, a))
        one = order[np.concatenate(([True], a[order][1:] != a[order][:-1]))]
        root[a[one]] = b[one]
        while not np.array_equal(up := root[root], root):
            root[:] = up
        found.append((x[one], y[one]))
    empty = np.empty(0, np.int64)
    return tuple(np.concatenate([empty, *[f[i] for f in found]]).astype(np.int64) for i in (0, 1))


def _batch(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], ["a", "b"])


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): the fingerprint in hex and the least doc_id that links reach, itself included."""
    marked = Stored(fingerprints(docs), "fingerprints").df
    nodes = Stored(marked.groupBy("bits").agg(F.min("doc_id").alias("least")), "nodes").df
    edges = Stored(links(nodes), "links")
    labels = graph_components(edges.df).df.withColumnRenamed("node", "bits")
    labelled = nodes.join(labels, "bits", "left").select("bits", "least", F.coalesce("label", "bits").alias("label"))
    heads = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = labelled.join(heads, "label").select("bits", "component_id")
    return marked.join(ids, "bits").select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
