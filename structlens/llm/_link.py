"""Links among nodes that share buckets: a star in every bucket, then block against block in buckets that it leaves open.

No pair of a bucket becomes a row. In the star, every member meets the smallest one of its bucket, so groups of copies
cost a test or two a member. A bucket whose members still span components is cut into blocks of bounded size; a task
takes two blocks with the members' full sets, passes over pairs that are settled (in one component, or met in an
earlier bucket that both share) and emits a spanning forest of the links it confirms. All other pairs are compared:
nothing is dropped for its bucket's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._buckets import shared
from ._common import Stored
from ._graph import components

#: Of a block, or of the members that meet one copy of a centre: most members and bytes, on average.
BLOCK_ROWS, BLOCK_BYTES = 800, 4 << 20
LINKS = "a binary, b binary"


@dataclass(frozen=True)
class Measure:
    """How nodes are compared: sets makes sorted distinct numbers of their data, percent is the least similarity, and
    likely tells from a sketch and an array of others which may reach it."""

    sets: Callable[[list[bytes]], list[np.ndarray]]
    percent: int
    likely: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if 100 * min(len(a), len(b)) < self.percent * max(len(a), len(b)):
            return False
        both = np.concatenate((a, b))
        both.sort()
        met = int(np.count_nonzero(both[1:] == both[:-1]))
        return 100 * met >= self.percent * (len(both) - met)


def link(
    nodes: DataFrame,
    bands: int,
    data: Callable[[DataFrame], DataFrame],
    measure: Measure,
    sketches: DataFrame | None = None,
    screen: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(node, label): the components of the links among nodes (node, bytes, bands), rows of which may repeat.

    bands holds the 64-bit keys of a node's buckets, so many each, as bytes; bytes is the size of its data. data gives (node, data) of the nodes asked
    for. sketches has (node, sketch) if the measure has likely. Given screen, it drops pairs (a, b) of the star that
    cannot be links. Nodes without links are left out.
    """
    others = Stored(shared(nodes, bands), "others")
    wanted = others.df.select("node").unionByName(others.df.select(F.col("a").alias("node"))).distinct()
    held = Stored(data(wanted), "data")
    edges = Stored(_stars(others.df, held.df, measure, screen), "links")
    labels = components(edges.df)
    more = Stored(_blocks(others.df, sketches, labels.df, held.df, measure), "links")
    if not more.df.isEmpty():
        labels.drop()
        labels = components(edges.df.unionByName(more.df))
    for x in (held, others, edges, more):
        x.drop()
    return labels.df


def _stars(others: DataFrame, held: DataFrame, measure: Measure, screen) -> DataFrame:
    """(a, b): links of members with a, the smallest member of one of their buckets."""
    pairs = others.select("a", F.col("node").alias("b"), "bytes").distinct()
    tested = Stored(screen(pairs) if screen else pairs, "tested")
    # Few centres have more members than a part takes.
    large = tested.df.groupBy("a").agg(_parts().alias("parts")).where("parts > 1")
    dealt = tested.df.join(large, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"))
    centres = dealt.select("a", "part").distinct()
    goes = dealt.select("a", "part", F.lit(1).alias("side"), F.col("b").alias("node"))
    goes = goes.unionByName(centres.select("a", "part", F.lit(0).alias("side"), F.col("a").alias("node")))
    sent = goes.join(held, "node").select("a", "part", "side", "node", "data")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            sides, centre, node, data = (batch.column(c).to_pylist() for c in ("side", "a", "node", "data"))
            found = []
            for i, s in enumerate(measure.sets(data)):
                if not sides[i]:
                    head = s
                elif measure.linked(head, s):
                    found.append((centre[i], node[i]))
            yield _links(found)

    return sent.repartition("a", "part").sortWithinPartitions("a", "part", "side").mapInArrow(meet, LINKS)


def _parts():
    return F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("bytes") / BLOCK_BYTES)).cast("long")


def _blocks(others: DataFrame, sketches: DataFrame | None, labels: DataFrame, held: DataFrame, measure: Measure) -> DataFrame:
    """(a, b): links across the components of labels, a spanning forest of those in each pair of blocks.

    The star has tested the smallest member of a bucket against all others, so it is left out: a bucket of two is done.
    """
    labelled = others.drop("a").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    buckets = labelled.groupBy("bucket").agg(
        F.min(F.xxhash64("label")).alias("low"), F.max(F.xxhash64("label")).alias("high"), _parts().alias("parts"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.count("*").alias("n"),
    )
    # Of buckets with the same members one is enough.
    several = buckets.where("low <> high").groupBy("x", "y", "n").agg(F.min("bucket").alias("bucket"), F.max("parts").alias("parts"))
    still = Stored(labelled.join(several.select("bucket", "parts"), "bucket").select("node", "label", "bucket", "parts"), "open")
    mine = still.df.groupBy("node").agg(F.sort_array(F.collect_list("bucket")).alias("mine"))  # at most one bucket a band
    facts = held.join(mine, "node")
    if sketches is not None:
        facts = facts.join(sketches, "node")
    block = F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts"))
    goes = still.df.select("node", "label", "bucket", block.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("j"))
    goes = goes.select("node", "label", "bucket", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), (F.col("i") > F.col("j")).cast("int").alias("side"))
    sent = goes.join(facts, "node")
    names = ["node", "label", "mine", "data", *(["sketch"] if sketches is not None else [])]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            found = []
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("bucket", "p", "q")], strict=True))
            sides, rows = batch.column("side").to_pylist(), list(zip(*[batch.column(c).to_pylist() for c in names], strict=True))
            for k, side, row, s in zip(keys, sides, rows, measure.sets([r[3] for r in rows]), strict=True):
                if k != key:
                    found += _forest(key, held, measure)
                    key, held = k, []
                held.append((side, s, *row))
            yield _links(found)
        yield _links(_forest(key, held, measure))

    keys = ["bucket", "p", "q"]
    return sent.select(*keys, "side", *names).repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(meet, LINKS)


def _links(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["a", "b"])


def _forest(key, rows, measure: Measure) -> list[tuple[bytes, bytes]]:
    """Links that join components among the members of two blocks; rows of (side, set, node, label, mine, data, sketch)."""
    if len(rows) < 2:
        return []
    if len(rows) == 2:
        (_, s, a, x, mine, *_), (_, t, b, y, other, *_) = rows
        first = next(k for k in mine if k in other) == key[0]
        return [(a, b)] if x != y and first and measure.linked(s, t) and (key[1] == key[2] or rows[0][0] != rows[1][0]) else []
    bucket, p, q = key
    n = np.array([len(r[1]) for r in rows])
    names: dict[bytes, int] = {}
    root = np.array([names.setdefault(r[3], len(names)) for r in rows])
    if len(names) < 2:
        return []
    side = np.array([r[0] for r in rows])
    left, right = (np.arange(len(rows)),) * 2 if p == q else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    if not len(left) or not len(right):
        return []
    open_ = root[left][:, None] != root[right][None, :]
    open_ &= np.minimum(n[left][:, None], n[right][None, :]) * 100 >= np.maximum(n[left][:, None], n[right][None, :]) * measure.percent
    if p == q:
        open_ &= left[:, None] < right[None, :]
    before: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        for b in r[4]:
            if b >= bucket:
                break
            before.setdefault(b, []).append(i)
    for who in before.values():
        if len(who) > 1:
            x, y = (np.array(who),) * 2 if p == q else (np.searchsorted(left, [i for i in who if not side[i]]), np.searchsorted(right, [i for i in who if side[i]]))
            open_[np.ix_(x, y)] = False
    if measure.likely:
        sketches = np.array([r[6] for r in rows], np.int64)
        for i in np.flatnonzero(open_.any(axis=1)):
            at = np.flatnonzero(open_[i])
            open_[i, at] = measure.likely(sketches[left[i]], sketches[right[at]])
    wanted = np.unique(np.concatenate((left[open_.any(axis=1)], right[open_.any(axis=0)])))
    if not len(wanted):
        return []
    flat = np.unique(np.concatenate([rows[i][1] for i in wanted]), return_inverse=True)[1]
    ids = dict(zip(wanted.tolist(), np.split(flat, np.cumsum(n[wanted])[:-1]), strict=True))
    marked = np.zeros(int(flat.max()) + 1, np.int64)
    found = []
    for i in np.flatnonzero(open_.any(axis=1)):
        a = left[i]
        others = right[open_[i] & (root[right] != root[a])]
        if not len(others):
            continue
        marked[ids[int(a)]] = 1
        met = np.add.reduceat(marked[np.concatenate([ids[int(b)] for b in others])], np.concatenate(([0], np.cumsum(n[others])[:-1])))
        marked[ids[int(a)]] = 0
        for b in others[100 * met >= measure.percent * (n[a] + n[others] - met)]:
            if root[b] != root[a]:
                found.append((rows[a][2], rows[b][2]))
                root[root == root[b]] = root[a]
    return found
