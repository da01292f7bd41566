"""Connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Stored

#: Edges that one task contracts in memory.
CHUNK = 1 << 20


def components(edges: DataFrame, contract: bool = True) -> Stored:
    """(node, label): for each node of edges (a, b) the smallest node it reaches.

    Tasks contract chunks of at most about CHUNK edges to forests whose nodes point at their roots. Where there are
    several chunks, union-find goes on by alternating star operations: every node's larger neighbours move to its
    smallest neighbour, then its smaller ones do, until every node but the roots points at one root. Each round is a few
    aggregations and joins over the edges and is written out; rounds grow with the logarithm of the longest path, and no
    adjacency list is ever gathered. Without contract, all is done by these rounds, in DataFrame operations.
    """
    now = Stored(_oriented(edges), "edges")
    rounds = True
    if contract:
        chunks, first = -(-max(1, now.df.count()) // CHUNK), now
        now, rounds = Stored(_contracted(first.df, chunks), "edges"), chunks > 1
        first.drop()
    while rounds and not _is_forest(now.df):
        both = now.df.unionByName(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["k"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _oriented(large)
        small = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        moved = large.join(small, large["a"] == small["k"])
        after = Stored(_oriented(moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("k").alias("a"), F.col("m").alias("b")))), "edges")
        now.drop()
        now = after
    heads = now.df.select(F.col("b").alias("node")).distinct()
    out = Stored(now.df.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(heads.select("node", F.col("node").alias("label"))), "labels")
    now.drop()
    return out


def _contracted(edges: DataFrame, chunks: int) -> DataFrame:
    """Forests with the components of each chunk of edges: every node points at the smallest one."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):
            top = x
            while (above := up.get(top, top)) != top:
                top = above
            while (above := up.get(x, x)) != top and x != top:
                up[x], x = top, above
            return top

        schema = None
        for batch in batches:
            schema = batch.schema
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
        if schema is not None:
            pairs = [(x, root(x)) for x in list(up)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], schema.field(n).type) for i, n in enumerate("ab")], ["a", "b"])

    return edges.select("a", "b").repartition(chunks).mapInArrow(contract, edges.select("a", "b").schema)


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node, without loops."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node that points at a smaller one points at just one, and at none that points on: by node, at most one
    way down and not both a way down and one up."""
    down, up = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    ways = down.unionByName(up).groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return ways.where("down > 1 or (down = 1 and up = 1)").isEmpty()
