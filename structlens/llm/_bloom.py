"""A blocked Bloom filter of bounded size, built and probed by DataFrame operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds the broadcast filter: 2**20 blocks of 64 bits. Fuller filters pass more, never less.
MOST_BLOCKS = 1 << 20


def blocks_for(n: int) -> int:
    """Blocks for n keys: a power of two, at least four keys each at most."""
    blocks = 1 << 10
    while blocks < MOST_BLOCKS and blocks * 4 < n:
        blocks *= 2
    return blocks


def _bits(key: Column) -> Column:
    """Four of the 64 bits of a block, as a long."""
    seed = F.xxhash64(key, F.lit(17))
    one = F.lit(1).cast("long")
    return reduce(Column.bitwiseOR, [F.call_function("shiftleft", one, F.shiftrightunsigned(seed, 6 * i).bitwiseAND(63).cast("int")) for i in range(4)])


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(__fblock, __fbits): every key sets four bits of one 64-bit block; at most `blocks` rows."""
    each = listed.select(_block(F.col(key), blocks).alias("__fblock"), _bits(F.col(key)).alias("__b"))
    return each.groupBy("__fblock").agg(F.bit_or("__b").alias("__fbits"))


def probed(rows: DataFrame, key: str, filtered: DataFrame, blocks: int) -> DataFrame:
    """rows with __maybe: whether the filter may hold the key; false for null keys."""
    at = rows.withColumns({"__block": _block(F.col(key), blocks), "__bits": _bits(F.col(key))})
    joined = at.join(F.broadcast(filtered), at["__block"] == filtered["__fblock"], "left")
    hit = F.col(key).isNotNull() & F.coalesce(F.col("__fbits").bitwiseAND(F.col("__bits")) == F.col("__bits"), F.lit(False))
    return joined.withColumn("__maybe", hit).drop("__block", "__bits", "__fblock", "__fbits")
