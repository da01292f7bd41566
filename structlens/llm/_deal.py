"""Dealing numbered buckets evenly over shuffle partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of input for each bucket.
BUCKET_BYTES = 8 << 20


def buckets(df: DataFrame) -> int:
    """How many buckets to cut the work on df into: the session's shuffle partitions, or more for larger inputs."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, size // BUCKET_BYTES) if size < 1 << 50 else least


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """n numbers of which hash partitioning into n parts sends one to each part."""
    wanted = spark.range(n * 30 + 200, numPartitions=1).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("part")).agg(F.min("id").alias("id"))
    found = {r["part"]: r["id"] for r in wanted.collect()}
    return [found.get(i, i) for i in range(n)]
