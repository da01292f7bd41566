"""From documents to shards in five stages, each written as Parquet before the next one reads it.

A stage takes any documents (doc_id, text, lang, source and further columns, whatever their names) and keeps their columns;
the last one says where each document went. Empty tables stay empty. Null texts go in quality_rules, which wants words;
null languages and sources are values like others; of repeated rows near_dedup keeps the first id's, all of them if
they are equal in id and text.

The setting structlens.pipeline.output names a folder, shared by driver and executors, that keeps the product: stages
go to folders of their own there, the shards to one with versioned manifests. A run that finds a stage complete there
takes it as it is and goes on with the next one; the last stage adds the arrivals that the shards' manifest doesn't name
yet. The folder says which input it is for, and a run with another one is refused. Without the setting all is temporary.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from structlens.llm import decontaminate, minhash, mixing, quality, sharding
from structlens.llm._common import contents, exists, stored, write_once

#: The setting that names the folder of the product.
OUTPUT = "structlens.pipeline.output"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality.good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.one_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixing.mixture(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard that holds each document, read back from the committed manifest."""
    output = spark.conf.get(OUTPUT, None)
    return sharding.shard(docs, folder=f"{output}/shards" if output else None)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", mix_sources),
    ("sharding", shards),
]

#: Robust estimates and sharding are not SQL: the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document of the product is: the rows of the last stage."""
    docs, output = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(OUTPUT, None)
    if output is not None:
        wanted = "\n".join(contents(spark, f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
        if (there := write_once(spark, f"{output}/input", wanted)) != wanted:
            raise ValueError(f"{output} is the product of another input:\n{there}")
    for name, stage in STAGES[:-1]:
        if output is None:
            docs = stored(stage(spark, docs, sf_dir), name)
            continue
        path = f"{output}/{name}"
        if not exists(spark, f"{path}/_SUCCESS"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
