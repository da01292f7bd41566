"""Progress events and conversations, in batches and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def progress_stream(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type, with a watermark: state of windows that can't change any more is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def new_indices(items: DataFrame, done_path: str) -> None:
    """For foreachBatch: adds the items of a batch that aren't in the table of done ones, so replays change nothing."""
    spark = items.sparkSession
    try:
        done = spark.read.parquet(done_path)
        items = items.join(done, ["task_id", "index"], "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    items.dropDuplicates(["task_id", "index"]).write.mode("append").parquet(done_path)


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("__nth", F.row_number().over(newest)).where(F.col("__nth") <= n).drop("__nth")


def since(messages: DataFrame, marks: DataFrame, with_system: bool = False) -> DataFrame:
    """Messages after the turn that was last shown of their conversation (conv_id, turn in marks), system ones on request."""
    shown = messages if with_system else messages.where("lower(role) <> 'system'")
    seen = marks.groupBy("conv_id").agg(F.max("turn").alias("mark"))
    return shown.join(seen, "conv_id", "left").where("mark is null or turn > mark").drop("mark")


def token_usage(usage: DataFrame, *keys: str) -> DataFrame:
    """Sums of input, output and all tokens by key and overall (null keys)."""
    sums = [F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum(F.col("input") + F.col("output")).alias("total")]
    return usage.rollup(*keys).agg(*sums)


def loop_progress(workers: DataFrame) -> DataFrame:
    """(task_id, completed, failed, running, total) of (task_id, index, status)."""
    count = lambda s: F.count_if(F.col("status") == s)
    return workers.groupBy("task_id").agg(count("SUCCESSFUL").alias("completed"), count("FAILED").alias("failed"), count("RUNNING").alias("running"), F.count("*").alias("total"))
