"""What is done, remembered across batches and runs of a stream.

A task's done indices are bits in a keyed state of CHUNK indices each, so a task with most of the rows is many keys, and a
key's state never grows. A batch reads and writes the states of the keys that it has rows of, and nothing else; replays and
repeats of an index come out once. The state lives in the checkpoint of the query, in RocksDB on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Indices of a state.
CHUNK = 1 << 12
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Done(StatefulProcessor):
    """Emits the indices of a (task, chunk) that weren't there before; forgets a key that had no rows for ttl seconds, if given."""

    def __init__(self, ttl: float | None = None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bits = handle.getValueState("bits", "bits BINARY", ttlDurationMs=int(self.ttl * 1000) if self.ttl else None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = np.zeros(CHUNK // 8, np.uint8)
        if self.bits.exists():
            before[:] = np.frombuffer(self.bits.get()[0], np.uint8)
        met = np.zeros(CHUNK, bool)
        for batch in rows:
            met[batch["index"].to_numpy() % CHUNK] = True
        known = np.unpackbits(before, bitorder="little").astype(bool)
        fresh = np.flatnonzero(met & ~known)
        if len(fresh) or self.ttl:
            self.bits.update((np.packbits(met | known, bitorder="little").tobytes(),))
        if len(fresh):
            yield pd.DataFrame({"task_id": pd.Series([key[0]] * len(fresh), dtype=object), "index": fresh + key[1] * CHUNK})

    def close(self) -> None:
        pass


def new_indices(items: DataFrame, ttl: float | None = None) -> DataFrame:
    """(task_id, index) of a stream of items, each once. Indices are numbers from 0; rows without one, or with one below, have
    nothing to remember and are left out. The session's state store has to be RocksDB, see session_for_state()."""
    plain = items.select("task_id", F.col("index").cast("long").alias("index")).where("index >= 0")
    keyed = plain.withColumn("chunk", F.expr(f"index div {CHUNK}")).groupBy("task_id", "chunk")
    kind = dict(items.dtypes)["task_id"]
    mode = "ProcessingTime" if ttl else "None"
    return keyed.transformWithStateInPandas(statefulProcessor=Done(ttl), outputStructType=f"task_id {kind}, index LONG", outputMode="append", timeMode=mode)


def session_for_state(spark: SparkSession) -> SparkSession:
    """A session beside spark's that keeps streaming state in RocksDB."""
    other = spark.newSession()
    other.conf.set(PROVIDER, ROCKSDB)
    return other


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Adds what a stream has now to the Parquet table at path; run again, it goes on after what it has read."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
