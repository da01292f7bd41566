"""Sessions, and tables written out between the rounds of iterative operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "structlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on; other settings as given or as the cluster has them."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=defaults | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def _shared(spark: SparkSession) -> str:
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there is None and (set_before := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        there = set_before.get()
    if there is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="structlens-")
        spark.conf.set("spark.checkpoint.dir", there)
        atexit.register(_delete, spark, there)
    return there


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended
        pass


def new_path(spark: SparkSession) -> str:
    """A fresh path in the folder that all executors share, deleted when the driver's Python ends."""
    path = f"{_shared(spark).rstrip('/')}/step-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


class Written:
    """A table in the folder that all executors share: cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = new_path(self.spark)
        df.write.parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def written(df: DataFrame) -> DataFrame:
    return Written(df).df
