"""Tables in the folder that all executors share: what a plan that runs in rounds keeps between them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir; where none is set, below a temporary one, which only a local session may use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tallywork-")
        _own[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: its lineage ends there, so a lost executor costs the running stage only."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The state of an iteration: each round's table replaces the last one, which is deleted once the new one is written."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.path = spark, name, ""

    def keep(self, df: DataFrame) -> DataFrame:
        path, last = folder(self.spark, self.name), self.path
        df.write.parquet(path)
        self.path = path
        if last:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(last)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return self.spark.read.schema(df.schema).parquet(path)
