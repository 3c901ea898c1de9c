"""What the operators share: the folder that all executors see, tables that cut lineage, prefix sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters; bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

#: Chunks in a group of the prefix sums.
CHUNKS = 1000

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where none is set, a temporary folder, which only a local session may use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="tallywork-")
        base = _own[app]
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back.

    Cuts lineage so that a lost executor costs no more than the running stage. It also gives a later join two plain
    exchanges, which adaptive execution can split where one key holds a large share of the rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallywork-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def starts(df: DataFrame, key: str, chunk: str, order: list[str], value: str, out: str, row: str) -> DataFrame:
    """Adds out, the sum of value over the rows before this one of its key, and row, a number unique within key and chunk.

    Three passes: sums within (key, chunk), over the totals of a group of chunks, and over the groups' totals, so no task
    gets all rows of a hot key, nor all its chunks. The order is by chunk, a number from 0 on, then by the given columns;
    key and chunk aren't null.
    """

    def summed(rows: DataFrame, within: list[str], by: list[str], of: str, name: str) -> DataFrame:
        before = Window.partitionBy(*within).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, F.coalesce(F.sum(of).over(before), F.lit(0)))

    rows = summed(df, [key, chunk], order, value, "_in").withColumn(row, F.row_number().over(Window.partitionBy(key, chunk).orderBy(*order)))
    chunks = df.groupBy(F.col(key).alias("_key"), F.col(chunk).alias("_chunk")).agg(F.sum(value).alias("_of")).withColumn("_group", F.floor(F.col("_chunk") / CHUNKS))
    groups = chunks.groupBy(F.col("_key").alias("_k"), F.col("_group").alias("_g")).agg(F.sum("_of").alias("_all"))
    bases = summed(chunks, ["_key", "_group"], ["_chunk"], "_of", "_low").join(summed(groups, ["_k"], ["_g"], "_all", "_high"), (F.col("_key") == F.col("_k")) & (F.col("_group") == F.col("_g")))
    known = rows.join(bases.select("_key", "_chunk", (F.col("_low") + F.col("_high")).alias("_base")), (F.col(key) == F.col("_key")) & (F.col(chunk) == F.col("_chunk")))
    return known.withColumn(out, F.col("_base") + F.col("_in")).drop("_in", "_base", "_key", "_chunk")


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
