"""Writers: submissions as JSON lines, grading reports, run sets, metadata, six-decimal CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tallywork.functions import ordering

#: Runs in one document of a run set, about.
RUNS = 100_000


def write_submissions(results: DataFrame, path: str) -> int:
    """Rows whose submission exists, as JSON lines; how many, counted as they are written."""
    rows, written = results.where("has_submission").select("competition_id", "seed", "submission_path"), Observation()
    rows.observe(written, F.count("*").alias("n")).write.mode("errorifexists").json(path)
    return written.get["n"]


def grading_summary(grades: DataFrame) -> DataFrame:
    """One row: counts, the rate per submission, and the map item|seed to medal."""
    key = F.concat_ws("|", "item", F.col("seed").cast("string"))
    return grades.agg(F.count("*").alias("submissions"), F.count_if("medal").alias("medals"), F.avg(F.col("medal").cast("double")).alias("any_medal_rate"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(key.alias("k"), F.col("medal").alias("v"))))).alias("by_run"))


def verdicts(artifacts: DataFrame, grades: DataFrame) -> DataFrame:
    """Artifacts with the validation error of their latest grade; the files themselves stay as they are."""
    last = grades.groupBy("item", "seed").agg(F.max_by("error", "graded_at").alias("latest"), F.lit(True).alias("was_graded"))
    return artifacts.join(last, ["item", "seed"], "left").withColumn("validation_error", F.when(F.col("was_graded"), F.col("latest")).otherwise(F.col("validation_error"))).drop("latest", "was_graded")


def write_run_sets(runs: DataFrame, path: str, most: int | None = None) -> None:
    """Run sets (run_set, split_id, container_config, and run, a struct as the format has it) as JSON documents, a file each.

    A run set of more than most (RUNS) runs becomes several documents of one label and fingerprint, dealt by a hash of their place,
    which files.run_sets reads as one run set. A document is written line by line out of a sort, so no row and no task holds
    more than one run of it; a document of some most runs is all that a reader needs to hold.
    """
    head = ["run_set", "split_id", "container_config"]
    placed = runs.select(*head, "run", F.monotonically_increasing_id().alias("_id"))
    sizes = runs.groupBy(*head).agg(F.ceil(F.count("*") / F.lit(most or RUNS)).alias("_parts"))
    dealt = ordering.matched(placed, sizes, head).select(*head, "run", "_id", F.xxhash64(*head).alias("set"), F.pmod(F.xxhash64("_id"), F.col("_parts")).alias("part"))
    within = Window.partitionBy("set", "part").orderBy("run", "_id")
    begin = F.concat(_head(F.col("run_set"), F.col("split_id"), F.col("container_config")), F.lit(', "runs": [\n'))
    line = F.concat(F.when(F.lag("_id").over(within).isNull(), begin).otherwise(""), F.to_json("run"), F.when(F.lead("_id").over(within).isNull(), "\n]}").otherwise(","))
    lines = dealt.select("set", "part", "run", "_id", line.alias("value")).sortWithinPartitions("set", "part", "run", "_id")
    lines.select("set", "part", "value").write.partitionBy("set", "part").option("maxRecordsPerFile", 0).text(path)


def _head(label: Column, split_id: Column, container_config: Column) -> Column:
    """A document's label and fingerprint, as JSON without the closing brace."""
    known = F.to_json(F.struct(label.alias("label"), F.struct(split_id.alias("split_id"), container_config.alias("container_config")).alias("fingerprint")))
    return F.regexp_replace(known, r"\}$", "")


def documented() -> Column:
    """A run (item, seed, medal, infra_failure) as documents have it."""
    return F.struct(F.col("item").alias("competition_id"), "seed", F.col("medal").alias("any_medal"), "infra_failure")


def run_set_document(runs: DataFrame, label: str, split_id: str, container_config: str) -> DataFrame:
    """One row, value: a run set as JSON, for few runs; write_run_sets takes any number."""
    body = F.sort_array(F.collect_list(documented()))
    return runs.agg(F.to_json(F.struct(F.lit(label).alias("label"), F.struct(F.lit(split_id).alias("split_id"), F.lit(container_config).alias("container_config")).alias("fingerprint"), body.alias("runs"))).alias("value"))


def write_metadata(artifacts: DataFrame, path: str) -> None:
    """One JSON line a run, checkpoints included."""
    artifacts.drop("harness_log", "agent_log").write.mode("errorifexists").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with six decimals. Spark's committer makes the folder appear whole or not at all."""
    fixed = [F.format_string("%.6f", c).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes]
    rows.select(*fixed).write.mode("errorifexists").option("header", True).csv(path)


def as_documents(rows: DataFrame) -> DataFrame:
    """value: each row as JSON, nested columns included."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))
