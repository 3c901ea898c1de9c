"""Readers of run sets, run directories, submissions and small tables. A missing piece gets its default, not an error."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.operators import runs

TAIL_BYTES = 64_000
FINGERPRINT = "split_id string, container_config string, harness_version string"
RUN = "competition_id string, seed int, medal boolean, any_medal boolean, infra_failure boolean"
METADATA = "competition_id string, seed int, exit_code int, wall_clock_seconds double, time_cap_seconds double, timed_out boolean, isolation string, validation_error string, harness_error string, checkpoints array<struct<elapsed_seconds double, sha256 string, path string>>"
RUN_PATH = r"/([^/]+)/(?:metadata\.json|submission/submission\.csv|logs/[^/]+)$"


def run_sets(spark: SparkSession, path: str) -> DataFrame:
    """run_set, fingerprint, item, seed, medal, infra_failure of JSON documents; a document without split_id is refused."""
    docs = spark.read.schema(f"label string, fingerprint struct<{FINGERPRINT}>, runs array<struct<{RUN}>>").option("multiLine", True).json(path)
    f = F.col("fingerprint")
    label = F.coalesce("label", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.json)?$", 1))
    split = F.when(f["split_id"].isNull(), F.raise_error(F.concat(label, F.lit(": fingerprint.split_id is missing")))).otherwise(f["split_id"])
    known = docs.select(label.alias("run_set"), F.named_struct(F.lit("split_id"), split, F.lit("container_config"), F.coalesce(f["container_config"], F.lit("default")), F.lit("harness_version"), F.coalesce(f["harness_version"], F.lit("unknown"))).alias("fingerprint"), F.explode("runs").alias("r"))
    flat = known.select("run_set", "fingerprint", F.col("r.competition_id").alias("item"), "r.seed", "r.medal", "r.any_medal", "r.infra_failure")
    return flat.select("run_set", "fingerprint", "item", F.coalesce("seed", F.lit(0)).alias("seed"), F.coalesce("any_medal", "medal", F.lit(False)).alias("medal"), F.coalesce("infra_failure", F.lit(False)).alias("infra_failure"))


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """pre, post, place of a JSON array of pairs; an empty one is an error."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("place", "p")).select("place", F.col("p")[0].alias("pre"), F.col("p")[1].alias("post"))
    if not rows.limit(1).count():
        raise ValueError(f"{path}: no pairs")
    return rows


def published(spark: SparkSession, path: str) -> DataFrame:
    """experiment, competition_id, medals, seeds of a CSV with a header; of repeated keys the last line counts."""
    rows = spark.read.schema("experiment string, competition_id string, medals int, seeds int").option("header", True).csv(path).withColumn("ord", F.monotonically_increasing_id())
    return rows.groupBy("experiment", "competition_id").agg(F.max_by("medals", "ord").alias("medals"), F.max_by("seeds", "ord").alias("seeds"))


def complexity(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("competition_id string, complexity string").option("header", True).csv(path)


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).withColumn("run", F.regexp_extract("path", RUN_PATH, 1))


def _text(content: Column) -> Column:
    """The last TAIL_BYTES as UTF-8, broken bytes replaced."""
    return F.make_valid_utf8(F.substring(content, -TAIL_BYTES, TAIL_BYTES).cast("string"))


def run_directories(spark: SparkSession, root: str, trusted: tuple[str, ...] = ("harness.log",)) -> DataFrame:
    """Artifacts of each run directory below root: metadata joined to its submission and logs, by directory name.

    Only logs named in trusted become harness_log; all others become agent_log.
    """
    meta = _files(spark, root, "metadata.json").select("run", F.from_json(F.make_valid_utf8(F.col("content").cast("string")), METADATA, {"mode": "PERMISSIVE"}).alias("m"))
    sub = _files(spark, root, "submission.csv").where(F.col("path").contains("/submission/")).select("run", submission_rows(F.col("content").cast("string")).alias("submission_rows"))
    logs = _files(spark, root, "*.log").withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).withColumn("kind", F.when(F.col("name").isin(list(trusted)), "harness_log").otherwise("agent_log"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", _text(F.col("content")).alias("t")))), lambda x: x["t"]), "\n")
    per = logs.groupBy("run").pivot("kind", ["harness_log", "agent_log"]).agg(text)
    every = meta.select("run").union(sub.select("run")).union(logs.select("run")).distinct()
    j = every.join(meta, "run", "left").join(sub, "run", "left").join(per, "run", "left")
    m = lambda c: F.col(f"m.{c}")
    return j.select(
        "run", F.coalesce(m("competition_id"), F.regexp_extract("run", r"^(.*)__seed\d+$", 1), F.col("run")).alias("item"), F.coalesce(m("seed"), F.lit(0)).alias("seed"), F.coalesce(m("exit_code"), F.lit(0)).alias("exit_code"),
        m("wall_clock_seconds").alias("wall_clock"), m("time_cap_seconds").alias("time_cap"), F.coalesce(m("isolation"), F.lit("unknown")).alias("isolation"), m("validation_error").alias("validation_error"), m("harness_error").alias("harness_error"),
        F.coalesce(m("checkpoints"), F.array().cast("array<struct<elapsed_seconds double, sha256 string, path string>>")).alias("checkpoints"),
        F.col("submission_rows").isNotNull().alias("has_submission"), F.coalesce("submission_rows", F.lit(0)).alias("submission_rows"), F.coalesce("harness_log", F.lit("")).alias("harness_log"), F.coalesce("agent_log", F.lit("")).alias("agent_log"),
    )


def submission_rows(text: Column) -> Column:
    """Physical lines less the header, at least 0."""
    lines = F.size(F.split(text, "\n")) - F.when(text.endswith("\n"), 1).otherwise(0)
    return F.greatest(F.when(F.length(text) == 0, 0).otherwise(lines - 1), F.lit(0))


#: A record of a CSV file, with line ends in quotes; and a field with the comma before it. Possessive, so that long ones need no stack.
RECORD = r'(?:[^"\n]++|"(?:[^"]++|"")*+(?:"|\z))++'
FIELD = r',((?:[^",]++|"(?:[^"]++|"")*+(?:"|\z))*+)'


def csv_records(text: Column) -> Column:
    """Records of a CSV text as arrays of fields, quotes taken off and doubled ones made single; blank lines are left out."""
    plain = lambda f: F.when(f.startswith('"'), F.replace(F.regexp_replace(f, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(f)
    fields = lambda r: F.transform(F.regexp_extract_all(F.concat(F.lit(","), r), F.lit(FIELD), F.lit(1)), plain)
    return F.transform(F.regexp_extract_all(F.regexp_replace(text, "\r\n?", "\n"), F.lit(RECORD), F.lit(0)), fields)


def any_of(spark: SparkSession, paths: list[str]) -> list[str]:
    """Patterns, one a file system, that stand for those of the absolute paths that exist; file systems with none are left out."""
    groups: dict[str, list[str]] = {}
    for p in paths:
        system, rest = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?/*(.*)$", p).groups()
        groups.setdefault(system or "", []).append(re.sub(r"([\\\[\]{}*?,])", r"\\\1", rest))
    patterns = [f"{system}/{{{','.join(sorted(set(rest)))}}}" for system, rest in groups.items()]

    def there(pattern: str) -> bool:
        try:
            spark.read.format("binaryFile").load(pattern).schema
            return True
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return False
            raise

    return [p for p in patterns if there(p)]


def submission(spark: SparkSession, path: str | list[str], id_column: str, target_column: str, run: str = r"([^/]+)$") -> DataFrame:
    """run, line_no, id, raw of CSV files; a header without the columns gives one row whose raw is null and line_no 1.

    Each file is read whole. run is the pattern of a run's name in a file's path; line_no counts records.
    """
    texts = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True) if path else spark.createDataFrame([], "value string").withColumn("_metadata", F.named_struct(F.lit("file_path"), F.lit("")))
    found = texts.select(F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), run, 1)).alias("run"), csv_records(F.col("value")).alias("records"))
    head = found.select("run", "records", F.array_position(F.get("records", F.lit(0)), id_column).cast("int").alias("i"), F.array_position(F.get("records", F.lit(0)), target_column).cast("int").alias("t"))
    good = head.where("i > 0 and t > 0").select("run", "i", "t", F.posexplode("records").alias("pos", "cells")).where("pos > 0")
    rows = good.select("run", (F.col("pos") + 1).alias("line_no"), F.get("cells", F.col("i") - 1).alias("id"), F.get("cells", F.col("t") - 1).alias("raw"))
    bad = head.where("not coalesce(i > 0 and t > 0, false)").select("run", F.lit(1).alias("line_no"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("raw"))
    return rows.unionByName(bad)


def submissions_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """competition_id, seed, submission_path; blank lines and comments are skipped."""
    rows = spark.read.text(path).where(~F.trim("value").rlike(r"^(?:#|//)") & (F.trim("value") != ""))
    return rows.select(F.from_json("value", "competition_id string, seed int, submission_path string").alias("r")).select("r.*")


def answers(spark: SparkSession, path: str, task: str = r"/([^/]+)/[^/]+$") -> DataFrame:
    """task, id, y of answers.json files, the task being what its pattern finds in a path: the directory."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), task, 1).alias("task"), F.explode(F.from_json("value", "map<string,double>")).alias("id", "y"))
    return rows


def leaderboards(spark: SparkSession, path: str) -> DataFrame:
    """task, team, score of leaderboard.json files."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1).alias("task"), F.posexplode(F.from_json("value", "array<double>")).alias("team", "score"))


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """subject, item, rate of a CSV whose first column names the subject; fewer than two subjects is an error."""
    wide = spark.read.option("header", True).option("inferSchema", True).csv(path)
    first, *items = wide.columns
    if wide.limit(2).count() < 2:
        raise ValueError(f"{path}: at least two subjects are needed")
    return wide.unpivot([first], items, "item", "rate").select(F.col(first).cast("string").alias("subject"), "item", F.col("rate").cast("double"))


def names(spark: SparkSession, path: str) -> DataFrame:
    """name: one to a line; blank lines and comments are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name != '' and not startswith(name, '#')")


def feature_table(spark: SparkSession, path: str, target: str) -> DataFrame:
    """id, all others as doubles (empty: null), target last if the header has it."""
    wide = spark.read.option("header", True).option("nullValue", "").csv(path)
    first, *rest = wide.columns
    feats = [c for c in rest if c != target]
    return wide.select(F.col(first).alias("id"), *[F.col(c).try_cast("double").alias(c) for c in feats], *([F.col(target).try_cast("double").alias("target")] if target in rest else []))


def cells_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a document {"cells": [...]} (skill profiles, probe results)."""
    return spark.read.schema(f"cells array<struct<{schema}>>").option("multiLine", True).json(path).select(F.inline("cells"))


def instances(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """run, test, kind of instance documents with FAIL_TO_PASS and PASS_TO_PASS, one a file or one a line."""
    docs = spark.read.schema("instance_id string, FAIL_TO_PASS array<string>, PASS_TO_PASS array<string>").option("multiLine", not lines).json(path)
    return docs.select(F.col("instance_id").alias("run"), F.explode("FAIL_TO_PASS").alias("test"), F.lit("f2p").alias("kind")).unionByName(docs.select(F.col("instance_id").alias("run"), F.explode("PASS_TO_PASS").alias("test"), F.lit("p2p").alias("kind")))


def memory(spark: SparkSession, root: str) -> DataFrame:
    """fingerprint, answer, priority of JSON maps; a later file goes before an earlier one."""
    return spark.read.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("priority"), F.explode(F.from_json("value", "map<string,double>")).alias("fingerprint", "answer"))


def grader_schemas(spark: SparkSession, path: str) -> DataFrame:
    """task, id_column, target_column, low, high, kind read out of graders' source text; what isn't stated leaves the task out."""
    t = F.col("value")
    rows = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1).alias("task"),
        F.regexp_extract(t, r"""(?i)id_col(?:umn)?\s*=\s*["']([^"']+)["']""", 1).alias("id_column"), F.regexp_extract(t, r"""(?i)target_col(?:umn)?\s*=\s*["']([^"']+)["']""", 1).alias("target_column"),
        F.regexp_extract(t, r"\.between\(\s*(-?[0-9.]+)\s*,", 1).try_cast("double").alias("low"), F.regexp_extract(t, r"\.between\(\s*-?[0-9.]+\s*,\s*(-?[0-9.]+)", 1).try_cast("double").alias("high"),
        F.when(t.rlike(r"(?i)roc_auc"), "binary").when(t.rlike(r"(?i)root_mean_squared|rmse"), "regression").alias("kind"),
    )
    return rows.where("id_column != '' and target_column != '' and kind is not null")


def session(spark: SparkSession, root: str) -> DataFrame:
    """Artifacts of all agents' runs below root/runs/<agent>/<competition>__seed<n>/, with the agent."""
    found = run_directories(spark, f"{root.rstrip('/')}/runs")
    where = _files(spark, f"{root.rstrip('/')}/runs", "*").select("run", F.regexp_extract("path", r"/runs/([^/]+)/", 1).alias("agent")).where("run != ''").distinct()
    return where.join(found, "run")


def grades(spark: SparkSession, root: str) -> DataFrame:
    """agent, item, seed, score, medal of root/grades/<agent>/*.json; a corrupt document gives no row."""
    docs = spark.read.option("recursiveFileLookup", True).text(f"{root.rstrip('/')}/grades", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"/grades/([^/]+)/", 1).alias("agent"), F.from_json("value", "reports array<struct<competition_id string, seed int, score double, any_medal boolean, valid_submission boolean>>").alias("d"))
    return docs.select("agent", F.explode("d.reports").alias("r")).select("agent", F.col("r.competition_id").alias("item"), "r.seed", "r.score", F.col("r.any_medal").alias("medal"), F.col("r.valid_submission").alias("valid"))


def typed(records: DataFrame) -> DataFrame:
    return runs.runs_from(records)


SPEC = "competition_id string, metric string, is_lower_better boolean, id_column string, target_column string, thresholds struct<gold:double,silver:double,bronze:double,median:double,n_teams:int>, challenges array<string>, target_range array<double>"


def specs_of_schemas(schemas: DataFrame, tasks: DataFrame) -> DataFrame:
    """task, kind, id_column, target_column, low, high for each task (a column task); a task without a readable schema is an error."""
    both = tasks.select("task").distinct().join(schemas, "task", "left")
    kind = F.when(F.col("kind").isNull(), F.raise_error(F.concat(F.col("task"), F.lit(": no schema that can be generated")))).otherwise(F.col("kind"))
    return both.select("task", kind.alias("kind"), "id_column", "target_column", "low", "high")


def task_specs(spark: SparkSession, path: str) -> DataFrame:
    """One row a competition.json; unknown keys are ignored, missing ones null."""
    return spark.read.schema(SPEC).option("multiLine", True).json(path)
