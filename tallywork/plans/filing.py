"""Queries over files: tables are written in the formats of run groups, submissions and task folders, and read back through the sources.

Files go to the shared folder that the session names. Documents that a format wants one by one under a fixed name are made
from tables of a fixed number of rows (nation: 25, region: 5); what grows is written by Spark.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.plans import fixtures as fx
from tallywork.plans.catalog import query
from tallywork.sources import files, sinks
from tallywork.sources.shared import folder


def put(spark: SparkSession, path: str, content: str | bytes) -> str:
    """One small file, wherever Spark can write."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(content.encode() if isinstance(content, str) else content))
    out.close()
    return path


def nations(spark: SparkSession, d: str) -> list[dict]:
    return [r.asDict() for r in fx.table(spark, d, "nation").orderBy("n_nationkey").collect()]


# Run sets


@query("select 'set-' || subject as run_set, 'split-' || (subject % 2) as split_id, 'default' as container_config, count(*) as n, sum(medal::int)::bigint as medals, sum(infra_failure::int)::bigint as infra, sum(seed)::bigint as seeds from runs group by subject", "runs")
def file_run_sets(spark: SparkSession, d: str) -> DataFrame:
    """JSON documents by subject, medal and any_medal in turns, read as run sets (SRC-01)."""
    where = folder(spark, "run-sets")
    r = fx.runs(spark, d)
    one = F.struct(F.concat(F.lit("t"), F.col("item")).alias("competition_id"), F.col("seed"), F.when(F.col("item") % 2 == 0, F.col("medal")).alias("medal"), F.when(F.col("item") % 2 == 1, F.col("medal")).alias("any_medal"), F.when(F.col("infra_failure"), True).alias("infra_failure"))
    sinks.write_run_sets(r.select(F.concat(F.lit("set-"), F.col("subject")).alias("run_set"), F.concat(F.lit("split-"), F.col("subject") % 2).alias("split_id"), F.lit(None).cast("string").alias("container_config"), one.alias("run")), where)
    got = files.run_sets(spark, where)
    return got.groupBy("run_set", "fingerprint.split_id", "fingerprint.container_config").agg(F.count("*").alias("n"), F.count_if("medal").alias("medals"), F.count_if("infra_failure").alias("infra"), F.sum("seed").cast("long").alias("seeds"))


@query("select 'g' || (o_custkey % 3) as run_set, count(*) as n, sum(case when o_orderkey % 3 = 0 then (o_totalprice > 100000.0::double)::int else (o_orderstatus = 'O')::int end)::bigint as medals, sum(case when o_orderkey % 5 = 0 then 0 else o_orderkey % 4 end)::bigint as seeds, sum((o_orderpriority = '1-URGENT')::int)::bigint as infra from orders group by 1")
def file_records(spark: SparkSession, d: str) -> DataFrame:
    """Loose JSON records with some fields missing, as runs (SRC-02)."""
    where = folder(spark, "records")
    o, k = fx.table(spark, d, "orders"), F.col("o_orderkey")
    o.select(F.concat(F.lit("g"), F.col("o_custkey") % 3).alias("run_set"), F.concat(F.lit("t"), k % 7).alias("item"), F.when(k % 5 != 0, k % 4).alias("seed"), (F.col("o_orderstatus") == "O").alias("medal"), F.when(k % 3 == 0, F.col("o_totalprice") > 100000.0).alias("any_medal"), F.when(F.col("o_orderpriority") == "1-URGENT", True).alias("infra_failure")).write.json(where)
    records = spark.read.schema("run_set string, item string, seed long, medal boolean, any_medal boolean, infra_failure boolean").json(where)
    return files.typed(records).groupBy("run_set").agg(F.count("*").alias("n"), F.count_if("medal").alias("medals"), F.sum("seed").cast("long").alias("seeds"), F.count_if("infra_failure").alias("infra"))


@query("select 'a' || subject as label, count(*) as n, sum(medal::int)::bigint as medals, sum(infra_failure::int)::bigint as infra from runs where subject = 3 group by subject", "runs")
def file_run_set_written(spark: SparkSession, d: str) -> DataFrame:
    """A run set written as documents and read back (SNK-04)."""
    where = folder(spark, "run-set")
    mine = fx.runs(spark, d).where("subject = 3").select(F.col("item").cast("string").alias("item"), F.col("seed").cast("int").alias("seed"), "medal", "infra_failure")
    sinks.write_run_sets(mine.select(F.lit("a3").alias("run_set"), F.lit("s").alias("split_id"), F.lit("docker").alias("container_config"), sinks.documented().alias("run")), where)
    return files.run_sets(spark, where).groupBy(F.col("run_set").alias("label")).agg(F.count("*").alias("n"), F.count_if("medal").alias("medals"), F.count_if("infra_failure").alias("infra"))


@query("select row_number() over (order by n_nationkey) - 1 as place, n_name as pre, r_name as post from nation join region on n_regionkey = r_regionkey")
def file_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A JSON array of pairs (SRC-03)."""
    regions = {r["r_regionkey"]: r["r_name"] for r in fx.table(spark, d, "region").collect()}
    where = put(spark, f"{folder(spark, 'pairs')}/pairs.json", json.dumps([[n["n_name"], regions[n["n_regionkey"]]] for n in nations(spark, d)]))
    return files.pairs(spark, where).select(F.col("place").cast("long").alias("place"), "pre", "post")


# Small tables


@query("select 'e' || s_nationkey as experiment, 'c' || (s_suppkey % 3) as competition_id, arg_max(s_suppkey % 5, s_suppkey)::bigint as medals, arg_max(5 + s_suppkey % 2, s_suppkey)::bigint as seeds from supplier group by 1, 2")
def file_published(spark: SparkSession, d: str) -> DataFrame:
    """A CSV with repeated keys, of which the last line counts (SRC-04)."""
    where = folder(spark, "published")
    k = F.col("s_suppkey")
    lines = fx.table(spark, d, "supplier").select(k, F.concat(F.lit("e"), F.col("s_nationkey")).alias("experiment"), F.concat(F.lit("c"), k % 3).alias("competition_id"), (k % 5).alias("medals"), (5 + k % 2).alias("seeds"))
    lines.coalesce(1).sortWithinPartitions("s_suppkey").drop("s_suppkey").write.option("header", True).csv(where)  # one file: the order of lines matters
    return files.published(spark, where).select("experiment", "competition_id", F.col("medals").cast("long").alias("medals"), F.col("seeds").cast("long").alias("seeds"))


@query("select case when p_size < 15 then 'low' when p_size < 35 then 'medium' else 'high' end as complexity, count(*) as n, count(distinct p_name) as names from part group by 1")
def file_complexity(spark: SparkSession, d: str) -> DataFrame:
    """A CSV of tiers (SRC-05)."""
    where = folder(spark, "complexity")
    tier = F.when(F.col("p_size") < 15, "low").when(F.col("p_size") < 35, "medium").otherwise("high")
    fx.table(spark, d, "part").select(F.col("p_name").alias("competition_id"), tier.alias("complexity")).write.option("header", True).csv(where)
    return files.complexity(spark, where).groupBy("complexity").agg(F.count("*").alias("n"), F.count_distinct("competition_id").alias("names"))


@query("select 's' || subject as subject, 'i' || item as item, round(rate, 6) as rate from cells", "cells")
def file_matrix(spark: SparkSession, d: str) -> DataFrame:
    """A matrix as CSV with a column an item (SRC-15); written with six decimals (SNK-06)."""
    where = folder(spark, "matrix")
    c = fx.cells(spark, d)
    sinks.write_csv(c.groupBy(F.concat(F.lit("s"), F.col("subject")).alias("subject")).pivot("item", list(range(20))).agg(F.first("rate")).toDF("subject", *[f"i{k}" for k in range(20)]), where)
    return files.matrix(spark, where)


@query("select distinct trim(c_mktsegment) as name from customer")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    """Names a line, with blank lines and comments between them (SRC-16)."""
    where = folder(spark, "names")
    c = fx.table(spark, d, "customer").select("c_mktsegment").distinct()
    c.select(F.explode(F.array(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" ")), F.concat(F.lit("# "), F.col("c_mktsegment")), F.lit(""))).alias("value")).write.text(where)
    return files.names(spark, where)


@query("select doc_id::varchar as id, case when doc_id % 7 = 0 then null else n_chars::double end as n_chars, quality::double as quality, toxic::double as target from labels join documents using (doc_id)")
def file_features(spark: SparkSession, d: str) -> DataFrame:
    """A CSV of features with empty cells and the target last (SRC-17)."""
    where = folder(spark, "features")
    both = fx.table(spark, d, "labels").join(fx.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    both.select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("n_chars")).alias("n_chars"), "quality", "toxic").write.option("header", True).csv(where)
    return files.feature_table(spark, where, "toxic")


# Run directories


def run_group(spark: SparkSession, d: str, root: str) -> None:
    """A directory a nation: complete, without a submission, with broken metadata, or with a log that only claims to be the harness's."""
    for n in nations(spark, d):
        k = n["n_nationkey"]
        run = f"{root}/{n['n_name'].replace(' ', '_')}__seed{k % 3}"
        meta = {"competition_id": n["n_name"], "seed": k % 3, "exit_code": k % 2, "wall_clock_seconds": 1.5 * k, "time_cap_seconds": 100.0, "isolation": "docker", "checkpoints": [{"elapsed_seconds": float(j), "sha256": f"{j}", "path": "x"} for j in range(k % 4)], "unknown": 1}
        put(spark, f"{root}/notes-{k}.txt", "a loose file")
        put(spark, f"{run}/metadata.json", "{broken" if k % 5 == 4 else json.dumps(meta))
        if k % 3:
            put(spark, f"{run}/submission/submission.csv", "id,y\n" + "".join(f"{j},0.5\n" for j in range(k)))
        put(spark, f"{run}/logs/agent.log", b"\xff" * 70_000 + f"end {k}".encode())
        if k % 2:
            put(spark, f"{run}/logs/harness.log", "Spot ITN received" if k % 4 == 1 else "fine")


RUN_GROUP = """select replace(n_name, ' ', '_') || '__seed' || (n_nationkey % 3) as run, case when n_nationkey % 5 = 4 then replace(n_name, ' ', '_') else n_name end as item, case when n_nationkey % 5 = 4 then 0 else n_nationkey % 3 end::bigint as seed,
  case when n_nationkey % 5 = 4 then 0 else n_nationkey % 2 end::bigint as exit_code, case when n_nationkey % 5 <> 4 then 1.5::double * n_nationkey end as wall_clock, case when n_nationkey % 5 = 4 then 'unknown' else 'docker' end as isolation, case when n_nationkey % 5 = 4 then 0 else n_nationkey % 4 end::bigint as n_checkpoints,
  n_nationkey % 3 <> 0 as has_submission, case when n_nationkey % 3 <> 0 then n_nationkey else 0 end::bigint as submission_rows, case when n_nationkey % 4 = 1 then 'Spot ITN received' when n_nationkey % 2 = 1 then 'fine' else '' end as harness_log, 'end ' || n_nationkey as tail from nation"""


@query(RUN_GROUP)
def file_run_group(spark: SparkSession, d: str) -> DataFrame:
    """All run directories of a group (SRC-06, SRC-07, SRC-08, SRC-09)."""
    where = folder(spark, "run-group")
    run_group(spark, d, where)
    r = files.run_directories(spark, where)
    return r.select("run", "item", F.col("seed").cast("long").alias("seed"), F.col("exit_code").cast("long").alias("exit_code"), "wall_clock", "isolation", F.size("checkpoints").cast("long").alias("n_checkpoints"), "has_submission", F.col("submission_rows").cast("long").alias("submission_rows"), "harness_log", F.regexp_extract("agent_log", "(end [0-9]+)$", 1).alias("tail"))


@query("select case when n_nationkey % 5 = 4 then 'unknown' else 'docker' end as isolation, count(*) as n, sum(case when n_nationkey % 5 = 4 then 0 else n_nationkey % 4 end)::bigint as n_checkpoints, sum((n_nationkey % 5 <> 4 and n_nationkey % 4 >= 2)::int)::bigint as later from nation group by 1")
def file_report_rows(spark: SparkSession, d: str) -> DataFrame:
    """Metadata written as JSON lines, checkpoints included, and read again for a report (SRC-10, SNK-05, SNK-07)."""
    where = folder(spark, "metadata")
    run_group(spark, d, f"{where}/runs")
    sinks.write_metadata(files.run_directories(spark, f"{where}/runs"), f"{where}/metadata")
    sinks.as_documents(spark.read.schema("run string, isolation string, checkpoints array<struct<elapsed_seconds double, sha256 string>>").json(f"{where}/metadata")).write.text(f"{where}/documents")
    back = spark.read.schema("isolation string, checkpoints array<struct<elapsed_seconds double>>").json(f"{where}/documents")
    return back.groupBy("isolation").agg(F.count("*").alias("n"), F.sum(F.size("checkpoints")).cast("long").alias("n_checkpoints"), F.count_if(F.exists("checkpoints", lambda c: c["elapsed_seconds"] >= 1.0)).alias("later"))


@query("select 'agent' || (n_nationkey % 2) as agent, count(*) as n, sum((n_nationkey % 7 <> 3)::int)::bigint as graded, sum((n_nationkey % 7 <> 3 and n_regionkey = 1)::int)::bigint as medals from nation group by 1")
def file_session(spark: SparkSession, d: str) -> DataFrame:
    """A tree of agents' runs with their grades, one grades document corrupt (SRC-11)."""
    where = folder(spark, "session")
    for n in nations(spark, d):
        k = n["n_nationkey"]
        put(spark, f"{where}/runs/agent{k % 2}/c{k}__seed0/metadata.json", json.dumps({"competition_id": f"c{k}", "seed": 0}))
        report = {"reports": [{"competition_id": f"c{k}", "seed": 0, "score": 0.5, "any_medal": n["n_regionkey"] == 1, "valid_submission": True}]}
        put(spark, f"{where}/grades/agent{k % 2}/g{k}.json", "{corrupt" if k % 7 == 3 else json.dumps(report))
    found, grades = files.session(spark, where), files.grades(spark, where).select("agent", "item", "medal")
    both = found.join(grades, ["agent", "item"], "left")
    return both.groupBy("agent").agg(F.count("*").alias("n"), F.count("medal").alias("graded"), F.count_if("medal").alias("medals"))


# Submissions and tasks


@query("select run, 'k,' || id || '\"' as id, raw from subs", "subs")
def file_submission(spark: SparkSession, d: str) -> DataFrame:
    """CSV files of all runs, columns in another order, ids with commas and quotes in them (SRC-12)."""
    where = folder(spark, "submissions")
    rows = fx.submissions(spark, d).select(F.replace("run", F.lit("/"), F.lit("~")).alias("of"), F.col("raw").alias("y,x"), F.concat(F.lit("k,"), F.col("id"), F.lit('"')).alias("id"))
    rows.write.partitionBy("of").option("header", True).option("escape", '"').csv(where)
    got = files.submission(spark, where, "id", "y,x", run=r"/of=([^/]+)/[^/]+$")
    return got.select(F.replace("run", F.lit("~"), F.lit("/")).alias("run"), "id", "raw")


@query("select 't' || l_partkey as competition_id, l_linenumber::bigint as seed, 's/' || l_orderkey || '.csv' as submission_path from lineitem where l_quantity > 25.0::double")
def file_submissions_list(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines of the runs that have a submission (SNK-01), with comments and blank lines added, read again (SRC-13)."""
    where = folder(spark, "jsonl")
    li = fx.table(spark, d, "lineitem")
    sinks.write_submissions(li.select(F.concat(F.lit("t"), F.col("l_partkey")).alias("competition_id"), F.col("l_linenumber").alias("seed"), F.concat(F.lit("s/"), F.col("l_orderkey"), F.lit(".csv")).alias("submission_path"), (F.col("l_quantity") > 25.0).alias("has_submission")), f"{where}/rows")
    spark.read.text(f"{where}/rows").union(spark.createDataFrame([("# a note",), ("",), ("  // more",)], "value string")).write.text(f"{where}/list")
    return files.submissions_jsonl(spark, f"{where}/list").select("competition_id", F.col("seed").cast("long").alias("seed"), "submission_path")


@query("select task, id, y from answers", "answers")
def file_answers(spark: SparkSession, d: str) -> DataFrame:
    """A JSON map of answers a task (SRC-14)."""
    where = folder(spark, "answers")
    a = fx.answers(spark, d)
    a.groupBy("task").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", "y")))).alias("value")).write.partitionBy("task").text(where)
    return files.answers(spark, where).select(F.regexp_replace("task", "^task=", "").alias("task"), "id", "y")


@query("select task, count(*) as n, round(sum(score), 6) as total, round(max(score), 9) as top from leaderboard group by task", "leaderboard")
def file_leaderboards(spark: SparkSession, d: str) -> DataFrame:
    """A JSON array of scores a task (SRC-14)."""
    where = folder(spark, "leaderboards")
    fx.leaderboard(spark, d).groupBy("task").agg(F.to_json(F.collect_list("score")).alias("value")).write.partitionBy("task").text(where)
    got = files.leaderboards(spark, where)
    return got.groupBy(F.regexp_replace("task", "^task=", "").alias("task")).agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"), F.round(F.max("score"), 9).alias("top"))


@query("select 'c' || n_nationkey as competition_id, case when n_nationkey % 2 = 0 then 'rmse' else 'auc' end as metric, n_nationkey % 2 = 0 as is_lower_better, (n_nationkey / 10.0)::double as gold, (n_regionkey = 0) as no_target from nation")
def file_task_specs(spark: SparkSession, d: str) -> DataFrame:
    """competition.json documents, with keys unknown or missing (SRC-14)."""
    where = folder(spark, "specs")
    for n in nations(spark, d):
        k = n["n_nationkey"]
        doc = {"competition_id": f"c{k}", "metric": "auc" if k % 2 else "rmse", "is_lower_better": k % 2 == 0, "id_column": "id", "thresholds": {"gold": k / 10, "n_teams": 9}, "extra": [1]} | ({"target_column": "y"} if n["n_regionkey"] else {})
        put(spark, f"{where}/c{k}/competition.json", json.dumps(doc, indent=1))
    return files.task_specs(spark, f"{where}/*").select("competition_id", "metric", "is_lower_better", "thresholds.gold", F.col("target_column").isNull().alias("no_target"))


@query("select 'a' || subject as agent, challenge, unit, round(control, 9) as control, round(challenged, 9) as challenged from (select agent, replace(agent, 'a', '') as subject, challenge, unit::bigint as unit, control, challenged from pairs)", "pairs")
def file_cells(spark: SparkSession, d: str) -> DataFrame:
    """A document of cells (SRC-18)."""
    where = folder(spark, "cells")
    p = fx.skill_pairs(spark, d)
    p.groupBy("agent").agg(F.to_json(F.struct(F.collect_list(F.struct("agent", "challenge", "unit", "control", "challenged")).alias("cells"))).alias("value")).write.partitionBy("agent").text(where)
    got = files.cells_json(spark, where, "agent string, challenge string, unit long, control double, challenged double")
    return got.select("agent", "challenge", "unit", F.round("control", 9).alias("control"), F.round("challenged", 9).alias("challenged"))


@query("select conv_id::varchar as run, test, kind from (select distinct conv_id from conversations), (values ('tests::t0', 'f2p'), ('tests::t1', 'p2p'), ('tests::t2', 'p2p')) as e(test, kind)")
def file_instances(spark: SparkSession, d: str) -> DataFrame:
    """Instance documents (SRC-19)."""
    where = folder(spark, "instances")
    e = fx.expected_tests(spark, d)
    of = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("test"))))
    e.groupBy(F.col("run").cast("string").alias("instance_id")).agg(of("f2p").alias("FAIL_TO_PASS"), of("p2p").alias("PASS_TO_PASS")).write.json(where)
    return files.instances(spark, where, lines=True)


@query("select 'c' || n_nationkey as task, 'id_' || n_regionkey as id_column, 'y' as target_column, case when n_nationkey % 4 = 1 then 0.0::double end as low, case when n_nationkey % 4 = 1 then 1.5::double end as high, case when n_nationkey % 2 = 1 then 'binary' else 'regression' end as kind from nation where n_nationkey % 5 <> 0")
def file_grader_schemas(spark: SparkSession, d: str) -> DataFrame:
    """Schemas read out of graders' source text; what lacks a column is left out (SRC-20)."""
    where = folder(spark, "graders")
    for n in nations(spark, d):
        k = n["n_nationkey"]
        check = "    assert frame['y'].between(0.0, 1.5).all()\n" if k % 4 == 1 else ""
        target = '    TARGET_COLUMN = "y"\n' if k % 5 else ""
        score = "roc_auc_score(a, b)" if k % 2 else "root_mean_squared_error(a, b)"
        put(spark, f"{where}/c{k}/grade.py", f"def grade(frame):\n    ID_COL = 'id_{n['n_regionkey']}'\n{target}{check}    return {score}\n")
    return files.grader_schemas(spark, f"{where}/*")


@query("select 'f' || (n_nationkey % 10) as fingerprint, max(n_nationkey)::double as answer from nation group by 1")
def file_memory(spark: SparkSession, d: str) -> DataFrame:
    """JSON maps of fingerprints to answers, a later file before an earlier one (SRC-21)."""
    where = folder(spark, "memory")
    for n in nations(spark, d):
        put(spark, f"{where}/{n['n_nationkey']:03d}.json", json.dumps({f"f{n['n_nationkey'] % 10}": float(n["n_nationkey"])}))
    return files.memory(spark, where).groupBy("fingerprint").agg(F.max_by("answer", "priority").alias("answer"))


# Writers without a reader of their own


@query("select count(*) as submissions, sum(medal::int)::bigint as medals, round(avg(medal::int::double), 9) as any_medal_rate, count(distinct item || '|' || seed) as keys from (select item, seed, bool_or(medal) as medal from runs group by all)", "runs")
def file_grading_summary(spark: SparkSession, d: str) -> DataFrame:
    """The summary of grades with its map of runs to medals (SNK-02)."""
    grades = fx.runs(spark, d).groupBy("item", "seed").agg(F.bool_or("medal").alias("medal"))
    s = sinks.grading_summary(grades)
    return s.select("submissions", "medals", F.round("any_medal_rate", 9).alias("any_medal_rate"), F.size("by_run").cast("long").alias("keys"))


@query("""select event_id as run, case when g.item is null then validation_error else error end as validation_error from (select event_id, event_id % 17 as item, event_id % 5 as seed, case when event_id % 31 = 0 then 'missing ids: 3' end as validation_error from events) a
  left join (select n_nationkey % 17 as item, n_nationkey % 5 as seed, arg_max(case when n_regionkey < 2 then n_name else '' end, n_nationkey) as error from nation group by all) g on g.item = a.item and g.seed = a.seed""")
def file_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts with the latest verdicts; those without a grade keep their own (SNK-03)."""
    k = F.col("n_nationkey")
    grades = fx.table(spark, d, "nation").select((k % 17).alias("item"), (k % 5).alias("seed"), F.when(F.col("n_regionkey") < 2, F.col("n_name")).otherwise("").alias("error"), k.alias("graded_at"))
    return sinks.verdicts(fx.artifacts(spark, d), grades).select("run", "validation_error")
