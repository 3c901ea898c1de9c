"""Benchmark tables derived from the driver's tables, as DataFrames and, independently, as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.functions import expr

LANGS = ("de", "en", "es", "fr")
AGENTS = ("const", "length", "dup", "text", "miss", "extra")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def runs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    subject, item = F.col("l_suppkey") % 10, F.col("l_partkey") % 20
    infra = (F.col("l_discount") == 0.1) & (F.col("l_tax") == 0.0)
    medal = ~infra & (F.col("l_quantity") + 5.5 * (item - 5) <= 26.0 + 5.0 * subject)
    return li.select(subject.alias("subject"), item.alias("item"), F.col("l_linenumber").cast("long").alias("seed"), infra.alias("infra_failure"), medal.alias("medal"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    good = runs(spark, d).where("not infra_failure")
    return good.groupBy("subject", "item").agg(F.sum(F.col("medal").cast("long")).alias("successes"), F.count("*").alias("trials"), F.avg(F.col("medal").cast("double")).alias("rate"))


def arms(spark: SparkSession, d: str) -> DataFrame:
    """unit, arm, rate, seeds: each order as a unit, its lines as seeds, even suppliers as arm a and odd ones as arm b."""
    li = table(spark, d, "lineitem").where("not (l_discount = 0.1 and l_tax = 0.0)")
    medal = (F.col("l_quantity") + 5.5 * (F.col("l_partkey") % 20 - 5) <= 26.0 + 5.0 * (F.col("l_suppkey") % 10)).cast("double")
    arm = F.when(F.col("l_suppkey") % 2 == 0, "a").otherwise("b")
    return li.groupBy(F.col("l_orderkey").alias("unit"), arm.alias("arm")).agg(F.avg(medal).alias("rate"), F.count("*").alias("seeds"))


def tiers(items: DataFrame) -> DataFrame:
    return items.withColumn("tier", F.when(F.col("item") < 8, "low").when(F.col("item") < 16, "medium").otherwise("high"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return both.select(F.col("lang").alias("task"), F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("double").alias("y"), "doc_id", "n_chars")


def submissions(spark: SparkSession, d: str) -> DataFrame:
    """run, task, line_no, id, raw: six agents on each task, four of them malformed in their own way."""
    a = answers(spark, d).withColumn("agent", F.explode(F.array(*map(F.lit, AGENTS))))
    value = F.concat(F.lit("0."), F.lpad((F.col("n_chars") % 1000).cast("string"), 3, "0"))
    raw = F.when(F.col("agent") == "const", "0.5").when((F.col("agent") == "text") & (F.col("doc_id") % 89 == 0), "abc").otherwise(value)
    rows = a.where(~((F.col("agent") == "miss") & (F.col("doc_id") % 83 == 0))).select(F.concat_ws("/", "agent", "task").alias("run"), "task", (F.col("doc_id") * 2 + 2).alias("line_no"), "id", raw.alias("raw"), "agent", "doc_id")
    again = rows.where((F.col("agent") == "dup") & (F.col("doc_id") % 97 == 0)).withColumn("line_no", F.col("line_no") + 1)
    extra = rows.where((F.col("agent") == "extra") & (F.col("doc_id") % 101 == 0)).withColumn("line_no", F.col("line_no") + 1).withColumn("id", F.concat(F.lit("x"), F.col("id")))
    return rows.union(again).union(extra).select("run", "task", "line_no", "id", "raw")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """run, task, y, p of agent length."""
    return answers(spark, d).select(F.concat(F.lit("length/"), F.col("task")).alias("run"), "task", "y", ((F.col("n_chars") % 1000) / 1000.0).alias("p"))


def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    langs = F.array(*map(F.lit, LANGS))
    return p.select(F.get(langs, (F.col("p_partkey") % 4).cast("int")).alias("task"), F.col("p_partkey").alias("team"), (F.col("p_retailprice") / 4096.0).alias("score"))


HARNESS_LINES = (
    "ok", "Spot ITN received", "GET computeMetadata/v1/instance/preempted", "Preempted by pod x on node n1", "The node was low on resource: memory", "pod x: ErrImagePull", "x FailedMount y", "docker daemon is not running",
    "write failed: No space left on device", "all quiet",
)
AGENT_LINES = ("epoch 1", "RuntimeError: CUDA out of memory. Tried 2 GiB", "ResourceExhaustedError: OOM", "Killed process 77 (python) total-vm:1kB", "loss 0.3", "No space left on device", "done")


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    pick = lambda lines, n: F.get(F.array(*map(F.lit, lines)), (F.col("event_id") % n).cast("int"))
    i = F.col("event_id")
    harness = F.when(i % 13 == 0, pick(HARNESS_LINES, 10)).otherwise("")
    agent = F.concat(F.lit("start\n"), pick(AGENT_LINES, 7), F.lit("\nend"))
    code = F.when(F.col("event_type") == "error", F.when(i % 4 == 0, 137).when(i % 4 == 1, 124).when(i % 4 == 2, 1).otherwise(0)).otherwise(0)
    return e.select(
        i.alias("run"), F.col("user_id").alias("subject"), (i % 17).alias("item"), (i % 5).alias("seed"), F.when(i % 101 == 0, "harness died").alias("harness_error"), harness.alias("harness_log"), agent.alias("agent_log"),
        F.col("event_type").isin("view", "purchase").alias("has_submission"), F.when(i % 29 == 0, 0).otherwise(10).alias("submission_rows"), F.when(i % 31 == 0, "missing ids: 3").alias("validation_error"), code.alias("exit_code"),
        (i % 400).cast("double").alias("wall_clock"), F.when(i % 3 == 0, 300.0).alias("time_cap"), F.when(i % 2 == 0, "docker").when(i % 7 == 0, "none").alias("isolation"),
    )


def checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """run, at (seconds since 2024 began), sha."""
    e = table(spark, d, "events")
    at = F.datediff("ts", F.lit("2024-01-01").cast("date")) * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return e.select(F.col("user_id").alias("run"), at.cast("long").alias("at"), F.md5(F.concat_ws("|", "event_type", F.substring("props", 1, 6)).cast("binary")).alias("sha")).groupBy("run", "at").agg(F.max("sha").alias("sha"))


def marks(spark: SparkSession, d: str) -> DataFrame:
    return checkpoints(spark, d).select("run").distinct().withColumn("mark", F.explode(F.sequence(F.lit(86400).cast("long"), F.lit(86400 * 30).cast("long"), F.lit(86400).cast("long"))))


STATUSES = ("PASSED", "FAILED", "XPASS", "PASSED", "ERROR")


def test_logs(spark: SparkSession, d: str) -> DataFrame:
    from tallywork.operators import swe

    c = table(spark, d, "conversations")
    status = F.get(F.array(*map(F.lit, STATUSES)), ((F.col("turn") + F.col("conv_id")) % 5).cast("int"))
    line = F.concat(status, F.lit(" tests::t"), (F.col("turn") % 3).cast("string"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n")
    log = F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit("x\n"), F.col("t"))).otherwise(F.concat(F.lit(f"x\n{swe.START}\n"), F.col("t"), F.lit(f"\n{swe.END}\nPASSED tests::t9")))
    return c.groupBy("conv_id").agg(text.alias("t")).select(F.col("conv_id").alias("run"), log.alias("log"))


def expected_tests(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id").distinct()
    return c.select(F.col("conv_id").alias("run"), F.explode(F.array(*[F.struct(F.lit(f"tests::t{k}").alias("test"), F.lit("f2p" if k == 0 else "p2p").alias("kind")) for k in range(3)])).alias("e")).select("run", "e.test", "e.kind")


def probe(spark: SparkSession, d: str) -> DataFrame:
    """agent, item, is_clone, transform, percentile, medal, valid, recalled."""
    r = runs(spark, d).groupBy("subject", "item").agg(F.avg(F.col("medal").cast("double")).alias("own"), F.count("*").alias("n"), F.max("seed").alias("top"))
    item = F.concat(F.lit("task_"), F.col("item").cast("string"))
    base = [F.concat(F.lit("a"), F.col("subject").cast("string")).alias("agent")]
    orig = r.select(*base, item.alias("item"), F.lit(False).alias("is_clone"), F.lit(None).cast("string").alias("transform"), F.col("own").alias("percentile"), (F.col("own") > 0.5).alias("medal"), (F.col("n") % 7 != 0).alias("valid"), (F.col("subject") == 9).alias("recalled"))
    clone = r.select(*base, F.concat(item, F.lit("__relabel")).alias("item"), F.lit(True).alias("is_clone"), F.lit("relabel").alias("transform"), F.when(F.col("subject") == 9, F.col("own") / 2).otherwise(F.col("own")).alias("percentile"), (F.col("own") > 0.6).alias("medal"), (F.col("n") % 5 != 0).alias("valid"), F.lit(False).alias("recalled"))
    return orig.union(clone)


def skill_pairs(spark: SparkSession, d: str) -> DataFrame:
    """agent, challenge, unit, control, challenged: even items against the odd ones after them, ten units a cell."""
    c = cells(spark, d)
    control = c.where("item % 2 = 0").select("subject", (F.col("item") / 2).cast("long").alias("unit"), F.col("rate").alias("control"))
    hard = c.where("item % 2 = 1").select("subject", ((F.col("item") - 1) / 2).cast("long").alias("unit"), F.col("rate").alias("challenged"))
    both = control.join(hard, ["subject", "unit"]).withColumn("challenge", F.explode(F.array(F.lit("leak"), F.lit("shift"))))
    got = F.when((F.col("challenge") == "shift") & (F.col("subject") == 3), None).when(F.col("challenge") == "shift", F.col("challenged") + 0.02 * F.col("subject")).when((F.col("unit") == 7) & (F.col("subject") == 4), None).otherwise(F.col("challenged"))
    return both.select(F.concat(F.lit("a"), F.col("subject").cast("string")).alias("agent"), "challenge", "unit", "control", got.alias("challenged"))


def features(spark: SparkSession, d: str) -> DataFrame:
    """row, feature, x: all numbers of each vector, every eleventh missing, some wild."""
    v = table(spark, d, "embeddings")
    rows = v.select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("feature", "x"))
    x = F.when((F.col("row") + F.col("feature")) % 11 == 0, None).when((F.col("feature") == 2) & (F.col("row") % 97 == 0), F.col("x").cast("double") * 1000.0).otherwise(F.col("x").cast("double"))
    return rows.select("row", F.col("feature").cast("long").alias("feature"), x.alias("x"))


def targets(spark: SparkSession, d: str) -> DataFrame:
    """row, y: the first feature, nearly."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), (F.get("embedding", F.lit(0)).cast("double") * 2.0 + F.col("label").cast("double") * 0.001).alias("y"))


def sql_case(values: tuple[str, ...], by: str) -> str:
    return "(case " + by + "".join(f" when {k} then '{v}'" for k, v in enumerate(values)) + " end)"


SQL = {
    "runs": "select l_suppkey % 10 as subject, l_partkey % 20 as item, l_linenumber::bigint as seed, (l_discount = 0.1::double and l_tax = 0.0::double) as infra_failure, (not (l_discount = 0.1::double and l_tax = 0.0::double) and l_quantity + 5.5::double * ((l_partkey % 20) - 5) <= 26.0::double + 5.0::double * (l_suppkey % 10)) as medal from lineitem",
    "cells": "select subject, item, sum(medal::int)::bigint as successes, count(*) as trials, avg(medal::int::double) as rate from runs where not infra_failure group by all",
    "arms": "select l_orderkey as unit, case when l_suppkey % 2 = 0 then 'a' else 'b' end as arm, avg((l_quantity + 5.5::double * ((l_partkey % 20) - 5) <= 26.0::double + 5.0::double * (l_suppkey % 10))::int::double) as rate, count(*) as seeds from lineitem where not (l_discount = 0.1::double and l_tax = 0.0::double) group by all",
    "answers": "select lang as task, doc_id::varchar as id, quality::double as y, doc_id, n_chars from labels join documents using (doc_id)",
    "subs0": f"""select agent || '/' || task as run, task, doc_id * 2 + 2 as line_no, id, case when agent = 'const' then '0.5' when agent = 'text' and doc_id % 89 = 0 then 'abc' else '0.' || lpad((n_chars % 1000)::varchar, 3, '0') end as raw, agent, doc_id
      from answers, (select unnest({list(AGENTS)}) as agent) where not (agent = 'miss' and doc_id % 83 = 0)""",
    "subs": "select run, task, line_no, id, raw from subs0 union all select run, task, line_no + 1, id, raw from subs0 where agent = 'dup' and doc_id % 97 = 0 union all select run, task, line_no + 1, 'x' || id, raw from subs0 where agent = 'extra' and doc_id % 101 = 0",
    "predictions": "select 'length/' || task as run, task, y, (n_chars % 1000) / 1000.0::double as p from answers",
    "leaderboard": f"select {sql_case(LANGS, 'p_partkey % 4')} as task, p_partkey as team, p_retailprice / 4096.0::double as score from part",
    "artifacts": f"""select event_id as run, user_id as subject, event_id % 17 as item, event_id % 5 as seed, case when event_id % 101 = 0 then 'harness died' end as harness_error, case when event_id % 13 = 0 then {sql_case(HARNESS_LINES, 'event_id % 10')} else '' end as harness_log,
      'start' || chr(10) || {sql_case(AGENT_LINES, 'event_id % 7')} || chr(10) || 'end' as agent_log, event_type in ('view', 'purchase') as has_submission, case when event_id % 29 = 0 then 0 else 10 end as submission_rows, case when event_id % 31 = 0 then 'missing ids: 3' end as validation_error,
      case when event_type = 'error' then case event_id % 4 when 0 then 137 when 1 then 124 when 2 then 1 else 0 end else 0 end as exit_code, (event_id % 400)::double as wall_clock, case when event_id % 3 = 0 then 300.0::double end as time_cap,
      case when event_id % 2 = 0 then 'docker' when event_id % 7 = 0 then 'none' end as isolation from events""",
    "found": """select *, case when harness_log = 'Spot ITN received' then 'spot-interruption' when harness_log like '%instance/preempted' then 'gcp-preemption' when harness_log like 'Preempted by pod%' then 'preemption' when harness_log like 'The node was low%' then 'node-pressure-eviction' when harness_log like '%ErrImagePull%' then 'image-pull' when harness_log like '%FailedMount%' then 'mount' when harness_log like 'docker daemon%' then 'docker-daemon' when harness_log like '%No space left%' then 'disk-full' end as infra_signal,
      case when agent_log like '%CUDA out of memory%' then 'cuda-oom' when agent_log like '%ResourceExhaustedError%' then 'tensorflow-oom' when agent_log like '%Killed process%' then 'host-oom' end as mem_signal, coalesce(wall_clock >= time_cap * 0.99::double, false) as capped from artifacts""",
    "triaged": """select *, case when harness_error is not null then 'infra' when infra_signal is not null then 'infra' when has_submission and validation_error is null and submission_rows = 0 then 'invalid_submission' when has_submission and validation_error is null then 'valid'
      when validation_error is not null then 'invalid_submission' when capped then 'timeout' when mem_signal is not null then 'oom' when exit_code = 124 then 'timeout' when exit_code = 137 then 'oom' when exit_code <> 0 then 'crash' else 'no_submission' end as outcome,
      case when harness_error is not null then 'harness-error' when infra_signal is not null then infra_signal when has_submission and validation_error is null and submission_rows = 0 then 'empty-submission' when has_submission and validation_error is null then null
      when validation_error is not null then 'grader-rejected' when capped then 'wall-clock' when mem_signal is not null then mem_signal when exit_code <> 0 then 'exit-code' else 'clean-exit' end as signal from found""",
    "checkpoints": "select user_id as run, (date_diff('day', date '2024-01-01', ts::date) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts))::bigint as at, max(md5(event_type || '|' || substr(props, 1, 6))) as sha from events group by all",
    "marks": "select run, unnest(range(86400, 86400 * 31, 86400)) as mark from (select distinct run from checkpoints)",
    "marked": "select marks.run, mark, sha from marks asof join checkpoints on marks.run = checkpoints.run and marks.mark >= checkpoints.at",
    "statuses": f"select conv_id as run, 'tests::t' || (turn % 3) as test, replace(arg_max({sql_case(STATUSES, '(turn + conv_id) % 5')}, turn), 'XPASS', 'XFAIL') as status from conversations group by all",
    "probe": """select 'a' || subject as agent, 'task_' || item as item, false as is_clone, avg(medal::int::double) as percentile, avg(medal::int::double) > 0.5 as medal, count(*) % 7 <> 0 as valid, subject = 9 as recalled from runs group by subject, runs.item
      union all select 'a' || subject, 'task_' || item || '__relabel', true, case when subject = 9 then avg(medal::int::double) / 2 else avg(medal::int::double) end, avg(medal::int::double) > 0.6, count(*) % 5 <> 0, false from runs group by subject, runs.item""",
    "pairs": """select 'a' || c.subject as agent, challenge, c.item // 2 as unit, c.rate as control, case when challenge = 'shift' and c.subject = 3 then null when challenge = 'shift' then h.rate + 0.02::double * c.subject when c.item // 2 = 7 and c.subject = 4 then null else h.rate end as challenged
      from cells c join cells h on c.subject = h.subject and h.item = c.item + 1, (select unnest(['leak', 'shift']) as challenge) where c.item % 2 = 0""",
    "features": "select row, feature, case when (row + feature) % 11 = 0 then null when feature = 2 and row % 97 = 0 then x::double * 1000.0::double else x::double end as x from (select vec_id as row, unnest(range(len(embedding))) as feature, unnest(embedding) as x from embeddings)",
    "targets": "select vec_id as row, embedding[1]::double * 2.0::double + label::double * 0.001::double as y from embeddings",
}
NEEDS = {"cells": ["runs"], "subs0": ["answers"], "subs": ["subs0"], "predictions": ["answers"], "found": ["artifacts"], "triaged": ["found"], "marks": ["checkpoints"], "marked": ["marks"], "probe": ["runs"], "pairs": ["cells"]}


def sql(body: str, *names: str) -> str:
    """body with the named fixtures, and what they need, before it."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in order) + " " + body if order else body
