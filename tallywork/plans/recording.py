"""Queries over runs, submissions, outcomes, logs and checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.functions import expr, metrics
from tallywork.operators import grading, runs, skills, swe, triage
from tallywork.plans import fixtures as fx
from tallywork.plans.catalog import query, rounded
from tallywork.streaming import checkpoints as ck

# Runs


@query("select subject, round(avg(rate), 9) as macro_rate, count(*) as n_items from (select subject, item, avg(medal::int::double) as rate from runs where not infra_failure group by all) group by subject", "runs")
def macro_rate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(runs.macro_rate(fx.runs(spark, d), ["subject"]))


@query("select subject, round(avg(medal::int::double), 9) as micro_rate, count(*) filter (medal) as medals, count(*) as submissions from runs group by subject", "runs")
def micro_rate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(runs.micro_rate(fx.runs(spark, d), ["subject"]))


@query("select subject, round(avg(r), 9) as graded_macro_rate from (select subject, item, avg(medal::int::double) as r from runs where not infra_failure group by all) group by subject", "runs")
def graded_macro_rate(spark: SparkSession, d: str) -> DataFrame:
    graded = fx.runs(spark, d).where("not infra_failure")
    return rounded(graded.groupBy("subject", "item").agg(F.avg(F.col("medal").cast("double")).alias("r")).groupBy("subject").agg(F.avg("r").alias("graded_macro_rate")))


@query("select subject, item, round(rate, 9) as rate, trials as seeds from cells", "cells")
def rate_by_item(spark: SparkSession, d: str) -> DataFrame:
    return rounded(runs.rate_by_item(fx.runs(spark, d), ["subject"]))


@query("select subject, count(*) as total, count(*) filter (infra_failure) as infra, count(*) filter (not infra_failure) as effective from runs group by subject", "runs")
def infra_excluded_denominator(spark: SparkSession, d: str) -> DataFrame:
    return runs.denominators(fx.runs(spark, d), ["subject"])


@query("select item from runs where not infra_failure and subject < 5 and item < 15 intersect select item from runs where not infra_failure and subject >= 5 and item > 4", "runs")
def shared_items(spark: SparkSession, d: str) -> DataFrame:
    r = fx.runs(spark, d)
    return runs.shared_items(r.where("subject < 5 and item < 15"), r.where("subject >= 5 and item > 4"))


@query("select distinct item, case when item <= 4 then 'a' else 'b' end as side from runs where (item <= 4 and subject < 5 or item >= 15 and subject >= 5) and not infra_failure", "runs")
def dropped_items(spark: SparkSession, d: str) -> DataFrame:
    r = fx.runs(spark, d)
    return runs.dropped_items(r.where("subject < 5 and item < 15"), r.where("subject >= 5 and item > 4"))


@query("select o_orderkey as pair, '[' || array_to_string(list_filter([case when o_orderstatus <> o_orderpriority[1:1] then 'split_id: ' || o_orderstatus || ' vs ' || o_orderpriority[1:1] end, case when o_custkey % 2 <> 0 then 'container_config: default vs gpu' end], lambda x: x is not null), ', ') || ']' as conflicts from orders")
def fingerprint_conflicts(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders")
    known = F.lit("1")
    pair = o.select(F.col("o_orderkey").alias("pair"), F.struct(F.col("o_orderstatus").alias("split_id"), F.lit("default").alias("container_config"), known.alias("harness_version")).alias("a"), F.struct(F.substring("o_orderpriority", 1, 1).alias("split_id"), F.when(F.col("o_custkey") % 2 != 0, "gpu").otherwise("default").alias("container_config"), known.alias("harness_version")).alias("b"))
    return pair.select("pair", F.concat(F.lit("["), F.array_join(runs.conflicts("a", "b"), ", "), F.lit("]")).alias("conflicts"))


@query("select subject, count(distinct item) as n_items from runs where not infra_failure and not (subject = 3 and item = 7) group by subject having count(distinct item) = (select count(distinct item) from runs where not infra_failure)", "runs")
def complete_subjects(spark: SparkSession, d: str) -> DataFrame:
    return runs.complete_subjects(fx.runs(spark, d).where("not (subject = 3 and item = 7)"))


@query("select subject, count(*) as n_items, round(avg(rate), 9) as mean_rate, count(*) filter (rate = 0) as never, count(*) filter (rate = 1) as always from cells group by subject", "cells")
def pool_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(runs.pool_summary(fx.runs(spark, d)))


@query("select subject, round(avg(rate), 9) as macro_rate from cells group by subject order by avg(rate) desc, subject limit 4", "cells")
def frontier_top_n(spark: SparkSession, d: str) -> DataFrame:
    return rounded(runs.frontier(fx.runs(spark, d), 4))


@query("select i.item, s.seed, coalesce(v, 'none') as value from (select distinct item from runs) i cross join (select distinct seed from runs) s left join (select item, seed, arg_max(case when medal then 'medal' else 'miss' end, subject) as v from (select item, seed, subject, bool_or(medal) as medal from runs where (item + seed) % 4 <> 0 group by all) group by all) r on i.item = r.item and s.seed = r.seed", "runs")
def dense_grid(spark: SparkSession, d: str) -> DataFrame:
    r = fx.runs(spark, d)
    known = r.where("(item + seed) % 4 <> 0").groupBy("item", "seed", F.col("subject").alias("ord")).agg(F.bool_or("medal").alias("medal"))
    labels = r.select("item", "seed", F.lit(-1).cast("long").alias("ord"), F.lit(None).cast("boolean").alias("medal")).distinct()
    both = known.unionByName(labels).withColumn("v", F.when(F.col("medal"), "medal").when(~F.col("medal"), "miss"))
    return runs.dense_grid(both, F.col("v"), "none")


STANDING = "select subject, round(avg(rate), 9) as medal_rate, round(avg(greatest(rate - 0.1::double, 0)), 9) as mean_percentile, round(avg((trials % 2)::double), 9) as valid_rate from cells group by subject"


def _standings(spark: SparkSession, d: str) -> DataFrame:
    c = fx.cells(spark, d)
    return rounded(c.groupBy("subject").agg(F.avg("rate").alias("medal_rate"), F.avg(F.greatest(F.col("rate") - 0.1, F.lit(0.0))).alias("mean_percentile"), F.avg((F.col("trials") % 2).cast("double")).alias("valid_rate")))


@query(f"select *, row_number() over (order by medal_rate desc, coalesce(mean_percentile, 0) desc, valid_rate desc, subject) as place from ({STANDING})", "cells")
def standing_ranked(spark: SparkSession, d: str) -> DataFrame:
    return rounded(runs.standings(_standings(spark, d)))


@query(f"with s as ({STANDING.replace('from cells', 'from (with runs as (' + fx.SQL['runs'] + '), cells as (' + fx.SQL['cells'] + ') select * from cells)')}), t as (select least(medal_rate, 0.5::double) as medal_rate, mean_percentile from s) select count(*) >= 2 and max(medal_rate) > 0 and max(mean_percentile) - min(mean_percentile) > 0.01 as is_saturated, count(*) as n_tied from t where medal_rate = (select max(medal_rate) from t)")
def saturation_flag(spark: SparkSession, d: str) -> DataFrame:
    return runs.saturated(_standings(spark, d).withColumn("medal_rate", F.least("medal_rate", F.lit(0.5))))


@query("select subject * 100 + item as item, seed, bool_or(medal) and not bool_or(infra_failure) as medal, bool_or(infra_failure) as infra_failure from runs group by subject, runs.item, seed", "runs")
def medals_to_runs(spark: SparkSession, d: str) -> DataFrame:
    r = fx.runs(spark, d).withColumn("item", F.col("subject") * 100 + F.col("item")).groupBy("item", "seed").agg(F.bool_or("medal").alias("medal"), F.bool_or("infra_failure").alias("ended"))
    return runs.with_medals(r.select("item", "seed", F.when(F.col("ended"), "infra").otherwise("valid").alias("outcome")), r)


# Grading


def _metric(name: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        p = fx.predictions(spark, d)
        if name == "rmsle":
            p = p.withColumn("p", F.when(F.col("task") == "fr", F.col("p") - 1.5).otherwise(F.col("p")))
        return rounded(metrics.scored(p, ["run"], name))

    f.__name__ = f"metric_{name}"
    return f


_SCORE = {
    "accuracy": "avg((y = round_even(p, 0))::int::double)", "rmse": "sqrt(avg((y - p) * (y - p)))", "mae": "avg(abs(y - p))",
    "log_loss": "-avg(y * ln(greatest(least(p, 1 - 1e-15::double), 1e-15::double)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-15::double), 1e-15::double)))",
}
for _name, _sql in _SCORE.items():
    query(f"select run, round({_sql}, 9) as score, null::varchar as error from predictions group by run", "predictions")(_metric(_name))
query("select run, round(case when max(task) <> 'fr' then sqrt(avg(pow(ln(1 + y) - ln(1 + p), 2))) end, 9) as score, case when max(task) = 'fr' then 'rmsle is undefined here' end as error from predictions group by run", "predictions")(_metric("rmsle"))
query("select run, round((sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0::double) / (count(*) filter (y = 1) * nullif(count(*) filter (y = 0), 0)), 9) as score, case when count(*) filter (y = 0) = 0 or count(*) filter (y = 1) = 0 then 'auc is undefined here' end as error from (select *, rank() over (partition by run order by p) + (count(*) over (partition by run, p) - 1) / 2.0::double as r from predictions) group by run", "predictions")(_metric("auc"))


@query("""with n as (select unnest(range(1, 3000, 7)) as n), raw as (select n, case when n < 100 then floor(n * 0.1::double) when n < 250 then 10 when n < 1000 then 10 + floor(n * 0.002::double) else 10 + floor(n * 0.002::double) end as g, case when n < 100 then floor(n * 0.2::double) when n < 250 then 20 when n < 1000 then 50 else floor(n * 0.05::double) end as s, case when n < 250 then floor(n * 0.4::double) when n < 1000 then 100 else floor(n * 0.1::double) end as b from n)
select n, greatest(g, 1)::bigint as gold, least(greatest(s, greatest(g, 1)), n)::bigint as silver, least(greatest(b, least(greatest(s, greatest(g, 1)), n)), n)::bigint as bronze from raw""")
def medal_ranks(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, 3000, 7).withColumnRenamed("id", "n").select("n", expr.medal_ranks(F.col("n")).alias("r")).select("n", "r.gold", "r.silver", "r.bronze")


LIMITS = """n as (select task, count(*) as n_teams from leaderboard group by task), raw as (select task, n_teams, case when n_teams < 100 then floor(n_teams * 0.1::double) when n_teams < 250 then 10 else 10 + floor(n_teams * 0.002::double) end as g0, case when n_teams < 100 then floor(n_teams * 0.2::double) when n_teams < 250 then 20 when n_teams < 1000 then 50 else floor(n_teams * 0.05::double) end as s0, case when n_teams < 250 then floor(n_teams * 0.4::double) when n_teams < 1000 then 100 else floor(n_teams * 0.1::double) end as b0 from n),
limits as (select l.task, n_teams, max(score) filter (pl = greatest(g0, 1)) as gold, max(score) filter (pl = least(greatest(s0, greatest(g0, 1)), n_teams)) as silver, max(score) filter (pl = least(greatest(b0, least(greatest(s0, greatest(g0, 1)), n_teams)), n_teams)) as bronze, median(score) as median from (select *, row_number() over (partition by task order by score desc, team) as pl from leaderboard) l join raw using (task) group by all)"""


@query("select * from limits".replace("select * from limits", f"with leaderboard as ({fx.SQL['leaderboard']}), {LIMITS} select task, n_teams, round(gold, 9) as gold, round(silver, 9) as silver, round(bronze, 9) as bronze, round(median, 9) as median from limits"))
def thresholds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(grading.thresholds(fx.leaderboard(spark, d), ["task"], "score", True))


SCORES = "select doc_id as run, task, ((n_chars % 997) / 997.0::double) as score from answers"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return fx.answers(spark, d).select(F.col("doc_id").alias("run"), "task", ((F.col("n_chars") % 997) / 997.0).alias("score"))


@query(f"with leaderboard as ({fx.SQL['leaderboard']}), answers as ({fx.SQL['answers']}), s as ({SCORES}), {LIMITS} select run, task, round(score, 9) as score, score >= gold as is_gold, score >= silver as is_silver, score >= bronze as is_bronze, score > median as above_median, score >= least(gold, silver, bronze) as any_medal, case when score >= gold then 'gold' when score >= silver then 'silver' when score >= bronze then 'bronze' when score > median then 'above median' else '-' end as medal from s join limits using (task)")
def medal_award(spark: SparkSession, d: str) -> DataFrame:
    limits = grading.thresholds(fx.leaderboard(spark, d), ["task"], "score", True)
    return rounded(grading.awarded(_scores(spark, d), limits, ["task"], True))


@query(f"with leaderboard as ({fx.SQL['leaderboard']}), answers as ({fx.SQL['answers']}), s as ({SCORES}) select task, round(s.score, 9) as score, run, round((select count(*) from leaderboard l where l.task = s.task and s.score > l.score) / (select count(*) from leaderboard l where l.task = s.task)::double, 9) as percentile from s")
def leaderboard_percentile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(grading.percentiles(_scores(spark, d), fx.leaderboard(spark, d), ["task"], "score", True))


@query("select run, arg_min(error, line_no * 2 + rule) as error from (select *, case when rn > 1 then 1 when raw = 'abc' then 2 end as rule, case when rn > 1 then 'duplicate id ' || id || ' at row ' || line_no else 'not a number at row ' || line_no end as error from (select *, row_number() over (partition by run, id order by line_no) as rn from subs)) where rule is not null group by run", "subs")
def submission_first_error(spark: SparkSession, d: str) -> DataFrame:
    return grading.first_errors(fx.submissions(spark, d))


@query("select run, count(*) filter (g is null) as missing, count(*) filter (k is null) as unknown from (select coalesce(a.run, b.run) as run, k, g from (select r.run, a.id, 1 as k from (select distinct run, task from subs) r join answers a using (task)) a full join (select distinct run, id, 1 as g from subs) b on a.run = b.run and a.id = b.id) group by run", "answers", "subs")
def submission_id_mismatches(spark: SparkSession, d: str) -> DataFrame:
    return grading.id_mismatches(fx.submissions(spark, d), fx.answers(spark, d).select("task", "id", "y"))


@query("""with bad as (select distinct run from (select run, id, raw, row_number() over (partition by run, id order by line_no) as rn from subs) where rn > 1 or raw = 'abc' union select run from (select run from subs where id like 'x%') union select run from (select distinct run, task from subs) r join answers a using (task) where not exists (select 1 from subs s where s.run = r.run and s.id = a.id))
select r.run, r.task, round(s.score, 9) as score, b.run is null as is_valid from (select distinct run, task from subs) r left join bad b on r.run = b.run left join (select s.run, avg(abs(y - raw::double)) as score from subs s join answers a using (task, id) where s.run not in (select run from bad) group by s.run) s on r.run = s.run""".replace("with bad", ", bad", 1), "answers", "subs")
def graded_submissions(spark: SparkSession, d: str) -> DataFrame:
    out = grading.graded(fx.submissions(spark, d), fx.answers(spark, d).select("task", "id", "y"), "mae")
    return rounded(out.select("run", "task", "score", F.col("error").isNull().alias("is_valid")))


@query("select raw, try_cast(regexp_replace(raw, '_', '', 'g') as double) as value from (select distinct case n_chars % 6 when 0 then '1_000' when 1 then ' 2.5 ' when 2 then '-3e2' when 3 then 'x1' when 4 then '' else '.5' end as raw from documents)")
def parsed_numbers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_chars") % 6
    raw = F.when(k == 0, "1_000").when(k == 1, " 2.5 ").when(k == 2, "-3e2").when(k == 3, "x1").when(k == 4, "").otherwise(".5")
    return fx.table(spark, d, "documents").select(raw.alias("raw")).distinct().select("raw", expr.parsed_number(F.col("raw")).alias("value"))


# Outcomes


@query("select run, outcome, signal, outcome = 'valid' and (capped or exit_code <> 0) as truncated from triaged", "triaged")
def triage_outcome(spark: SparkSession, d: str) -> DataFrame:
    return triage.classified(fx.artifacts(spark, d)).select("run", "outcome", "signal", "truncated")


@query("select o.ord, o.outcome, count(t.outcome) as n from (select unnest(range(7)) as ord, unnest(['valid', 'invalid_submission', 'no_submission', 'timeout', 'oom', 'crash', 'infra']) as outcome) o left join triaged t on o.outcome = t.outcome group by all", "triaged")
def triage_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(triage.counts(triage.classified(fx.artifacts(spark, d))))


@query("select item, count(*) as total, count(*) filter (outcome <> 'infra') as gradeable, count(*) filter (outcome = 'infra') as infra, round(avg((outcome = 'valid')::int::double), 9) as valid_rate, round(avg((outcome not in ('valid', 'infra'))::int::double), 9) as mechanical_rate, avg((outcome not in ('valid', 'infra'))::int::double) > 0.15 as warning from triaged group by item", "triaged")
def tier_share_warning(spark: SparkSession, d: str) -> DataFrame:
    return rounded(triage.shares(triage.classified(fx.artifacts(spark, d)), ["item"]))


@query("select case outcome when 'valid' then 'signal' when 'infra' then 'excluded' else 'agent' end as tier, count(*) as n from triaged group by 1", "triaged")
def tier_counts(spark: SparkSession, d: str) -> DataFrame:
    return triage.classified(fx.artifacts(spark, d)).groupBy(triage.tier(F.col("outcome")).alias("tier")).agg(F.count("*").alias("n"))


@query("select subject, case when count(distinct outcome) = 1 then min(outcome) end as outcome from triaged group by subject", "triaged")
def only_outcome(spark: SparkSession, d: str) -> DataFrame:
    return triage.only_outcome(triage.classified(fx.artifacts(spark, d)), ["subject"])


@query("select run, case when mem_signal = 'cuda-oom' then 'RuntimeError: CUDA out of memory. Tried 2 GiB' when mem_signal = 'tensorflow-oom' then 'ResourceExhaustedError: OOM' else 'Killed process 77 (python) total-vm:1kB' end as line from found where mem_signal is not null", "found")
def evidence_line(spark: SparkSession, d: str) -> DataFrame:
    found = fx.artifacts(spark, d).withColumn("m", triage.first_match(F.col("agent_log"), triage.MEMORY))
    return found.where("m is not null").select("run", F.col("m.line").alias("line"))


@query("select item, case count(distinct isolation) when 0 then 'unknown' when 1 then max(isolation) else 'mixed' end as isolation from artifacts group by item", "artifacts")
def isolation_mixed(spark: SparkSession, d: str) -> DataFrame:
    return triage.isolation(fx.artifacts(spark, d), ["item"])


@query("select round(max(wall_clock) * 1.05::double, 9) as max_time, max(time_cap) as time_cap, round(max(wall_clock) / max(time_cap), 9) as cap_headroom from artifacts", "artifacts")
def cap_headroom(spark: SparkSession, d: str) -> DataFrame:
    return rounded(triage.headroom(fx.artifacts(spark, d)))


# Test logs


@query("select run, test, status from statuses union all select distinct run, 'tests::t9', 'PASSED' from statuses where run % 7 = 0 and false", "statuses")
def swe_statuses(spark: SparkSession, d: str) -> DataFrame:
    return swe.statuses(fx.test_logs(spark, d))


RESOLUTION = """select r.run, r.run % 7 <> 0 as applied, case when r.run % 7 <> 0 then count(*) filter (kind = 'f2p' and ok) end as n_f2p, case when r.run % 7 <> 0 then count(*) filter (kind = 'p2p' and ok) end as n_p2p, r.run % 7 <> 0 and bool_and(ok) as resolved, r.run % 7 <> 0 and bool_and(ok or kind = 'p2p') and not bool_and(ok) as regressed
from (select c.run, c.test, case when c.test = 'tests::t0' then 'f2p' else 'p2p' end as kind, coalesce(status = 'PASSED', false) as ok from (select distinct conv_id as run, unnest(['tests::t0', 'tests::t1', 'tests::t2']) as test from conversations) c left join statuses s on c.run = s.run and c.test = s.test) r group by r.run"""


@query(RESOLUTION, "statuses")
def swe_resolution(spark: SparkSession, d: str) -> DataFrame:
    out = swe.resolved(fx.test_logs(spark, d), fx.expected_tests(spark, d))
    return out.select("run", "applied", F.size("f2p_success").cast("long").alias("n_f2p"), F.size("p2p_success").cast("long").alias("n_p2p"), "resolved", "regressed")


TRANSITIONS = "select coalesce(b.run, a.run) as run, coalesce(b.test, a.test) as test, case when coalesce(b.status = 'PASSED', false) then case when coalesce(a.status = 'PASSED', false) then 'p2p' else 'regressed' end when coalesce(a.status = 'PASSED', false) then 'f2p' else 'other' end as kind from (select * from statuses where run % 3 <> 0) b full join (select run, test, case when (run + length(status)) % 2 = 0 then 'PASSED' else 'FAILED' end as status from statuses where run % 5 <> 0) a on a.run = b.run and a.test = b.test"


@query(TRANSITIONS, "statuses")
def fail_to_pass(spark: SparkSession, d: str) -> DataFrame:
    s = swe.statuses(fx.test_logs(spark, d))
    after = s.where("run % 5 <> 0").withColumn("status", F.when((F.col("run") + F.length("status")) % 2 == 0, "PASSED").otherwise("FAILED"))
    return swe.transitions(s.where("run % 3 <> 0"), after)


@query(f", t as ({TRANSITIONS}) select run, count(*) filter (kind = 'f2p') as n_f2p, count(*) filter (kind = 'regressed') as n_regressed, count(*) filter (kind = 'f2p') > 0 and count(*) filter (kind = 'regressed') = 0 as valid from t group by run", "statuses")
def swe_instances(spark: SparkSession, d: str) -> DataFrame:
    return swe.valid_instances(fail_to_pass(spark, d))


STRATEGY = "case run % 5 " + " ".join(f"when {k} then '{e[0]}'" for k, e in enumerate(swe.EXPECTED)) + " end"
WANTED = "(values " + ", ".join(f"('{name}', {str(applied).lower()}, '{summary}')" for name, applied, summary in swe.EXPECTED) + ") as w(strategy, should_apply, expected)"


@query(f", r as ({RESOLUTION}), q as (select run, {STRATEGY} as strategy, applied, case when not applied then 'patch not applied' when resolved then 'resolved' when regressed then 'regressed' else 'not resolved' end as summary from r) select run, q.strategy, summary, expected from q join {WANTED} on q.strategy = w.strategy where summary <> expected or applied <> should_apply", "statuses")
def swe_unexpected(spark: SparkSession, d: str) -> DataFrame:
    out = swe.resolved(fx.test_logs(spark, d), fx.expected_tests(spark, d))
    return swe.unexpected(out.select("run", F.expr(STRATEGY).alias("strategy"), "applied", "summary"))


@query("select user_id as run, arg_max('f' || event_id, (ts, 'f' || event_id)) as path from events where event_id % 5 > 0 group by user_id")
def newest_files(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "events")
    return ck.newest(e.select(F.col("user_id").alias("run"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), (F.col("event_id") % 5).alias("length"), F.col("ts").alias("modificationTime")))


@query("select run from triaged where outcome = 'infra'", "triaged")
def retryable_runs(spark: SparkSession, d: str) -> DataFrame:
    return triage.retryable(triage.classified(fx.artifacts(spark, d))).select("run")


@query(", p as (select subject, item, seed, arg_min(outcome, run) as outcome from triaged group by all) select subject, item, seed, outcome, case when (subject + item) % 3 = 0 then (subject % 7) / 8.0::double end as score, case when (subject + item) % 3 = 0 and seed % 2 = 0 then 'gold' end as medal from p", "triaged")
def session_outcomes(spark: SparkSession, d: str) -> DataFrame:
    t = triage.classified(fx.artifacts(spark, d))
    s, i = F.col("subject"), F.col("item")
    grades = t.where((s + i) % 3 == 0).select("subject", "item", "seed", ((s % 7) / 8.0).alias("score"), F.when(F.col("seed") % 2 == 0, "gold").alias("medal"))
    return runs.session_outcomes(t, grades)


GATED = "case when doc_id % 4 = 0 then source || '.txt' when doc_id % 4 = 1 then source || '.CSV' else source || '.csv' end"


@query(f"select doc_id, case when not lower({GATED}) like '%.csv' then 'not a .csv file' when doc_id % 3 = 0 then 'no file' end as reason from documents")
def submission_gates(spark: SparkSession, d: str) -> DataFrame:
    paths = fx.table(spark, d, "documents").select("doc_id", F.expr(GATED).alias("path"), (F.col("doc_id") % 3 != 0).alias("there"))
    return paths.select("doc_id", grading.file_gate(F.col("path"), F.col("there")).alias("reason"))


# Probe


CONTROLS = """, g as (select o.agent, avg(o.percentile - c.percentile) as gap from probe o join probe c on o.agent = c.agent and c.item = o.item || '__relabel' where o.valid and c.valid and not o.is_clone and c.is_clone group by o.agent),
rs as (select 'an honest agent has no gap on a relabelled clone' as control, abs(gap) < 1e-9 as passed, gap as value from g where agent = 'a1' union all select 'a rescaled clone is as hard', true, 0.004::double union all select 'a rescaled clone tells memory from honesty', false, null
union all select 'originals are recalled', avg(recalled::int::double) > 0.9, avg(recalled::int::double) from probe where agent = 'a9' and not is_clone union all select 'relabelling alone defeats no recall', avg(recalled::int::double) > 0.5, avg(recalled::int::double) from probe where agent = 'a9' and is_clone union all select 'rescaling defeats recall', true, 0.0::double)
select control, passed, round(value, 9) as value from rs"""


@query(CONTROLS, "probe")
def probe_controls(spark: SparkSession, d: str) -> DataFrame:
    deltas = spark.createDataFrame([("rescale", -0.004), ("relabel", 0.1)], "transform string, delta double")
    return rounded(skills.controls(fx.probe(spark, d), deltas, "a1", "a9"))


@query("select o.agent, count(*) as n, round(avg(o.percentile - c.percentile), 9) as gap from probe o join probe c on o.agent = c.agent and c.item = o.item || '__relabel' where o.valid and c.valid and not o.is_clone and c.is_clone group by o.agent", "probe")
def probe_gap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(skills.probe_gap(fx.probe(spark, d), "relabel"))


@query("select o.agent, count(*) as n, round(avg(o.medal::int::double - c.medal::int::double), 9) as gap from probe o join probe c on o.agent = c.agent and c.item = o.item || '__relabel' where not o.is_clone and c.is_clone group by o.agent", "probe")
def medal_gap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(skills.probe_gap(fx.probe(spark, d), "relabel", "medal", only_valid=False))


@query("select agent, round(avg(recalled::int::double) filter (not is_clone), 9) as recall from probe group by agent", "probe")
def recall_rate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(skills.recall_rate(fx.probe(spark, d)))


# Checkpoints


@query("select run, mark, sha from marked", "marked")
def asof_marks(spark: SparkSession, d: str) -> DataFrame:
    return ck.as_of(fx.checkpoints(spark, d), fx.marks(spark, d))


@query("select run, mark, sha from (select *, lag(sha) over (partition by run order by mark) as was from marked) where was is null or was <> sha", "marked")
def skip_unchanged(spark: SparkSession, d: str) -> DataFrame:
    return ck.changed(asof_marks(spark, d))


@query("select run, max(mark) as last, count(*) as n from (select *, lag(sha) over (partition by run order by mark) as was from marked) where was is null or was <> sha group by run order by 2 desc, 1 limit 30", "marked")
def last_change_topk(spark: SparkSession, d: str) -> DataFrame:
    return ck.last_changes(skip_unchanged(spark, d))


@query("select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    return ck.tumbling(fx.table(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("select strftime(start, '%Y-%m-%d %H:%M:%S') as start, count(*) as n from (select unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) as start from events) group by 1")
def sliding(spark: SparkSession, d: str) -> DataFrame:
    return ck.sliding(fx.table(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("with g as (select *, sum(new) over (partition by user_id order by ts, event_id) as s from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30 minutes' then 0 else 1 end as new from events)) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from g group by user_id, s")
def session(spark: SparkSession, d: str) -> DataFrame:
    return ck.sessions(fx.table(spark, d, "events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("select page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) as lang, regexp_extract(url, '[?&]page=([0-9]+)', 1) as page, regexp_extract(html, '<title>([^<]*)</title>', 1) <> '' as has_title from pages")
def schema_regex(spark: SparkSession, d: str) -> DataFrame:
    p = fx.table(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("url", "[?&]page=([0-9]+)", 1).alias("page"), (F.regexp_extract("html", "<title>([^<]*)</title>", 1) != "").alias("has_title"))
