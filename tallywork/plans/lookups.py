"""Queries of lookups, orders and agreements between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.operators import features, irt, runs, skills, swe, triage
from tallywork.plans import fixtures as fx
from tallywork.plans.catalog import query


@query("select item, count(distinct outcome) = 1 as is_one, min(outcome) as least from triaged group by item", "triaged")
def one_outcome(spark: SparkSession, d: str) -> DataFrame:
    """Items whose runs all ended alike (SET-05)."""
    return triage.one_outcome(triage.classified(fx.artifacts(spark, d)), ["item"])


@query("select agent, round(avg(p), 9) as mean_percentile, count(*) as n_items from (select agent, replace(item, '__relabel', '') as item, avg(percentile) as p from probe where valid group by all) group by agent", "probe")
def mean_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Mean over items of the mean over runs (AGG-11)."""
    p = fx.probe(spark, d).select("agent", F.replace("item", F.lit("__relabel"), F.lit("")).alias("item"), F.when(F.col("valid"), F.col("percentile")).alias("percentile"))
    return runs.mean_percentile(p, "agent").select("agent", F.round("mean_percentile", 9).alias("mean_percentile"), "n_items")


@query("select o_orderkey as run, o_orderkey % 13 <> 0 and o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0 as agree from orders")
def grader_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Two graders' lists and verdicts side by side; the second lacks some runs (JON-16)."""
    k = F.col("o_orderkey")
    lists = lambda first: [first.alias("f2p_success"), F.array(F.lit("t1"), F.col("o_orderpriority")).alias("f2p_failure"), F.array().cast("array<string>").alias("p2p_success"), F.array("o_orderstatus").alias("p2p_failure")]
    o = fx.table(spark, d, "orders")
    ours = o.select(k.alias("run"), (F.col("o_totalprice") > 1e5).alias("resolved"), *lists(F.array("o_orderstatus", F.lit("t0"))))
    theirs = o.where(k % 13 != 0).select(k.alias("run"), ((F.col("o_totalprice") > 1e5) != (k % 11 == 0)).alias("resolved"), *lists(F.when(k % 7 == 0, F.array("o_orderstatus")).otherwise(F.array(F.lit("t0"), "o_orderstatus"))))
    return swe.agreement(ours, theirs)


@query("select a.agent, c.challenge, round(m, 9) as challenged, n from (select distinct agent from pairs) a cross join (select distinct challenge from pairs) c left join (select agent, challenge, avg(challenged) as m, count(*) as n from pairs where challenged is not null and unit < 3 and agent <> 'a2' group by all) p on p.agent = a.agent and p.challenge = c.challenge where a.agent <> 'a2'", "pairs")
def skill_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every agent with every challenge, cells missing where nothing was measured (JON-17)."""
    p = fx.skill_pairs(spark, d).where("challenged is not null and unit < 3 and agent != 'a2'")
    return skills.dense(p.groupBy("agent", "challenge").agg(F.round(F.avg("challenged"), 9).alias("challenged"), F.count("*").alias("n")))


@query("select event_type, min(event_id) as first from events group by event_type")
def first_appearance(spark: SparkSession, d: str) -> DataFrame:
    """Labels with the place of their first appearance (WIN-06)."""
    return skills.in_order(fx.table(spark, d, "events"), "event_type", "event_id")


@query("with n as (select *, row_number() over (order by user_id) - 1 as place, count(*) over () as n from (select distinct user_id from events)) select user_id from n where list_contains([i * n // 10 for i in range(least(10, n))], place)")
def thinned_agents(spark: SparkSession, d: str) -> DataFrame:
    """Ten users evenly spread over their order (PRJ-14)."""
    return runs.thinned(fx.table(spark, d, "events").select("user_id").distinct(), 10, "user_id")


@query("select p_partkey as item, round(p_retailprice / 1000.0 - 1.5, 9)::double as b from part where p_size > 5 and p_partkey % 10 <> 0 order by b desc, item limit 12")
def hardest_located(spark: SparkSession, d: str) -> DataFrame:
    """The hardest items among those that are located (SRT-05); a top-k report."""
    p = fx.table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.lit(1.0).alias("a"), F.round(F.col("p_retailprice") / 1000.0 - 1.5, 9).alias("b"), (F.col("p_size") > 5).alias("identified"), (F.col("p_partkey") % 10 == 0).alias("extrapolated"))
    return irt.hardest(p, 12).select("item", "b")


@query("select c_mktsegment as fit, round(min(c_acctbal), 9) as low, round(max(c_acctbal), 9) as high from customer group by 1")
def ability_range(spark: SparkSession, d: str) -> DataFrame:
    """Least and greatest ability by fit (IRT-13)."""
    c = fx.table(spark, d, "customer").select(F.col("c_mktsegment").alias("fit"), F.col("c_acctbal").alias("theta"))
    return irt.ability_range(c, "fit").select("fit", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("select row, substr(sha256(string_agg('f' || feature, ',' order by feature) || '#' || row), 1, 24) as fingerprint from features where x is not null group by row", "features")
def row_fingerprint_by_names(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints by the names of a row's features and its number (FN-15)."""
    named = fx.features(spark, d).where("x is not null").select("row", F.col("feature").alias("place"), F.concat(F.lit("f"), F.col("feature")).alias("name"))
    return features.name_fingerprints(named)
