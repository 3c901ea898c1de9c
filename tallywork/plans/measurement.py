"""Queries of inference, power, classical test theory, item response and feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork import summaries
from tallywork.functions import expr, shuffles
from tallywork.operators import clustering, ctt, features, inference, irt, kernels, published, skills, subset, suites
from tallywork.plans import fixtures as fx
from tallywork.plans.catalog import query, rounded

FLIPS, BOOTS = 199, 200

# Paired inference: arm a is the lines of even suppliers, arm b of odd ones, orders are units


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    """Each order with lines in both arms."""
    both = fx.arms(spark, d).groupBy("unit").agg(F.max(F.when(F.col("arm") == "a", F.col("rate"))).alias("ra"), F.max(F.when(F.col("arm") == "b", F.col("rate"))).alias("rb"))
    return both.where("ra is not null and rb is not null").select(F.lit(1).alias("k"), "unit", (F.col("rb") - F.col("ra")).alias("diff"))


def _halves(spark: SparkSession, d: str) -> DataFrame:
    """Each item with its subjects as units: the rate of the first three seeds against that of the others."""
    half = lambda first: F.avg(F.when((F.col("seed") <= 3) == F.lit(first), F.col("medal").cast("double")))
    both = fx.runs(spark, d).where("not infra_failure").groupBy("item", "subject").agg((half(True) - half(False)).alias("diff"))
    return both.where("diff is not null").select("item", F.col("subject").alias("unit"), "diff")


DIFFS = ", d as (select a.unit, b.rate - a.rate as diff from arms a join arms b on a.unit = b.unit where a.arm = 'a' and b.arm = 'b')"
P_VALUE = "round((count(*) filter (m >= abs(mean) - 1e-12) + 1.0::double) / (count(*) + 1.0::double), 9) as p_value"


def _flips(n: int, seed: str = "flip") -> str:
    """Tables f (perm, m) and o (mean, n) from d (unit, diff)."""
    return f""", lanes as (select diff, lane, {expr.lane_bits_sql(seed, 'lane', 'unit')} as bits from d, (select unnest(range({-(-n // expr.LANE)})) as lane)),
    o as (select avg(diff) as mean, count(*) as n from d), f as (select lane * {expr.LANE} + k as perm, abs(sum(diff * (1 - 2 * ((bits >> k) & 1)))) / (select n from o) as m from lanes, (select unnest(range({expr.LANE}))::int as k) where lane * {expr.LANE} + k < {n} group by 1)"""


def _boots(n: int, seed: str = "boot") -> str:
    """Table q (boot, m) from d, as weights."""
    return f", w as (select boot, diff, {expr.poisson_sql(seed, 'boot', 'unit')} as w from d, (select unnest(range({n})) as boot)), q as (select boot, sum(w * diff) / sum(w) as m from w group by boot)"


@query(f""", d as (select item, subject as unit, avg(medal::int::double) filter (seed <= 3) - avg(medal::int::double) filter (seed > 3) as diff from runs where not infra_failure group by all),
    u as (select *, row_number() over (partition by item order by unit) - 1 as i, count(*) over (partition by item) as n, avg(diff) over (partition by item) as mean from d where diff is not null),
    f as (select item, perm, n, mean, abs(sum(case when (perm >> i::int) % 2 = 1 then -diff else diff end) / n) as m from u, (select unnest(range(1024)) as perm) where perm < (1 << n::int) group by item, perm, n, mean)
    select item, n as n_units, round(mean, 9) as mean_diff, {P_VALUE} from f group by item, n, mean""", "runs")
def signflip_exact(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.sign_flip(_halves(spark, d), ["item"]))


@query(f"{DIFFS}{_flips(FLIPS)} select n as n_units, round(mean, 9) as mean_diff, {P_VALUE} from f, o group by n, mean", "arms")
def signflip_random(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.sign_flip(_diffs(spark, d), ["k"], FLIPS).drop("k"))


@query(f"{DIFFS}{_boots(BOOTS)} select round(quantile_cont(m, 0.025), 9) as ci_low, round(quantile_cont(m, 0.975), 9) as ci_high from q", "arms")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.bootstrap_ci(_diffs(spark, d), ["k"], BOOTS).drop("k"))


@query(f""", d as (select item, subject as unit, avg(medal::int::double) filter (seed <= 3) - avg(medal::int::double) filter (seed > 3) as diff from runs where not infra_failure group by all),
    u as (select *, row_number() over (partition by item order by unit) - 1 as i, count(*) over (partition by item) as n from d where diff is not null),
    g as (select item, n, boot, j, floor({expr.uniform_sql('boot', 'boot', 'j')} * n)::bigint as i from (select distinct item, n from u), (select unnest(range({BOOTS})) as boot), (select unnest(range(10)) as j) where j < n),
    m as (select item, boot, sum(diff) / any_value(u.n) as m from g join u using (item, i) group by item, boot) select item, round(quantile_cont(m, 0.025), 9) as ci_low, round(quantile_cont(m, 0.975), 9) as ci_high from m group by item""", "runs")
def bootstrap_ci_small(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.bootstrap_ci(_halves(spark, d), ["item"], BOOTS))


@query("select n_units, case when n_units <= 15 then 3.0::double / (pow(2.0::double, n_units) + 1.0::double) else 1.0::double / 10000.0::double end as p_floor from (select unnest(range(1, 41)) as n_units)")
def pvalue_floor(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, 41).select(F.col("id").alias("n_units"), expr.pvalue_floor(F.col("id")).alias("p_floor"))


def _report_sql(pairs: str, units: str, seeds: str, said: str) -> str:
    return f"""{pairs}{_flips(FLIPS)}{_boots(BOOTS)}, r as (select n as n_units, {units} as n_dropped, {seeds} as min_seeds, round((select avg(ra) from d), 9) as mean_a, round((select avg(rb) from d), 9) as mean_b, round(mean, 9) as difference, {P_VALUE}, round(1 / {FLIPS + 1}.0::double, 9) as p_floor from f, o group by n, mean)
    select r.*, (select round(quantile_cont(m, 0.025), 9) from q) as ci_low, (select round(quantile_cont(m, 0.975), 9) from q) as ci_high, p_value < 0.05 as significant, p_floor >= 0.05 as underpowered, p_value < 0.05 and difference < 0 as regression, concat_ws('; ', {said}) as warnings from r"""


SIDES = ", a as (select * from arms where arm = 'a'), b as (select * from arms where arm = 'b')"


def _rates(spark: SparkSession, d: str) -> list[DataFrame]:
    return [fx.arms(spark, d).where(F.col("arm") == arm).select(F.col("unit").alias("item"), "rate", "seeds") for arm in "ab"]


@query(_report_sql(SIDES + ", d as (select unit, b.rate - a.rate as diff, a.rate as ra, b.rate as rb from a join b using (unit))", "(select count(*) from a full join b using (unit) where a.rate is null or b.rate is null)", "(select least(min(a.seeds), min(b.seeds)) from a full join b using (unit))",
    "case when n_dropped > 0 then 'units without a counterpart were dropped' end, case when min_seeds < 3 then 'fewer than 3 seeds' end, case when p_floor >= 0.05 then 'too few units for this alpha' end"), "arms")
def compare_paired(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.compared(*_rates(spark, d), n_boot=BOOTS, n_permutations=FLIPS))


@query(_report_sql(SIDES + ", d as (select a.unit || '|' || b.unit as unit, b.rate - a.rate as diff, a.rate as ra, b.rate as rb, a.seeds as sa, b.seeds as sb from a join b on b.unit = a.unit + 1)", "0", "(select least(min(sa), min(sb)) from d)",
    f"'{inference.MATCHED}', (select count(*) from lineitem where l_discount = 0.1::double and l_tax = 0.0::double) || ' runs that infrastructure ended were left out', case when min_seeds < 3 then 'fewer than 3 seeds' end"), "arms")
def compare_matched_report(spark: SparkSession, d: str) -> DataFrame:
    a, b = _rates(spark, d)
    pairs = a.select(F.col("item").alias("pre")).join(b.select(F.col("item").alias("post")), F.col("post") == F.col("pre") + 1)
    ended = fx.runs(spark, d).where("infra_failure").count()
    return rounded(inference.compared(a, b, n_boot=BOOTS, n_permutations=FLIPS, pairs=pairs, infra_failures=ended))


@query("select a.subject || 'm' || a.item as pair, round(a.rate, 9) as rate_a, round(b.rate, 9) as rate_b, round(b.rate - a.rate, 9) as diff from cells a left join cells b on b.item = a.item + 3 and b.subject = a.subject + 1", "cells")
def compare_matched(spark: SparkSession, d: str) -> DataFrame:
    from tallywork.operators import runs

    c = fx.cells(spark, d)
    at = lambda subject, item: F.concat_ws("m", subject.cast("string"), item.cast("string"))
    s, i = F.col("subject"), F.col("item")
    pairs = c.select(at(s, i).alias("pre"), at(s + 1, i + 3).alias("post"))
    rates = c.select(at(s, i).alias("item"), "rate")
    out = runs.matched(pairs, rates, rates)
    return rounded(out.select(F.col("pre").alias("pair"), "rate_a", "rate_b", "diff"))


# Skills


CELLS = """select p.agent, p.challenge, count(*) as n_pairs, count(*) filter (challenged is null) as n_broken, round(avg(challenged - control), 9) as delta, bool_and(challenged is null) as broke, count(*) filter (challenged is null) between 1 and count(*) - 1 as partially_broke,
  round(max(f.p), 9) as p_value from pairs p left join (select agent, challenge, (count(*) filter (m >= abs(mean) - 1e-12) + 1.0::double) / (count(*) + 1.0::double) as p from (select agent, challenge, perm, abs(sum(case when (perm >> i::int) % 2 = 1 then -diff else diff end) / count(*)) as m, avg(diff) as mean
    from (select *, challenged - control as diff, row_number() over (partition by agent, challenge order by unit) - 1 as i, count(*) over (partition by agent, challenge) as n from pairs where challenged is not null) u, (select unnest(range(1024)) as perm) where perm < (1 << n::int) group by all) group by all) f on f.agent = p.agent and f.challenge = p.challenge group by p.agent, p.challenge"""


@query(CELLS, "pairs")
def skill_cells(spark: SparkSession, d: str) -> DataFrame:
    out = skills.cells(fx.skill_pairs(spark, d), n_boot=BOOTS)
    return rounded(out.select("agent", "challenge", "n_pairs", "n_broken", "delta", "broke", "partially_broke", "p_value"))


@query("""with c as (select agent, challenge, avg(challenged - control) as delta, bool_and(challenged is null) as broke, bool_or(abs(challenged - control) >= 0) as any_ok from pairs group by all) select agent, round(avg(case when broke then -1 when abs(delta) >= 0.15 then least(delta, 0) else 0 end), 9) as robustness from c group by agent""".replace("with c", ", c", 1), "pairs")
def skill_robustness(spark: SparkSession, d: str) -> DataFrame:
    p = fx.skill_pairs(spark, d).groupBy("agent", "challenge").agg(F.avg(F.col("challenged") - F.col("control")).alias("delta"), F.bool_and(F.col("challenged").isNull()).alias("broke"))
    return rounded(skills.robustness(p.withColumn("meaningful", F.abs("delta") >= 0.15)))


@query(""", c as (select agent, challenge, avg(challenged - control) as delta, bool_and(challenged is null) as broke from pairs group by all), e as (select *, delta - 0.05::double as lo, delta + 0.05::double as hi from c)
select agent from e where not broke and not exists (select 1 from e o where o.challenge = e.challenge and o.agent <> e.agent and o.lo > e.hi and o.delta - e.delta >= 0.02) group by agent having count(*) = 2""", "pairs")
def dominant_agent(spark: SparkSession, d: str) -> DataFrame:
    p = fx.skill_pairs(spark, d).groupBy("agent", "challenge").agg(F.avg(F.col("challenged") - F.col("control")).alias("delta"), F.bool_and(F.col("challenged").isNull()).alias("broke"))
    return skills.dominant(p.withColumn("ci_low", F.col("delta") - 0.05).withColumn("ci_high", F.col("delta") + 0.05))


@query(f", c as ({CELLS}) select agent, challenge, agent || ' under ' || challenge || ': ' || case when broke then 'broken in all pairs' else printf('%+.3f', delta) || case when partially_broke then ', ' || n_broken || ' of ' || n_pairs || ' pairs broken' else '' end || case when p_value < 0.05 then ' *' else '' end end as line from c", "pairs")
def skill_lines(spark: SparkSession, d: str) -> DataFrame:
    return summaries.skills(skills.cells(fx.skill_pairs(spark, d), n_boot=BOOTS))


@query(", c as (select agent, challenge, avg(challenged - control) as delta, bool_and(challenged is null) as broke from pairs group by all), l as (select agent, challenge, case when broke then -1 when abs(delta) >= 0.15 then delta else 0 end as loss from c) select agent, arg_min(challenge, (round(loss, 12), challenge)) as challenge, round(min(loss), 9) as loss from l where loss < 0 group by agent", "pairs")
def skill_hardest(spark: SparkSession, d: str) -> DataFrame:
    p = fx.skill_pairs(spark, d).groupBy("agent", "challenge").agg(F.avg(F.col("challenged") - F.col("control")).alias("delta"), F.bool_and(F.col("challenged").isNull()).alias("broke"))
    return rounded(skills.hardest(p.withColumn("meaningful", F.abs("delta") >= 0.15)))


# Classical test theory

ALPHA = "(select case when var_samp(t) > 0 then {k} / ({k} - 1) * (1 - (select sum(v) from (select var_samp(rate) as v from {c} group by item)) / var_samp(t)) else 0 end from (select sum(rate) as t from {c} group by subject))"


@query(f"select (select count(distinct item) from cells) as k, (select count(distinct subject) from cells) as n, round({ALPHA.format(k='20.0::double', c='cells')}, 9) as alpha", "cells")
def cronbach_alpha(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ctt.alpha(fx.cells(spark, d)))


ITEMS = """s as (select item, avg(rate) as mean, stddev_samp(rate) as sd, avg(rest) as rm, stddev_samp(rest) as rsd, covar_samp(rate, rest) as cov, avg(rate * (1 - rate) / greatest(trials::double, 1)) as noise from (select c.*, (t - rate) / (k - 1.0::double) as rest from cells c join (select subject, sum(rate) as t, count(*) as k from cells group by subject) using (subject)) group by item),
i as (select *, sd <= 1e-9 * greatest(1, abs(mean)) as dead, case when sd <= 1e-9 * greatest(1, abs(mean)) or rsd <= 1e-9 * greatest(1, abs(rm)) then 0 else cov / (sd * rsd) end as item_rest from s)"""


@query(f", {ITEMS} select item, round(mean, 9) as mean, round(sd, 9) as sd, round(item_rest, 9) as item_rest, round(case when dead then 0 else least(greatest(noise / (sd * sd), 0), 1) end, 9) as noise_share, dead, dead or item_rest < 0.2 as weak, item_rest < -0.2 as trap, case when dead then case when mean <= 0 then 'floor' when mean >= 1 then 'ceiling' else 'constant' end end as saturation from i", "cells")
def ins_item_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ctt.item_stats(fx.cells(spark, d)).drop("disattenuated"))


@query(f"select round(sqrt(a / (1 - a)), 9) as separation, round((4 * sqrt(a / (1 - a)) + 1) / 3, 9) as strata, case when a <= 0 then null when a >= 0.97 then 20 else ceil(20 * 0.97::double * (1 - a) / (a * (1 - 0.97::double)))::bigint end as items_needed from (select {ALPHA.format(k='20.0::double', c='cells')} as a)", "cells")
def strata(spark: SparkSession, d: str) -> DataFrame:
    a = ctt.alpha(fx.cells(spark, d))
    r = F.col("alpha")
    return rounded(a.select(ctt.separation(r).alias("separation"), ctt.strata(r).alias("strata"), ctt.items_needed(r, F.col("k"), 0.97).alias("items_needed")))


HALVES = f""", o as (select split, item, row_number() over (partition by split order by {expr.uniform_sql('half', 'split', 'item')}, item) as place from (select distinct item from cells), (select unnest(range(40)) as split)),
m as (select split, subject, avg(rate) filter (place <= 10) as a, avg(rate) filter (place > 10 and place <= 20) as b from cells join o using (item) group by all), r as (select split, covar_samp(a, b) / (stddev_samp(a) * stddev_samp(b)) as r from m group by split) select split, round(r, 9) as r, round(2 * r / (1 + r), 9) as reliability from r"""


@query(HALVES, "cells")
def split_half(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ctt.split_half(fx.cells(spark, d), 40))


@query(
    HALVES.rsplit(" select split", 1)[0] + f", {ITEMS}, b as (select min(r) as lowest, max(r) as highest from (select subject, avg(rate) as r from cells group by subject)) select 20::bigint as n_items, 10::bigint as n_subjects, round(lowest, 9) as lowest, round(highest, 9) as highest, round({ALPHA.format(k='20.0::double', c='cells')}, 9) as alpha,"
    " (select round(avg(2 * r / (1 + r)), 9) from r) as split_half, (select coalesce(string_agg(item::varchar, ',' order by item), '') from i where dead) as dead, (select coalesce(string_agg(item::varchar, ',' order by item), '') from i where dead or item_rest < 0.2) as weak, (select coalesce(string_agg(item::varchar, ',' order by item), '') from i where item_rest < -0.2) as trap from b",
    "cells",
)
def suite_report(spark: SparkSession, d: str) -> DataFrame:
    out = ctt.report(fx.cells(spark, d), 40, 20)
    listed = [F.array_join(F.transform(f"{k}_items", lambda x: x.cast("string")), ",").alias(k) for k in ("dead", "weak", "trap")]
    return rounded(out.select("n_items", "n_subjects", "lowest", "highest", "alpha", "split_half", *listed))


@query(", b as (select subject as u, avg(rate) as a from cells where subject <> 4 group by subject) select round(sum(sign(x.a - y.a) * sign(x.u - y.u)) / sqrt(sum((x.a <> y.a)::int::double) * sum((x.u <> y.u)::int::double)), 9) as tau from b x join b y on x.u < y.u", "cells")
def ladder_recovery(spark: SparkSession, d: str) -> DataFrame:
    c = fx.cells(spark, d)
    return rounded(ctt.ladder_recovery(c, c.where("subject <> 4").select("subject", F.col("subject").alias("rung")).distinct()))


NULLS = f""", no as (select subject, row_number() over (order by subject) - 1 as no from (select distinct subject from cells)), c as (select draw, {shuffles.permuted_sql('no', 10, 'null', 'draw', 'item')} as subject, item, rate from cells join no using (subject), (select unnest(range(60)) as draw)),
iv as (select draw, sum(v) as iv from (select draw, item, var_samp(rate) as v from c group by all) group by draw), tv as (select draw, var_samp(t) as tv from (select draw, subject, sum(rate) as t from c group by all) group by draw)
select round(quantile_cont(case when tv > 0 then 20.0::double / 19.0::double * (1 - iv / tv) else 0 end, 0.95), 9) as p95, count(*) as draws from iv join tv using (draw)"""


@query(NULLS, "cells")
def null_reliability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ctt.null_alphas(fx.cells(spark, d), 60).agg(F.percentile("alpha", F.lit(0.95)).alias("p95"), F.count("*").alias("draws")))


@query("with f as (select subject, avg(rate) as f from cells group by subject), p as (select subject, avg(rate) as p from cells where item % 7 = 1 group by subject), b as (select * from f join p using (subject)) select round(sum(sign(x.f - y.f) * sign(x.p - y.p)) / sqrt(sum((x.f <> y.f)::int::double) * sum((x.p <> y.p)::int::double)), 9) as tau from b x join b y on x.subject < y.subject".replace("with f", ", f", 1), "cells")
def tau_b(spark: SparkSession, d: str) -> DataFrame:
    c = fx.cells(spark, d)
    return rounded(ctt.fidelity(c, c.where("item % 7 = 1").select("item").distinct()))


@query(f", {ITEMS} select sum(w)::bigint as cost, round(coalesce(sum(w) filter (dead), 0) / sum(w)::double, 9) as dead_share from (select *, case when item < 8 then 1 when item < 16 then 6 else 15 end as w from i)", "cells")
def suite_cost(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ctt.cost(fx.tiers(ctt.item_stats(fx.cells(spark, d)))))


@query("select item, ntile(6) over (order by rate, item) as bin from (select item, avg(rate) as rate from cells group by item)", "cells")
def stratified_ntile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.strata_bins(fx.cells(spark, d).groupBy("item").agg(F.avg("rate").alias("rate")), 6).select("item", "bin"))


def greedy_sql(steps: int, priced: bool) -> str:
    """Tables s (split, budget, step, item) from x (split, subject, item, rate), costs (item, cost) and limits (budget): alpha of each trial suite from all its covariances."""
    out = """, cv as materialized (select a.split, a.item as i, b.item as j, covar_samp(a.rate, b.rate) as c from x a join x b on a.split = b.split and a.subject = b.subject group by all),
    it as materialized (select split, budget, i as item, cost from cv join costs on cv.i = costs.item, limits where i = j), s0 as (select split, budget, -1 as step, item from it where false)"""
    for t in range(steps):
        out += f""", o{t} as (select * from it where not exists (select 1 from s{t} s where s.split = it.split and s.budget = it.budget and s.item = it.item) and cost + coalesce((select sum(c.cost) from s{t} s join costs c using (item) where s.split = it.split and s.budget = it.budget), 0) <= budget and (select count(*) from s{t} s where s.split = it.split and s.budget = it.budget) = {t}),
        m{t} as (select split, budget, item as trial, item from o{t} union all select o.split, o.budget, o.item, s.item from o{t} o join s{t} s on s.split = o.split and s.budget = o.budget),
        g{t} as (select m.split, m.budget, m.trial, any_value(oo.cost) as cost, sum(c) as total, sum(case when i = j then c end) as parts from m{t} m join m{t} n on n.split = m.split and n.budget = m.budget and n.trial = m.trial join cv on cv.split = m.split and cv.i = m.item and cv.j = n.item join o{t} oo on oo.split = m.split and oo.budget = m.budget and oo.item = m.trial group by all),
        b{t} as (select split, budget, {t} as step, arg_min(trial, (-round({'sqrt(greatest(total, 0))' if t == 0 else f'(case when total > 0 then {t + 1}.0::double / {t}.0::double * (1 - parts / total) else 0 end)'} / {'cost' if priced else '1'}, 12), trial)) as item from g{t} group by all),
        s{t + 1} as materialized (select * from s{t} union all select * from b{t})"""
    return out + f", s as (select * from s{steps})"


def halves_sql(n: int, seed: str) -> str:
    """Table sets (split, subject, train)."""
    return f", sets as materialized (select split, subject, row_number() over (partition by split order by {expr.uniform_sql(seed, 'split', 'subject')}, subject) <= (select count(distinct subject) // 2 from cells) as train from (select distinct subject from cells), (select unnest(range({n})) as split))"


TAUS = """, fu as (select split, subject, avg(rate) as f from cells join sets using (subject) where not train group by all), pa as (select s.split, s.budget, c.subject, avg(rate) as p from s join sets t on t.split = s.split and not t.train join cells c on c.subject = t.subject and c.item = s.item group by all),
    pr as (select * from pa join fu using (split, subject)), ta as (select x.split, x.budget, sum(sign(round(x.f - y.f, 12)) * sign(round(x.p - y.p, 12))) / nullif(sqrt(sum((round(x.f - y.f, 12) <> 0)::int::double) * sum((round(x.p - y.p, 12) <> 0)::int::double)), 0) as tau from pr x join pr y on x.split = y.split and x.budget = y.budget and x.subject < y.subject group by all)"""
PRICED = ", costs as (select distinct item, case when item < 8 then 1 when item < 16 then 6 else 15 end as cost from cells)"
FREE = ", costs as (select distinct item, 1 as cost from cells), limits as (select 'inf'::double as budget)"


@query(FREE + ", x as (select 0 as split, subject, item, rate from cells)" + greedy_sql(8, False) + " select step, item from s", "cells")
def greedy_alpha(spark: SparkSession, d: str) -> DataFrame:
    c = fx.cells(spark, d)
    sets = c.select(F.lit(0).cast("long").alias("split"), "subject").distinct()
    return rounded(suites.greedy(suites.by_sets(c, sets), 8).select("step", "item"))


@query(FREE + ", x as (select o.subject as split, c.subject, c.item, c.rate from cells c, (select distinct subject from cells) o where o.subject <> c.subject)" + greedy_sql(4, False) + " select split, step, item from s", "cells")
def greedy_alpha_left_out(spark: SparkSession, d: str) -> DataFrame:
    return rounded(suites.greedy(suites.leaving_one_out(fx.cells(spark, d)), 4).select("split", "step", "item"))


@query(FREE + ", x as (select o.subject as split, c.subject, c.item, c.rate from cells c, (select distinct subject from cells) o where o.subject <> c.subject)" + greedy_sql(3, False) + " select item, count(*) as n from s group by item", "cells")
def selection_counts(spark: SparkSession, d: str) -> DataFrame:
    chosen = suites.greedy(suites.leaving_one_out(fx.cells(spark, d)), 3)
    return published.selection_counts(chosen.groupBy("split").agg(F.collect_list("item").alias("items")))


SPLITS = 6


@query(FREE + halves_sql(SPLITS, "fidelity") + ", x as (select split, subject, item, rate from cells join sets using (subject) where train)" + greedy_sql(4, False) + TAUS + " select count(*) as n_splits, round(avg(tau), 9) as tau, round(stddev_samp(tau), 9) as tau_sd, (select count(distinct item) from s) as items_used from ta where tau is not null", "cells")
def suite_fidelity(spark: SparkSession, d: str) -> DataFrame:
    taus, used = suites.cross_validated(fx.cells(spark, d), 4, SPLITS)
    return rounded(taus.agg(F.count("*").alias("n_splits"), F.avg("tau").alias("tau"), F.stddev_samp("tau").alias("tau_sd")).crossJoin(used.agg(F.count("*").alias("items_used"))))  # one row each


@query(PRICED + ", limits as (select unnest([8.0::double, 24.0::double]) as budget)" + halves_sql(4, "frontier") + ", x as (select split, subject, item, rate from cells join sets using (subject) where train union all select -1, subject, item, rate from cells)" + greedy_sql(10, True) + TAUS + " select budget, (select count(*) from s where s.split = -1 and s.budget = ta.budget) as n_items, round(avg(tau), 9) as tau, round(coalesce(stddev_samp(tau), 0), 9) as tau_sd from ta where tau is not null group by budget", "cells")
def cost_frontier(spark: SparkSession, d: str) -> DataFrame:
    c = fx.cells(spark, d)
    costs = fx.tiers(c.select("item").distinct()).select("item", F.element_at(F.create_map(*[F.lit(x) for kv in ctt.COST.items() for x in kv]), F.col("tier")).cast("double").alias("cost"))
    return rounded(suites.frontier(c, costs, (8.0, 24.0), 4))


# Power

EFFECTS, SIMS, UNITS, SEEDS = (-0.4, -0.2, 0.0, 0.2, 0.4), 60, 8, 3


def _pool(spark: SparkSession, d: str) -> DataFrame:
    """Every cell's rate, numbered."""
    return fx.cells(spark, d).select((F.col("subject") * 20 + F.col("item")).alias("place"), "rate")


def _effects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e,) for e in EFFECTS], "effect double")


POWER = f""", pool as (select subject * 20 + item as place, rate from cells), g as (select sim, unit, floor({expr.uniform_sql('power/pool', 'sim', 'unit')} * 200)::bigint as place from (select unnest(range({SIMS})) as sim), (select unnest(range({UNITS})) as unit)), b as (select * from g join pool using (place)),
e as (select b.*, effect::double as effect, least(greatest(rate + effect::double, 0), 1) as pb from b, (select unnest([{', '.join(f'{x}::double' for x in EFFECTS)}]) as effect)), s as (select unnest(range({SEEDS})) as s),
d as (select effect, sim, unit, (sum(({expr.uniform_sql('power/b', 'sim', 'unit', 's')} < pb)::int) - sum(({expr.uniform_sql('power/a', 'sim', 'unit', 's')} < rate)::int)) / {SEEDS}.0::double as diff from e, s group by all),
f as (select effect, sim, perm, abs(sum(case when (perm >> unit::int) % 2 = 1 then -diff else diff end) / {UNITS}) as m, avg(diff) as mean from d, (select unnest(range({1 << UNITS})) as perm) group by all), p as (select effect, sim, (count(*) filter (m >= abs(mean) - 1e-12) + 1.0::double) / (count(*) + 1.0::double) as p from f group by all),
w as (select effect, avg((p < 0.05)::int::double) as power from p group by effect)"""


@query(POWER + " select effect, round(power, 9) as power from w", "cells")
def power_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.power(_pool(spark, d), _effects(spark), inference.Design(UNITS, SEEDS), SIMS))


@query(POWER + " select arg_min(effect, (abs(effect), effect)) filter (power >= 0.5) as mde from w where effect > 0", "cells")
def mde_grid(spark: SparkSession, d: str) -> DataFrame:
    powers = inference.power(_pool(spark, d), _effects(spark), inference.Design(UNITS, SEEDS), SIMS)
    return rounded(inference.minimum_detectable(powers.where("effect > 0"), 0.5))


BY_SEEDS = f""", pool as (select subject * 20 + item as place, rate from cells), g as (select sim, unit, floor({expr.uniform_sql('power/pool', 'sim', 'unit')} * 200)::bigint as place from (select unnest(range({SIMS})) as sim), (select unnest(range({UNITS})) as unit)),
d as (select seeds, sim, unit, (sum(({expr.uniform_sql('power/b', 'sim', 'unit', 's')} < least(greatest(rate + 0.4::double, 0), 1))::int) - sum(({expr.uniform_sql('power/a', 'sim', 'unit', 's')} < rate)::int)) / seeds::double as diff from g join pool using (place), (select unnest(range(1, 5)) as seeds), (select unnest(range(4)) as s) where s < seeds group by seeds, sim, unit),
f as (select seeds, sim, perm, abs(sum(case when (perm >> unit::int) % 2 = 1 then -diff else diff end) / {UNITS}) as m, avg(diff) as mean from d, (select unnest(range({1 << UNITS})) as perm) group by all), p as (select seeds, sim, (count(*) filter (m >= abs(mean) - 1e-12) + 1.0::double) / (count(*) + 1.0::double) as p from f group by all),
w as (select seeds, avg((p < 0.05)::int::double) as power from p group by seeds)"""


def _by_seeds(spark: SparkSession, d: str) -> DataFrame:
    plans = spark.range(1, 5).select(F.lit(0.4).alias("effect"), F.col("id").alias("seeds"))
    return inference.power(_pool(spark, d), plans, inference.Design(UNITS, 1), SIMS)


@query(BY_SEEDS + " select seeds, round(power, 9) as power from w", "cells")
def power_by_seeds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_by_seeds(spark, d).select("seeds", "power"))


@query(BY_SEEDS + " select min(seeds) filter (power >= 0.5) as seeds from w", "cells")
def seeds_needed(spark: SparkSession, d: str) -> DataFrame:
    return inference.seeds_needed(_by_seeds(spark, d), 0.5)


# Item response: fits are kernels; curves and estimates are plans over given parameters


def _parameters(spark: SparkSession, d: str) -> DataFrame:
    """Items with parameters made from their observed rates, so curves can be held against SQL."""
    c = fx.cells(spark, d).groupBy("item").agg((F.sum("successes") / F.sum("trials")).alias("observed_rate"))
    r = F.least(F.greatest(F.col("observed_rate"), F.lit(0.02)), F.lit(0.98))
    return c.select("item", (0.5 + (F.col("item") % 5) * 0.3).alias("a"), (-F.log(r / (1.0 - r))).alias("b"), "observed_rate", (F.col("observed_rate") > 0).alias("identified"), (F.col("item") == 3).alias("extrapolated"))


PARAMETERS = ", par as (select item, 0.5::double + (item % 5) * 0.3::double as a, -ln(r / (1 - r)) as b, o as observed_rate, o > 0 as identified, item = 3 as extrapolated from (select item, o, least(greatest(o, 0.02::double), 0.98::double) as r from (select item, sum(successes) / sum(trials)::double as o from cells group by item)))"
CURVE = PARAMETERS + ", g as (select n as node, -4.0::double + n * 0.25::double as theta from (select unnest(range(33)) as n)), cu as (select node, theta, sum(a * a * p * (1 - p)) * 3.0::double as information, avg(p) as expected_rate from (select *, 1 / (1 + exp(-a * (theta - b))) as p from par, g) group by all)"


def _curve(spark: SparkSession, d: str) -> DataFrame:
    return irt.curves(_parameters(spark, d), irt.grid(spark, -4.0, 4.0, 33), 3.0)


@query(CURVE + " select node, round(theta, 9) as theta, round(information, 9) as information, round(expected_rate, 9) as expected_rate, round(1 / sqrt(information), 9) as se from cu", "cells")
def irt_information_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_curve(spark, d))


@query(CURVE + " select round(min(theta) filter (1 / sqrt(information) <= 0.45), 9) as low, round(max(theta) filter (1 / sqrt(information) <= 0.45), 9) as high from cu", "cells")
def resolving_range(spark: SparkSession, d: str) -> DataFrame:
    return rounded(irt.resolving_range(_curve(spark, d), 0.45))


@query(CURVE + " select round(1 - sum(exp(-0.5 * theta * theta) / information) / sum(exp(-0.5 * theta * theta)), 9) as reliability from cu", "cells")
def marginal_reliability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(irt.marginal_reliability(_curve(spark, d)))


@query(CURVE + ", s as (select *, lead(expected_rate) over (order by node) - lag(expected_rate) over (order by node) as dr, lead(theta) over (order by node) - lag(theta) over (order by node) as dt from cu) select node, round(theta, 9) as theta, round(expected_rate, 9) as expected_rate, round(2.77::double / sqrt(information) * dr / dt, 9) as gap from s where dr is not null", "cells")
def resolution_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(irt.resolution(_curve(spark, d)))


@query(PARAMETERS + " select item, identified and not extrapolated as located, not identified as unidentified, extrapolated, a < 0 as inverted, round(a * a / 4, 9) as peak_information from par", "cells")
def irt_flags(spark: SparkSession, d: str) -> DataFrame:
    return rounded(irt.flags(_parameters(spark, d)))


@query(PARAMETERS + ", i as (select item, case when identified and not extrapolated then a * a * p * (1 - p) else 0 end as info from (select *, 1 / (1 + exp(-a * (0.5::double - b))) as p from par where item <> 4)) select item, round(info, 9) as info from i order by i.info desc, item limit 5", "cells")
def select_for_ability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(irt.select_for_ability(_parameters(spark, d), 0.5, 5, (4,)).select("item", "info"))


THETA = PARAMETERS + """, use as (select c.subject, n, -6.0::double + n * 0.025::double as theta, successes, trials, greatest(least(1 / (1 + exp(-a * (-6.0::double + n * 0.025::double - b))), 1 - 1e-9::double), 1e-9::double) as p from cells c join par using (item), (select unnest(range(481)) as n) where item % 3 = 0 and identified and not extrapolated),
ll as (select subject, n, theta, sum(successes * ln(p) + (trials - successes) * ln(1 - p)) - 0.5::double * theta * theta as ll from use group by subject, n, theta), w as (select *, exp(ll - max(ll) over (partition by subject)) as w from ll), th as (select subject, sum(w * theta) / sum(w) as theta from w group by subject)"""


def _small(spark: SparkSession, d: str) -> DataFrame:
    return fx.cells(spark, d).where("item % 3 = 0")


@query(THETA + " select subject, round(theta, 6) as theta from th", "cells")
def eap_theta(spark: SparkSession, d: str) -> DataFrame:
    return irt.abilities(_small(spark, d), _parameters(spark, d)).select("subject", F.round("theta", 6).alias("theta"))


@query(THETA + " select th.subject, round(avg(coalesce(c.successes / c.trials::double, case when identified and not extrapolated then 1 / (1 + exp(-a * (theta - b))) else observed_rate end)), 6) as predicted from th cross join par left join (select * from cells where item % 3 = 0) c on c.subject = th.subject and c.item = par.item group by th.subject", "cells")
def pirt_rate(spark: SparkSession, d: str) -> DataFrame:
    small, par = _small(spark, d), _parameters(spark, d)
    return irt.predicted_rates(small, par, irt.abilities(small, par)).select("subject", F.round("predicted", 6).alias("predicted"))


#: Rounds of the fits that are held against SQL.
EM = 5
NODES = ", nd as materialized (select n as node, x, -0.5 * x * x - ln(sum(exp(-0.5 * x * x)) over ()) as prior from (select n, -6.0::double + n * 0.05::double as x from (select unnest(range(241)) as n)))"


def em_posterior_sql(cells: str, params: str, out: str) -> str:
    """Table out (fit_id, subject, x, post, ll)."""
    z = "(a * x + d)"
    return f""", l_{out} as materialized (select c.fit_id, subject, x, sum(trials * (least({z}, 0) - ln(1 + exp(-abs({z})))) - (trials - successes) * {z}) + any_value(prior) as l from {cells} c join {params} p on p.fit_id = c.fit_id and p.item = c.item, nd group by all),
    {out} as materialized (select fit_id, subject, x, exp(l - m) / sum(exp(l - m)) over (partition by fit_id, subject) as post, ln(sum(exp(l - m)) over (partition by fit_id, subject)) + m as ll from (select *, max(l) over (partition by fit_id, subject) as m from l_{out}))"""


def em_sql(cells: str, name: str, rounds: int = EM, slopes: str = "") -> str:
    """Tables name0 .. name<rounds> (fit_id, item, a, d); slopes names a table of fixed slopes."""
    begin = f"coalesce((select a from {slopes} s where s.fit_id = c.fit_id), 1)" if slopes else "1.0::double"
    out = f", {name}0 as materialized (select fit_id, item, {begin} as a, ln(r / (1 - r)) as d from (select fit_id, item, least(greatest(sum(successes) / sum(trials)::double, 1e-3::double), 1 - 1e-3::double) as r from {cells} group by all) c)"
    for k in range(rounds):
        out += em_posterior_sql(cells, f"{name}{k}", f"{name}o{k}")
        out += f""", {name}s{k} as (select fit_id, item, any_value(a) as a, any_value(d) as d, sum(e) as e, sum(w) as w, sum(e * x) as ex, sum(w * x) as wx, sum(w * x * x) as wxx from (select *, post * (successes - trials * p) as e, post * trials * p * (1 - p) as w from
          (select c.fit_id, c.item, a, d, x, post, successes, trials, 1 / (1 + exp(-(a * x + d))) as p from {cells} c join {name}o{k} o on o.fit_id = c.fit_id and o.subject = c.subject join {name}{k} q on q.fit_id = c.fit_id and q.item = c.item)) group by fit_id, item),
        {name}g{k} as (select *, e - d / 16 as gd, w + 1 / 16.0::double + 1e-6::double as hd, ex - (a - 1) / 0.36::double as ga, wxx + 1 / 0.36::double + 1e-6::double as ha from {name}s{k}),
        {name}v{k} as (select *, {'0.0::double' if slopes else '(hd * ga - wx * gd) / (ha * hd - wx * wx)'} as da, {'gd / hd' if slopes else '(ha * gd - wx * ga) / (ha * hd - wx * wx)'} as dd from {name}g{k}),
        {name}{k + 1} as materialized (select fit_id, item, a + da * least(1, 1 / greatest(abs(da), abs(dd), 1e-12::double)) as a, d + dd * least(1, 1 / greatest(abs(da), abs(dd), 1e-12::double)) as d from {name}v{k})"""
    return out


def em_scaled_sql(cells: str, params: str, name: str) -> str:
    """Tables name_items, name_subjects and name_fits of fitted parameters, normalised."""
    return em_posterior_sql(cells, params, f"{name}_o") + f""", {name}_raw as (select fit_id, subject, sum(post * x) as theta, sqrt(greatest(sum(post * x * x) - sum(post * x) * sum(post * x), 0)) as se, max(ll) as ll from {name}_o group by all),
    {name}_fits as (select fit_id, avg(theta) as mu, stddev_samp(theta) as unit, min(theta) as low, max(theta) as high, sum(ll) as log_likelihood from {name}_raw group by fit_id),
    {name}_subjects as (select fit_id, subject, (theta - mu) / unit as theta, se / unit as se from {name}_raw join {name}_fits using (fit_id)),
    {name}_items as (select *, steep and s <> 0 and s <> n as identified, not (b between (low - mu) / unit - 1 and (high - mu) / unit + 1) as extrapolated, s / n as observed_rate from (select fit_id, item, a, low, high, mu, unit, s, n, abs(a) >= 0.2 as steep, case when abs(a) >= 0.2 then -d / a else 'inf'::double end as b
      from (select p.fit_id, p.item, a * unit as a, d + a * mu as d, low, high, mu, unit, s, n from {params} p join {name}_fits f on f.fit_id = p.fit_id join (select fit_id, item, sum(successes)::double as s, sum(trials)::double as n from {cells} group by all) t on t.fit_id = p.fit_id and t.item = p.item)))"""


ALL = ", every as materialized (select 'all' as fit_id, * from cells)"
WHOLE = NODES + ALL + em_sql("every", "p") + em_scaled_sql("every", f"p{EM}", "z")


@query(NODES + ALL + em_sql("every", "p", 1) + " select item, round(a, 7) as a, round(d, 7) as d from p1", "cells")
def irt_step(spark: SparkSession, d: str) -> DataFrame:
    c = fx.cells(spark, d)
    return irt.stepped(c, irt.started(c)).select("item", F.round("a", 7).alias("a"), F.round("d", 7).alias("d"))


def _fits(spark: SparkSession, d: str) -> DataFrame:
    return fx.cells(spark, d).withColumn("fit_id", F.lit("all"))


@query(NODES + ALL + em_sql("every", "p", 8) + " select item, round(a, 4) as a, round(d, 4) as d from p8", "cells")
def irt_fit_distributed(spark: SparkSession, d: str) -> DataFrame:
    return irt.fitted_in_rounds(_fits(spark, d), 8).select("item", F.round("a", 4).alias("a"), F.round("d", 4).alias("d"))


def _model(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = _fits(spark, d)
    return irt.scaled(c, irt.fitted_in_rounds(c, EM))


@query(WHOLE + " select item, round(a, 6) as a, round(case when isfinite(b) then b end, 6) as b, round(observed_rate, 6) as observed_rate, identified, extrapolated from z_items", "cells")
def irt_fit(spark: SparkSession, d: str) -> DataFrame:
    located = F.when(F.col("b") != float("inf"), F.col("b"))
    return _model(spark, d)[0].select("item", F.round("a", 6).alias("a"), F.round(located, 6).alias("b"), F.round("observed_rate", 6).alias("observed_rate"), "identified", "extrapolated")


@query(WHOLE + " select subject, round(theta, 6) as theta, round(se, 6) as se from z_subjects", "cells")
def irt_abilities(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d)[1].select("subject", F.round("theta", 6).alias("theta"), F.round("se", 6).alias("se"))


@query(WHOLE + f" select round(log_likelihood, 4) as log_likelihood, {EM}::bigint as iterations, false as converged from z_fits", "cells")
def irt_likelihood(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_model(spark, d)[2].select(F.round("log_likelihood", 4).alias("log_likelihood"), "iterations", "converged"))


FOLDS = f""", known as (select *, floor({expr.uniform_sql('cv', 'subject', 'item')} * 3)::bigint::varchar as fold from cells), folds as (select unnest(['0', '1', '2']) as fit_id), train as materialized (select fit_id, subject, item, successes, trials from known, folds where fold <> fit_id)"""


@query(NODES + FOLDS + em_sql("train", "p") + f", slopes as (select fit_id, avg(a) as a from p{EM} group by fit_id)" + em_sql("train", "q", slopes="slopes") + em_posterior_sql("train", f"p{EM}", "po") + f""", th as (select fit_id, subject, sum(post * x) as theta from po group by all), im as (select fit_id, item, least(greatest(sum(successes) / sum(trials)::double, 1e-4::double), 1 - 1e-4::double) as r from train group by all),
    asked as (select k.*, 1 / (1 + exp(-(p.a * theta + p.d))) as p2, 1 / (1 + exp(-(q.a * theta + q.d))) as p1, r from known k join th on th.fit_id = k.fold and th.subject = k.subject join p{EM} p on p.fit_id = k.fold and p.item = k.item join q{EM} q on q.fit_id = k.fold and q.item = k.item join im on im.fit_id = k.fold and im.item = k.item),
    scored as (select trials, successes, unnest(['2pl', 'rasch', 'item_mean']) as model, least(greatest(unnest([p2, p1, r]), 1e-6::double), 1 - 1e-6::double) as p from asked)
    select model, round(sum(successes * ln(p) + (trials - successes) * ln(1 - p)) / sum(trials), 7) as log_likelihood from scored group by model""", "cells")
def irt_held_out(spark: SparkSession, d: str) -> DataFrame:
    return irt.held_out(fx.cells(spark, d), 3, rounds=EM).select("model", F.round("log_likelihood", 7).alias("log_likelihood"))


DRAWS = 24


def em_rest_sql(cells: str, name: str, still: float = kernels.TOLERANCE) -> str:
    """Table name (fit_id, item, a, d) of em_sql's rounds, as many as it takes until no parameter of a fit moves by still. Sums over subjects, items and nodes are products of lists."""
    return f""", {name}_full as materialized (select fit_id, subject, item, coalesce(successes, 0)::double as s, coalesce(trials, 0)::double as t from (select distinct fit_id, subject from {cells}) join (select distinct fit_id, item from {cells}) using (fit_id) left join {cells} using (fit_id, subject, item)),
    {name}_by_subject as materialized (select fit_id, subject, list(t order by item) as ts, list(t - s order by item) as fs from {name}_full group by all),
    {name}_by_item as materialized (select fit_id, item, list(s order by subject) as ss, list(t order by subject) as ts from {name}_full group by all),
    {name}_grid as materialized (select list(x order by node) as xs, list(x * x order by node) as xxs, list(prior order by node) as priors from nd),
    {name}_turns as materialized (with recursive turns as (select fit_id, item, 1.0::double as a, ln(r / (1 - r)) as d, 0 as k, 'inf'::double as moved from (select fit_id, item, least(greatest(sum(successes) / sum(trials)::double, 1e-3::double), 1 - 1e-3::double) as r from {cells} group by all)
     union all (with live as materialized (select fit_id, item, a, d, k from turns where k < {irt.ENDLESS} and fit_id in (select fit_id from turns group by fit_id having max(moved) >= {still}::double)),
      models as materialized (select fit_id, ma, md, xs, priors, list_transform(xs, lambda x: list_transform(list_zip(ma, md), lambda m: least(m[1] * x + m[2], 0) - ln(1 + exp(-abs(m[1] * x + m[2]))))) as logs from (select fit_id, list(a order by item) as ma, list(d order by item) as md from live group by fit_id), {name}_grid),
      l as materialized (select fit_id, subject, list_transform(logs, lambda u, i: list_dot_product(ts, u) - fa * xs[i] - fd + priors[i]) as l from (select *, list_dot_product(fs, ma) as fa, list_dot_product(fs, md) as fd from {name}_by_subject join models using (fit_id))),
      w as (select fit_id, subject, list_transform(l, lambda v: exp(v - top)) as w from (select *, list_max(l) as top from l)),
      o as materialized (select fit_id, list(post order by subject) as posts from (select fit_id, subject, list_transform(w, lambda v: v / mass) as post from (select *, list_sum(w) as mass from w)) group by fit_id),
      across as materialized (select fit_id, xs, xxs, list_transform(xs, lambda x, i: list_transform(posts, lambda p: p[i])) as nodes from o, {name}_grid),
      rf as (select fit_id, item, a, d, k, xs, xxs, list_transform(nodes, lambda n: list_dot_product(ss, n)) as r, list_transform(nodes, lambda n: list_dot_product(ts, n)) as f, list_transform(xs, lambda x: 1 / (1 + exp(-(a * x + d)))) as p from {name}_by_item join across using (fit_id) join live using (fit_id, item)),
      ew as (select *, list_transform(r, lambda v, i: v - f[i] * p[i]) as es, list_transform(f, lambda v, i: v * p[i] * (1 - p[i])) as ws from rf),
      sums as (select fit_id, item, a, d, k, list_sum(es) as e, list_sum(ws) as w, list_dot_product(es, xs) as ex, list_dot_product(ws, xs) as wx, list_dot_product(ws, xxs) as wxx from ew),
      g as (select *, e - d / 16 as gd, w + 1 / 16.0::double + 1e-6::double as hd, ex - (a - 1) / 0.36::double as ga, wxx + 1 / 0.36::double + 1e-6::double as ha from sums),
      v as (select *, (hd * ga - wx * gd) / (ha * hd - wx * wx) as da, (ha * gd - wx * ga) / (ha * hd - wx * wx) as dd from g),
      s as (select *, least(1, 1 / greatest(abs(da), abs(dd), 1e-12::double)) as scale from v)
      select fit_id, item, a + da * scale, d + dd * scale, k + 1, greatest(abs(da), abs(dd)) * scale from s)) select * from turns),
    {name} as materialized (select fit_id, item, a, d from {name}_turns qualify k = max(k) over (partition by fit_id))"""


@query(NODES + ALL + em_rest_sql("every", "p") + em_scaled_sql("every", "p", "z") + f""", made as (select subject, item, trials, case when isfinite(b) then 1 / (1 + exp(-a * (theta - b))) else 0 end as p from cells join z_items i using (item) join z_subjects s using (subject)),
    again as materialized (select fit_id, subject, item, count(*) filter ({expr.uniform_sql('attenuation', 'fit_id', 'subject', 'item', 't')} < p) as successes, any_value(trials) as trials from (select draw::varchar as fit_id, made.*, unnest(range(1, trials + 1)) as t from made, (select unnest(range({DRAWS})) as draw)) group by fit_id, subject, item)"""
    + em_rest_sql("again", "y") + em_scaled_sql("again", "y", "t") + """, io as (select n.fit_id, count(*) as n, covar_samp(o.a, n.a) / var_samp(o.a) as slope, covar_samp(o.b, n.b) / (stddev_samp(o.b) * stddev_samp(n.b)) as difficulty_recovery from t_items n join z_items o using (item) where o.identified and isfinite(o.b) and isfinite(n.b) group by n.fit_id),
    so as (select n.fit_id, covar_samp(o.theta, n.theta) / (stddev_samp(o.theta) * stddev_samp(n.theta)) as ability_recovery from t_subjects n join z_subjects o using (subject) group by n.fit_id) select fit_id as draw, round(slope, 6) as slope, round(ability_recovery, 6) as ability_recovery, round(difficulty_recovery, 6) as difficulty_recovery from io join so using (fit_id) where n >= 3""", "cells")  # fmt: skip
def irt_attenuation(spark: SparkSession, d: str) -> DataFrame:
    out = irt.attenuation(fx.cells(spark, d), DRAWS)
    return out.select("draw", *[F.round(c, 6).alias(c) for c in ("slope", "ability_recovery", "difficulty_recovery")])


# Subsets: each subject left out in turn


def _newton_sql(source: str, params: str, out: str) -> str:
    """Table out (held, item, a, d): one damped step of params on the counts of source (held, item, x, r, f)."""
    return f""", {out}s as (select held, item, any_value(a) as a, any_value(d) as d, sum(r - f * p) as e, sum(f * p * (1 - p)) as w, sum((r - f * p) * x) as ex, sum(f * p * (1 - p) * x) as wx, sum(f * p * (1 - p) * x * x) as wxx from (select *, 1 / (1 + exp(-(a * x + d))) as p from {source} join {params} using (held, item)) group by all),
    {out}g as (select *, e - d / 16 as gd, w + 1 / 16.0::double + 1e-6::double as hd, ex - (a - 1) / 0.36::double as ga, wxx + 1 / 0.36::double + 1e-6::double as ha from {out}s), {out}v as (select *, (hd * ga - wx * gd) / (ha * hd - wx * wx) as da, (ha * gd - wx * ga) / (ha * hd - wx * wx) as dd from {out}g),
    {out} as materialized (select held, item, a + da * least(1, 1 / greatest(abs(da), abs(dd), 1e-12::double)) as a, d + dd * least(1, 1 / greatest(abs(da), abs(dd), 1e-12::double)) as d from {out}v)"""


LEFT_OUT = NODES + ALL + em_sql("every", "p") + em_posterior_sql("every", f"p{EM}", "po") + f""", rf as (select item, x, sum(successes * post) as r, sum(trials * post) as f from cells join po using (subject) group by all),
own as materialized (select c.subject as held, c.item, x, rf.r - successes * post as r, rf.f - trials * post as f from cells c join po using (subject) join rf using (item, x)), h0 as (select c.subject as held, c.item, a, d from cells c join p{EM} p on p.item = c.item)""" + _newton_sql("own", "h0", "h1") + _newton_sql("own", "h1", "h2") + """, th as (select subject, sum(post * x) as theta from po group by subject),
sc as (select a.subject as held, avg(b.theta) as mu, stddev_samp(b.theta) as unit, min(b.theta) as low, max(b.theta) as high from th a join th b on a.subject <> b.subject group by 1), ot as (select o.subject as held, c.item, sum(successes)::double as s, sum(trials)::double as n from cells c, (select distinct subject from cells) o where o.subject <> c.subject group by all),
models as materialized (select held as subject, item, a, b, s / n as observed_rate, abs(a) >= 0.2 and s <> 0 and s <> n as identified, not (b between (low - mu) / unit - 1 and (high - mu) / unit + 1) as extrapolated from (select *, case when abs(a) >= 0.2 then -d / a else 'inf'::double end as b from (select held, item, a * unit as a, d + a * mu as d, mu, unit, low, high from h2 join sc using (held)) join ot using (held, item)))"""
KS, REPEATS = (4, 8), 2
SELECTED = FREE + f", x as (select o.subject as split, c.subject, c.item, c.successes / c.trials::double as rate from cells c, (select distinct subject from cells) o where o.subject <> c.subject)" + greedy_sql(max(KS), False) + f""", ks as (select unnest({list(KS)}) as k), rp as (select unnest(range({REPEATS}))::int as repeat),
chosen as materialized (select subject, 'random' as selector, k, repeat, item from (select *, row_number() over (partition by subject, k, repeat order by {expr.uniform_sql('subset/random', 'subject', 'k', 'repeat', 'item')}, item) as place from models, ks, rp) where place <= k
  union all select subject, 'stratified', k, repeat, arg_min(item, ({expr.uniform_sql('subset/stratified', 'subject', 'k', 'repeat', 'item')}, item)) from ({' union all '.join(f'select *, {k} as k, ntile({k}) over (partition by subject order by observed_rate, item) as bin from models' for k in KS)}), rp group by subject, k, repeat, bin
  union all select split, 'greedy_alpha', k, 0, item from s, ks where step < k
  union all select subject, 'max_information', k, 0, item from (select *, row_number() over (partition by subject order by round(case when identified and not extrapolated then a * a * p * (1 - p) else 0 end, 12) desc, item) as place from (select *, 1 / (1 + exp(a * b)) as p from models)), ks where place <= k)"""
ESTIMATED = """, ran as (select c.*, successes, trials, successes / trials::double as rate from chosen c join cells using (subject, item)),
ll as (select subject, selector, k, repeat, theta, sum(successes * ln(p) + (trials - successes) * ln(1 - p)) - 0.5 * theta * theta as l from (select r.*, theta, least(greatest(1 / (1 + exp(-a * (theta - b))), 1e-9::double), 1 - 1e-9::double) as p from ran r join models m using (subject, item), (select -6.0::double + n * 0.025::double as theta from (select unnest(range(481)) as n)) where identified and not extrapolated) group by subject, selector, k, repeat, theta),
ab as (select subject, selector, k, repeat, sum(w * theta) / sum(w) as theta from (select *, exp(l - max(l) over (partition by subject, selector, k, repeat)) as w from ll) group by all), ca as (select subject, selector, k, repeat, avg(rate) as naive, coalesce(any_value(theta), 0) as theta from ran left join ab using (subject, selector, k, repeat) group by all),
pi as (select ca.subject, ca.selector, ca.k, ca.repeat, any_value(naive) as naive, avg(coalesce(r.rate, case when identified and not extrapolated then 1 / (1 + exp(-a * (theta - b))) else observed_rate end)) as pirt from ca join models m using (subject) left join ran r on r.subject = ca.subject and r.selector = ca.selector and r.k = ca.k and r.repeat = ca.repeat and r.item = m.item group by all),
er as (select selector, k, unnest(['pirt', 'naive']) as estimator, unnest([pirt - truth, naive - truth]) as error from pi join (select subject, avg(successes / trials::double) as truth from cells group by subject) using (subject))"""


@query(LEFT_OUT + " select subject, item, round(a, 6) as a, round(case when isfinite(b) then b end, 5) as b, round(observed_rate, 9) as observed_rate, identified, extrapolated from models", "cells")
def irt_left_out(spark: SparkSession, d: str) -> DataFrame:
    b = F.when(F.col("b") != float("inf"), F.round("b", 5))
    return subset.left_out(fx.cells(spark, d), EM).select("subject", "item", F.round("a", 6).alias("a"), b.alias("b"), F.round("observed_rate", 9).alias("observed_rate"), "identified", "extrapolated")


@query(LEFT_OUT + SELECTED + ESTIMATED + " select selector, estimator, k, round(avg(abs(error)), 6) as mae, round(max(abs(error)), 6) as max_error, round(avg(error), 6) as bias, count(*) as n from er group by selector, estimator, k", "cells")
def subset_eval(spark: SparkSession, d: str) -> DataFrame:
    found = subset.errors(fx.cells(spark, d), KS, REPEATS, {k: v for k, v in subset.SELECTORS.items() if k != "anchor"}, EM)
    return rounded(subset.summary(found).select("selector", "estimator", "k", *[F.round(c, 6).alias(c) for c in ("mae", "max_error", "bias")], "n"))


@query()
def anchor_eval(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda models, cells, k, repeats: subset.select_anchor(models, cells, k, repeats, 3)
    return rounded(subset.summary(subset.errors(fx.cells(spark, d), (4,), 1, {"anchor": pick}, EM)))


def kmeans_sql(k: int, rounds: int) -> str:
    """Table c<rounds> (c, x) from points (point, x)."""
    race = lambda step: f"-ln(greatest({expr.uniform_sql('kmeans', chr(39) + '0' + chr(39), str(step), 'point')}, 1e-12::double))"
    far = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - s.x[i]) * (p.x[i] - s.x[i])))"
    out = f", s0 as materialized (select 0 as c, arg_min(x, ({race(0)}, point)) as x from points)"
    for step in range(1, k):
        out += f", s{step} as materialized (select * from s{step - 1} union all select {step}, arg_min(x, ({race(step)} / far, point)) from (select p.point, p.x, min({far}) as far from points p, s{step - 1} s group by p.point, p.x) where far > 0)"
    out += f", c0 as (select * from s{k - 1})"
    for r in range(rounds):
        out += f""", a{r} as materialized (select point, any_value(x) as x, arg_min(c, (far, c)) as c from (select p.point, p.x, s.c, {far} as far from points p, c{r} s) group by point),
        n{r} as (select c, list(m order by i) as m from (select c, i, avg(x[i]) as m from a{r}, (select unnest(range(1, 1 + (select max(len(x)) from points)::bigint)) as i) group by c, i) group by c), c{r + 1} as materialized (select c{r}.c, coalesce(m, x) as x from c{r} left join n{r} using (c))"""
    return out


CLUSTERS, TURNS = 5, 3
POINTS = ", points as (select vec_id as point, list_transform(embedding, lambda v: v::double) as x from embeddings)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("point"), F.col("embedding").cast("array<double>").alias("x"))


@query(("with " + (POINTS + kmeans_sql(CLUSTERS, TURNS))[2:]) + f" select c::bigint as c, i - 1 as dimension, round(x[i], 9) as value from c{TURNS}, (select unnest(range(1, 65)) as i)")
def kmeans_centres(spark: SparkSession, d: str) -> DataFrame:
    found = clustering.kmeans(_points(spark, d), CLUSTERS, TURNS)
    return rounded(found.select(F.posexplode("centres").alias("c", "x")).select("c", F.posexplode("x").alias("dimension", "value")))


@query(("with " + (POINTS + kmeans_sql(CLUSTERS, TURNS))[2:]) + f", d as (select c, point, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - s.x[i]) * (p.x[i] - s.x[i]))) as d from points p, c{TURNS} s)" + "".join(f", e{c} as ({f'select * from e{c - 1} union all ' if c else ''}select {c} as c, arg_min(point, (d, point)) as point from d where c = {c}{f' and point not in (select point from e{c - 1})' if c else ''})" for c in range(CLUSTERS)) + f" select point from e{CLUSTERS - 1}")
def kmeans_exemplars(spark: SparkSession, d: str) -> DataFrame:
    points = _points(spark, d)
    return clustering.exemplars(points, clustering.kmeans(points, CLUSTERS, TURNS))


# Feature tables


@query("with m as (select feature, avg(x) as m from features where row % 2 = 0 group by feature) select row, feature, round(coalesce(x, m, 0), 6) as x from features left join m using (feature)".replace("with m", ", m", 1), "features")
def impute_mean(spark: SparkSession, d: str) -> DataFrame:
    f = fx.features(spark, d)
    return features.imputed(f, f.where("row % 2 = 0")).select("row", "feature", F.round("x", 6).alias("x"))


@query(", q as (select feature, median(x) as med, quantile_cont(x, 0.005) as lo, quantile_cont(x, 0.995) as hi from features group by feature), s as (select feature, 1.4826::double * median(abs(x - med)) as mad, max(abs(x - med)) as far from features join q using (feature) group by feature) select row, feature, round(case when far > 12 * greatest(mad, 1e-12) then least(greatest(x, lo), hi) else x end, 6) as x from features join q using (feature) join s using (feature) where x is not null", "features")
def winsorise_mad(spark: SparkSession, d: str) -> DataFrame:
    return features.winsorised(fx.features(spark, d).where("x is not null")).select("row", "feature", F.round("x", 6).alias("x"))


@query("select feature, round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) as r from (select row, feature, x, y from features join targets using (row) where x is not null) group by feature having abs(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y))) > 0.9", "features", "targets")
def leak_features(spark: SparkSession, d: str) -> DataFrame:
    return features.suspicious(fx.features(spark, d).where("x is not null"), fx.targets(spark, d)).select("feature", F.round("r", 6).alias("r"))


def _quarter(spark: SparkSession, d: str) -> DataFrame:
    """Features in quarters, which print alike everywhere."""
    return fx.features(spark, d).where("x is not null").select("row", "feature", (F.floor(F.col("x") * 4) / 4.0).alias("x"))


PRINTS = ", fp as (select row, substr(sha256(string_agg(v, ',' order by v)), 1, 24) as fingerprint from (select row, printf('%.4f', case when floor(x * 4) = 0 then 0.0::double else floor(x * 4) / 4.0::double end) as v from features where x is not null) group by row)"


@query(PRINTS + " select row, fingerprint from fp", "features")
def row_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return features.fingerprints(_quarter(spark, d))


@query(PRINTS + " select row, row_number() over (order by fingerprint, row) <= (select floor(count(*) * 0.75::double) from fp) as is_train from fp", "features")
def content_holdout(spark: SparkSession, d: str) -> DataFrame:
    return features.content_holdout(features.fingerprints(_quarter(spark, d)), 0.75)


@query(PRINTS + ', m as (select fingerprint, arg_max(row % 2, row) as answer from fp where row % 3 <> 0 group by fingerprint) select fp.row % 3 as "group", round(avg((m.fingerprint is not null)::int::double), 9) as hit_rate, avg((m.fingerprint is not null)::int::double) >= 0.9 as uses_memory from fp left join m using (fingerprint) group by 1', "features")
def memory_lookup(spark: SparkSession, d: str) -> DataFrame:
    fp = features.fingerprints(_quarter(spark, d))
    memory = fp.where("row % 3 <> 0").select("fingerprint", (F.col("row") % 2).alias("answer"), F.col("row").alias("priority"))
    return rounded(features.recalled(fp.withColumn("group", F.col("row") % 3), memory))


@query("select task, doc_id, round((row_number() over (partition by task order by n_chars, doc_id) - 0.5::double) / count(*) over (partition by task), 9) as q from answers", "answers")
def rank_normalise(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.rank_normalised(fx.answers(spark, d), ["task"], "n_chars", "doc_id"))


@query(", v as (select vec_id, label::double as y, list_transform(embedding, lambda x: x::double) as x from embeddings), e as (select vec_id, y, i - 1 as i, x[i] as xi from v, (select unnest(range(1, 65)) as i)), n as (select *, 64 as one from v)"
    " select a.i, b.i as j, round(sum(a.xi * b.xi), 6) as g from e a join e b using (vec_id) where a.i <= b.i group by a.i, b.i union all select i, 64, round(sum(xi), 6) from e group by i union all select i, 65, round(sum(xi * y), 6) from e group by i union all select 64, 64, count(*) from v union all select 64, 65, round(sum(y), 6) from v".replace(", v as", "with v as", 1))  # fmt: skip
def ridge_sums(spark: SparkSession, d: str) -> DataFrame:
    """Sums of products of 64 features, of a column of ones (64) and of the target (65)."""
    rows = fx.table(spark, d, "embeddings").select(F.array(*[F.get("embedding", F.lit(k)).cast("double") for k in range(64)], F.lit(1.0)).alias("x"), F.col("label").cast("double").alias("y"))
    return rounded(features.gram(rows, 65).select("i", "j", F.round("g", 6).alias("g")))


# Published tables and small filters

PUBLISHED = ", pub as (select 'e' || subject as experiment, 'c' || item as competition_id, successes as medals, trials as seeds from cells where not (subject = 3 and item in (2, 5)))"


def _published(spark: SparkSession, d: str) -> DataFrame:
    c = fx.cells(spark, d).where("not (subject = 3 and item in (2, 5))")
    return c.select(F.concat(F.lit("e"), F.col("subject").cast("string")).alias("experiment"), F.concat(F.lit("c"), F.col("item").cast("string")).alias("competition_id"), F.col("successes").alias("medals"), F.col("trials").alias("seeds"))


@query(PUBLISHED + " select experiment from pub group by 1 having count(distinct competition_id) = 20", "cells")
def complete_experiments(spark: SparkSession, d: str) -> DataFrame:
    return published.complete(_published(spark, d), 20)


@query(PUBLISHED + " select experiment as subject, competition_id as item, round(medals / seeds::double, 9) as rate, seeds as trials from pub where competition_id in (select competition_id from pub group by 1 having count(distinct experiment) = (select count(distinct experiment) from pub))", "cells")
def common_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(published.matrix(_published(spark, d)))


@query(PUBLISHED + " select experiment, count(*) as n, round(avg(medals / seeds::double), 9) as mean_rate, count(*) filter (medals = 0) as never, count(*) filter (medals = seeds) as always from pub group by 1", "cells")
def experiment_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(published.summary(_published(spark, d)))


@query(PUBLISHED + " select competition_id, round(medals / seeds::double, 9) as rate from pub where experiment = 'e4' and competition_id not in ('c1', 'c2')", "cells")
def reference_rates(spark: SparkSession, d: str) -> DataFrame:
    t = _published(spark, d)
    return rounded(published.rates(t, "e4", t.where("competition_id not in ('c1', 'c2')").select("competition_id").distinct()))


@query("select subject, count(*) as n_live from cells where item in (select item from cells group by 1 having stddev_pop(rate) > 0) and subject in (select subject from cells group by 1 having avg(rate) between 0.3 and 0.6) group by 1", "cells")
def live_band(spark: SparkSession, d: str) -> DataFrame:
    c = fx.cells(spark, d)
    return published.band(c, 0.3, 0.6).join(published.live(c).select("item").distinct(), "item", "left_semi").groupBy("subject").agg(F.count("*").alias("n_live"))


@query("select item, s as seed, item || '__seed' || s as slug from (select distinct item from cells), (select unnest(range(3)) as s)", "cells")
def run_targets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(published.targets(fx.cells(spark, d).select("item").distinct(), 3))


@query(f", {ITEMS}, r as (select item, round(item_rest, 9) as item_rest from i) select * from (select * from r order by item_rest, item limit 3) union all select * from (select * from r order by item_rest desc, item limit 3)", "cells")
def worst_and_best_items(spark: SparkSession, d: str) -> DataFrame:
    return published.ends(rounded(ctt.item_stats(fx.cells(spark, d)).select("item", "item_rest")), "item_rest", 3)
