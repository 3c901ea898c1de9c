"""Skill profiles (paired control and challenged scores) and contamination probes (originals and clones)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywork.functions import expr
from tallywork.operators import inference

#: Least mean difference that matters.
MATTERS = 0.02


def cells(pairs: DataFrame, alpha: float = 0.05, n_boot: int = 1000, n_permutations: int = 9999) -> DataFrame:
    """agent, challenge: delta, interval, p-value and flags. pairs: agent, challenge, unit, control, challenged (null: failed).

    A pair without both scores counts as broken and never as a difference of zero.
    """
    keys = ["agent", "challenge"]
    ok = pairs.where("control is not null and challenged is not null").withColumn("diff", F.col("challenged") - F.col("control"))
    n = pairs.groupBy(*keys).agg(F.count("*").alias("n_pairs"), F.count_if(F.col("control").isNull() | F.col("challenged").isNull()).alias("n_broken"))
    p, ci = inference.sign_flip(ok, keys, n_permutations, "skill"), inference.bootstrap_ci(ok, keys, n_boot, alpha, "skill")
    out = n.join(p, keys, "left").join(ci, keys, "left").withColumnRenamed("mean_diff", "delta")
    significant = F.coalesce(F.col("p_value") < alpha, F.lit(False))
    return out.select(*keys, "n_pairs", "n_broken", "delta", "p_value", "ci_low", "ci_high", (F.col("n_broken") == F.col("n_pairs")).alias("broke"), ((F.col("n_broken") > 0) & (F.col("n_broken") < F.col("n_pairs"))).alias("partially_broke"), significant.alias("significant"), (significant & (F.abs("delta") >= MATTERS)).alias("meaningful"))


def robustness(found: DataFrame) -> DataFrame:
    """agent, robustness: mean over challenges of -1 if broken, the loss if it matters, else 0; unknown ones are skipped."""
    loss = F.when(F.col("broke"), -1.0).when(F.col("delta").isNull(), None).when(F.col("meaningful"), F.least(F.col("delta"), F.lit(0.0))).otherwise(0.0)
    return found.groupBy("agent").agg(F.avg(loss).alias("robustness"))


def hardest(found: DataFrame) -> DataFrame:
    """agent, challenge of the largest loss, only if there is one; ties by challenge."""
    loss = F.when(F.col("broke"), -1.0).when(F.col("meaningful"), F.col("delta")).otherwise(0.0)
    worst = found.withColumn("loss", loss).where("loss < 0").groupBy("agent").agg(F.min(F.struct("loss", "challenge")).alias("w"))
    return worst.select("agent", F.col("w.challenge").alias("challenge"), F.col("w.loss").alias("loss"))


def dominant(found: DataFrame) -> DataFrame:
    """Agents that no other agent clearly beats on any challenge and that have every challenge unbroken."""
    challenges = found.select("challenge").distinct()
    full = found.where(~F.col("broke") & F.col("delta").isNotNull()).groupBy("agent").agg(F.count_distinct("challenge").alias("n")).join(F.broadcast(challenges.agg(F.count("*").alias("of"))), F.col("n") == F.col("of"))
    other = found.select(F.col("challenge").alias("c"), F.col("agent").alias("rival"), F.col("ci_low").alias("rival_low"), F.col("delta").alias("rival_delta"))
    beaten = found.join(other, (F.col("challenge") == F.col("c")) & (F.col("agent") != F.col("rival")) & (F.col("rival_low") > F.col("ci_high")) & (F.col("rival_delta") - F.col("delta") >= MATTERS))
    return full.select("agent").join(beaten.select("agent").distinct(), "agent", "left_anti")


def in_order(rows: DataFrame, label: str, order: str) -> DataFrame:
    """Distinct labels in order of first appearance."""
    return rows.groupBy(label).agg(F.min(order).alias("first"))


def dense(found: DataFrame) -> DataFrame:
    """Every agent and challenge with its cell, if any; both are short lists of labels."""
    grid = found.select("agent").distinct().crossJoin(found.select("challenge").distinct())
    return grid.join(found, ["agent", "challenge"], "left")


def probe_gap(rows: DataFrame, transform: str, value: str = "percentile", only_valid: bool = True) -> DataFrame:
    """agent, n, gap: mean of original less clone. rows: agent, item, is_clone, transform, value, valid.

    A clone's item is the original's name, two underscores and a suffix. Percentile gaps leave out invalid rows, medal gaps don't.
    """
    good = rows.where("valid") if only_valid else rows
    good = good.where(F.col(value).isNotNull())
    clones = good.where(F.col("is_clone") & (F.col("transform") == transform)).select("agent", expr.before_last(F.col("item"), "__").alias("item"), F.col(value).cast("double").alias("clone"))
    both = good.where(~F.col("is_clone")).select("agent", "item", F.col(value).cast("double").alias("own")).join(clones, ["agent", "item"])
    return both.groupBy("agent").agg(F.count("*").alias("n"), F.avg(F.col("own") - F.col("clone")).alias("gap"))


def recall_rate(rows: DataFrame, transform: str | None = None) -> DataFrame:
    """agent, recall: share recalled of the originals, or of one transform's clones; 0 where there are none."""
    which = ~F.col("is_clone") if transform is None else F.col("is_clone") & (F.col("transform") == transform)
    return rows.groupBy("agent").agg(F.coalesce(F.avg(F.when(which, F.col("recalled").cast("double"))), F.lit(0.0)).alias("recall"))


def controls(rows: DataFrame, deltas: DataFrame, honest: str, memoriser: str, bar: float = 0.05, most_delta: float = 0.005) -> DataFrame:
    """control, passed, value: the battery that a contamination probe must pass before its gaps mean anything.

    rows as for probe_gap, with recalled; deltas (transform, delta) are differences of difficulty between original and
    clone. What can't be computed fails.
    """
    gap = lambda transform, agent: probe_gap(rows, transform).where(F.col("agent") == agent).agg(F.max("gap").alias("v"))
    recall = lambda transform: recall_rate(rows, transform).where(F.col("agent") == memoriser).agg(F.max("recall").alias("v"))
    worst = deltas.where("transform = 'rescale'").agg(F.max(F.abs("delta")).alias("v"))
    apart = gap("rescale", memoriser).crossJoin(gap("rescale", honest).withColumnRenamed("v", "h")).select((F.col("v") - F.col("h")).alias("v"))  # one row each
    v = F.col("v")
    battery = [
        ("an honest agent has no gap on a relabelled clone", gap("relabel", honest), F.abs(v) < 1e-9), ("a rescaled clone is as hard", worst, v <= most_delta), ("a rescaled clone tells memory from honesty", apart, v > bar),
        ("originals are recalled", recall(None), v > 0.9), ("relabelling alone defeats no recall", recall("relabel"), v > 0.5), ("rescaling defeats recall", recall("rescale"), v < 0.1),
    ]
    found = [df.select(F.lit(name).alias("control"), F.coalesce(passed, F.lit(False)).alias("passed"), v.cast("double").alias("value")) for name, df, passed in battery]
    return reduce(DataFrame.unionByName, found)


def probe_checks(gaps: DataFrame, recalls: DataFrame, honest: str, memoriser: str, bar: float = 0.05) -> DataFrame:
    """One row of yes or no: the probe tells the memoriser from the honest agent, and harms the honest one little."""
    one = gaps.agg(F.max(F.when(F.col("agent") == honest, F.abs("gap"))).alias("h"), F.max(F.when(F.col("agent") == memoriser, F.col("gap"))).alias("m"))
    two = recalls.agg(F.max(F.when(F.col("agent") == memoriser, F.col("recall"))).alias("r"))
    return one.crossJoin(two).select((F.col("h") <= bar).alias("honest_unharmed"), (F.col("m") - F.col("h") > bar).alias("memoriser_found"), (F.col("r") > 0.9).alias("memoriser_recalls"))
