"""Runs (run_set, subject, item, seed, medal, infra_failure): rates, denominators, grids and guards.

Three rates exist and keep their names: macro_rate is the mean over items of the mean over gradeable runs,
graded_macro_rate the same over graded items only, micro_rate the mean over submissions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs_from(records: DataFrame) -> DataFrame:
    """Typed runs of loose records: any_medal goes before medal, a missing seed is 0, a missing flag false."""
    have = set(records.columns)
    first = lambda names, kind, default: reduce(lambda rest, c: F.coalesce(F.col(c).cast(kind), rest), [c for c in reversed(names) if c in have], F.lit(default))
    return records.select("run_set", "item", first(["seed"], "int", 0).alias("seed"), first(["any_medal", "medal"], "boolean", False).alias("medal"), first(["infra_failure"], "boolean", False).alias("infra_failure"))


def broken_invariant(runs: DataFrame) -> DataFrame:
    """Rows that claim a medal for a run that infrastructure ended."""
    return runs.where("medal and infra_failure")


def gradeable(runs: DataFrame) -> DataFrame:
    return runs.where(~F.col("infra_failure"))


def rate_by_item(runs: DataFrame, keys: list[str]) -> DataFrame:
    return gradeable(runs).groupBy(*keys, "item").agg(F.avg(F.col("medal").cast("double")).alias("rate"), F.count("*").alias("seeds"))


def macro_rate(runs: DataFrame, keys: list[str]) -> DataFrame:
    return rate_by_item(runs, keys).groupBy(*keys).agg(F.avg("rate").alias("macro_rate"), F.count("*").alias("n_items"))


def micro_rate(grades: DataFrame, keys: list[str]) -> DataFrame:
    return grades.groupBy(*keys).agg(F.avg(F.col("medal").cast("double")).alias("micro_rate"), F.count_if("medal").alias("medals"), F.count("*").alias("submissions"))


def denominators(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("infra_failure").alias("infra"), F.count_if(~F.col("infra_failure")).alias("effective"))


def shared_items(a: DataFrame, b: DataFrame) -> DataFrame:
    """Items that both sides have; each side's are made distinct where they lie, so no task gets all runs of an item."""
    return gradeable(a).select("item").distinct().intersect(gradeable(b).select("item").distinct())


def dropped_items(a: DataFrame, b: DataFrame) -> DataFrame:
    """Items that only one side has, and which."""
    one, two = gradeable(a).select("item").distinct(), gradeable(b).select("item").distinct()
    return one.join(two, "item", "left_anti").withColumn("side", F.lit("a")).unionByName(two.join(one, "item", "left_anti").withColumn("side", F.lit("b")))


FINGERPRINT = ("split_id", "container_config", "harness_version")


def conflicts(a: str, b: str) -> Column:
    """The fields in which two fingerprint structs differ, in fixed order."""
    parts = [F.when(~F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}")), F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f"{a}.{f}"), F.lit("none")), F.lit(" vs "), F.coalesce(F.col(f"{b}.{f}"), F.lit("none")))) for f in FINGERPRINT]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


class Incomparable(ValueError):
    """Two run sets were made under different conditions."""


def assert_comparable(pair: DataFrame, a: str = "a", b: str = "b", allow_mismatch: bool = False) -> list[str]:
    """Reads the one row that holds both fingerprints; raises with all conflicts unless they are allowed."""
    found = pair.select(conflicts(a, b).alias("c")).first()["c"]
    if found and not allow_mismatch:
        raise Incomparable("; ".join(found))
    return found


def complete_subjects(runs: DataFrame) -> DataFrame:
    """Subjects that have every item (relational division)."""
    good = gradeable(runs)
    items = good.select("item").distinct().agg(F.count("*").alias("all_items"))
    per = good.groupBy("subject").agg(F.count_distinct("item").alias("n_items"))
    return per.join(F.broadcast(items), per.n_items == items.all_items).select("subject", "n_items")


def pool_summary(runs: DataFrame) -> DataFrame:
    """By subject: items, their mean rate, and how many never or always give a medal."""
    return rate_by_item(runs, ["subject"]).groupBy("subject").agg(F.count("*").alias("n_items"), F.avg("rate").alias("mean_rate"), F.count_if(F.col("rate") == 0).alias("never"), F.count_if(F.col("rate") == 1).alias("always"))


def dense_grid(runs: DataFrame, value: Column, default) -> DataFrame:
    """Every item and seed with the value of its last run by order column ord, or the default."""
    rows = runs.groupBy("item", "seed").agg(F.max_by(value, "ord").alias("value"))
    # Both sides are short lists of distinct labels, so the grid is no larger than the table it lays out.
    grid = runs.select("item").distinct().crossJoin(runs.select("seed").distinct())
    return grid.join(rows, ["item", "seed"], "left").select("item", "seed", F.coalesce("value", F.lit(default)).alias("value"))


def frontier(runs: DataFrame, n: int) -> DataFrame:
    """The n best subjects, ties by name, listed by name."""
    means = macro_rate(runs, ["subject"])
    best = means.orderBy(F.desc("macro_rate"), "subject").limit(n)
    return best.select("subject", "macro_rate")


def thinned(subjects: DataFrame, m: int, order: str = "subject") -> DataFrame:
    """m subjects evenly spread over the order: places floor(i * n / m)."""
    n = subjects.count()
    places = [i * n // m for i in range(min(m, n))]
    return subjects.withColumn("place", F.row_number().over(Window.orderBy(order)) - 1).where(F.col("place").isin(places)).drop("place")


def standings(per: DataFrame) -> DataFrame:
    """Rank by medal rate, percentile (none counts 0), valid rate, all falling, then by label."""
    order = Window.orderBy(F.desc("medal_rate"), F.desc(F.coalesce("mean_percentile", F.lit(0.0))), F.desc("valid_rate"), "subject")
    return per.withColumn("place", F.row_number().over(order))


def saturated(per: DataFrame, spread: float = 0.01) -> DataFrame:
    """One row: whether two subjects or more tie at a positive top rate while their percentiles differ."""
    top = per.agg(F.max("medal_rate").alias("top"))
    tied = per.join(F.broadcast(top), per.medal_rate == top.top)
    return tied.agg(((F.count("*") >= 2) & (F.max("medal_rate") > 0) & (F.max("mean_percentile") - F.min("mean_percentile") > spread)).alias("is_saturated"), F.count("*").alias("n_tied"))


def with_medals(triage: DataFrame, medals: DataFrame) -> DataFrame:
    """Triage rows as runs: medals joined by item and seed, none is false; the outcome tells infrastructure failures."""
    return triage.join(medals.select("item", "seed", "medal"), ["item", "seed"], "left").select("item", "seed", (F.coalesce("medal", F.lit(False)) & (F.col("outcome") != "infra")).alias("medal"), (F.col("outcome") == "infra").alias("infra_failure"))


def session_outcomes(triaged: DataFrame, grades: DataFrame) -> DataFrame:
    """subject, item, seed, outcome, score, medal: what each place of a session came to, and its grade if there is one.

    Of several runs of one place the first by name counts, of several grades the one of the highest score.
    """
    place = ["subject", "item", "seed"]
    first = triaged.groupBy(*place).agg(F.min_by("outcome", "run").alias("outcome"))
    best = grades.groupBy(*place).agg(F.max(F.struct("score", "medal")).alias("g"))
    return first.join(best, place, "left").select(*place, "outcome", F.col("g.score").alias("score"), F.col("g.medal").alias("medal"))


def matched(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """pre, post and both rates for pairs of items; a side without the item leaves its rate null."""
    return pairs.join(a.select(F.col("item").alias("pre"), F.col("rate").alias("rate_a")), "pre", "left").join(b.select(F.col("item").alias("post"), F.col("rate").alias("rate_b")), "post", "left").select("pre", "post", "rate_a", "rate_b", (F.col("rate_b") - F.col("rate_a")).alias("diff"))


def mean_percentile(rows: DataFrame, by: str) -> DataFrame:
    """by, mean_percentile, n_items: the mean over items of the mean over an item's runs; items without a percentile are left out."""
    per = rows.groupBy(by, "item").agg(F.avg("percentile").alias("p")).where("p is not null")
    return per.groupBy(by).agg(F.avg("p").alias("mean_percentile"), F.count("*").alias("n_items"))
