"""Item suites chosen step by step over long cells: all suites of a search at once, no matrix in a task.

A search is a set of choices that differ in their subjects (split) and budget. Its state is one row an item and choice: the
item's variance, its covariance with the total of the items chosen so far, its cost. Cronbach's alpha of those items and one
more follows from that row alone, so a step is an aggregate over items that finds each choice's best one, and an update: the
new item's covariance with every other is added to theirs (a rank-one update of the total's). Covariances come from sums
over subjects, a join of the cells with the few columns just chosen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.functions import expr, ordering
from tallywork.operators import ctt
from tallywork.sources.shared import Rounds, stored

#: Gains closer than this count as equal; the lower item goes first.
PLACES = 12
#: The split of all subjects.
WHOLE = -1

#: (split, item, var) of all items, and (split, with_item, item, cov) for given (split, with_item).
Spread = tuple[DataFrame, Callable[[DataFrame], DataFrame]]


def by_sets(cells: DataFrame, sets: DataFrame) -> Spread:
    """Variances and covariances over the subjects of each split. sets: split, subject."""
    known = stored(cells.select("subject", "item", "rate").join(sets, "subject"), "suite-cells")

    def cov(chosen: DataFrame) -> DataFrame:
        column = known.withColumnsRenamed({"item": "with_item", "rate": "other"}).join(chosen, ["split", "with_item"])
        both = known.join(column, ["split", "subject"])
        return both.groupBy("split", "with_item", "item").agg(F.covar_samp("rate", "other").alias("cov"))

    return known.groupBy("split", "item").agg(F.var_samp("rate").alias("var")), cov


def leaving_one_out(cells: DataFrame) -> Spread:
    """Those over all subjects but one, which names the split: sums over all subjects, less that one's own values.

    A table that copied the cells for each subject left out would grow with the square of the subjects; this one has a row a
    cell and a row for each chosen item's cells.
    """
    own = cells.select(F.col("subject").alias("split"), "item", F.col("rate").alias("x"))

    def less(total: DataFrame, mine: DataFrame, keys: list[str]) -> Column:
        n = F.col("n") - 1
        return mine.join(total, keys).withColumn("cov", (F.col("xy") - F.col("x") * F.col("y") - (F.col("sx") - F.col("x")) * (F.col("sy") - F.col("y")) / n) / (n - 1))

    # Sums are taken about the mean of all subjects, so that little is lost where one value is taken off them.
    centre = cells.groupBy("item").agg(F.avg("rate").alias("mean"))
    mine = stored(own.join(centre, "item").select("split", "item", (F.col("x") - F.col("mean")).alias("x")), "suite-cells")
    totals = mine.groupBy("item").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("xy"))
    var = less(totals.withColumn("sy", F.col("sx")), mine.withColumn("y", F.col("x")), ["item"]).select("split", "item", F.greatest("cov", F.lit(0.0)).alias("var"))

    def cov(chosen: DataFrame) -> DataFrame:
        column = mine.withColumnsRenamed({"item": "with_item", "x": "y"})
        pairs = mine.join(column.join(chosen.select("with_item").distinct(), "with_item"), "split")
        sums = pairs.groupBy("with_item", "item").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("xy"))
        return less(sums, pairs.join(chosen, ["split", "with_item"]), ["with_item", "item"]).select("split", "with_item", "item", "cov")

    return var, cov


def greedy(spread: Spread, k: int | None = None, costs: DataFrame | None = None, budgets: tuple[float, ...] = (float("inf"),)) -> DataFrame:
    """split, budget, step (from 0), item: the suite of each split and budget, chosen greedily.

    First comes the item of the widest spread, then whatever raises alpha most, both per cost if costs (item, cost) are given;
    a choice ends with k items or when nothing more fits its budget. Alpha counts as 0 where the total doesn't vary. Each step
    is one plan over all choices; its state is stored, and the driver learns only whether any choice went on.
    """
    var, cov = spread
    spark = var.sparkSession
    priced = var.join(costs.select("item", F.col("cost").cast("double").alias("cost")), "item") if costs is not None else var.withColumn("cost", F.lit(1.0))
    limits = spark.createDataFrame([(float(b),) for b in budgets], "budget double")  # a list that a user wrote
    key = ["split", "budget"]
    states = Rounds(spark, "greedy")
    state = states.keep(priced.crossJoin(F.broadcast(limits)).select(*key, "item", "var", "cost", *[F.lit(0.0).alias(c) for c in ("with_total", "total", "sum", "spent")], F.lit(0).alias("n"), F.lit(None).cast("int").alias("step")))
    step = 0
    while k is None or step < k:
        m = F.col("n") + 1.0
        total, parts = F.col("total") + 2.0 * F.col("with_total") + F.col("var"), F.col("sum") + F.col("var")
        gain = F.when(F.col("n") == 0, F.sqrt("var")).when(total > 0, m / (m - 1.0) * (1.0 - parts / total)).otherwise(0.0) / (F.col("cost") if costs is not None else 1.0)
        open_ = state.where(F.col("step").isNull() & (F.col("n") == step) & (F.col("spent") + F.col("cost") <= F.col("budget"))).withColumn("gain", F.round(gain, PLACES))
        # NaN is the largest number to Spark; a gain that isn't finite is no gain.
        best = open_.where(~F.isnan("gain") & (F.abs("gain") < float("inf"))).groupBy(*key).agg(F.min(F.struct((-F.col("gain")).alias("loss"), "item", "var", "cost", "with_total")).alias("b"))
        best = stored(best.select(*key, F.col("b.item").alias("with_item"), F.col("b.var").alias("b_var"), F.col("b.cost").alias("b_cost"), F.col("b.with_total").alias("b_with")), "greedy-step")
        if not best.limit(1).count():
            break
        added = cov(best.select("split", "with_item").distinct())
        known = state.join(best, key, "left").join(added, ["split", "with_item", "item"], "left")
        grows = F.col("with_item").isNotNull()
        plus = lambda c, x: F.when(grows, F.col(c) + x).otherwise(F.col(c)).alias(c)
        state = states.keep(known.select(
            *key, "item", "var", "cost", plus("with_total", F.coalesce("cov", F.lit(0.0))), plus("total", 2.0 * F.col("b_with") + F.col("b_var")), plus("sum", F.col("b_var")), plus("spent", F.col("b_cost")), plus("n", F.lit(1)),
            F.when(F.col("item") == F.col("with_item"), F.lit(step)).otherwise(F.col("step")).alias("step"),
        ))
        step += 1
    return state.where("step is not null").select(*key, "step", "item")


def halves(cells: DataFrame, n_splits: int, seed: str = "fidelity") -> DataFrame:
    """split, subject, train: half of the subjects, rounded down, in train, dealt anew for each split."""
    subjects = cells.select("subject").distinct()
    splits = cells.sparkSession.range(n_splits).withColumnRenamed("id", "split")  # some tens
    dealt = ordering.places(subjects.crossJoin(F.broadcast(splits)).withColumn("u", expr.uniform(seed, "split", "subject")), ["split"], ["u", "subject"])
    return dealt.select("split", "subject", (F.col("place") <= F.floor(F.lit(subjects.count()) / 2)).alias("train"))


def fidelity(cells: DataFrame, chosen: DataFrame, sets: DataFrame, keys: list[str]) -> DataFrame:
    """keys (split and more), tau: agreement of the means over a suite with those over all items, on the split's test subjects.

    chosen: keys, item. sets: split, subject, train. Suites whose tau isn't defined are left out.
    """
    test = cells.join(sets.where("not train").select("split", "subject"), "subject")
    full = test.groupBy("split", "subject").agg(F.avg("rate").alias("full"))
    part = test.join(chosen, ["split", "item"]).groupBy(*keys, "subject").agg(F.avg("rate").alias("part"))
    pairs = stored(part.join(full, ["split", "subject"]), "fidelity")
    return ctt.tau_b(pairs, keys, "part", "full", "subject").where("tau is not null")


def cross_validated(cells: DataFrame, k: int, n_splits: int = 40, choose: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(split, tau) and (item, n_splits): how well a rule's suites rank subjects it hasn't seen, and how often it takes each item.

    choose gets cells and sets (split, subject) and gives split, item; without it suites are chosen by alpha. Raises below six subjects.
    """
    if cells.select("subject").distinct().count() < 6:
        raise ValueError("cross-validation needs at least six subjects")
    sets = stored(halves(cells, n_splits), "halves")
    train = sets.where("train").select("split", "subject")
    chosen = stored(choose(cells, train) if choose else greedy(by_sets(cells, train), k).select("split", "item"), "chosen")
    return fidelity(cells, chosen, sets, ["split"]), chosen.groupBy("item").agg(F.count_distinct("split").alias("n_splits"))


def frontier(cells: DataFrame, costs: DataFrame, budgets: tuple[float, ...], n_splits: int = 20) -> DataFrame:
    """budget, n_items, tau, tau_sd: what each budget buys. All budgets and splits, and the suite of all subjects, are one search."""
    sets = stored(halves(cells, n_splits, "frontier"), "halves")
    every = cells.select("subject").distinct().select(F.lit(WHOLE).cast("long").alias("split"), "subject")
    chosen = stored(greedy(by_sets(cells, sets.where("train").select("split", "subject").unionByName(every)), None, costs, budgets), "chosen")
    taus = fidelity(cells, chosen.where(F.col("split") != WHOLE), sets, ["budget", "split"])
    sizes = chosen.where(F.col("split") == WHOLE).groupBy("budget").agg(F.count("*").alias("n_items"))
    return taus.groupBy("budget").agg(F.avg("tau").alias("tau"), F.coalesce(F.stddev_samp("tau"), F.lit(0.0)).alias("tau_sd")).join(sizes, "budget").select("budget", "n_items", "tau", "tau_sd")
