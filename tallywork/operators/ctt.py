"""Classical test theory over long cells (subject, item, rate, trials): plain aggregations, no matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywork.functions import expr, ordering, shuffles

#: Cost of an item by tier.
COST = {"low": 1, "medium": 6, "high": 15}
CONSTANT = 1e-9
WEAK, TRAP = 0.2, -0.2
TOP_RELIABILITY = 0.999999


def constant(sd: Column, mean: Column) -> Column:
    return sd <= CONSTANT * F.greatest(F.lit(1.0), F.abs(mean))


def alpha(cells: DataFrame, keys: list[str] | None = None, value: str = "rate") -> DataFrame:
    """keys, k, n, alpha: Cronbach's alpha; 0 where totals don't vary, null below two items or subjects."""
    keys = keys or []
    items = cells.groupBy(*keys, "item").agg(F.var_samp(value).alias("v")).groupBy(*keys).agg(F.sum("v").alias("item_var"), F.count("*").alias("k"))
    totals = cells.groupBy(*keys, "subject").agg(F.sum(value).alias("t")).groupBy(*keys).agg(F.var_samp("t").alias("total_var"), F.count("*").alias("n"))
    both = items.join(totals, keys) if keys else items.crossJoin(totals)  # one row each
    k = F.col("k").cast("double")
    a = F.when(F.col("total_var") > 0, k / F.nullif(k - 1.0, F.lit(0.0)) * (1.0 - F.col("item_var") / F.nullif(F.col("total_var"), F.lit(0.0)))).otherwise(0.0)
    return both.select(*keys, "k", "n", F.when((F.col("k") >= 2) & (F.col("n") >= 2), a).alias("alpha"))


def item_stats(cells: DataFrame) -> DataFrame:
    """item, mean, sd, item_rest (corrected item-total correlation, 0 if either side is constant), noise_share, and flags."""
    k = cells.groupBy("subject").agg(F.sum("rate").alias("total"), F.count("*").alias("k"))
    rest = cells.join(k, "subject").withColumn("rest", (F.col("total") - F.col("rate")) / F.nullif(F.col("k") - 1.0, F.lit(0.0)))
    noise = F.avg(F.col("rate") * (1.0 - F.col("rate")) / F.greatest(F.col("trials").cast("double"), F.lit(1.0)))
    per = rest.groupBy("item").agg(F.avg("rate").alias("mean"), F.stddev_samp("rate").alias("sd"), F.avg("rest").alias("rest_mean"), F.stddev_samp("rest").alias("rest_sd"), F.covar_samp("rate", "rest").alias("cov"), noise.alias("noise"))
    fixed = constant(F.col("sd"), F.col("mean")) | constant(F.col("rest_sd"), F.col("rest_mean"))
    r = F.when(fixed, 0.0).otherwise(F.col("cov") / F.nullif(F.col("sd") * F.col("rest_sd"), F.lit(0.0)))
    dead = constant(F.col("sd"), F.col("mean"))
    share = F.when(dead, 0.0).otherwise(F.least(F.greatest(F.col("noise") / F.nullif(F.col("sd") * F.col("sd"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    out = per.select("item", "mean", "sd", r.alias("item_rest"), share.alias("noise_share"), dead.alias("dead"))
    saturation = F.when(F.col("mean") <= 0, "floor").when(F.col("mean") >= 1, "ceiling").otherwise("constant")
    signal = F.sqrt(F.greatest(1.0 - F.col("noise_share"), F.lit(0.0)))
    return out.withColumn("disattenuated", F.when(signal > 0, F.least(F.greatest(F.col("item_rest") / F.nullif(signal, F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))).otherwise(0.0)).withColumn("weak", F.col("dead") | (F.col("item_rest") < WEAK)).withColumn("trap", F.col("item_rest") < TRAP).withColumn("saturation", F.when(F.col("dead"), saturation))


#: Subjects below which a reliability is itself badly known.
FEW_SUBJECTS = 10


def report(cells: DataFrame, n_splits: int = 100, n_draws: int = 200) -> DataFrame:
    """One row about a suite: size, abilities, reliability against chance, separation, strata, flagged items and notes.

    cells: subject, item, rate, trials. Raises where a cell is missing, occurs twice or isn't finite, or below two subjects.
    """
    size = cells.agg(F.count_distinct("subject").alias("subjects"), F.count_distinct("item").alias("items"), F.count("*").alias("n"), F.count_if(F.col("rate").isNull() | F.isnan("rate") | (F.abs("rate") == float("inf"))).alias("odd")).first()
    distinct = cells.select("subject", "item").distinct().count()
    if size["subjects"] < 2:
        raise ValueError("a suite is judged on at least two subjects")
    if size["odd"]:
        raise ValueError(f"{size['odd']} rates are not finite")
    if distinct != size["n"] or size["n"] != size["subjects"] * size["items"]:
        raise ValueError("not every subject has every item once")
    stats = item_stats(cells)
    named = lambda flag: F.sort_array(F.collect_list(F.when(F.col(flag), F.col("item")))).alias(f"{flag}_items")
    flagged = stats.agg(named("dead"), named("weak"), named("trap"), expr.ratio(F.sum(F.col("noise_share") * F.col("sd") * F.col("sd")), F.sum(F.col("sd") * F.col("sd"))).alias("noise"))
    band = cells.groupBy("subject").agg(F.avg("rate").alias("r")).agg(F.min("r").alias("lowest"), F.max("r").alias("highest"))
    halves = split_half(cells, n_splits).agg(F.avg("reliability").alias("split_half"))
    chance = null_alphas(cells, n_draws).agg(F.percentile("alpha", F.lit(0.95)).alias("null_p95"))
    every = alpha(cells).withColumnsRenamed({"k": "n_items", "n": "n_subjects"})
    for one in (chance, halves, band, flagged):
        every = every.crossJoin(one)  # one row each
    a = F.col("alpha")
    said = [
        F.when(~(a > F.col("null_p95")), "reliability is within what unrelated items reach by chance"), F.when(F.col("n_subjects") < FEW_SUBJECTS, "too few subjects to know a reliability well"),
        F.when(F.col("noise") > 0, F.concat(F.round(100.0 * F.col("noise"), 1).cast("string"), F.lit("% of the items' variance is noise of few seeds"))),
    ]
    return every.select(
        "n_items", "n_subjects", "lowest", "highest", "alpha", "null_p95", (a > F.col("null_p95")).alias("above_chance"), "split_half", separation(a).alias("separation"), strata(a).alias("strata"),
        "dead_items", "weak_items", "trap_items", F.array_join(F.filter(F.array(*said), lambda x: x.isNotNull()), "; ").alias("notes"),
    )


def ladder_recovery(cells: DataFrame, ladder: DataFrame) -> DataFrame:
    """One row, tau: agreement of subjects' mean rates with their known order. ladder: subject, rung; others are left out."""
    means = cells.groupBy("subject").agg(F.avg("rate").alias("ability"))
    return tau_b(means.join(ladder, "subject"), [], "ability", "rung", "subject")


def separation(r: Column) -> Column:
    c = F.least(F.greatest(r, F.lit(0.0)), F.lit(TOP_RELIABILITY))
    return F.sqrt(c / (1.0 - c))


def strata(r: Column) -> Column:
    return (4.0 * separation(r) + 1.0) / 3.0


def items_needed(r: Column, n: Column, target: float) -> Column:
    """Items for a target reliability; n if it is met, null if r isn't positive."""
    factor = target * (1.0 - r) / (F.nullif(r, F.lit(0.0)) * (1.0 - target))
    return F.when(r <= 0, F.lit(None).cast("long")).when(r >= target, n.cast("long")).otherwise(F.ceil(n * factor).cast("long"))


def split_half(cells: DataFrame, n_splits: int, seed: str = "half") -> DataFrame:
    """split, r, reliability: correlation of two random disjoint halves of floor(k / 2) items, stepped up; constant halves skipped."""
    spark = cells.sparkSession
    items = cells.select("item").distinct()
    k = items.count()
    order = Window.partitionBy("split").orderBy("u", "item")
    dealt = items.crossJoin(F.broadcast(spark.range(n_splits).withColumnRenamed("id", "split"))).withColumn("u", expr.uniform(seed, "split", "item")).withColumn("place", F.row_number().over(order))
    halves = dealt.where(F.col("place") <= k // 2 * 2).select("split", "item", (F.col("place") <= k // 2).alias("first"))
    means = cells.join(halves, "item").groupBy("split", "subject").agg(F.avg(F.when(F.col("first"), F.col("rate"))).alias("a"), F.avg(F.when(~F.col("first"), F.col("rate"))).alias("b"))
    r = expr.ratio(F.covar_samp("a", "b"), F.stddev_samp("a") * F.stddev_samp("b"))
    return means.groupBy("split").agg(r.alias("r")).where("r is not null and r > -1").select("split", "r", (2.0 * F.col("r") / (1.0 + F.col("r"))).alias("reliability"))


def null_alphas(cells: DataFrame, n_draws: int, seed: str = "null") -> DataFrame:
    """draw, alpha: each item's column shuffled over the subjects on its own.

    Subjects are numbered once; a draw sends each cell to another number by the item's permutation of them, a column
    expression. Nothing is sorted, and the only shuffles are those of alpha's sums.
    """
    draws = cells.sparkSession.range(n_draws).withColumnRenamed("id", "draw")  # some hundreds
    subjects = cells.select("subject").distinct()
    n = subjects.count()
    numbered = ordering.matched(cells.select("subject", "item", "rate"), ordering.places(subjects, [], ["subject"]), ["subject"])
    dealt = numbered.crossJoin(F.broadcast(draws)).select("draw", shuffles.permuted(F.col("place") - 1, n, seed, "draw", "item").alias("subject"), "item", "rate")
    return alpha(dealt, ["draw"]).select("draw", "alpha")


def tau_b(pairs: DataFrame, keys: list[str], a: str, b: str, unit: str) -> DataFrame:
    """keys, tau: Kendall's tau-b over pairs of units, null where one side is all ties; units without both values are left out.

    No pairs are made. Two units of different rank in a part ways at one bit of it, so for each bit those that agree in the
    higher bits form a group, in which running sums in order of b count the pairs in and out of order: n log n rows.
    """
    by = keys or [ordering.ALL]
    known = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*[k for k in keys], *([] if keys else [F.lit(1).alias(ordering.ALL)]), F.col(a).alias("a"), F.col(b).alias("b"), F.lit(1).cast("long").alias("n"))
    ranks = ordering.running(known.select(*by, "a", "n"), by, "a", ["n"])
    tied = lambda df: df.groupBy(*by).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2.0).alias("tied"), F.sum("n").alias("units"))
    cells = ordering.matched(known.groupBy(*by, "a", "b").agg(F.sum("n").alias("n")), ranks.select(*by, "a", F.col("before_n").alias("rank")), [*by, "a"])
    bits = ordering.matched(cells, ranks.groupBy(*by).agg(F.length(F.bin(F.max("before_n"))).alias("bits")), by).withColumn("bit", F.explode(F.sequence(F.lit(0), F.col("bits") - 1)))
    up = F.expr("shiftright(rank, bit) % 2 = 1")
    sided = bits.select(*by, "bit", F.expr("shiftright(rank, bit + 1)").alias("prefix"), "b", F.when(up, 0).otherwise(F.col("n")).cast("long").alias("low"), F.when(up, F.col("n")).otherwise(0).cast("long").alias("high"))
    counted = ordering.running(sided, [*by, "bit", "prefix"], "b", ["low", "high"])
    in_order = counted.groupBy(*by, "bit", "prefix").agg(F.sum(F.col("high") * F.col("before_low")).alias("c"), F.sum(F.col("high") * F.col("low")).alias("t"), F.sum("low").alias("l"), F.sum("high").alias("h"))
    score = in_order.groupBy(*by).agg(F.sum(2 * F.col("c") + F.col("t") - F.col("l") * F.col("h")).alias("score"))
    of_a = tied(ranks).withColumnsRenamed({"tied": "tied_a"})
    of_b = tied(known.groupBy(*by, "b").agg(F.sum("n").alias("n"))).select(*by, F.col("tied").alias("tied_b"))
    every = ordering.matched(ordering.matched(of_a, of_b, by), score, by)
    all_pairs = F.col("units") * (F.col("units") - 1) / 2.0
    return every.select(*keys, expr.ratio(F.col("score").cast("double"), F.sqrt((all_pairs - F.col("tied_a")) * (all_pairs - F.col("tied_b")))).alias("tau"))


def cost(items: DataFrame, flagged: str = "dead") -> DataFrame:
    """One row: cost of the suite and the dead items' share; null if any tier is unknown. items: tier and the flag."""
    price = F.element_at(F.create_map(*[F.lit(x) for kv in COST.items() for x in kv]), F.col("tier"))
    total = F.sum(price)
    return items.agg(F.when(F.bool_or(F.col("tier").isNull()), None).otherwise(total).cast("long").alias("cost"), F.when(F.bool_or(F.col("tier").isNull()), None).otherwise(F.coalesce(F.sum(F.when(F.col(flagged), price)), F.lit(0)) / total).cast("double").alias("dead_share"))


def fidelity(cells: DataFrame, subset: DataFrame) -> DataFrame:
    """One row: tau-b of subjects' means over a subset of items against their means over all."""
    full = cells.groupBy("subject").agg(F.avg("rate").alias("full"))
    part = cells.join(subset, "item", "left_semi").groupBy("subject").agg(F.avg("rate").alias("part"))
    return tau_b(full.join(part, "subject"), [], "full", "part", "subject")
