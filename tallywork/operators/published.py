"""Published results (experiment, competition_id, medals, seeds) and the small filters over subjects and items."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class UnknownExperiment(ValueError):
    """No rows for an experiment."""


def experiments(table: DataFrame) -> DataFrame:
    return table.select("experiment").distinct()


def rates(table: DataFrame, experiment: str, only: DataFrame | None = None) -> DataFrame:
    """competition_id, rate of one experiment, of the given competitions only."""
    rows = table.where(F.col("experiment") == experiment)
    if only is not None:
        rows = rows.join(only, "competition_id", "left_semi")
    if not rows.limit(1).count():
        raise UnknownExperiment(experiment)
    return rows.select("competition_id", (F.col("medals").cast("double") / F.col("seeds")).alias("rate"))


def complete(table: DataFrame, n: int) -> DataFrame:
    """Experiments with exactly n competitions."""
    return table.groupBy("experiment").agg(F.count_distinct("competition_id").alias("n")).where(F.col("n") == n).select("experiment")


def common(table: DataFrame) -> DataFrame:
    """Competitions that every experiment of the table has (relational division)."""
    of = table.agg(F.count_distinct("experiment").alias("of"))
    return table.groupBy("competition_id").agg(F.count_distinct("experiment").alias("n")).join(F.broadcast(of), F.col("n") == F.col("of")).select("competition_id")


def matrix(table: DataFrame) -> DataFrame:
    """subject, item, rate, trials over the common competitions."""
    kept = table.join(common(table), "competition_id", "left_semi")
    return kept.select(F.col("experiment").alias("subject"), F.col("competition_id").alias("item"), (F.col("medals").cast("double") / F.col("seeds")).alias("rate"), F.col("seeds").alias("trials"))


def summary(table: DataFrame) -> DataFrame:
    r = F.col("medals").cast("double") / F.col("seeds")
    return table.groupBy("experiment").agg(F.count("*").alias("n"), F.avg(r).alias("mean_rate"), F.count_if(r == 0).alias("never"), F.count_if(r == 1).alias("always"))


def live(cells: DataFrame) -> DataFrame:
    """Cells of items that vary over subjects."""
    good = cells.groupBy("item").agg(F.stddev_pop("rate").alias("sd")).where("sd > 0")
    return cells.join(good, "item", "left_semi")


def band(cells: DataFrame, low: float, high: float) -> DataFrame:
    """Cells of subjects whose mean rate lies in [low, high]."""
    good = cells.groupBy("subject").agg(F.avg("rate").alias("m")).where(F.col("m").between(low, high))
    return cells.join(good, "subject", "left_semi")


def targets(items: DataFrame, seeds: int) -> DataFrame:
    """Each item with each of so many seeds, as runs to make."""
    return items.select("item", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed")).withColumn("slug", slug(F.col("item"), F.col("seed")))


def slug(item: Column, seed: Column) -> Column:
    return F.concat(item.cast("string"), F.lit("__seed"), seed.cast("string"))


def item_of(slug_: Column) -> Column:
    return F.regexp_extract(slug_, r"^(.*)__seed\d+$", 1)


def seed_of(slug_: Column) -> Column:
    return F.regexp_extract(slug_, r"__seed(\d+)$", 1).try_cast("int")


def ends(items: DataFrame, by: str, n: int) -> DataFrame:
    """The n first and n last items by a column, ties by item; none twice."""
    first = items.orderBy(by, "item").limit(n)
    last = items.join(first.select("item"), "item", "left_anti").orderBy(F.desc(by), "item").limit(n)
    return first.unionByName(last.select(*items.columns))


def selection_counts(folds: DataFrame) -> DataFrame:
    """item, n: in how many folds (split, items) each item was chosen."""
    return folds.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def beta_pool(spark: SparkSession, base_rate: float, concentration: float, n: int = 2000, seed: int = 0) -> DataFrame:
    """place, rate: a pool of base rates from a Beta law with the given mean, for designs without published rates."""
    draws = np.random.default_rng(seed).beta(base_rate * concentration, (1 - base_rate) * concentration, n)
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(draws)], "place long, rate double")
