"""Submissions against answers: validation, score, thresholds, percentile and medals.

Submissions are rows (run, line_no, id, raw) as read, with ids and values as strings; answers are (task, id, y). All
violations are found at once and the first by line and rule is the run's error, so nothing raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywork.functions import expr, metrics, ordering


def marked(rows: DataFrame) -> DataFrame:
    """Rows with the rule that they break: 1 for an id seen on an earlier line, 2 for what isn't a number."""
    again = F.row_number().over(Window.partitionBy("run", "id").orderBy("line_no")) > 1
    return rows.withColumn("rule", F.when(again, 1).when(expr.parsed_number(F.col("raw")).isNull(), 2))


def said_of() -> Column:
    at = F.col("line_no").cast("string")
    return F.when(F.col("rule") == 1, F.concat(F.lit("duplicate id "), F.col("id"), F.lit(" at row "), at)).otherwise(F.concat(F.lit("not a number at row "), at))


def first_errors(rows: DataFrame) -> DataFrame:
    """run, error: the first row that repeats an id or isn't a number, repeats first; runs without one are absent."""
    return marked(rows).where("rule is not null").groupBy("run").agg(F.min_by(said_of(), F.struct("line_no", "rule")).alias("error"))


def id_mismatches(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """run, missing, unknown: answers without a prediction and predictions without an answer. rows carry task."""
    runs = rows.select("run", "task").distinct()
    expected = runs.join(answers.select("task", "id", F.lit(1).alias("known")), "task")
    both = expected.join(rows.select("run", "task", "id", F.lit(1).alias("given")).distinct(), ["run", "task", "id"], "full_outer")
    return both.groupBy("run").agg(F.count_if(F.col("given").isNull()).alias("missing"), F.count_if(F.col("known").isNull()).alias("unknown"))


def file_gate(path: Column, exists: Column) -> Column:
    """Why a path is no submission, or null: a wrong suffix and a missing file are told apart."""
    return F.when(~F.lower(path).endswith(".csv"), "not a .csv file").when(~exists, "no file")


def thresholds(leaderboard: DataFrame, keys: list[str], score: str, higher_is_better: bool) -> DataFrame:
    """gold, silver, bronze, median and n_teams by the ranks that the size of the field sets; teams without a score come last."""
    best = -F.col(score) if higher_is_better else F.col(score)
    counted = ordering.running(leaderboard.select(*keys, F.struct(F.col(score).isNull().alias("none"), best.alias("best")).alias("at"), F.lit(1).cast("long").alias("n")), keys, "at", ["n"])
    sizes = leaderboard.groupBy(*keys).agg(F.count("*").alias("n_teams"))
    ranked = ordering.matched(counted, sizes, keys).withColumn("r", expr.medal_ranks(F.col("n_teams"))).withColumn("score", -F.col("at.best") if higher_is_better else F.col("at.best"))
    at = lambda which: F.max(F.when((F.col("before_n") < F.col(f"r.{which}")) & (F.col(f"r.{which}") <= F.col("before_n") + F.col("n")), F.col("score"))).alias(which)
    limits = ranked.groupBy(*keys).agg(F.first("n_teams").alias("n_teams"), at("gold"), at("silver"), at("bronze"))
    medians = ordering.quantiles(leaderboard, keys, score, [0.5]).select(*keys, F.col("q")[0].alias("median"))
    return ordering.matched(limits, medians, keys, "left")


def awarded(scores: DataFrame, limits: DataFrame, keys: list[str], higher_is_better: bool) -> DataFrame:
    """Scores with medal flags. Medals look at the unrounded score; reaching a threshold is enough."""
    gib = F.lit(higher_is_better)
    with_limits = scores.join(limits, keys)
    flags = {k: expr.beats(F.col("score"), gib, F.col(k)) for k in ("gold", "silver", "bronze")}
    out = with_limits.select(*scores.columns, *[F.coalesce(v, F.lit(False)).alias(f"is_{k}") for k, v in flags.items()], F.coalesce(F.when(gib, F.col("score") > F.col("median")).otherwise(F.col("score") < F.col("median")), F.lit(False)).alias("above_median"))
    return out.withColumn("any_medal", F.col("is_gold") | F.col("is_silver") | F.col("is_bronze")).withColumn("medal", expr.medal_label(F.col("is_gold"), F.col("is_silver"), F.col("is_bronze"), F.col("above_median")))


def percentiles(scores: DataFrame, leaderboard: DataFrame, keys: list[str], score: str, higher_is_better: bool) -> DataFrame:
    """Share of the leaderboard that each score strictly beats.

    Scores and leaderboard are counted by value, and running sums over the distinct values replace a comparison of every
    score with every team.
    """
    values = leaderboard.groupBy(*keys, F.col(score).alias("v")).agg(F.count("*").alias("teams")).unionByName(scores.where("score is not null").select(*keys, F.col("score").alias("v"), F.lit(0).cast("long").alias("teams")).distinct())
    sizes = leaderboard.groupBy(*keys).agg(F.count(score).alias("n_scored"), F.count("*").alias("n"))
    summed = ordering.running(values.where("v is not null"), keys, "v", ["teams"]).join(sizes, keys)
    beaten = F.col("before_teams") if higher_is_better else F.col("n_scored") - F.col("before_teams") - F.col("teams")
    shares = summed.select(*keys, "v", (beaten.cast("double") / F.col("n")).alias("percentile"))
    return scores.join(shares.withColumnRenamed("v", "score"), [*keys, "score"])


def graded(rows: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """run, task, score, error: validation, then the metric over the joined rows of valid runs."""
    given = marked(rows).groupBy("run", "task", "id").agg(F.min(F.when(F.col("rule").isNotNull(), F.struct("line_no", "rule", said_of().alias("said")))).alias("broken"), F.min_by(expr.parsed_number(F.col("raw")), "line_no").alias("p"))
    known = given.join(answers.select("task", "id", "y", F.lit(1).alias("known")), ["task", "id"], "left")
    seen = known.groupBy("run", "task").agg(F.min("broken").alias("broken"), F.count("known").alias("n_known"), F.count_if(F.col("known").isNull()).alias("unknown"))
    seen = seen.join(answers.groupBy("task").agg(F.count("*").alias("n")), "task", "left").withColumn("missing", F.coalesce("n", F.lit(0)) - F.col("n_known"))
    said = F.coalesce(F.col("broken.said"), F.when(F.col("missing") > 0, F.concat(F.lit("missing ids: "), F.col("missing").cast("string"))), F.when(F.col("unknown") > 0, F.concat(F.lit("unknown ids: "), F.col("unknown").cast("string"))))
    verdicts = seen.select("run", "task", said.alias("rejected"))
    pairs = known.join(verdicts.where("rejected is null").select("run"), "run", "left_semi").select("run", "y", "p")
    return verdicts.join(metrics.scored(pairs, ["run"], name), "run", "left").select("run", "task", "score", F.coalesce("rejected", "error").alias("error"))


def agreement(ours: DataFrame, theirs: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """run, ours, theirs, agree: two graders' scores (run, score; null: refused) within a tolerance, or refused by both."""
    both = ours.select("run", F.col("score").alias("ours")).join(theirs.select("run", F.col("score").alias("theirs")), "run", "full_outer")
    near = F.coalesce(F.abs(F.col("ours") - F.col("theirs")) <= tolerance, F.lit(False))
    return both.withColumn("agree", near | (F.col("ours").isNull() & F.col("theirs").isNull()))
