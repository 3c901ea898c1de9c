"""Metrics as aggregate expressions over columns y and p, by name; register() adds one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.functions import ordering

CLIP = 1e-15


@dataclass(frozen=True)
class Metric:
    """build(y, p) gives the aggregate; invalid(y, p) is true of a row that makes the whole submission invalid."""

    name: str
    higher_is_better: bool
    build: Callable[[Column, Column], Column]
    invalid: Callable[[Column, Column], Column] | None = None
    ranked: bool = False


METRICS: dict[str, Metric] = {}


def register(metric: Metric) -> Metric:
    METRICS[metric.name] = metric
    return metric


def metric(name: str) -> Metric:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(sorted(METRICS))}")
    return METRICS[name]


def _auc(y: Column, rank: Column) -> Column:
    up, down = F.sum((y == 1).cast("double")), F.sum((y == 0).cast("double"))
    return F.when((up > 0) & (down > 0), (F.sum(F.when(y == 1, rank).otherwise(0.0)) - up * (up + 1.0) / 2.0) / F.nullif(up * down, F.lit(0.0)))


def _log1p(x: Column) -> Column:
    return F.when(x == -1.0, F.lit(float("-inf"))).otherwise(F.log1p(x))


def _log_loss(y: Column, p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - CLIP)), F.lit(CLIP))
    return -F.avg(y * F.log(q) + (1.0 - y) * F.log(1.0 - q))


register(Metric("auc", True, _auc, ranked=True))
register(Metric("accuracy", True, lambda y, p: F.avg((y == F.bround(p, 0)).cast("double"))))
register(Metric("rmse", False, lambda y, p: F.sqrt(F.avg((y - p) * (y - p)))))
register(Metric("mae", False, lambda y, p: F.avg(F.abs(y - p))))
register(Metric("rmsle", False, lambda y, p: F.sqrt(F.avg(F.pow(_log1p(F.when(y >= -1, y)) - _log1p(F.when(p >= -1, p)), 2))), lambda y, p: (y < -1) | (p < -1)))
register(Metric("log_loss", False, _log_loss))


def with_mid_rank(df: DataFrame, keys: list[str], score: str, out: str = "mid_rank") -> DataFrame:
    """Adds the 1-based ascending rank within keys, ties sharing the mean of their ranks.

    Equal scores are counted first, and running sums go over ranges of the distinct scores.
    """
    counts = ordering.running(df.select(*keys, score, F.lit(1).cast("long").alias("_n")), keys, score, ["_n"])
    ranks = counts.select(*keys, score, (F.col("before__n") + (F.col("_n") + 1) / 2.0).alias(out))
    return ordering.matched(df, ranks, [*keys, score])


def scored(pairs: DataFrame, keys: list[str], name: str, y: str = "y", p: str = "p") -> DataFrame:
    """keys, score, error: the metric by group of rows (y, p). A bad row gives an error and no score, never an exception."""
    m = metric(name)
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    checked = pairs.withColumn("_bad", bad(y) | bad(p)).withColumn("_no", F.lit(False) if m.invalid is None else F.coalesce(m.invalid(F.col(y), F.col(p)), F.lit(False)))
    if m.ranked:
        checked = with_mid_rank(checked, keys, p, "_rank")
    value = m.build(F.col(y), F.col("_rank" if m.ranked else p))
    out = checked.groupBy(*keys).agg(F.count_if("_bad").alias("n_bad"), F.count_if("_no").alias("n_no"), value.alias("value"))
    error = F.when(F.col("n_bad") > 0, F.concat(F.col("n_bad").cast("string"), F.lit(" values are not finite"))).when((F.col("n_no") > 0) | F.col("value").isNull(), f"{name} is undefined here")
    return out.select(*keys, F.when(error.isNull(), F.col("value")).alias("score"), error.alias("error"))
