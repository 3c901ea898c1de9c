"""Running sums, places and quantiles of groups of any size: no window and no aggregate sees all values of a group.

The distinct values of a group are cut into PARTS ranges, whose bounds come from a sample of the values: of each of SAMPLE
classes of hashes the value of the least one. Sums by range give each range its base, and a window runs within one range only. The sample
sets how even the ranges are and nothing else; as it follows from the values alone, a task that runs again after an
executor is lost finds the same ranges.
"""

from __future__ import annotations

from functools import reduce
from itertools import pairwise
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywork.sources.shared import stored

PARTS, SAMPLE = 64, 2048
#: Of the approximate percentiles beside a quantile: they miss their place by a part in so many of a group.
ACCURACY = 500
ALL = "_all"


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by keys in which null equals null; the keys of the left side stay."""
    names = {k: f"_right_{k}" for k in keys}
    same = None
    for k, r in names.items():
        one = F.col(k).eqNullSafe(F.col(r))
        same = one if same is None else same & one
    return left.join(right.withColumnsRenamed(names), same, how).drop(*names.values())


def running(rows: DataFrame, keys: list[str], value: str, sums: list[str]) -> DataFrame:
    """keys, value, sums and before_* of each distinct value: its sums, and those of all smaller values. Nulls are smallest."""
    by = keys or [ALL]
    known = rows if keys else rows.withColumn(ALL, F.lit(1))
    per = known.groupBy(*by, value).agg(*[F.sum(s).alias(s) for s in sums])
    drawn = per.where(F.col(value).isNotNull()).groupBy(*by, F.pmod(F.xxhash64(value), F.lit(SAMPLE)).alias("_draw")).agg(F.min(F.struct(F.xxhash64(value).alias("_hash"), F.col(value).alias("_value"))).alias("_least"))
    sample = drawn.groupBy(*by).agg(F.sort_array(F.collect_list("_least._value")).alias("_sample"))
    place = lambda k: F.floor(k * F.size("_sample") / F.lit(PARTS)).cast("int")
    bounds = sample.select(*by, F.transform(F.sequence(F.lit(1), F.lit(PARTS - 1)), lambda k: F.get("_sample", place(k))).alias("_bounds"))
    smaller = F.size(F.filter("_bounds", lambda b: b < F.col(value)))
    cut = matched(per, bounds, by, "left").withColumn("_part", F.when(F.col("_bounds").isNull(), 0).otherwise(smaller)).drop("_bounds")
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most PARTS rows a group
    bases = cut.groupBy(*by, "_part").agg(*[F.sum(s).alias(f"_sum_{s}") for s in sums]).select(*by, "_part", *[F.coalesce(F.sum(f"_sum_{s}").over(earlier), F.lit(0)).alias(f"_base_{s}") for s in sums])
    within = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = matched(cut, bases, [*by, "_part"])
    return out.select(*keys, value, *sums, *[(F.coalesce(F.sum(s).over(within), F.lit(0)) + F.col(f"_base_{s}")).alias(f"before_{s}") for s in sums])


def places(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, order and place, 1 for the first: the rows of each group in ascending order; equal rows get places in a row."""
    at = rows.select(*keys, F.struct(*order).alias("_at"), F.lit(1).cast("long").alias("n"))
    found = running(at, keys, "_at", ["n"])
    return found.select(*keys, *[F.col(f"_at.{c}").alias(c) for c in order], F.explode(F.sequence(F.col("before_n") + 1, F.col("before_n") + F.col("n"))).alias("place"))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys, n, q: exact quantiles of the values that aren't null, linear between neighbours; groups without one are absent.

    Approximate percentiles cut each group below and above every share. Values up to each cut are counted, and only those
    between two cuts that have a wanted place between them are put in order. Where the cuts lie sets how many those are and
    nothing else. Cuts and counts, a row a group, are stored: all passes see the same ones, and Spark knows their size when it
    plans the joins, so that rows aren't shuffled to meet a small table. The values kept are stored too, as running goes
    through them twice; so rows are gone through three times.
    """
    known = rows.where(F.col(value).isNotNull()).select(*keys, value)
    beside = lambda left, right: matched(left, right, keys) if keys else left.crossJoin(right)  # noqa: E731  (one row)
    near = sorted({min(max(share + off, 0.0), 1.0) for share in shares for off in (-2.0 / ACCURACY, 2.0 / ACCURACY)})
    cuts = stored(known.groupBy(*keys).agg(F.percentile_approx(value, near, ACCURACY).alias("_cuts")).select(*keys, F.sort_array("_cuts").alias("_cuts")), "cuts")
    upto = [F.col(value) <= F.get("_cuts", F.lit(k)) for k in range(len(near))]
    counts = beside(known, cuts).groupBy(*keys).agg(F.count("*").alias("_size"), *[F.count_if(u).alias(f"_upto{k}") for k, u in enumerate(upto)])
    ends = [F.lit(0).cast("long"), *[F.col(f"_upto{k}") for k in range(len(near))], F.col("_size")]
    at = [F.lit(float(share)) * (F.col("_size") - 1) for share in shares]
    wanted = lambda begin, end: reduce(or_, [(begin <= p) & (p < end) for a in at for p in (F.floor(a), F.ceil(a))])
    spans = stored(beside(cuts, counts).select(*keys, "_size", "_cuts", F.array(*[F.when(wanted(b, e), b) for b, e in pairwise(ends)]).alias("_bases")), "spans")
    base = F.get("_bases", sum((-u.cast("int") for u in upto), F.lit(len(near))))  # that of a value's range
    kept = beside(known, spans).select(*keys, "_size", base.alias("_base"), value, F.lit(1).cast("long").alias("n")).where("_base is not null")
    found = running(stored(kept, "kept"), [*keys, "_size", "_base"], value, ["n"]).withColumn("before_n", F.col("before_n") + F.col("_base"))
    holds = lambda p: (F.col("before_n") <= p) & (p < F.col("before_n") + F.col("n"))
    picks = []
    for k, a in enumerate(at):
        picks += [F.max(F.when(holds(F.floor(a)), F.col(value).cast("double"))).alias(f"_low{k}"), F.max(F.when(holds(F.ceil(a)), F.col(value).cast("double"))).alias(f"_high{k}")]
    between = lambda k, share: F.col(f"_low{k}") + (F.col(f"_high{k}") - F.col(f"_low{k}")) * (F.lit(float(share)) * (F.col("n") - 1) - F.floor(F.lit(float(share)) * (F.col("n") - 1)))
    return found.groupBy(*keys).agg(F.max("_size").alias("n"), *picks).where("n is not null").select(*keys, "n", F.array(*[between(k, share) for k, share in enumerate(shares)]).alias("q"))
