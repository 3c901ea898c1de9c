"""Paired inference and power: sign flips, cluster bootstrap, comparisons, designs.

Resamples are rows. Random numbers come from a hash of their place, so each draw is made where it is needed and the same
one is used at every effect size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tallywork.functions import expr, ordering
from tallywork.sources.shared import stored

EXACT_UP_TO = 15
TOLERANCE = 1e-12
PERMUTATIONS, BOOTSTRAPS = 9999, 10000
RUN_PRICE = 150


def sized(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """diffs with n_units and mean_diff of their group beside each."""
    return ordering.matched(diffs, diffs.groupBy(*keys).agg(F.count("*").alias("n_units"), F.avg("diff").alias("mean_diff")), keys)


#: Draws that one row of a resampling plan carries, and units of a group that are dealt together.
WIDTH, DEALT = 256, 1024


def drawn(known: DataFrame, group: list[str], n: int, seed: str, each: int, decode: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """group, number, total, weight for n draws of each group: over its units, the sums of diff times factor and of factor.

    known has group, unit, diff and n_units. A unit's factors come from its digests, which are made in columns: each draws a
    digest, and decode makes factors of rows of digests. Batches of rows add up to a partial sum a group and draw, those to the
    group's, so no row and no task holds the units of a large group; small groups are dealt whole.
    """
    per = min(WIDTH // each, -(-n // each))
    parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = known.repartition(parts, *group, F.pmod(F.xxhash64("unit"), F.ceil(F.col("n_units") / F.lit(DEALT))))
    rows = dealt.select(*group, F.coalesce(F.col("diff").cast("double"), F.lit(0.0)).alias("diff"), "unit", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // (per * each)))).alias("chunk"))
    hashed = rows.select(*group, "chunk", "diff", expr.digests(seed, F.col("chunk") * per, per, "unit").alias("digests"))
    by = [*group, "chunk"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            code = np.zeros(b.num_rows, np.int64)
            for k in by:
                one = b.column(k).dictionary_encode("encode")
                code = np.unique(code * len(one.dictionary) + one.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            _, first, sizes = np.unique(code, return_index=True, return_counts=True)
            order, ends = np.argsort(code, kind="stable"), np.cumsum(sizes)
            factors = decode(np.frombuffer(b"".join(b.column("digests").to_pylist()), np.uint8).reshape(b.num_rows, -1))
            diff = b.column("diff").to_numpy(zero_copy_only=False)
            if len(first) > 1:
                factors, diff = factors[order], diff[order]
            spans = list(zip(ends - sizes, ends, strict=True))
            sums = [pa.array([x for s, e in spans for x in [(diff[s:e] @ factors[s:e]) if k else factors[s:e].sum(axis=0)]], pa.list_(pa.float64())) for k in (1, 0)]
            yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(first)) for k in by] + sums, [*by, "total", "weight"])

    schema = StructType([hashed.schema[k] for k in by] + [StructField(k, ArrayType(DoubleType())) for k in ("total", "weight")])
    sums = hashed.mapInArrow(add, schema).select(*by, F.posexplode(F.arrays_zip("total", "weight")).alias("at", "s"))
    numbered = sums.select(*group, (F.col("chunk") * (per * each) + F.col("at")).alias("number"), "s.total", "s.weight").where(F.col("number") < n)
    return numbered.groupBy(*group, "number").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))


def sign_flip(diffs: DataFrame, keys: list[str], n_permutations: int = PERMUTATIONS, seed: str = "flip") -> DataFrame:
    """keys, n_units, mean_diff, p_value: two-sided, add-one, over all patterns up to EXACT_UP_TO units, else over random ones.

    diffs has unit (distinct within a group) and diff. Random patterns are sums of signed differences that add up over the parts
    of the data (drawn), so the number of units has no bound; what is kept is n_permutations sums a group.
    """
    known = sized(diffs, keys)
    named = [*keys, "n_units", "mean_diff"]
    few = known.where(F.col("n_units") <= EXACT_UP_TO).groupBy(*named).agg(F.transform(F.sort_array(F.collect_list(F.struct("unit", "diff"))), lambda x: x["diff"]).alias("d"))
    pattern = few.withColumn("perm", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2.0), F.col("n_units")).cast("long") - 1)))
    flipped = F.aggregate(F.transform(F.col("d"), lambda x, i: x * F.when(F.floor(F.col("perm") / F.pow(F.lit(2.0), i)).cast("long") % 2 == 1, -1.0).otherwise(1.0)), F.lit(0.0), lambda s, x: s + x)
    exact = pattern.select(*named, flipped.alias("total"))
    each = drawn(known.where(F.col("n_units") > EXACT_UP_TO), named, n_permutations, seed, expr.DIGEST_BITS, expr.signs)
    hit = F.abs(F.col("total") / F.col("n_units")) >= F.abs(F.col("mean_diff")) - TOLERANCE
    return exact.unionByName(each.select(*named, "total")).groupBy(*named).agg(F.count_if(hit).alias("hits"), F.count("*").alias("size")).select(*named, ((F.col("hits") + 1.0) / (F.col("size") + 1.0)).alias("p_value"))


#: Units up to which a group is drawn from as one array.
ARRAY = 1000


def bootstrap_ci(diffs: DataFrame, keys: list[str], n_boot: int = BOOTSTRAPS, alpha: float = 0.05, seed: str = "boot") -> DataFrame:
    """keys, ci_low, ci_high: percentile interval of the mean over resampled units.

    Up to ARRAY units, as many are drawn as there are. Beyond, each unit is taken a Poisson number of times (mean 1), so that a
    draw is two sums, of weighted differences and of weights, that add up over the parts of the data as in sign_flip; how many
    units a draw has then varies by a standard deviation of the root of their number, by which its mean is divided out.
    """
    known = sized(diffs, keys)
    few = known.where(F.col("n_units") <= ARRAY).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("unit", "diff"))), lambda x: x["diff"]).alias("d"))
    rows = few.withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    n = F.size("d")
    taken = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.get("d", F.floor(expr.uniform(seed, F.col("boot"), j) * n).cast("int"))), F.lit(0.0), lambda s, x: s + x)
    each = drawn(known.where(F.col("n_units") > ARRAY), keys, n_boot, seed, expr.WEIGHTS, expr.weights)
    means = rows.select(*keys, (taken / n).alias("m")).unionByName(each.select(*keys, expr.ratio(F.col("total"), F.col("weight")).alias("m")))
    q = F.percentile("m", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return means.groupBy(*keys).agg(q.alias("q")).select(*keys, F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


#: Said of a comparison of different items.
MATCHED = "matched pairs: the difference holds what is left of their difference in difficulty"


def compared(
    rates_a: DataFrame, rates_b: DataFrame, alpha: float = 0.05, n_boot: int = BOOTSTRAPS, n_permutations: int = PERMUTATIONS, pairs: DataFrame | None = None, infra_failures: int = 0
) -> DataFrame:
    """One row: difference b - a over shared items with p-value, interval, floor, seeds, warnings and the regression gate.

    rates_* have item, rate and seeds; the fewest seeds are looked for among dropped items too. With pairs (pre, post) the
    sides are different items, all pairs must have both, and seeds are looked for among the pairs only. infra_failures is
    the number of runs that were left out beforehand.
    """
    a, b = (r.select("item", F.col("rate").alias(f"rate_{s}"), F.col("seeds").alias(f"seeds_{s}")) for r, s in ((rates_a, "a"), (rates_b, "b")))
    if pairs is None:
        both = stored(a.join(b, "item", "full_outer"), "compared")
    else:
        met = pairs.join(a.withColumnRenamed("item", "pre"), "pre", "left").join(b.withColumnRenamed("item", "post"), "post", "left")
        sides = stored(met, "compared")
        lost = sides.where("rate_a is null or rate_b is null").agg(F.count("*").alias("n"), F.min(F.struct("pre", "post")).alias("first")).first()
        if lost["n"]:
            raise ValueError(f"{lost['n']} pairs lack gradeable runs on one side, the first {tuple(lost['first'])}")
        both = sides.select(F.concat_ws("|", "pre", "post").alias("item"), "rate_a", "seeds_a", "rate_b", "seeds_b")
    shared = both.where("rate_a is not null and rate_b is not null")
    diffs = shared.select(F.lit(1).alias("k"), F.col("item").alias("unit"), (F.col("rate_b") - F.col("rate_a")).alias("diff"))
    sides = both.agg(F.count_if(F.col("rate_a").isNull() | F.col("rate_b").isNull()).alias("n_dropped"), F.least(F.min("seeds_a"), F.min("seeds_b")).alias("min_seeds"), F.avg(F.when(F.col("rate_b").isNotNull(), F.col("rate_a"))).alias("mean_a"), F.avg(F.when(F.col("rate_a").isNotNull(), F.col("rate_b"))).alias("mean_b"))
    p, ci = sign_flip(diffs, ["k"], n_permutations), bootstrap_ci(diffs, ["k"], n_boot, alpha)
    out = p.join(ci, "k").crossJoin(sides)  # one row each
    floor = expr.pvalue_floor(F.col("n_units"), n_permutations, EXACT_UP_TO)
    significant = F.col("p_value") < alpha
    said = [
        F.when(F.col("n_dropped") > 0, "units without a counterpart were dropped"), F.lit(None if pairs is None else MATCHED), F.lit(f"{infra_failures} runs that infrastructure ended were left out" if infra_failures else None),
        F.when(F.col("min_seeds") < 3, "fewer than 3 seeds"), F.when(floor >= alpha, "too few units for this alpha"),
    ]
    warnings = F.filter(F.array(*said), lambda x: x.isNotNull())
    return out.select("n_units", "n_dropped", "min_seeds", "mean_a", "mean_b", F.col("mean_diff").alias("difference"), "p_value", floor.alias("p_floor"), "ci_low", "ci_high", significant.alias("significant"), (floor >= alpha).alias("underpowered"), (significant & (F.col("mean_diff") < 0)).alias("regression"), F.array_join(warnings, "; ").alias("warnings"))


@dataclass(frozen=True)
class Design:
    """A planned comparison: so many paired units with so many seeds a side."""

    units: int
    seeds: int
    matching_sd: float = 0.0

    def __post_init__(self):
        if self.units < 1 or self.seeds < 1:
            raise ValueError("a design needs at least one unit and one seed")

    @property
    def runs(self) -> int:
        return 2 * self.units * self.seeds

    @property
    def price(self) -> int:
        return self.runs * RUN_PRICE


#: Units and seeds of the named designs.
DESIGNS = {"lite": Design(22, 3), "full": Design(75, 3), "pairs-8": Design(8, 3, 0.15), "pairs-16": Design(16, 3, 0.15), "pairs-24": Design(24, 3, 0.15)}


#: Rates in a pool made of a Beta distribution.
POOL = 1000


def beta_pool(spark: SparkSession, base_rate: float, heterogeneity: float, n: int = POOL) -> DataFrame:
    """place, rate: n equally likely rates of a Beta distribution of mean base_rate; the smaller heterogeneity, the more they lie at 0 and 1.

    Rates are the quantiles in the middle of n equal slices, so the pool is the same in every run.
    """
    if not 0.0 <= base_rate <= 1.0 or heterogeneity < 0:
        raise ValueError("a base rate lies in [0, 1], heterogeneity isn't negative")
    many = max(heterogeneity, 1e-6)
    a, b = max(base_rate * many, 1e-6), max((1.0 - base_rate) * many, 1e-6)
    x = np.concatenate([10.0 ** np.linspace(-300, -3, 3000), np.linspace(1e-3, 1.0, 20000)[1:]])
    half = np.searchsorted(x, 0.5)

    def lower(p: float, q: float) -> np.ndarray:
        """Integral of t^(p - 1) (1 - t)^(q - 1) from 0 to each x up to a half; the power is integrated exactly."""
        at = x[: half + 1]
        middle = np.sqrt(at[1:] * at[:-1])
        parts = (at[1:] ** p - at[:-1] ** p) / p * (1.0 - middle) ** (q - 1.0)
        return np.concatenate([[at[0] ** p / p], at[0] ** p / p + np.cumsum(parts)])

    left, right = lower(a, b), lower(b, a)
    rates = np.concatenate([x[: half + 1], 1.0 - x[: half + 1][::-1]])
    mass = np.concatenate([left, left[-1] + right[-1] - right[::-1]])
    drawn = np.interp((np.arange(n) + 0.5) / n, mass / (left[-1] + right[-1]), rates)
    return spark.createDataFrame(list(enumerate(drawn.tolist())), "place long, rate double")


def simulated(pool: DataFrame, effects: DataFrame, design: Design, n_sims: int, seed: str = "power") -> DataFrame:
    """effect, sim, unit, diff. pool has place (0 .. n - 1) and rate; effects a column effect and, if they differ from the design's, seeds.

    Base rates, matching noise and outcomes of a sim are the same at every effect, and fewer seeds are the first ones of more.
    """
    spark = pool.sparkSession
    n = pool.count()
    grid = spark.range(n_sims).withColumnRenamed("id", "sim").withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(design.units - 1))))
    base = grid.withColumn("place", expr.index(n, f"{seed}/pool", "sim", "unit")).join(pool, "place")
    noisy = base.withColumn("noise", expr.normal(f"{seed}/match", "sim", "unit") * design.matching_sd if design.matching_sd else F.lit(0.0))
    planned = effects if "seeds" in effects.columns else effects.withColumn("seeds", F.lit(design.seeds))
    # A plan lists some tens of effects and seeds; each simulated unit meets each of them, since that is the grid asked for.
    both = noisy.crossJoin(planned).withColumn("p_b", F.least(F.greatest(F.col("rate") + F.col("effect") + F.col("noise"), F.lit(0.0)), F.lit(1.0)))

    def hits(arm: str, p: str) -> Column:
        return F.aggregate(F.transform(F.sequence(F.lit(0), (F.col("seeds") - 1).cast("int")), lambda s: F.when(expr.uniform(f"{seed}/{arm}", "sim", "unit", s) < F.col(p), 1.0).otherwise(0.0)), F.lit(0.0), lambda t, x: t + x)

    return both.select(*effects.columns, "sim", "unit", ((hits("b", "p_b") - hits("a", "rate")) / F.col("seeds")).alias("diff"))


def smallest_p(units: int, n_permutations: int) -> float:
    return 3.0 / (2**units + 1) if units <= EXACT_UP_TO else 1.0 / (n_permutations + 1)


def power(pool: DataFrame, effects: DataFrame, design: Design, n_sims: int, alpha: float = 0.05, n_permutations: int = 999) -> DataFrame:
    """effect (and seeds, if effects have them), power: share of simulations below alpha; zero where the design can't reach alpha at all."""
    if smallest_p(design.units, n_permutations) >= alpha:
        return effects.withColumn("power", F.lit(0.0))
    tests = sign_flip(simulated(pool, effects, design, n_sims), [*effects.columns, "sim"], n_permutations)
    return tests.groupBy(*effects.columns).agg(F.avg((F.col("p_value") < alpha).cast("double")).alias("power"))


def minimum_detectable(powers: DataFrame, target: float = 0.8) -> DataFrame:
    """One row: the effect nearest zero whose power reaches the target on a grid of effects, null if none does."""
    reached = F.when(F.col("power") >= target, F.struct(F.abs("effect").alias("size"), F.col("effect").alias("effect")))
    return powers.agg(F.min(reached)["effect"].alias("mde"))


#: Effects tried at once in a search.
FAN = 8


def detectable_effect(pool: DataFrame, design: Design, n_sims: int, direction: str = "decrease", target: float = 0.8, alpha: float = 0.05, n_permutations: int = 999, tolerance: float = 0.005, max_effect: float = 1.0) -> float | None:
    """The smallest effect of a direction that reaches the target, within tolerance; None if none up to max_effect does.

    Each round is one plan over FAN effects between the largest known to fail and the smallest known to do, so a tolerance
    of 0.005 takes three rounds.
    """
    if direction not in ("decrease", "increase"):
        raise ValueError("direction is decrease or increase")
    if not 0.0 < target <= 1.0 or tolerance <= 0 or max_effect <= 0:
        raise ValueError("a target lies in (0, 1], tolerance and largest effect are positive")
    if smallest_p(design.units, n_permutations) >= alpha:
        return None
    sign, low, high = (-1.0 if direction == "decrease" else 1.0), 0.0, max_effect
    while True:
        sizes = [low + (high - low) * (k + 1) / FAN for k in range(FAN)]
        effects = pool.sparkSession.createDataFrame([(sign * s,) for s in sizes], "effect double")
        found = {abs(r["effect"]): r["power"] for r in power(pool, effects, design, n_sims, alpha, n_permutations).collect()}
        reached = [s for s in sizes if found[s] >= target]
        if not reached:
            return None
        high = reached[0]
        low = max([s for s in sizes if s < high], default=low)
        if high - low <= tolerance:
            return sign * high


def seeds_needed(powers_by_seeds: DataFrame, target: float = 0.8) -> DataFrame:
    """One row: the fewest seeds whose power reaches the target, null if none does."""
    return powers_by_seeds.agg(F.min(F.when(F.col("power") >= target, F.col("seeds"))).alias("seeds"))
