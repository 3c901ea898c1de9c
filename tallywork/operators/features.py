"""Feature tables in long form (row, feature, x): cleaning, leaks, hashed holdouts, fingerprints, generated tasks, clones."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.functions import expr, ordering
from tallywork.sources.shared import stored

EPS = 1e-12


def imputed(rows: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """Missing values filled with the feature's mean over the training rows; 0 where all are missing. Any number of features."""
    means = (train if train is not None else rows).groupBy("feature").agg(F.avg("x").alias("m"))
    return rows.join(means, "feature", "left").select("row", "feature", F.coalesce("x", "m", F.lit(0.0)).alias("x"))


def winsorised(rows: DataFrame, low: float = 0.005, high: float = 0.995, outliers_only: bool = True, z: float = 12.0) -> DataFrame:
    """Values clipped to percentiles; with outliers_only just in features where some value lies over z scaled deviations from the median."""
    known = stored(ordering.quantiles(rows, ["feature"], "x", [0.5, low, high]).drop("n"), "percentiles")
    dev = ordering.matched(rows, known, ["feature"]).withColumn("dev", F.abs(F.col("x") - F.col("q")[0]))
    scale = stored(ordering.quantiles(dev, ["feature"], "dev", [0.5, 1.0]).select("feature", F.col("q").alias("far")), "deviations")
    joined = ordering.matched(dev, scale, ["feature"])
    wild = F.col("far")[1] > z * F.greatest(1.4826 * F.col("far")[0], F.lit(EPS))
    clipped = F.least(F.greatest(F.col("x"), F.col("q")[1]), F.col("q")[2])
    return joined.select("row", "feature", (F.when(wild, clipped).otherwise(F.col("x")) if outliers_only else clipped).alias("x"))


def suspicious(rows: DataFrame, target: DataFrame, limit: float = 0.9) -> DataFrame:
    """feature, r: features whose correlation with the target (row, y) exceeds the limit; constant ones are left out."""
    both = rows.join(target, "row")
    sx, sy = F.stddev_pop("x"), F.stddev_pop("y")
    r = F.when((sx > EPS) & (sy > EPS), F.covar_pop("x", "y") / F.nullif(sx * sy, F.lit(0.0)))
    return both.groupBy("feature").agg(r.alias("r")).where(F.abs("r") > limit)


def fingerprints(rows: DataFrame) -> DataFrame:
    """row, fingerprint: 24 hex digits over the row's sorted values at four places, so column order and names don't matter."""
    four = F.format_string("%.4f", F.when(F.round("x", 4) == 0, 0.0).otherwise(F.round("x", 4)))
    return rows.groupBy("row").agg(F.sort_array(F.collect_list(four)).alias("v")).select("row", F.substring(F.sha2(F.array_join("v", ",").cast("binary"), 256), 1, 24).alias("fingerprint"))


def name_fingerprints(named: DataFrame) -> DataFrame:
    """row, fingerprint: 24 hex digits over the names in a row, by place, and its number; rows of one header differ by number only."""
    head = F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"])
    whole = lambda names: F.concat(F.array_join(names, ","), F.lit("#"), F.col("row").cast("string"))
    return named.groupBy("row").agg(head.alias("names")).select("row", F.substring(F.sha2(whole(F.col("names")).cast("binary"), 256), 1, 24).alias("fingerprint"))


def content_holdout(keyed: DataFrame, fraction: float) -> DataFrame:
    """row, is_train: the first floor(n * fraction) rows by content hash, at least one and not all. keyed: row, fingerprint.

    Ties go by row.
    """
    n = keyed.count()
    take = min(max(int(n * fraction), 1), n - 1)
    return ordering.places(keyed, [], ["fingerprint", "row"]).select("row", (F.col("place") <= take).alias("is_train"))


def rank_normalised(rows: DataFrame, keys: list[str], value: str, unit: str) -> DataFrame:
    """(place - 0.5) / n in each group, ties by unit."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return ordering.matched(ordering.places(rows, keys, [value, unit]), sizes, keys).select(*keys, unit, ((F.col("place") - 0.5) / F.col("n")).alias("q"))


def strata_bins(items: DataFrame, k: int) -> DataFrame:
    """item, rate, bin: k contiguous bins by rate, larger ones first."""
    placed = ordering.places(items, [], ["rate", "item"]).crossJoin(items.agg(F.count("*").alias("n")))  # one row
    at, small, larger = F.col("place") - 1, F.floor(F.col("n") / F.lit(k)), F.col("n") % k
    rest = larger + F.floor((at - larger * (small + 1)) / F.nullif(small, F.lit(0)))
    return placed.select("item", "rate", (F.when(at < larger * (small + 1), F.floor(at / (small + 1))).otherwise(rest) + 1).cast("int").alias("bin"))


def recalled(rows: DataFrame, memory: DataFrame) -> DataFrame:
    """group, hit_rate, uses_memory: share of rows whose fingerprint a memory (fingerprint, answer, priority) knows; the last answer wins.

    Memory is used where it knows nine rows in ten.
    """
    last = memory.groupBy("fingerprint").agg(F.max_by("answer", "priority").alias("answer"))
    hits = rows.join(last, "fingerprint", "left")
    return hits.groupBy("group").agg(F.avg(F.col("answer").isNotNull().cast("double")).alias("hit_rate")).withColumn("uses_memory", F.col("hit_rate") >= 0.9)


@dataclass(frozen=True)
class TaskSpec:
    """A generated prediction task."""

    task: str
    n_train: int = 600
    n_test: int = 300
    n_features: int = 8
    difficulty: float = 0.3
    kind: str = "binary"
    pathologies: tuple[str, ...] = ()
    n_teams: int = 120

    def __post_init__(self):
        if self.kind not in ("binary", "regression"):
            raise ValueError(f"unknown kind {self.kind!r}")
        if not 0 <= self.difficulty < 1:
            raise ValueError("difficulty lies in [0, 1)")
        if self.n_features < 3:
            raise ValueError("at least three features")
        if bad := set(self.pathologies) - {"leakage", "shift", "outliers", "missing"}:
            raise ValueError(f"unknown pathologies: {', '.join(sorted(bad))}")

    @property
    def control(self) -> str:
        return f"{self.task}__control"


def generated(spark: SparkSession, spec: TaskSpec) -> DataFrame:
    """id, part (train, test), f0 .. fN, target: normal features, a latent signal with an interaction, noise by difficulty.

    Every number is a hash of its place, so any partitioning gives the same task. Pathologies come after the target.
    """
    n = spec.n_train + spec.n_test
    base = spark.range(n).withColumn("part", F.when(F.col("id") < spec.n_train, "train").otherwise("test"))
    feats = base.select("*", *[expr.normal(f"{spec.task}/f{j}", F.col("id")).alias(f"f{j}") for j in range(spec.n_features)])
    linear = sum((F.col(f"f{j}") * float(np.cos(j + 1)) for j in range(spec.n_features)), F.lit(0.0))
    signal = linear + 1.5 * F.col("f0") * F.col("f1") + 1.2 * F.tanh(2.0 * F.col("f2"))
    noisy = feats.withColumn("z", signal + float(np.tan(spec.difficulty * np.pi / 2)) * expr.normal(f"{spec.task}/noise", F.col("id")))
    if spec.kind == "binary":
        out = noisy.crossJoin(ordering.quantiles(noisy, [], "z", [0.5]).select(F.col("q")[0].alias("cut"))).withColumn("target", (F.col("z") > F.col("cut")).cast("double")).drop("cut", "z")
    else:
        out = noisy.withColumn("target", 10.0 + 3.0 * F.col("z")).drop("z")
    train = F.col("part") == "train"
    if "leakage" in spec.pathologies:
        leak = F.when(train, F.col("target") + 0.01 * expr.normal(f"{spec.task}/leak", F.col("id"))).otherwise(expr.normal(f"{spec.task}/leak", F.col("id")))
        out = out.withColumn(f"f{spec.n_features}", leak)
    if "shift" in spec.pathologies:
        out = out.withColumn("f0", F.when(train, F.col("f0")).otherwise(F.col("f0") + 2.0))
    if "outliers" in spec.pathologies:
        out = out.withColumn("f1", F.when(train & (expr.uniform(f"{spec.task}/out", F.col("id")) < 0.01), F.col("f1") * 1000.0).otherwise(F.col("f1")))
    if "missing" in spec.pathologies:
        out = out.withColumn("f2", F.when(expr.uniform(f"{spec.task}/miss", F.col("id")) < 0.1, None).otherwise(F.col("f2")))
    return out


def ridge(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    return np.linalg.solve(x.T @ x + penalty * np.eye(x.shape[1]), x.T @ y)


def ridge_fit(rows: DataFrame, features: list[str], target: str, penalty: float = 1.0) -> np.ndarray:
    """Weights with intercept last, from sums of products over the cluster; the driver solves a system of the features' number."""
    p = len(features) + 1
    x = F.array(*[F.col(f).cast("double") for f in features], F.lit(1.0))
    system = np.zeros((p, p + 1))
    for r in gram(rows.select(x.alias("x"), F.col(target).cast("double").alias("y")), p).collect():
        system[r["i"], r["j"]] = r["g"]
        if r["j"] < p:
            system[r["j"], r["i"]] = r["g"]
    return np.linalg.solve(system[:, :p] + penalty * np.eye(p), system[:, p])


#: Products that one row of sums holds.
BESIDE = 16


def gram(rows: DataFrame, p: int) -> DataFrame:
    """i, j, g: sums of x[i] * x[j] for i <= j < p and, as j = p, of x[i] * y; rows has x, an array of p doubles, and y.

    A row meets each i once and adds to BESIDE products at a time, so a task keeps p * p / BESIDE rows of sums for all of its
    rows, and those are what is shuffled.
    """
    whole = rows.select(F.concat("x", F.array("y")).alias("z"))
    at = whole.select("z", F.posexplode(F.slice("z", 1, p)).alias("i", "a")).withColumn("block", F.explode(F.sequence(F.floor(F.col("i") / BESIDE).cast("int"), F.lit(p // BESIDE))))
    sums = at.groupBy("i", "block").agg(F.array(*[F.sum(F.col("a") * F.get("z", F.col("block") * BESIDE + k)) for k in range(BESIDE)]).alias("g"))
    each = sums.select("i", "block", F.posexplode("g").alias("k", "g"))
    return each.select("i", (F.col("block") * BESIDE + F.col("k")).alias("j"), "g").where((F.col("j") >= F.col("i")) & (F.col("j") <= p))


def leaderboard(task: DataFrame, spec: TaskSpec) -> DataFrame:
    """team, score: teams that fit ridge models of differing care on resamples of the training rows, a team a group."""
    spark = task.sparkSession
    names = [c for c in task.columns if c.startswith("f")]
    teams = spark.range(spec.n_teams).withColumnRenamed("id", "team")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        from tallywork.operators.kernels import rng

        g = rng(spec.task, "team", key[0])
        filled = pdf.fillna(pdf[names].mean())
        a, b = filled[filled["part"] == "train"], filled[filled["part"] == "test"]
        pick = a.sample(len(a), replace=True, random_state=int(g.integers(2**31)))
        use = sorted(g.choice(len(names), max(1, int(len(names) * g.uniform(0.3, 1))), replace=False))
        design = lambda d: np.column_stack([d[names].to_numpy(float)[:, use], np.ones(len(d))])
        w = ridge(design(pick), pick["target"].to_numpy(float), float(10 ** g.uniform(-1, 3)))
        p, y = design(b) @ w, b["target"].to_numpy(float)
        if spec.kind == "regression":
            return pd.DataFrame({"team": [key[0]], "score": [float(np.sqrt(((p - y) ** 2).mean()))]})
        r = pd.Series(p).rank().to_numpy()
        up = y == 1
        return pd.DataFrame({"team": [key[0]], "score": [float((r[up].sum() - up.sum() * (up.sum() + 1) / 2) / (up.sum() * (~up).sum()))]})

    return task.crossJoin(F.broadcast(teams)).groupBy("team").applyInPandas(run, "team long, score double")


def cloned(task: DataFrame, seed: str, transform: str = "relabel") -> DataFrame:
    """The task under new names: columns permuted and renamed, ids reissued in hashed order; rescale also maps each feature by a positive affine."""
    if transform not in ("relabel", "rescale"):
        raise ValueError(f"unknown transform {transform!r}")
    names = [c for c in task.columns if c.startswith("f") and c[1:].isdigit()]
    from tallywork.operators.kernels import rng

    g = rng("clone", seed)
    order = g.permutation(len(names))
    scale = g.uniform(0.5, 2.0, len(names)) if transform == "rescale" else np.ones(len(names))
    shift = g.normal(size=len(names)) if transform == "rescale" else np.zeros(len(names))
    cols = [(F.col(names[o]) * float(scale[o]) + float(shift[o])).alias(f"c{k}") for k, o in enumerate(order)]
    return task.select(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col("id").cast("string")).cast("binary"), 256), 1, 12).alias("id"), "part", *cols, "target")


def invariant(task: DataFrame, names: list[str]) -> DataFrame:
    """Features that no renaming or reordering of columns changes: mean, spread, extremes of a row's values."""
    v = F.array(*[F.coalesce(F.col(n), F.lit(0.0)) for n in names])
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / len(names)
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) / len(names)
    return task.select("id", "part", "target", mean.alias("m"), square.alias("q"), F.array_min(v).alias("lo"), F.array_max(v).alias("hi"))


def difficulty(task: DataFrame) -> float:
    """Root mean square error on the test part of a ridge model over invariant features; the same for a relabelled clone."""
    names = [c for c in task.columns if c[0] in "fc" and c[1:].isdigit()]
    rows = invariant(task, names)
    use = ["m", "q", "lo", "hi"]
    w = ridge_fit(rows.where("part = 'train'"), use, "target")
    guess = sum((F.col(n) * float(w[k]) for k, n in enumerate(use)), F.lit(float(w[-1])))
    return rows.where("part = 'test'").agg(F.sqrt(F.avg((guess - F.col("target")) ** 2)).alias("e")).first()["e"]
