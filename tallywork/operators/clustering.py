"""k-means over points of any number: seeds drawn by weight, rounds of grouped means, a point for each centre.

Points are rows (keys, point, x); each key is a clustering of its own and all keys run side by side. Centres, k a key, are the
only thing a point meets: as one array beside it, never as rows of pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywork.functions import expr
from tallywork.sources.shared import Rounds, stored

ROUNDS = 60
#: Centres that move by no more than this, absolutely and as a share, stand still.
NEAR, SHARE = 1e-8, 1e-5
ALL = "_all"


def squared(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def seeded(points: DataFrame, keys: list[str], k: int, seed: str) -> DataFrame:
    """keys, centres: k points a key, each drawn with a chance that goes with its squared distance from the nearest one so far.

    The draw is a race: each point's time is -log(uniform) / weight, and the first one is the draw, so a step is one minimum
    over the points. Where all points lie on centres every point is as likely as another.
    """
    rounds = Rounds(points.sparkSession, "seeds")
    state = points.withColumn("far", F.lit(None).cast("double")).withColumn("centres", F.array().cast("array<array<double>>"))
    for step in range(k):
        race = -F.log(F.greatest(expr.uniform(seed, *keys, F.lit(step), "point"), F.lit(1e-12)))
        first = F.min(F.struct(F.when(F.col("far") > 0, race / F.col("far")).alias("time"), F.col("point"), F.col("x")))
        weighted = state.where("far > 0").groupBy(*keys).agg(first.alias("w"))
        plain = state.groupBy(*keys).agg(F.min(F.struct(race.alias("time"), F.col("point"), F.col("x"))).alias("p"), F.first("centres").alias("before"))
        drawn = plain.join(weighted, keys, "left").select(*keys, F.array_append("before", F.coalesce("w.x", "p.x")).alias("new"))
        near = F.least(F.col("far"), squared(F.col("x"), F.element_at("new", -1)))
        state = rounds.keep(state.join(drawn, keys).select(*keys, "point", "x", near.alias("far"), F.col("new").alias("centres")))
    return state.groupBy(*keys).agg(F.first("centres").alias("centres"))


def kmeans(points: DataFrame, k: int, rounds: int = ROUNDS, keys: list[str] | None = None, seed: str = "kmeans") -> DataFrame:
    """keys, centres (array of k points): k-means++ seeds, then at most rounds of means; a centre without points stays.

    points: keys, point, x (arrays of one length). Ties go to the earlier centre.
    """
    by = keys or [ALL]
    known = points if keys else points.withColumn(ALL, F.lit("0"))
    known = stored(known.select(*by, "point", "x"), "points")
    width = known.agg(F.max(F.size("x")).alias("n")).first()["n"] or 0
    centres = seeded(known, by, k, seed)
    tables = Rounds(points.sparkSession, "centres")
    centres = tables.keep(centres)
    for _ in range(rounds):
        near = F.array_min(F.transform("centres", lambda c, i: F.struct(squared(F.col("x"), c).alias("d"), i.alias("c"))))["c"]
        means = known.join(centres, by).select(*by, "x", near.alias("c")).groupBy(*by, "c").agg(F.array(*[F.avg(F.get("x", F.lit(j))) for j in range(width)]).alias("mean"))
        found = means.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("c", "mean"))).alias("means"))  # k entries
        new = centres.join(found, by).select(*by, F.transform("centres", lambda c, i: F.coalesce(F.try_element_at("means", i), c)).alias("centres"), F.col("centres").alias("_old"))
        still = F.forall(F.arrays_zip(F.flatten("centres").alias("a"), F.flatten("_old").alias("b")), lambda v: F.abs(v["a"] - v["b"]) <= NEAR + SHARE * F.abs(v["b"]))
        centres = tables.keep(new.select(*by, "centres", still.alias("still")))
        if not centres.where("not still").limit(1).count():
            break
        centres = centres.drop("still")
    return centres.select(*(keys or []), "centres")


def exemplars(points: DataFrame, centres: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, point: for each centre in turn the nearest point not yet taken, ties to the lower point.

    A centre's choice is among its k nearest points, since at most k - 1 of them are taken: k times k candidates a key.
    """
    by = keys or [ALL]
    known, given = (points, centres) if keys else (points.withColumn(ALL, F.lit("0")), centres.withColumn(ALL, F.lit("0")))
    each = known.join(given.withColumn("k", F.size("centres")), by).select(*by, "point", "x", "k", F.posexplode("centres").alias("c", "centre"))
    ranked = each.withColumn("d", squared(F.col("x"), F.col("centre"))).withColumn("rank", F.row_number().over(Window.partitionBy(*by, "c").orderBy("d", "point"))).where(F.col("rank") <= F.col("k"))
    lists = ranked.groupBy(*by, "c").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "point"))), lambda v: v["point"]).alias("nearest")).groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "nearest"))), lambda v: v["nearest"]).alias("lists"))
    kind = dict(points.dtypes)["point"]

    def taken(chosen: Column, nearest: Column) -> Column:
        left = F.filter(nearest, lambda p: ~F.array_contains(chosen, p))
        return F.when(F.size(left) > 0, F.array_append(chosen, F.get(left, F.lit(0)))).otherwise(chosen)

    return lists.select(*(keys or []), F.explode(F.aggregate("lists", F.array().cast(f"array<{kind}>"), taken)).alias("point"))
