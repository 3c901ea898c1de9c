"""Item response models: fits by group, curves as plain plans over items and a grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallywork.functions import digest, expr
from tallywork.operators import kernels
from tallywork.sources.shared import Rounds, stored

ITEMS = "fit_id string, item long, a double, b double, d double, observed_rate double, identified boolean, extrapolated boolean"
SUBJECTS = "fit_id string, subject long, theta double, se double"
FITS = "fit_id string, log_likelihood double, iterations int, converged boolean"


def fitted(cells: DataFrame, what: str = "items") -> DataFrame:
    """Items, subjects or fit rows of one model for each fit_id of cells (fit_id, subject, item, successes, trials)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s, n, subjects, items = kernels.matrices(pdf)
        m = kernels.fit(s, n)
        if what == "items":
            return pd.DataFrame({"fit_id": key[0], "item": items, "a": m["a"], "b": m["b"], "d": m["d"], "observed_rate": m["rate"], "identified": m["identified"], "extrapolated": m["extrapolated"]})
        if what == "subjects":
            return pd.DataFrame({"fit_id": key[0], "subject": subjects, "theta": m["theta"], "se": m["se"]})
        return pd.DataFrame({"fit_id": [key[0]], "log_likelihood": m["ll"], "iterations": m["iterations"], "converged": bool(m["converged"])})

    return cells.groupBy("fit_id").applyInPandas(run, {"items": ITEMS, "subjects": SUBJECTS, "fits": FITS}[what])


def nodes(spark: SparkSession) -> DataFrame:
    """x, prior: the abilities that the population is spread over, and the log of their share of it."""
    x, w = kernels.quadrature()
    at = F.lit(float(x[0])) + F.col("id") * F.lit(2.0 * kernels.REACH / (kernels.NODES - 1))
    return spark.range(0, kernels.NODES, 1, 1).select(at.alias("x"), (-0.5 * at * at - F.lit(float(np.log(np.exp(-0.5 * x * x).sum())))).alias("prior"))


FIT = "fit_id"


def tried(cells: DataFrame) -> DataFrame:
    return cells.where("trials > 0").select(F.col(FIT).cast("string").alias(FIT), "subject", "item", F.col("successes").cast("double").alias("successes"), F.col("trials").cast("double").alias("trials"))


def posteriors(cells: DataFrame, params: DataFrame) -> DataFrame:
    """fit_id, subject, x, post, ll: each subject's posterior over the nodes from its own cells, and its log-likelihood.

    Cells are dealt by subject before they meet the nodes, which are a fixed number, so what is shuffled is the cells. A
    subject may lack items.
    """
    at = by_subject(cells).join(params.select(FIT, "item", "a", "d"), [FIT, "item"]).crossJoin(F.broadcast(nodes(cells.sparkSession)))
    logit = at.selectExpr(FIT, "subject", "x", "prior", "successes", "trials", "a * x + d as z")
    ll = logit.groupBy(FIT, "subject", "x").agg(F.expr("sum(trials * (least(z, 0D) - log1p(exp(-abs(z)))) - (trials - successes) * z) + first(prior) as l"))
    # A window holds one row a node.
    top = ll.selectExpr("*", f"max(l) over (partition by {FIT}, subject) as top").selectExpr("*", "exp(l - top) as w").selectExpr("*", f"sum(w) over (partition by {FIT}, subject) as mass")
    return top.selectExpr(FIT, "subject", "x", "w / mass as post", "ln(mass) + top as ll")


def by_subject(cells: DataFrame) -> DataFrame:
    return cells.repartition(FIT, "subject")


def maximised(cells: DataFrame, post: DataFrame, params: DataFrame) -> DataFrame:
    """params (fit_id, item, a, d, fixed and more) after one damped Newton step an item; fixed slopes stay. Adds moved, the larger step."""
    at = by_subject(cells).join(post.select(FIT, "subject", "x", "post"), [FIT, "subject"]).join(params.select(FIT, "item", "a", "d"), [FIT, "item"])
    rows = at.selectExpr(FIT, "item", "x", "successes", "trials", "post", "1D / (1D + exp(-(a * x + d))) as p").selectExpr(FIT, "item", "x", "post * (successes - trials * p) as e", "post * trials * p * (1D - p) as w")
    sums = rows.groupBy(FIT, "item").agg(*map(F.expr, ("sum(e) as e", "sum(w) as w", "sum(e * x) as ex", "sum(w * x) as wx", "sum(w * x * x) as wxx")))
    of_a, of_d = 1 / kernels.PRIOR_A_SD**2, 1 / kernels.PRIOR_D_SD**2
    slopes = params.join(sums, [FIT, "item"]).selectExpr("*", f"e - d * {of_d}D as gd", f"w + {of_d + kernels.RIDGE}D as hd", f"ex - (a - {kernels.PRIOR_A}D) * {of_a}D as ga", f"wxx + {of_a + kernels.RIDGE}D as ha")
    moves = slopes.selectExpr("*", "if(fixed, 0D, (hd * ga - wx * gd) / (ha * hd - wx * wx)) as da", "if(fixed, gd / hd, (ha * gd - wx * ga) / (ha * hd - wx * wx)) as dd").selectExpr("*", "least(1D, 1D / greatest(abs(da), abs(dd), 1e-12D)) as scale")
    kept = [c for c in params.columns if c not in ("a", "d", "moved")]
    return moves.selectExpr(*kept, "a + da * scale as a", "d + dd * scale as d", "greatest(abs(da), abs(dd)) * scale as moved")


def stepped(cells: DataFrame, params: DataFrame) -> DataFrame:
    """item, a, d after one step of expectation and maximisation of one model from params (item, a, d)."""
    one, at = tried(cells.withColumn(FIT, F.lit(""))), params.withColumn(FIT, F.lit("")).withColumn("fixed", F.lit(False))
    return maximised(one, posteriors(one, at), at).select("item", "a", "d")


def started(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, item, a, d where a fit begins: the prior slope and the log odds of the item's rate."""
    rate = F.least(F.greatest(F.sum("successes") / F.sum("trials"), F.lit(1e-3)), F.lit(1 - 1e-3))
    return cells.groupBy(*keys, "item").agg(rate.alias("rate")).select(*keys, "item", F.lit(kernels.PRIOR_A).alias("a"), F.log(F.col("rate") / (1.0 - F.col("rate"))).alias("d"))


#: Rounds of a whole fit, and the step below which an item's parameters stand still.
ROUNDS, STILL = 300, 1e-4


def fitted_in_rounds(cells: DataFrame, rounds: int = ROUNDS, still: float = STILL, slopes: DataFrame | None = None, begin: DataFrame | None = None) -> DataFrame:
    """fit_id, item, a, d, rounds, converged: as many models at once as cells (fit_id, subject, item, successes, trials) has fits.

    A round is one plan over all fits that still move: subjects' posteriors, then a damped Newton step an item. Its parameters
    are stored, and are all that the next round takes over; the driver learns how many fits still move. A fit has converged
    when no parameter moved by still. Cells may lack items; those without trials are left out. slopes (fit_id, a) fixes the
    slopes of each fit; begin (fit_id, item, a, d) gives other starting points. Ten fits of ten million cells take no more
    memory than one of one.
    """
    known = stored(tried(cells), "irt-cells")
    first = (started(known, (FIT,)) if begin is None else begin.select(FIT, "item", "a", "d")).withColumn("fixed", F.lit(slopes is not None))
    if slopes is not None:
        first = first.drop("a").join(slopes.select(FIT, "a"), FIT)
    states = Rounds(cells.sparkSession, "irt")
    state = states.keep(first.withColumns({"rounds": F.lit(0), "moved": F.lit(float("inf"))}))
    for _ in range(rounds):
        most = state.groupBy(FIT).agg((F.max("moved") >= still).alias("live"))
        marked = state.join(most, FIT)
        live = marked.where("live").withColumn("rounds", F.col("rounds") + 1).drop("live")
        new = maximised(known, posteriors(known, live), live)
        moving = Observation()
        state = states.keep(new.unionByName(marked.where("not live").select(*new.columns)).observe(moving, F.count_if(F.col("moved") >= still).alias("n")))
        if not moving.get["n"]:
            break
    most = state.groupBy(FIT).agg((F.max("moved") < still).alias("converged"))
    return state.join(most, FIT).select(FIT, "item", "a", "d", "rounds", "converged")


#: Rounds after which a fit counts as one that never comes to rest, and the most subjects and the most items of a fit that one task takes.
ENDLESS, FEW = 100_000, 1000


def fitted_to_rest(cells: DataFrame, still: float = kernels.TOLERANCE, few: int = FEW) -> DataFrame:
    """As fitted_in_rounds, until no parameter moves by still, which takes tens of rounds or thousands.

    Seconds a round are too many then, so a fit of at most few subjects and few items runs all its rounds in one task, a task a
    fit. The others run side by side in rounds of a plan. Both begin alike and take the same steps.
    """
    known = stored(tried(cells), "irt-cells")
    sizes = known.groupBy(FIT).agg(F.count_distinct("subject").alias("subjects"), F.count_distinct("item").alias("items"))
    small = stored(sizes.where((F.col("subjects") <= few) & (F.col("items") <= few)).select(FIT), "irt-small")
    large = known.join(small, FIT, "left_anti")
    once = known.join(small, FIT, "left_semi").groupBy(FIT, "subject", "item").agg(F.sum("successes").alias("successes"), F.sum("trials").alias("trials"))
    begun = once.join(started(once, (FIT,)), [FIT, "item"]).where("subject is not null")
    item = cells.schema["item"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        subjects, row = np.unique(pdf["subject"].to_numpy(), return_inverse=True)
        items, first, column = np.unique(pdf["item"].to_numpy(), return_index=True, return_inverse=True)
        s, n = np.zeros((len(subjects), len(items))), np.zeros((len(subjects), len(items)))
        s[row, column], n[row, column] = pdf["successes"], pdf["trials"]
        a, d, rounds, rest = kernels.to_rest(s, n, pdf["a"].to_numpy()[first], pdf["d"].to_numpy()[first], still, ENDLESS)
        return pd.DataFrame({FIT: key[0], "item": items, "a": a, "d": d, "rounds": rounds, "converged": rest})

    # So small a shuffle would be merged into one task, unless its number is given.
    dealt = begun.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), FIT)
    out = dealt.groupBy(FIT).applyInPandas(run, f"{FIT} string, item {item}, a double, d double, rounds int, converged boolean")
    return stored(out if large.isEmpty() else out.unionByName(fitted_in_rounds(large, ENDLESS, still)), "irt-rest")


def scaled(cells: DataFrame, params: DataFrame, normalize: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items (as ITEMS), subjects (as SUBJECTS) and fits (as FITS) of fitted parameters.

    Abilities and their standard deviations are those of the last posterior. Normalised ones have mean 0 and deviation 1 over the
    subjects of a fit; slopes and difficulties go along.
    """
    known = tried(cells)
    x, p = F.col("x"), F.col("post")
    found = posteriors(known, params).groupBy(FIT, "subject").agg(F.sum(p * x).alias("theta"), F.sum(p * x * x).alias("square"), F.max("ll").alias("ll"))
    raw = stored(found.select(FIT, "subject", "theta", F.sqrt(F.greatest(F.col("square") - F.col("theta") * F.col("theta"), F.lit(0.0))).alias("se"), "ll"), "irt-subjects")
    spread = F.when(F.count("*") > 1, F.stddev_samp("theta")).otherwise(1.0)
    by_fit = raw.groupBy(FIT).agg(F.avg("theta").alias("mean"), spread.alias("sd"), F.min("theta").alias("low"), F.max("theta").alias("high"), F.sum("ll").alias("log_likelihood"))
    use = (F.col("sd") > 0) & F.lit(normalize)
    by_fit = by_fit.withColumn("mu", F.when(use, F.col("mean")).otherwise(0.0)).withColumn("unit", F.when(use, F.col("sd")).otherwise(1.0))
    on = lambda c: (F.col(c) - F.col("mu")) / F.col("unit")
    subjects = raw.join(by_fit, FIT).select(FIT, "subject", on("theta").alias("theta"), (F.col("se") / F.col("unit")).alias("se"))
    totals = known.groupBy(FIT, "item").agg(F.sum("successes").alias("s"), F.sum("trials").alias("n"))
    items = params.join(totals, [FIT, "item"]).join(by_fit, FIT).withColumns({"d": F.col("d") + F.col("a") * F.col("mu"), "a": F.col("a") * F.col("unit"), "range": F.col("sd") / F.col("unit")})
    steep = F.abs("a") * F.col("range") >= kernels.IDENTIFIED
    items = items.withColumn("b", F.when(steep, -F.col("d") / F.col("a")).otherwise(float("inf")))
    located = (on("low") - F.col("range") <= F.col("b")) & (F.col("b") <= on("high") + F.col("range"))
    items = items.select(FIT, "item", "a", "b", "d", (F.col("s") / F.col("n")).alias("observed_rate"), (steep & (F.col("s") != 0) & (F.col("s") != F.col("n"))).alias("identified"), (~located).alias("extrapolated"))
    fits = by_fit.select(FIT, "log_likelihood").join(params.groupBy(FIT).agg(F.max("rounds").alias("iterations"), F.bool_and("converged").alias("converged")), FIT)
    return items, subjects, fits


def grid(spark, low: float, high: float, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("node"), (F.lit(low) + F.col("id") * F.lit((high - low) / (n - 1))).alias("theta"))


def probability(a: Column, b: Column, theta: Column) -> Column:
    return expr.sigmoid(a * (theta - b))


def curves(items: DataFrame, nodes: DataFrame, seeds: float, attenuation: float | None = None) -> DataFrame:
    """node, theta, information, se, expected_rate over all items of finite difficulty and the rest at their limits.

    The grid has a fixed number of nodes, so items times nodes grows with the items only.
    """
    p = F.when(F.col("b") == float("inf"), 0.0).otherwise(probability(F.col("a"), F.col("b"), F.col("theta")))
    both = items.crossJoin(F.broadcast(nodes)).withColumn("p", p)
    info = F.sum(F.col("a") * F.col("a") * F.col("p") * (1.0 - F.col("p"))) * seeds / (1.0 if attenuation is None else attenuation**2)
    out = both.groupBy("node", "theta").agg(info.alias("information"), F.avg("p").alias("expected_rate"))
    return out.withColumn("se", 1.0 / F.sqrt(F.when(F.col("information") > 0, F.col("information"))))


def resolving_range(curve: DataFrame, target_se: float) -> DataFrame:
    """One row: lowest and highest ability resolved to target_se, null if none; blind_above is the highest."""
    good = F.when(F.col("se") <= target_se, F.col("theta"))
    return curve.agg(F.min(good).alias("low"), F.max(good).alias("high"))


def marginal_reliability(curve: DataFrame) -> DataFrame:
    """One row: 1 less the mean squared error over a standard normal population."""
    w = F.exp(-0.5 * F.col("theta") * F.col("theta"))
    known = F.col("se").isNotNull()
    return curve.agg((1.0 - F.sum(F.when(known, w * F.col("se") * F.col("se"))) / F.sum(F.when(known, w))).alias("reliability"))


def resolution(curve: DataFrame, factor: float = 2.77) -> DataFrame:
    """theta, gap: the smallest difference of rates told apart, from the slope of the rate curve between neighbours."""
    w = Window.orderBy("node")  # a grid of fixed size
    slope = (F.lead("expected_rate").over(w) - F.lag("expected_rate").over(w)) / (F.lead("theta").over(w) - F.lag("theta").over(w))
    return curve.withColumn("slope", slope).where("slope is not null").select("node", "theta", "expected_rate", (factor * F.col("se") * F.col("slope")).alias("gap"))


def select_for_ability(items: DataFrame, theta: float, k: int, exclude: tuple = ()) -> DataFrame:
    if k < 1:
        raise ValueError("k must be at least 1")
    p = probability(F.col("a"), F.col("b"), F.lit(theta))
    info = F.when(F.col("identified") & ~F.col("extrapolated"), F.col("a") * F.col("a") * p * (1.0 - p)).otherwise(0.0)
    return items.where(~F.col("item").isin(list(exclude)) if exclude else F.lit(True)).withColumn("info", info).orderBy(F.desc("info"), "item").limit(k)


def flags(items: DataFrame) -> DataFrame:
    return items.select("item", (F.col("identified") & ~F.col("extrapolated")).alias("located"), (~F.col("identified")).alias("unidentified"), "extrapolated", (F.col("a") < 0).alias("inverted"), (F.col("a") * F.col("a") / 4.0).alias("peak_information"))


def abilities(responses: DataFrame, items: DataFrame, n_nodes: int = 481, reach: float = 6.0) -> DataFrame:
    """subject, theta: posterior mean from located items on a fixed grid. responses: subject, item, successes, trials."""
    nodes = grid(responses.sparkSession, -reach, reach, n_nodes)
    use = responses.join(items.where("identified and not extrapolated").select("item", "a", "b"), "item").crossJoin(F.broadcast(nodes))
    p = F.greatest(F.least(probability(F.col("a"), F.col("b"), F.col("theta")), F.lit(1 - 1e-9)), F.lit(1e-9))
    ll = use.groupBy("subject", "node", "theta").agg((F.sum(F.col("successes") * F.log(p) + (F.col("trials") - F.col("successes")) * F.log(1.0 - p)) - F.first(0.5 * F.col("theta") * F.col("theta"))).alias("ll"))
    weighted = ll.withColumn("w", F.exp(F.col("ll") - F.max("ll").over(Window.partitionBy("subject"))))
    return weighted.groupBy("subject").agg((F.sum(F.col("w") * F.col("theta")) / F.sum("w")).alias("theta"))


def predicted_rates(responses: DataFrame, items: DataFrame, theta: DataFrame) -> DataFrame:
    """subject, predicted: mean over all items of the rate seen, the model's, or the training rate.

    Every subject is asked for every item, so subjects times items is the size of the answer's sum.
    """
    every = theta.crossJoin(items).join(responses.select("subject", "item", (F.col("successes") / F.col("trials")).alias("seen")), ["subject", "item"], "left")
    model = F.when(F.col("identified") & ~F.col("extrapolated"), probability(F.col("a"), F.col("b"), F.col("theta"))).otherwise(F.col("observed_rate"))
    return every.groupBy("subject").agg(F.avg(F.coalesce("seen", model)).alias("predicted"))


#: Trials that are drawn together.
RUN = 4096


def drawn(cells: DataFrame, n_draws: int, seed: str = "attenuation") -> DataFrame:
    """fit_id (the draw), subject, item, successes, trials: binomial outcomes of cells (subject, item, trials, p), a uniform number a trial."""
    spark = cells.sparkSession
    draws = spark.range(n_draws).select(F.col("id").cast("string").alias(FIT))  # some tens of draws, each a copy by design
    asked = cells.crossJoin(F.broadcast(draws)).select(FIT, "subject", "item", F.col("trials").cast("long").alias("trials"), "p", F.monotonically_increasing_id().alias("cell"))
    # A cell may have any number of trials: they are dealt in runs of RUN over all partitions, and counted where they are drawn.
    begins = asked.withColumn("begin", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("trials"), F.lit(1)), F.lit(RUN).cast("long"))))
    dealt = begins.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(FIT, "subject", "item", "begin"))
    key = F.concat(F.concat_ws("|", F.lit(seed), FIT, F.col("subject").cast("string"), F.col("item").cast("string")), F.lit("|")).cast("binary")
    end = F.coalesce(F.least(F.col("begin") + (RUN - 1), F.coalesce("trials", F.lit(0))), F.lit(0))
    runs = dealt.select(FIT, "subject", "item", "trials", "cell", key.alias("key"), "begin", end.alias("end"), F.when(F.isnan("p"), 2.0).otherwise(F.coalesce("p", F.lit(-1.0))).alias("p"))
    kept = [FIT, "subject", "item", "trials", "cell"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin, last, p = (b.column(k).to_numpy(zero_copy_only=False) for k in ("begin", "end", "p"))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(digest.below(b.column("key").to_pylist(), begin, last, p))], [*kept, "hits"])

    each = runs.mapInArrow(count, StructType([runs.schema[k] for k in kept] + [StructField("hits", LongType())]))
    return each.groupBy(*kept).agg(F.sum("hits").cast("int").alias("successes")).select(FIT, "subject", "item", "successes", "trials")


def attenuation(cells: DataFrame, n_draws: int = 24, still: float = kernels.TOLERANCE) -> DataFrame:
    """draw, slope, ability_recovery, difficulty_recovery: a parametric bootstrap of the fit.

    Outcomes are drawn from the fitted model at the real numbers of trials, all draws are fitted at once, and the slopes found
    are regressed on those that made them. The model and the draws are fitted until no parameter moves by still. Draws with
    fewer than three usable items are skipped.
    """
    once = stored(cells.select("subject", "item", "successes", "trials"), "irt-once").withColumn(FIT, F.lit("base"))
    items, subjects, _ = scaled(once, fitted_to_rest(once, still))
    items, subjects = stored(items, "irt-base"), stored(subjects, "irt-base")
    usable = F.col("identified") & (F.col("b") != float("inf"))
    # An item without a difficulty has no ability at which it is solved.
    p = F.when(F.col("b") == float("inf"), 0.0).otherwise(probability(F.col("a"), F.col("b"), F.col("theta")))
    made = once.drop(FIT).join(items.select("item", "a", "b"), "item").join(subjects.select("subject", "theta"), "subject").withColumn("p", p)
    again = stored(drawn(made.select("subject", "item", "trials", "p"), n_draws), "irt-draws")
    new_items, new_subjects, _ = scaled(again, fitted_to_rest(again, still))
    base = items.where(usable).select("item", F.col("a").alias("a0"), F.col("b").alias("b0"))
    both = new_items.join(base, "item").where(F.col("b") != float("inf"))
    slope = expr.ratio(F.covar_samp("a0", "a"), F.var_samp("a0"))
    of_items = both.groupBy(FIT).agg(F.count("*").alias("n"), slope.alias("slope"), correlation("b0", "b").alias("difficulty_recovery")).where("n >= 3")
    of_subjects = new_subjects.join(subjects.select("subject", F.col("theta").alias("theta0")), "subject").groupBy(FIT).agg(correlation("theta0", "theta").alias("ability_recovery"))
    return of_items.join(of_subjects, FIT).select(F.col(FIT).alias("draw"), "slope", "ability_recovery", "difficulty_recovery")


def correlation(x: str, y: str) -> Column:
    return expr.ratio(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def attenuated(draws: DataFrame) -> DataFrame:
    """One row over the draws: mean slope and its deviation (0 for one draw), mean recoveries, their number."""
    return draws.agg(F.avg("slope").alias("slope"), F.coalesce(F.stddev_samp("slope"), F.lit(0.0)).alias("slope_sd"), F.avg("ability_recovery").alias("ability_recovery"), F.avg("difficulty_recovery").alias("difficulty_recovery"), F.count("*").alias("n_draws"))


def held_out(cells: DataFrame, n_folds: int = 5, seed: str = "cv", rounds: int = ROUNDS) -> DataFrame:
    """model, log_likelihood a trial: cells dealt to folds, each fold predicted from fits of the others, all folds fitted at once.

    Models: two parameters; one slope for all items, the mean of the free fit's; the item's mean rate. A subject or item that a
    fold leaves without any cell has no prediction there, nor do its cells count.
    """
    known = cells.select("subject", "item", "successes", "trials").withColumn("fold", F.floor(expr.uniform(seed, "subject", "item") * n_folds).cast("string"))
    folds = cells.sparkSession.range(n_folds).select(F.col("id").cast("string").alias(FIT))  # a handful, each with all other cells
    train = stored(known.crossJoin(F.broadcast(folds)).where(F.col("fold") != F.col(FIT)).drop("fold"), "irt-folds")
    free = fitted_in_rounds(train, rounds)
    one = fitted_in_rounds(train, rounds, slopes=free.groupBy(FIT).agg(F.avg("a").alias("a")))
    theta = posteriors(train, free).groupBy(FIT, "subject").agg(F.sum(F.col("post") * F.col("x")).alias("theta"))
    clipped = lambda p, at: F.least(F.greatest(p, F.lit(at)), F.lit(1 - at))
    rate = train.groupBy(FIT, "item").agg(clipped(F.sum("successes") / F.sum("trials"), 1e-4).alias("item_mean"))
    named = lambda fit, k: fit.select(FIT, "item", F.col("a").alias(f"a{k}"), F.col("d").alias(f"d{k}"))
    asked = known.withColumnRenamed("fold", FIT).join(theta, [FIT, "subject"])
    for side in (named(free, 0), named(one, 1), rate):
        asked = asked.join(side, [FIT, "item"])
    p = {"2pl": expr.sigmoid(F.col("a0") * F.col("theta") + F.col("d0")), "rasch": expr.sigmoid(F.col("a1") * F.col("theta") + F.col("d1")), "item_mean": F.col("item_mean")}
    s, n = F.col("successes"), F.col("trials")
    each = asked.select("trials", F.explode(F.array(*[F.struct(F.lit(k).alias("model"), (s * F.log(clipped(v, 1e-6)) + (n - s) * F.log(1.0 - clipped(v, 1e-6))).alias("ll")) for k, v in p.items()])).alias("m"))
    return each.groupBy("m.model").agg((F.sum("m.ll") / F.sum("trials")).alias("log_likelihood"))


def hardest(items: DataFrame, k: int) -> DataFrame:
    """The k hardest of the located items, ties by item."""
    return items.where("identified and not extrapolated").orderBy(F.desc("b"), "item").limit(k)


def ability_range(abilities: DataFrame, by: str) -> DataFrame:
    """by, low, high: the abilities that a fit has seen."""
    return abilities.groupBy(by).agg(F.min("theta").alias("low"), F.max("theta").alias("high"))
