"""Full scores estimated from item subsets: selectors against estimators, each subject left out in turn.

Nothing here copies the table for each subject left out. A subject's model is the fit of all subjects with the subject's
own expected counts taken off, and Newton steps from there: a row for each cell. Selectors and estimators are plans over those rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywork.functions import expr
from tallywork.operators import clustering, irt, kernels, suites
from tallywork.sources.shared import stored

#: Newton steps from the fit of all subjects.
STEPS = 2


def left_out(cells: DataFrame, rounds: int = irt.ROUNDS, steps: int = STEPS) -> DataFrame:
    """subject, item, a, b, observed_rate, identified, extrapolated: for each subject the model of all others, normalised on them.

    The others' posteriors are those of the fit of all, which one subject among many hardly moves: against whole refits
    of 25 subjects and 40 items the curves differ by less than 0.02 on average (tests).
    """
    known = stored(irt.tried(cells.withColumn(irt.FIT, F.lit("all"))), "left-out-cells")
    params = irt.fitted_in_rounds(known, rounds)
    post = stored(irt.posteriors(known, params).select("subject", "x", "post"), "left-out-posteriors")
    # Arrays over the nodes, a fixed number, in their order
    at_nodes = lambda *c: F.sort_array(F.collect_list(F.struct("x", *c)))
    of_subject = post.groupBy("subject").agg(at_nodes("post").alias("own"), F.sum(F.col("post") * F.col("x")).alias("theta"))
    every = known.join(post, "subject").groupBy("item", "x").agg(F.sum(F.col("successes") * F.col("post")).alias("r"), F.sum(F.col("trials") * F.col("post")).alias("f"))
    of_item = every.groupBy("item").agg(at_nodes("r", "f").alias("all")).join(known.groupBy("item").agg(F.sum("successes").alias("s_all"), F.sum("trials").alias("n_all")), "item")
    rows = known.join(of_subject, "subject").join(of_item, "item").join(params.select("item", "a", "d"), "item")
    rest = F.zip_with("all", "own", lambda e, o: F.struct(e["x"].alias("x"), (e["r"] - F.col("successes") * o["post"]).alias("r"), (e["f"] - F.col("trials") * o["post"]).alias("f")))
    moving = rows.withColumn("rest", rest).select("subject", "item", "successes", "trials", "s_all", "n_all", "a", "d", "rest")
    for _ in range(steps):
        moving = newton(moving)
    return located_without(moving.drop("rest"), of_subject.select("subject", "theta"))


def newton(rows: DataFrame) -> DataFrame:
    """rows with a and d after one damped step on their own expected counts (rest: x, r, f by node)."""
    zero = "named_struct('e', 0D, 'w', 0D, 'ex', 0D, 'wx', 0D, 'wxx', 0D)"
    with_p = "transform(rest, v -> named_struct('x', v.x, 'e', v.r - v.f / (1D + exp(-(a * v.x + d))), 'w', v.f / (1D + exp(-(a * v.x + d))) / (1D + exp(a * v.x + d))))"
    sums = f"aggregate({with_p}, {zero}, (t, v) -> named_struct('e', t.e + v.e, 'w', t.w + v.w, 'ex', t.ex + v.e * v.x, 'wx', t.wx + v.w * v.x, 'wxx', t.wxx + v.w * v.x * v.x))"
    of_a, of_d = 1 / kernels.PRIOR_A_SD**2, 1 / kernels.PRIOR_D_SD**2
    slopes = rows.selectExpr("*", f"{sums} as _s").selectExpr("*", f"_s.e - d * {of_d}D as _gd", f"_s.w + {of_d + kernels.RIDGE}D as _hd", f"_s.ex - (a - {kernels.PRIOR_A}D) * {of_a}D as _ga", f"_s.wxx + {of_a + kernels.RIDGE}D as _ha")
    moves = slopes.selectExpr("*", "(_hd * _ga - _s.wx * _gd) / (_ha * _hd - _s.wx * _s.wx) as _da", "(_ha * _gd - _s.wx * _ga) / (_ha * _hd - _s.wx * _s.wx) as _dd").selectExpr("*", "least(1D, 1D / greatest(abs(_da), abs(_dd), 1e-12D)) as _scale")
    return moves.selectExpr(*[f"a + _da * _scale as {c}" if c == "a" else f"d + _dd * _scale as {c}" if c == "d" else c for c in rows.columns])


def located_without(rows: DataFrame, theta: DataFrame) -> DataFrame:
    """Parameters on the scale of the other subjects' abilities, with their flags."""
    total = theta.agg(F.count("*").alias("n"), F.avg("theta").alias("centre"))
    ends = [r["theta"] for order in (F.col("theta"), F.desc("theta")) for r in theta.orderBy(order).limit(2).collect()]  # four numbers
    low, high = ends[: len(ends) // 2], ends[len(ends) // 2 :]
    around = theta.crossJoin(total).withColumn("t", F.col("theta") - F.col("centre"))  # total: one row
    squares = around.agg(F.sum(F.col("t") * F.col("t")).alias("ss"))
    m, mean = F.col("n") - 1, F.col("centre") - F.col("t") / (F.col("n") - 1)
    spread = F.sqrt(F.greatest((F.col("ss") - F.col("t") * F.col("t") - F.col("t") * F.col("t") / m) / F.nullif(m - 1, F.lit(0)), F.lit(0.0)))
    other = lambda two: F.when(F.col("theta") == two[0], two[-1]).otherwise(two[0])
    scale = around.crossJoin(squares).select("subject", mean.alias("mu"), F.when(spread > 0, spread).otherwise(1.0).alias("unit"), other(low).alias("low"), other(high).alias("high"))
    s, n = F.col("s_all") - F.col("successes"), F.col("n_all") - F.col("trials")
    a, d = F.col("a") * F.col("unit"), F.col("d") + F.col("a") * F.col("mu")
    steep = F.abs("a_") >= kernels.IDENTIFIED
    out = rows.join(scale, "subject").withColumns({"a_": a, "d_": d}).withColumn("b", F.when(steep, -F.col("d_") / F.col("a_")).otherwise(float("inf")))
    inside = F.col("b").between((F.col("low") - F.col("mu")) / F.col("unit") - 1.0, (F.col("high") - F.col("mu")) / F.col("unit") + 1.0)
    return out.select("subject", "item", F.col("a_").alias("a"), "b", expr.ratio(s, n).alias("observed_rate"), (steep & (s != 0) & (s != n)).alias("identified"), (~inside).alias("extrapolated"))


LOCATED = "identified and not extrapolated"
#: What a selector gets: models (subject, item, a, b, observed_rate, ...), cells, size, repeats. It gives subject, repeat, item.
Selector = Callable[[DataFrame, DataFrame, int, int], DataFrame]


def repeated(models: DataFrame, repeats: int) -> DataFrame:
    return models.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))


def select_random(models: DataFrame, cells: DataFrame, k: int, repeats: int) -> DataFrame:
    draw = Window.partitionBy("subject", "repeat").orderBy(expr.uniform("subset/random", "subject", F.lit(k), "repeat", "item"), "item")
    return repeated(models, repeats).withColumn("place", F.row_number().over(draw)).where(F.col("place") <= k).select("subject", "repeat", "item")


def select_stratified(models: DataFrame, cells: DataFrame, k: int, repeats: int) -> DataFrame:
    """One random item of each of k bins of observed rates."""
    binned = models.withColumn("bin", F.ntile(k).over(Window.partitionBy("subject").orderBy("observed_rate", "item")))
    drawn = F.min_by("item", F.struct(expr.uniform("subset/stratified", "subject", F.lit(k), "repeat", "item"), "item"))
    return repeated(binned, repeats).groupBy("subject", "repeat", "bin").agg(drawn.alias("item")).drop("bin")


def select_greedy(models: DataFrame, cells: DataFrame, k: int, repeats: int) -> DataFrame:
    rates = cells.select("subject", "item", (F.col("successes") / F.col("trials")).alias("rate"))
    return suites.greedy(suites.leaving_one_out(rates), k).select(F.col("split").alias("subject"), F.lit(0).alias("repeat"), "item")


def select_max_information(models: DataFrame, cells: DataFrame, k: int, repeats: int) -> DataFrame:
    p = expr.sigmoid(-F.col("a") * F.col("b"))
    info = F.when(F.expr(LOCATED), F.col("a") * F.col("a") * p * (1.0 - p)).otherwise(0.0)
    best = Window.partitionBy("subject").orderBy(F.desc(F.round(info, 12)), "item")
    return models.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("subject", F.lit(0).alias("repeat"), "item")


def select_anchor(models: DataFrame, cells: DataFrame, k: int, repeats: int, rounds: int = clustering.ROUNDS) -> DataFrame:
    """The items nearest to the centres of k clusters of located items' response curves; all of them where there are no more than k."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.lit(-3.0) + i * F.lit(0.25))
    curves = models.where(LOCATED).withColumn("x", F.transform(grid, lambda t: expr.sigmoid(F.col("a") * (t - F.col("b")))))
    points = stored(repeated(curves, repeats).select("subject", "repeat", F.col("item").alias("point"), "x"), "curves")
    keys = ["subject", "repeat"]
    return clustering.exemplars(points, clustering.kmeans(points, k, rounds, keys, f"subset/anchor/{k}"), keys).select("subject", "repeat", F.col("point").alias("item"))


#: Selectors by name; a user's own goes beside them.
SELECTORS: dict[str, Selector] = {"random": select_random, "stratified": select_stratified, "greedy_alpha": select_greedy, "max_information": select_max_information, "anchor": select_anchor}
#: Nodes of an ability's posterior.
GRID, REACH = 481, 6.0
CASE = ["subject", "selector", "k", "repeat"]


def errors(cells: DataFrame, ks: tuple[int, ...], repeats: int = 3, selectors: dict[str, Selector] | None = None, rounds: int = irt.ROUNDS) -> DataFrame:
    """held_out, selector, k, repeat, estimator (pirt, naive), n_items, error: estimate less truth over all items.

    Selectors see only the models and cells of the others. Those that don't draw give repeat 0 alone. Raises below three
    subjects, for sizes beyond the items, and for unknown cells (a subject without an item).
    """
    size = cells.agg(F.count_distinct("subject").alias("subjects"), F.count_distinct("item").alias("items"), F.count("*").alias("n")).first()
    if size["subjects"] < 3:
        raise ValueError("leaving one out needs at least three subjects")
    if any(not 1 <= k <= size["items"] for k in ks):
        raise ValueError(f"sizes lie in 1 .. {size['items']}")
    if size["n"] != size["subjects"] * size["items"]:
        raise ValueError("a subject lacks an item, or has it twice")
    known = stored(cells.select("subject", "item", F.col("successes").cast("double").alias("successes"), F.col("trials").cast("double").alias("trials")), "subset-cells")
    models = stored(left_out(known, rounds), "models")
    parts = [pick(models, known, k, repeats).select("subject", F.lit(name).alias("selector"), F.lit(k).alias("k"), F.col("repeat").cast("int").alias("repeat"), "item") for name, pick in (selectors or SELECTORS).items() for k in ks]
    picked = parts[0]
    for p in parts[1:]:
        picked = picked.unionByName(p)
    chosen = stored(picked, "chosen")
    return estimated(known, models, chosen)


def estimated(known: DataFrame, models: DataFrame, chosen: DataFrame) -> DataFrame:
    """The errors of both estimators for chosen items (CASE, item)."""
    seen = known.select("subject", "item", "successes", "trials", (F.col("successes") / F.col("trials")).alias("rate"))
    ran = chosen.join(seen, ["subject", "item"])
    use = ran.join(models.where(LOCATED).select("subject", "item", "a", "b"), ["subject", "item"])
    nodes = known.sparkSession.range(0, GRID, 1, 1).select((F.lit(-REACH) + F.col("id") * F.lit(2 * REACH / (GRID - 1))).alias("theta"))
    at = use.crossJoin(F.broadcast(nodes)).selectExpr(*CASE, "theta", "successes", "trials", "least(greatest(1D / (1D + exp(-a * (theta - b))), 1e-9D), 1D - 1e-9D) as p")
    ll = at.groupBy(*CASE, "theta").agg(F.expr("sum(successes * ln(p) + (trials - successes) * ln(1D - p)) - 0.5D * theta * theta as l"))
    w = ll.withColumn("w", F.exp(F.col("l") - F.max("l").over(Window.partitionBy(*CASE))))  # a row a node
    theta = w.groupBy(*CASE).agg((F.sum(F.col("w") * F.col("theta")) / F.sum("w")).alias("theta"))
    cases = ran.groupBy(*CASE).agg(F.count("*").alias("n_items"), F.avg("rate").alias("naive")).join(theta, CASE, "left").withColumn("theta", F.coalesce("theta", F.lit(0.0)))
    # Each case is asked for every item: its answer is a mean over all of them.
    every = cases.join(models, "subject").join(ran.select(*CASE, "item", "rate"), [*CASE, "item"], "left")
    guess = F.coalesce("rate", F.when(F.expr(LOCATED), expr.sigmoid(F.col("a") * (F.col("theta") - F.col("b")))).otherwise(F.col("observed_rate")))
    means = every.groupBy(*CASE, "n_items", "naive").agg(F.avg(guess).alias("pirt"))
    truth = seen.groupBy("subject").agg(F.avg("rate").alias("truth"))
    both = F.explode(F.array(*[F.struct(F.lit(e).alias("estimator"), (F.col(e) - F.col("truth")).alias("error")) for e in ("pirt", "naive")]))
    return means.join(truth, "subject").withColumn("e", both).select(F.col("subject").alias("held_out"), "selector", "k", "repeat", "e.estimator", F.col("n_items").cast("int").alias("n_items"), "e.error")


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("selector", "estimator", "k").agg(F.avg(F.abs("error")).alias("mae"), F.max(F.abs("error")).alias("max_error"), F.avg("error").alias("bias"), F.count("*").alias("n")).orderBy("mae", "selector", "estimator", "k")
