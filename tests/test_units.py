"""Values worked out by hand."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywork.functions import expr, metrics
from tallywork.operators import clustering, ctt, features, grading, inference, irt, kernels, runs, skills, subset, suites, swe, triage


def one(df):
    return df.first().asDict()


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.0, 0.1), (1, 1.0, 0.5), (1, 0.0, 0.5), (1, 1.0, 0.9)], "g int, y double, p double")
    assert one(metrics.scored(df, ["g"], "auc"))["score"] == pytest.approx(0.875)
    flat = df.withColumn("p", F.lit(0.3))
    assert one(metrics.scored(flat, ["g"], "auc"))["score"] == pytest.approx(0.5)


def test_auc_doesnt_change_under_a_rising_map(spark):
    df = spark.range(200).select(F.lit(1).alias("g"), (F.col("id") % 3 == 0).cast("double").alias("y"), expr.uniform("t", F.col("id")).alias("p"))
    a, b = (one(metrics.scored(x, ["g"], "auc"))["score"] for x in (df, df.withColumn("p", F.exp(3.0 * F.col("p")))))
    assert a == pytest.approx(b)


def test_log_loss_is_finite_and_rounding_goes_to_even(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (1, 0.0, 0.5), (1, 1.0, 1.5), (1, 2.0, 2.5)], "g int, y double, p double")
    assert one(metrics.scored(df, ["g"], "log_loss"))["score"] < 60
    assert one(metrics.scored(df, ["g"], "accuracy"))["score"] == pytest.approx(0.5)


def test_bad_values_make_an_error_and_not_an_exception(spark):
    df = spark.createDataFrame([(1, 1.0, float("nan")), (2, 1.0, 1.0)], "g int, y double, p double")
    out = {r["g"]: (r["score"], r["error"]) for r in metrics.scored(df, ["g"], "mae").collect()}
    assert out[2] == (0.0, None) and out[1][0] is None and "finite" in out[1][1]


def test_unknown_metric_names_the_known_ones():
    with pytest.raises(ValueError, match="auc"):
        metrics.metric("nope")


@pytest.mark.parametrize("n, want", [(1, (1, 1, 1)), (50, (5, 10, 20)), (99, (9, 19, 39)), (100, (10, 20, 40)), (249, (10, 20, 99)), (250, (10, 50, 100)), (999, (11, 50, 100)), (1000, (12, 50, 100)), (5000, (20, 250, 500))])
def test_medal_ranks(spark, n, want):
    r = spark.range(1).select(expr.medal_ranks(F.lit(n).cast("long")).alias("r")).first()["r"]
    assert (r["gold"], r["silver"], r["bronze"]) == want


def test_pvalue_floor_of_five_and_six_units(spark):
    df = spark.createDataFrame([(n, u, 0.1) for n in (5, 6) for u in range(n)], "g int, unit int, diff double")
    got = {r["n_units"]: r["p_value"] for r in inference.sign_flip(df, ["g"]).collect()}
    assert got == {5: pytest.approx(3 / 33), 6: pytest.approx(3 / 65)}


def test_sign_flip_is_symmetric(spark):
    df = spark.createDataFrame([(1, u, d) for u, d in enumerate((0.3, -0.1, 0.2, 0.4, 0.1, 0.25, -0.05))], "g int, unit int, diff double")
    a, b = (one(inference.sign_flip(x, ["g"]))["p_value"] for x in (df, df.withColumn("diff", -F.col("diff"))))
    assert a == pytest.approx(b)


def test_power_near_alpha_without_an_effect(spark):
    pool = spark.createDataFrame([(i, 0.1 + 0.04 * i) for i in range(20)], "place long, rate double")
    got = one(inference.power(pool, spark.createDataFrame([(0.0,)], "effect double"), inference.Design(10, 3), 300))
    assert got["power"] < 0.12


def test_design_that_cannot_reach_alpha_has_no_power(spark):
    pool = spark.createDataFrame([(0, 0.5)], "place long, rate double")
    assert one(inference.power(pool, spark.createDataFrame([(0.9,)], "effect double"), inference.Design(4, 3), 10))["power"] == 0.0
    with pytest.raises(ValueError):
        inference.Design(0, 3)


def test_numbers_are_read_as_python_reads_them(spark):
    raws = ["1", " 2.5 ", "1_000", "1__0", "_1", "1e3", ".5", "5.", "nan", "-Inf", "0x1p3", "1d", "", "abc"]
    got = [r["v"] for r in spark.createDataFrame([(r,) for r in raws], "raw string").select(expr.parsed_number(F.col("raw")).alias("v")).collect()]
    for raw, v in zip(raws, got, strict=True):
        try:
            want = float(raw)
        except ValueError:
            want = None
        assert v == want or want != want and v != v, (raw, v, want)


def test_first_error_is_by_line_then_rule(spark):
    rows = spark.createDataFrame([("r", 2, "a", "1"), ("r", 3, "a", "x"), ("r", 4, "b", "y"), ("s", 2, "a", "z")], "run string, line_no int, id string, raw string")
    got = {r["run"]: r["error"] for r in grading.first_errors(rows).collect()}
    assert got == {"r": "duplicate id a at row 3", "s": "not a number at row 2"}


BASE = {"harness_error": None, "harness_log": "", "agent_log": "", "has_submission": False, "submission_rows": 0, "validation_error": None, "exit_code": 0, "wall_clock": 10.0, "time_cap": 100.0}
SCHEMA = "harness_error string, harness_log string, agent_log string, has_submission boolean, submission_rows int, validation_error string, exit_code int, wall_clock double, time_cap double"


@pytest.mark.parametrize("change, want", [
    ({}, "no_submission"), ({"has_submission": True, "submission_rows": 5}, "valid"), ({"has_submission": True, "submission_rows": 5, "wall_clock": 100.0, "exit_code": 124}, "valid"), ({"has_submission": True}, "invalid_submission"),
    ({"validation_error": "bad"}, "invalid_submission"), ({"wall_clock": 99.0}, "timeout"), ({"exit_code": 124}, "timeout"), ({"exit_code": 137}, "oom"), ({"exit_code": 1}, "crash"), ({"exit_code": 1, "agent_log": "x\nCUDA  out of memory"}, "oom"),
    ({"harness_error": "x", "has_submission": True, "submission_rows": 1}, "infra"), ({"harness_log": "a\nspot itn received\nb"}, "infra"), ({"agent_log": "Spot ITN received", "exit_code": 1}, "crash"), ({"harness_log": "CUDA out of memory", "exit_code": 1}, "crash"),
    ({"wall_clock": 100.0, "agent_log": "CUDA out of memory", "exit_code": 124}, "timeout"),
])
def test_outcomes(spark, change, want):
    row = spark.createDataFrame([tuple((BASE | change).values())], SCHEMA)
    assert one(triage.classified(row))["outcome"] == want


def test_rule_order_goes_before_line_order(spark):
    row = spark.createDataFrame([tuple((BASE | {"harness_log": "No space left on device\npod: ImagePullBackOff"}).values())], SCHEMA)
    got = one(triage.classified(row))
    assert got["signal"] == "image-pull" and got["detail"] == "pod: ImagePullBackOff" and not got["ambiguous"]


def test_a_rule_added_as_a_row_changes_the_outcome(spark):
    row = spark.createDataFrame([tuple((BASE | {"harness_log": f"{'x' * 300} solar\nflare\nEC2 Spot Instance Interruption Warning", "exit_code": 1}).values())], SCHEMA)
    rules = triage.rule_table(spark)
    mine = rules.union(spark.createDataFrame([("harness", -1, "solar", r"solar\s+flare", True)], triage.RULES))
    before, after = one(triage.classified(row, rules)), one(triage.classified(row, mine))
    assert before["signal"] == "spot-interruption" and one(triage.classified(row)) == before
    assert after["outcome"] == "infra" and after["signal"] == "solar" and after["ambiguous"] and len(after["detail"]) == 160 and after["detail"].endswith("...")
    assert one(triage.classified(row, rules.where("log = 'agent'")))["outcome"] == "crash"
    found = row.select(triage.matches(F.col("harness_log"), triage.signatures(mine, "harness")).alias("m")).first()["m"]
    assert [(m["signal"], m["place"]) for m in found] == [("solar", 301), ("spot-interruption", 313)]


def test_permutations_are_bijections_and_differ(spark):
    from tallywork.functions import shuffles

    for n in (1, 2, 7, 100):
        got = spark.range(n).crossJoin(spark.range(3).withColumnRenamed("id", "draw")).select("draw", "id", shuffles.permuted(F.col("id"), n, "t", "draw").alias("to")).toPandas()
        assert all(sorted(g["to"]) == list(range(n)) for _, g in got.groupby("draw"))
    assert got.groupby("draw")["to"].apply(tuple).nunique() == 3
    draws = spark.range(600).select(shuffles.permuted(F.lit(2), 6, "u", "id").alias("to")).groupBy("to").count().toPandas()
    assert len(draws) == 6 and draws["count"].between(60, 140).all()


def test_absent_test_has_failed_and_markers_are_needed(spark):
    log = f"{swe.START}\nPASSED a\nFAILED b\nPASSED b\n{swe.END}\nFAILED a"
    logs = spark.createDataFrame([("ok", log), ("bare", "PASSED a"), ("nopatch", f"{swe.NO_PATCH}\n{log}")], "run string, log string")
    expected = spark.createDataFrame([(r, t, k) for r in ("ok", "bare", "nopatch") for t, k in (("a", "f2p"), ("b", "p2p"), ("c", "p2p"))], "run string, test string, kind string")
    got = {r["run"]: r for r in swe.resolved(logs, expected).collect()}
    assert got["ok"]["f2p_success"] == ["a"] and got["ok"]["p2p_failure"] == ["c"] and got["ok"]["regressed"]
    assert got["bare"]["summary"] == got["nopatch"]["summary"] == "patch not applied"


def test_conflicts_and_guard(spark):
    pair = spark.createDataFrame([(("s", "c", "1"), ("s", "d", None))], "a struct<split_id:string,container_config:string,harness_version:string>, b struct<split_id:string,container_config:string,harness_version:string>")
    with pytest.raises(runs.Incomparable, match="container_config: c vs d; harness_version: 1 vs none"):
        runs.assert_comparable(pair)
    assert len(runs.assert_comparable(pair, allow_mismatch=True)) == 2


def test_failed_pairs_are_never_zero_differences(spark):
    pairs = spark.createDataFrame([("a", "c", u, 1.0, None if u < 3 else 0.5) for u in range(8)] + [("b", "c", u, 1.0, None) for u in range(4)], "agent string, challenge string, unit int, control double, challenged double")
    got = {r["agent"]: r for r in skills.cells(pairs, n_boot=50).collect()}
    assert got["a"]["delta"] == pytest.approx(-0.5) and got["a"]["partially_broke"] and got["b"]["broke"] and got["b"]["delta"] is None


def simulated(n_subjects=25, n_items=40, trials=5, seed=0):
    g = np.random.default_rng(seed)
    a, b, theta = np.exp(g.normal(0.1, 0.4, n_items)), np.linspace(-2.2, 2.2, n_items), g.normal(size=n_subjects)
    n = np.full((n_subjects, n_items), float(trials))
    return a, b, theta, g.binomial(trials, kernels.sigmoid(a * (theta[:, None] - b))).astype(float), n


def test_fit_recovers_abilities_and_difficulties():
    _, b, theta, s, n = simulated()
    m = kernels.fit(s, n)
    ok = m["identified"]
    assert m["converged"] and np.corrcoef(theta, m["theta"])[0, 1] > 0.95 and np.corrcoef(b[ok], m["b"][ok])[0, 1] > 0.9
    assert m["theta"].mean() == pytest.approx(0, abs=1e-9) and m["theta"].std(ddof=1) == pytest.approx(1)


def frame(spark, s, n, **more):
    pdf = long_cells(s, n).assign(**more)
    return spark.createDataFrame(pdf)


def test_rounds_of_several_models_come_to_the_kernels_fits(spark):
    """Two models at once, one of them ragged; each ends by itself."""
    _, _, _, s, n = simulated(30, 8)
    whole, ragged = frame(spark, s, n, fit_id="whole"), frame(spark, s, n, fit_id="ragged").where("subject <> 3 or item <> 2")
    cells = whole.unionByName(ragged)
    params = irt.fitted_in_rounds(cells, 60, 2e-3)
    got = {(r["fit_id"], r["item"]): r for r in params.collect()}
    want = kernels.fit(s, n, normalize=False)
    assert len(got) == 16 and all(abs(got["whole", j]["a"] - want["a"][j]) < 0.06 for j in range(8))
    assert all(r["converged"] for r in got.values())
    assert abs(got["ragged", 2]["a"] - got["whole", 2]["a"]) > 1e-5
    items, subjects, fits = irt.scaled(cells, params)
    theta = np.array([r["theta"] for r in subjects.where("fit_id = 'whole'").orderBy("subject").collect()])
    full = kernels.fit(s, n)
    assert abs(theta.mean()) < 1e-9 and abs(theta.std(ddof=1) - 1) < 1e-9 and np.abs(theta - full["theta"]).max() < 0.05
    assert {r["item"] for r in items.where("fit_id = 'whole' and identified").collect()} == set(np.flatnonzero(full["identified"]))
    assert fits.where("fit_id = 'whole'").first()["log_likelihood"] == pytest.approx(full["ll"], abs=0.05)


def test_a_fixed_slope_stays(spark):
    _, _, _, s, n = simulated(12, 5)
    cells = frame(spark, s, n, fit_id="r")
    got = irt.fitted_in_rounds(cells, 25, 1e-3, slopes=spark.createDataFrame([("r", 0.8)], "fit_id string, a double")).orderBy("item").collect()
    want = kernels.fit(s, n, normalize=False, fixed_a=0.8, max_iterations=200)
    assert all(r["a"] == 0.8 for r in got) and np.allclose([r["d"] for r in got], want["d"], atol=0.02)


def test_models_without_a_subject_are_near_whole_refits(spark):
    _, _, _, s, n = simulated()
    got = subset.left_out(frame(spark, s, n), 40).toPandas()
    grid, gaps = np.linspace(-2, 2, 21), []
    for i in (0, 7, 19):
        keep = np.arange(25) != i
        want = kernels.fit(s[keep], n[keep])
        mine = got[got["subject"] == i].sort_values("item")
        ok = mine["identified"].to_numpy(bool) & want["identified"]
        a, b = mine["a"].to_numpy()[ok], mine["b"].to_numpy()[ok]
        gaps.append(np.abs(kernels.sigmoid(a[:, None] * (grid - b[:, None])) - kernels.sigmoid(want["a"][ok][:, None] * (grid - want["b"][ok][:, None]))).mean())
        assert np.allclose(mine["observed_rate"], want["rate"])
    assert max(gaps) < 0.02


def test_p_irt_beats_the_mean_of_a_subset(spark):
    _, _, _, s, n = simulated()
    pick = {k: v for k, v in subset.SELECTORS.items() if k in ("random", "stratified", "max_information")}
    got = {(r["selector"], r["estimator"]): r["mae"] for r in subset.summary(subset.errors(frame(spark, s, n), (8,), 2, pick, 20)).collect()}
    assert len(got) == 6 and got["random", "pirt"] < got["random", "naive"] and got["max_information", "pirt"] < got["max_information", "naive"]
    for wrong, said in ((frame(spark, s[:2], n[:2]), "three subjects"), (frame(spark, s, n).where("subject > 0 or item > 0"), "lacks an item")):
        with pytest.raises(ValueError, match=said):
            subset.errors(wrong, (8,))


def suite_of(m, chosen):
    k, total = len(chosen), m[:, chosen].sum(1).var(ddof=1)
    return m[:, chosen].std(ddof=1) if k == 1 else k / (k - 1) * (1 - m[:, chosen].var(0, ddof=1).sum() / total) if total > 0 else 0.0


def by_trial(m, k, cost=None, budget=np.inf):
    chosen, spent = [], 0.0
    while len(chosen) < k:
        open_ = [j for j in range(m.shape[1]) if j not in chosen and spent + (1 if cost is None else cost[j]) <= budget]
        if not open_:
            break
        chosen.append(max(open_, key=lambda j: (round(suite_of(m, [*chosen, j]) / (1 if cost is None else cost[j]), 12), -j)))
        spent += 1 if cost is None else cost[chosen[-1]]
    return chosen


def test_suites_are_those_of_trying_every_item(spark):
    m = np.random.default_rng(1).uniform(size=(9, 6))
    m[:, 4] *= 3
    m[:, 5] = 0.5
    cells = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(9) for j in range(6)], "subject long, item long, rate double")
    found = lambda df: [r["item"] for r in df.orderBy("step").collect()]
    every = cells.select(F.lit(0).cast("long").alias("split"), "subject").distinct()
    assert found(suites.greedy(suites.by_sets(cells, every), 5)) == by_trial(m, 5)
    cost = np.array([1, 6, 15, 1, 6, 1.0])
    priced = spark.createDataFrame(list(enumerate(cost.tolist())), "item long, cost double")
    got = suites.greedy(suites.by_sets(cells, every), None, priced, (8.0, 0.5))
    assert found(got.where("budget = 8")) == by_trial(m, 6, cost, 8) and got.where("budget < 1").count() == 0
    out = suites.greedy(suites.leaving_one_out(cells), 3)
    assert all(found(out.where(f"split = {i}")) == by_trial(m[np.arange(9) != i], 3) for i in range(9))
    with pytest.raises(ValueError, match="six subjects"):
        suites.cross_validated(cells.where("subject < 5"), 2)


def test_clusters_fill_and_exemplars_differ(spark):
    g = np.random.default_rng(5)
    xs = np.concatenate([g.normal(c, 0.1, (12, 3)) for c in (0.0, 4.0, 9.0)])
    points = spark.createDataFrame([("k", i, x.tolist()) for i, x in enumerate(xs)] + [("same", i, [1.0, 1.0, 1.0]) for i in range(4)] + [("few", 0, [0.0, 0.0, 0.0])], "key string, point long, x array<double>")
    centres = clustering.kmeans(points, 3, 10, ["key"])
    got = {r["key"]: r["centres"] for r in centres.collect()}
    assert sorted(round(c[0]) for c in got["k"]) == [0, 4, 9]
    chosen = {}
    for r in clustering.exemplars(points, centres, ["key"]).collect():
        chosen.setdefault(r["key"], []).append(r["point"])
    assert sorted(p // 12 for p in chosen["k"]) == [0, 1, 2] and len(set(chosen["same"])) == 3 and chosen["few"] == [0]


def test_many_units_are_resampled_like_numpy_does(spark):
    """2000 units: interval and p-value near those of arrays, the same however the rows are dealt."""
    d = np.random.default_rng(3).normal(0.05, 1.0, 2000)
    rows = spark.createDataFrame([(1, u, float(x)) for u, x in enumerate(d)], "g int, unit long, diff double")
    one_, two = (inference.bootstrap_ci(x, ["g"], 1000).first() for x in (rows, rows.repartition(7)))
    g = np.random.default_rng(4)
    means = d[g.integers(0, 2000, (1000, 2000))].mean(1)
    assert one_["ci_low"] == pytest.approx(np.quantile(means, 0.025), abs=0.01) and one_["ci_high"] == pytest.approx(np.quantile(means, 0.975), abs=0.01)
    assert one_["ci_low"] == pytest.approx(two["ci_low"], abs=1e-12)
    p = inference.sign_flip(rows, ["g"], 1999).first()
    flips = np.abs((g.choice([-1.0, 1.0], (1999, 2000)) @ d) / 2000)
    assert p["n_units"] == 2000 and p["p_value"] == pytest.approx(((flips >= abs(d.mean())).sum() + 1) / 2000, abs=0.02)


def test_alpha_of_a_constant_total_is_zero(spark):
    cells = spark.createDataFrame([(s, i, 0.5) for s in range(3) for i in range(3)], "subject long, item long, rate double")
    assert one(ctt.alpha(cells))["alpha"] == 0.0


def test_generated_task_is_the_same_however_partitioned(spark):
    spec = features.TaskSpec("t", 60, 30, pathologies=("leakage", "missing"))
    a = features.generated(spark, spec).orderBy("id").toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    b = features.generated(spark, spec).repartition(3).orderBy("id").toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a.round(9).equals(b.round(9)) and a["f2"].isna().any()
    with pytest.raises(ValueError):
        features.TaskSpec("t", kind="x")


def test_relabelled_clone_keeps_row_fingerprints(spark):
    task = features.generated(spark, features.TaskSpec("t", 40, 20))
    long = lambda df, key: df.unpivot([key], [c for c in df.columns if c[0] in "fc" and c[1:].isdigit()], "feature", "x").withColumnRenamed(key, "row")
    a, b = (features.fingerprints(long(df, "id")).select("fingerprint") for df in (task, features.cloned(task, "s")))
    assert a.exceptAll(b).count() == 0


def test_leaderboard_and_leak(spark):
    spec = features.TaskSpec("t", 200, 100, pathologies=("leakage",), n_teams=12)
    task = features.generated(spark, spec)
    scores = features.leaderboard(task, spec)
    assert scores.count() == 12 and 0.3 < scores.agg(F.avg("score")).first()[0] < 1
    train = task.where("part = 'train'")
    names = [c for c in task.columns if c.startswith("f")]
    long = train.unpivot(["id"], names, "feature", "x").withColumnRenamed("id", "row")
    found = features.suspicious(long, train.select(F.col("id").alias("row"), F.col("target").alias("y")))
    assert [r["feature"] for r in found.collect()] == ["f8"]


def test_ridge_by_sums_is_ridge(spark):
    task = features.generated(spark, features.TaskSpec("t", 100, 10, kind="regression")).where("part = 'train'")
    names = ["f0", "f1", "f2"]
    pdf = task.toPandas()
    x = np.column_stack([pdf[names], np.ones(len(pdf))])
    assert np.allclose(features.ridge_fit(task, names, "target"), features.ridge(x, pdf["target"].to_numpy()))


def test_relabelling_leaves_the_difficulty(spark):
    task = features.generated(spark, features.TaskSpec("d", 120, 60, kind="regression"))
    a, b = features.difficulty(task), features.difficulty(features.cloned(task, "s"))
    assert a == pytest.approx(b, rel=1e-9) and features.difficulty(features.cloned(task, "s", "rescale")) != pytest.approx(a, rel=1e-6)


def test_rounding_is_pythons(spark):
    from tallywork.functions.rounding import rounded

    xs = [0.123455, 2.675, 0.5, None, 1e-9, -0.123455]
    got = [r["r"] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(rounded(F.col("x")).alias("r")).collect()]
    assert got == [None if x is None else round(x, 5) for x in xs]
    g = np.random.default_rng(8)
    halves = (g.integers(-(10**7), 10**7, 60_000) + 0.5) / 1e5
    many = np.concatenate([halves, np.nextafter(halves, np.inf), np.nextafter(halves, -np.inf), g.normal(size=60_000) * 10.0 ** g.integers(-7, 12, 60_000), g.integers(-(2**40), 2**40, 20_000) / 2.0**17, [1e300, -1e300, 5e-324, float("inf"), 2.0**53]])
    got = spark.createDataFrame(pd.DataFrame({"x": many})).select("x", rounded(F.col("x")).alias("r")).toPandas()
    assert (got["r"].to_numpy() == np.array([round(v, 5) for v in got["x"].tolist()])).all()


def test_published_tables(spark):
    from tallywork.operators import published

    t = spark.createDataFrame([("a", "x", 1, 3), ("a", "y", 0, 3), ("b", "x", 3, 3)], "experiment string, competition_id string, medals int, seeds int")
    assert [r["competition_id"] for r in published.common(t).collect()] == ["x"]
    with pytest.raises(published.UnknownExperiment):
        published.rates(t, "c")
    s = spark.createDataFrame([("q__x__seed12",)], "s string").select(published.item_of(F.col("s")).alias("i"), published.seed_of(F.col("s")).alias("n")).first()
    assert (s["i"], s["n"]) == ("q__x", 12)
    assert published.beta_pool(spark, 0.17, 0.7, 500).agg(F.avg("rate")).first()[0] == pytest.approx(0.17, abs=0.05)


def test_smallest_effect_by_direction(spark):
    pool = inference.beta_pool(spark, 0.8, 4.0, 200)
    design = inference.Design(12, 3)
    drop = inference.detectable_effect(pool, design, 60, tolerance=0.02)
    gain = inference.detectable_effect(pool, design, 60, "increase", tolerance=0.02)
    assert drop < 0 and (gain is None or gain > -drop)  # a rate near 1 has little room above
    at = spark.createDataFrame([(drop,), (drop + 0.02,)], "effect double")
    found = {r["effect"]: r["power"] for r in inference.power(pool, at, design, 60).collect()}
    assert found[drop] >= 0.8 > found[drop + 0.02]
    assert inference.detectable_effect(pool, inference.Design(5, 3), 10) is None
    for wrong in ({"direction": "up"}, {"target": 0.0}, {"tolerance": 0.0}):
        with pytest.raises(ValueError):
            inference.detectable_effect(pool, design, 10, **wrong)


def test_beta_pool_has_the_mean_and_spread_of_the_distribution(spark):
    for rate, many in ((0.17, 0.5), (0.8, 1.0), (0.5, 50.0)):
        r = np.array([x["rate"] for x in inference.beta_pool(spark, rate, many).collect()])
        assert abs(r.mean() - rate) < 2e-3 and abs(r.var() - rate * (1 - rate) / (many + 1)) < 2e-3
    with pytest.raises(ValueError):
        inference.beta_pool(spark, 1.5, 1.0)


def test_matched_pairs_warn_and_must_be_whole(spark):
    rates = lambda names: spark.createDataFrame([(n, 0.1 * k, 2 + k % 2) for k, n in enumerate(names)], "item string, rate double, seeds long")
    a, b = rates(["a", "b", "c", "z"]), rates(["d", "e", "f"])
    pairs = spark.createDataFrame([("a", "e"), ("b", "f")], "pre string, post string")
    out = one(inference.compared(a, b, n_boot=20, pairs=pairs, infra_failures=4))
    assert out["n_units"] == 2 and out["n_dropped"] == 0 and abs(out["difference"] - 0.1) < 1e-12
    assert inference.MATCHED in out["warnings"] and "4 runs that infrastructure ended" in out["warnings"] and "dropped" not in out["warnings"]
    with pytest.raises(ValueError, match="1 pairs"):
        inference.compared(a, b, pairs=pairs.union(spark.createDataFrame([("c", "q")], "pre string, post string")))


def long_cells(s, n):
    return pd.DataFrame([(i, j, s[i, j], n[i, j]) for i in range(s.shape[0]) for j in range(s.shape[1])], columns=["subject", "item", "successes", "trials"])


def test_steps_stay_at_the_fit(spark):
    _, _, _, s, n = simulated(12, 6)
    whole = kernels.fit(s, n, normalize=False)
    params = spark.createDataFrame([(k, float(whole["a"][k]), float(whole["d"][k])) for k in range(6)], "item long, a double, d double")
    for r in irt.stepped(spark.createDataFrame(long_cells(s, n)), params).collect():
        assert abs(r["a"] - whole["a"][r["item"]]) < 1e-3 and abs(r["d"] - whole["d"][r["item"]]) < 1e-3


def test_ragged_cells_are_refused():
    _, _, _, s, n = simulated(4, 3)
    with pytest.raises(ValueError, match="lacks an item"):
        kernels.matrices(long_cells(s, n).iloc[1:])


def test_report_says_what_a_suite_lacks(spark):
    rng = np.random.default_rng(2)
    noise = spark.createDataFrame([(i, j, float(rng.random()), 3.0) for i in range(6) for j in range(5)], "subject long, item long, rate double, trials double")
    out = one(ctt.report(noise, 10, 40))
    assert not out["above_chance"] and "by chance" in out["notes"] and "too few subjects" in out["notes"]
    good = spark.createDataFrame([(i, j, 1.0 if i >= j else 0.0, 3.0) for i in range(12) for j in range(12)], "subject long, item long, rate double, trials double")
    out = one(ctt.report(good, 10, 40))
    assert out["above_chance"] and out["dead_items"] == [0] and "too few" not in out["notes"]
    assert one(ctt.ladder_recovery(good, good.select("subject", F.col("subject").alias("rung")).distinct()))["tau"] == 1.0
    for wrong, said in ((good.where("subject > 0 or item > 0"), "every item"), (good.union(good.limit(1)), "every item"), (good.where("subject = 1"), "two subjects"), (good.withColumn("rate", F.lit(float("nan"))), "finite")):
        with pytest.raises(ValueError, match=said):
            ctt.report(wrong)


def test_strategies_must_come_out_as_expected(spark):
    rows = [("r1", "gold", True, "resolved"), ("r2", "noop", True, "not resolved"), ("r3", "broken", False, "patch not applied"), ("r4", "regressive", True, "resolved")]
    got = swe.unexpected(spark.createDataFrame(rows, "run string, strategy string, applied boolean, summary string")).collect()
    assert [(r["run"], r["expected"]) for r in got] == [("r4", "regressed")]


def test_dashboard_draws_the_matrix_and_the_headroom(spark):
    from tallywork import report

    standings = spark.createDataFrame([("a<b", 0.5, 0.75, 1.0, 1), ("c", 0.25, None, 0.5, 2)], "subject string, medal_rate double, mean_percentile double, valid_rate double, place int")
    outcomes = spark.createDataFrame([("a<b", "i1", 0, "valid", 0.5, "gold"), ("a<b", "i1", 1, "crash", None, None), ("c", "i2", 0, "oom", None, None)], "subject string, item string, seed int, outcome string, score double, medal string")
    reached = spark.createDataFrame([("a<b", "i1", 0.75, 0.9), ("a<b", "i2", None, 0.8), ("c", "i1", 0.1, 0.9)], "subject string, item string, percentile double, gold double")
    page = report.dashboard(standings, None, "T", outcomes, reached)
    assert page.count("<circle") == 8 and "a&lt;b, i1, seed 0: valid, score 0.5000, gold" in page and "c, i1, seed 1: not run" in page and "a<b" not in page
    assert "i1: beats 75%" in page and "i2: beats" not in page and 'x1="420.0"' in page
    assert "No runs." in report.dashboard(standings, None, "T", outcomes.limit(0)) and "<svg" not in report.dashboard(standings)


def test_results_read_as_lines(spark):
    from tallywork import summaries

    row = "n_units long, difference double, p_value double, ci_low double, ci_high double, significant boolean, underpowered boolean, regression boolean, warnings string"
    made = spark.createDataFrame([(12, -0.25, 0.01, -0.4, -0.1, True, False, True, "fewer than 3 seeds")], row)
    assert one(summaries.compared(made, 0.1))["line"] == "-0.250 [90% interval -0.400 to -0.100], p = 0.0100 over 12 units: a regression (fewer than 3 seeds)"
    assert one(summaries.powered(spark.createDataFrame([(-0.1, 0.75)], "effect double, power double")))["line"] == "effect -0.100: found in 75.0% of experiments"
    assert one(summaries.estimates(spark.createDataFrame([("random", "pirt", 8, 0.0125, 0.05, -0.001)], "selector string, estimator string, k int, mae double, max_error double, bias double")))["line"] == "random of 8, pirt: off by 1.25% on average, 5.00% at worst, bias -0.10%"
    good = spark.createDataFrame([(i, j, 1.0 if i >= j else 0.0, 3.0) for i in range(12) for j in range(12)], "subject long, item long, rate double, trials double")
    assert one(summaries.suites(ctt.report(good, 10, 20)))["line"].startswith("12 items, 12 subjects: reliability 0.9") and "dead: 1" in one(summaries.suites(ctt.report(good, 10, 20)))["line"]
    assert one(summaries.attenuations(irt.attenuated(spark.createDataFrame([("0", 0.5, 0.75, 0.25)], "draw string, slope double, ability_recovery double, difficulty_recovery double"))))["line"] == "slopes come back at 0.500 of their size (sd 0.000), abilities at r = 0.750, difficulties at r = 0.250, over 1 draws"


def test_each_side_of_shared_items_is_distinct_before_they_meet(spark):
    df = spark.createDataFrame([(k % 3, k % 11 == 0) for k in range(100)] + [(7, True), (8, False)], "item int, infra_failure boolean")
    found = runs.shared_items(df.where("item < 8"), df.where("item > 0"))
    assert sorted(r["item"] for r in found.collect()) == [1, 2]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Join") :].count("Aggregate") == 2


def test_digests_give_the_draws_of_single_bits_and_limits(spark):
    import hashlib

    rows = [(g, k, (k * 7919 % 101) / 50 - 1.0) for g, many in ((1, 40), (None, 1500), (3, 17)) for k in range(many)]
    df = spark.createDataFrame(rows, "g int, unit long, diff double")
    known = inference.sized(df, ["g"])
    word = lambda seed, number, k, at, n: int(hashlib.md5(f"{seed}|{number}|{k}".encode()).hexdigest()[at : at + n], 16)
    bit = lambda m, k: 1.0 - 2.0 * (word("s", m // 128, k, m % 128 // 32 * 8, 8) >> m % 32 & 1)
    taken = lambda m, k: float(sum(t <= word("s", m // 8, k, m % 8 * 4, 4) for t in expr.POISSON))
    for n, each, decode, factor in ((300, expr.DIGEST_BITS, expr.signs, bit), (261, expr.WEIGHTS, expr.weights, taken)):
        got = {(r["g"], r["number"]): r for r in inference.drawn(known, ["g"], n, "s", each, decode).collect()}
        assert set(got) == {(g, m) for g in (1, None, 3) for m in range(n)}
        for g, m in ((1, 0), (1, n - 1), (None, 200), (3, 33), (3, 257)):
            units = [(factor(m, k), d) for h, k, d in rows if h == g]
            assert got[g, m]["total"] == pytest.approx(sum(f * d for f, d in units), abs=1e-9) and got[g, m]["weight"] == sum(f for f, _ in units)


def test_a_resampled_row_takes_little_time(spark):
    """20000 units in 2000 draws, which took 54 microseconds for each 8 of them when made in columns one by one."""
    import time

    df = spark.range(20000).select(F.lit(1).alias("k"), F.col("id").alias("unit"), (F.col("id") % 7 - 3.0).alias("diff"))
    inference.bootstrap_ci(df.limit(2000), ["k"], 16).collect()
    began = time.perf_counter()
    inference.bootstrap_ci(df, ["k"], 2000).collect()
    assert time.perf_counter() - began < 25


def test_trials_of_a_cell_are_drawn_in_runs(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(irt, "RUN", 7)
    cells = [(1, 1, 50, 0.4), (1, 2, 7, 0.9), (2, 1, 8, 0.5), (2, 2, 0, 1.0), (3, 1, 1, 1.0), (3, 1, 1, 1.0)]
    got = irt.drawn(spark.createDataFrame(cells, "subject long, item long, trials long, p double").coalesce(1), 2).collect()
    u = lambda fit, s, i, t: int(hashlib.md5(f"attenuation|{fit}|{s}|{i}|{t}".encode()).hexdigest()[:8], 16) / 2**32
    want = [(f, s, i, sum(u(f, s, i, t) < p for t in range(1, n + 1)), n) for f in "01" for s, i, n, p in cells]
    assert sorted(map(tuple, got)) == sorted(want)


def test_attenuation_fits_two_dozen_draws_until_nothing_moves(spark, monkeypatch):
    """The query against the same outcomes fitted by a loop here; three draws of five rounds give other slopes."""
    import hashlib

    from tallywork.plans import measurement

    n, x, w = np.full((6, 8), 12.0), *kernels.quadrature()
    s = np.round(n * kernels.sigmoid(1.5 * (np.linspace(-1.5, 1.5, 6)[:, None] - np.linspace(-1.2, 1.4, 8))))

    def fit(s):
        rate = np.clip(s.sum(0) / n.sum(0), 1e-3, 1 - 1e-3)
        a, d, moved, rounds = np.ones(8), np.log(rate / (1 - rate)), 1.0, 0
        while moved >= 1e-6:
            post, _ = kernels.posterior(s, n, a, d, x, w)
            a2, d2 = kernels.newton(s.T @ post, n.T @ post, x, a, d, steps=1)
            a, d, moved, rounds = a2, d2, max(np.abs(a2 - a).max(), np.abs(d2 - d).max()), rounds + 1
        theta = kernels.posterior(s, n, a, d, x, w)[0] @ x
        mean, sd = theta.mean(), theta.std(ddof=1)
        return a * sd, d + a * mean, (theta - mean) / sd, rounds

    a, d, theta, rounds = fit(s)
    assert rounds > 20
    u = lambda k, i, j, t: int(hashlib.md5(f"attenuation|{k}|{i}|{j}|{t}".encode()).hexdigest()[:8], 16) / 2**32
    p = kernels.sigmoid(theta[:, None] * a + d)
    want = {}
    for k in range(24):
        a1, d1, theta1, _ = fit(np.array([[sum(u(k, i, j, t) < p[i, j] for t in range(1, 13)) for j in range(8)] for i in range(6)], float))
        ok = (np.abs(a) >= kernels.IDENTIFIED) & (np.abs(a1) >= kernels.IDENTIFIED)
        want[str(k)] = (np.polyfit(a[ok], a1[ok], 1)[0], np.corrcoef(theta, theta1)[0, 1], np.corrcoef((d / a)[ok], (d1 / a1)[ok])[0, 1])
    cells = spark.createDataFrame([(i, j, int(s[i, j]), 12) for i in range(6) for j in range(8)], "subject long, item long, successes long, trials long")
    monkeypatch.setattr(measurement.fx, "cells", lambda spark, d: cells)
    got = {r["draw"]: (r["slope"], r["ability_recovery"], r["difficulty_recovery"]) for r in measurement.irt_attenuation(spark, "").collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_fits_to_rest_are_the_same_in_a_task_and_in_rounds(spark):
    rows = [(f, i, j, (7 * i + 5 * j + i * j) % 9 * 40 if f == "x" else max(0, min(400, 200 + 60 * (i - j))), 400) for f, subjects, items in (("x", 3, 3), ("y", 4, 5)) for i in range(subjects) for j in range(items) if (f, i, j) != ("y", 2, 1)]
    rows += [("y", 0, 0, 3, 5), ("y", 9, 9, 0, 0)]
    cells = spark.createDataFrame(rows, "fit_id string, subject long, item long, successes long, trials long")
    tasks, both, plans = (sorted(tuple(r) for r in irt.fitted_to_rest(cells, 1e-2, few).collect()) for few in (5, 3, 0))
    assert len(tasks) == 8 and all(r[-1] for r in tasks)
    for other in (both, plans):
        assert [r[:2] + r[4:] for r in other] == [r[:2] + r[4:] for r in tasks]
        assert all(p[2:4] == pytest.approx(q[2:4], abs=1e-9) for p, q in zip(tasks, other, strict=True))


def test_md5_of_many_texts_at_once_is_that_of_each(monkeypatch):
    import hashlib

    from tallywork.functions import digest

    texts = [f"attenuation|{k % 3}|{k}|".encode() for k in range(30)] + [b"x" * k for k in range(0, 140, 7)] + ["é|".encode(), b""]
    first, last, limit = (np.array([f(k) for k in range(len(texts))]) for f in (lambda k: 1 + 97 * k % 120, lambda k: 97 * k % 120 + 41 * k % 130 - 1, lambda k: k % 11 / 10))
    first[[4, 5, 6]], last[[4, 5, 6]], limit[[7, 8]] = (99990, 999999990, 2**33), (100020, 1000000010, 2**33 + 5), (2.0, -1.0)
    u = lambda text, t: int(hashlib.md5(text + str(t).encode()).hexdigest()[:8], 16) / 2**32
    want = [sum(u(x, t) < p for t in range(f, g + 1)) for x, f, g, p in zip(texts, first, last, limit, strict=True)]
    for together in (7, 16384):
        monkeypatch.setattr(digest, "TOGETHER", together)
        assert digest.below(texts, first, last, limit).tolist() == want
    assert digest.below([], first[:0], last[:0], limit[:0]).tolist() == []
