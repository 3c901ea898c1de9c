"""Commands over run directories, run sets and matrices: python -m tallywork.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallywork import report
from tallywork.operators import ctt, features, grading, inference, irt, runs, skills, subset, swe, triage
from tallywork.sources import files, sinks


def show(df) -> None:
    for line in sinks.as_documents(df).collect():
        print(line["value"])


def compare(spark, a) -> int:
    sets = [files.run_sets(spark, p) for p in (a.before, a.after)]
    sides = [runs.rate_by_item(s, []) for s in sets]
    lost = sets[0].union(sets[1]).where("infra_failure").count()
    pair = files.run_sets(spark, a.before).select(F.col("fingerprint").alias("a")).limit(1).crossJoin(files.run_sets(spark, a.after).select(F.col("fingerprint").alias("b")).limit(1))
    runs.assert_comparable(pair, allow_mismatch=a.allow_mismatch or bool(a.pairs))
    out = inference.compared(*sides, alpha=a.alpha, pairs=files.pairs(spark, a.pairs).select("pre", "post") if a.pairs else None, infra_failures=lost)
    show(out)
    return int(bool(out.first()["regression"]))


def do_triage(spark, a) -> int:
    found = triage.classified(files.run_directories(spark, a.path))
    show(found.select("run", "outcome", "signal", "detail", "ambiguous", "truncated") if a.runs else triage.counts(found).orderBy("ord"))
    return 0


def do_report(spark, a) -> int:
    with open(a.out, "w", encoding="utf-8") as f:
        f.write(report.report(triage.classified(files.run_directories(spark, a.path)), a.title))
    return 0


def dashboard(spark, a) -> int:
    found = triage.classified(files.session(spark, a.path)).withColumn("subject", F.col("agent"))
    shares = triage.shares(found, ["subject"]).select("subject", "valid_rate")
    rates = files.grades(spark, a.path).groupBy("agent", "item").agg(F.avg(F.col("medal").cast("double")).alias("r"), F.avg("score").alias("s")).groupBy(F.col("agent").alias("subject")).agg(F.avg("r").alias("medal_rate"), F.avg("s").alias("mean_percentile"))
    per = shares.join(rates, "subject", "left").withColumn("medal_rate", F.coalesce("medal_rate", F.lit(0.0)))
    graded = files.grades(spark, a.path).select(F.col("agent").alias("subject"), "item", "seed", "score", F.when(F.col("medal"), "medal").alias("medal"))
    with open(a.out, "w", encoding="utf-8") as f:
        f.write(report.dashboard(runs.standings(per), None, a.title, runs.session_outcomes(found, graded)))
    return 0


def cells(spark, a):
    return files.matrix(spark, a.path).select("subject", "item", "rate", F.lit(a.trials).cast("double").alias("trials"), F.round(F.col("rate") * a.trials).alias("successes"))


def numbered(df):
    """Cells with subjects and items as numbers in order of their names, as the kernels want them."""
    from pyspark.sql import Window

    place = lambda c: df.select(c).distinct().select(c, (F.row_number().over(Window.orderBy(c)) - 1).cast("long").alias("no"))
    s, i = place("subject"), place("item")
    return df.join(s, "subject").drop("subject").withColumnRenamed("no", "subject").join(i, "item").drop("item").withColumnRenamed("no", "item").select("subject", "item", "rate", "trials", "successes"), i


def instrument(spark, a) -> int:
    c = cells(spark, a)
    show(ctt.report(c))
    show(ctt.item_stats(c).orderBy("item_rest", "item"))
    return 0


def do_irt(spark, a) -> int:
    c, names = numbered(cells(spark, a))
    items = irt.fitted(c.withColumn("fit_id", F.lit("all")))
    show(items.join(names.withColumnRenamed("item", "name"), items.item == F.col("no")).select("name", "a", "b", "identified", "extrapolated").orderBy("b"))
    show(irt.marginal_reliability(irt.curves(items, irt.grid(spark, -6.0, 6.0, 241), a.trials)))
    return 0


def anchor(spark, a) -> int:
    show(subset.summary(subset.errors(numbered(cells(spark, a))[0], tuple(a.k), rounds=a.rounds)))
    return 0


def power(spark, a) -> int:
    pool = inference.beta_pool(spark, a.base_rate, a.heterogeneity)
    design = inference.DESIGNS[a.design] if a.design else inference.Design(a.units, a.seeds)
    effects = spark.createDataFrame([(float(e),) for e in a.effects], "effect double")
    show(inference.power(pool, effects, design, a.sims).orderBy("effect"))
    found = {way: inference.detectable_effect(pool, design, a.sims, way, a.target, tolerance=a.tolerance) for way in ("decrease", "increase")}
    print(json.dumps({"detectable": found, "runs": design.runs, "price": design.price}))
    return 0


def seeds(spark, a) -> int:
    plans = spark.range(1, a.most + 1).select(F.lit(a.effect).alias("effect"), F.col("id").alias("seeds"))
    powers = inference.power(inference.beta_pool(spark, a.base_rate, a.heterogeneity), plans, inference.Design(a.units, 1), a.sims)
    found = inference.seeds_needed(powers, a.target).first()["seeds"]
    print("none" if found is None else found)
    return int(found is None)


def grade(spark, a) -> int:
    """Grades the submissions of a list against tasks below a folder and writes reports and medals; a run is named by its file."""
    root = a.data.rstrip("/")
    listed = files.submissions_jsonl(spark, a.submissions).select(F.col("competition_id").alias("task"), F.coalesce("seed", F.lit(0)).alias("seed"), F.regexp_replace("submission_path", r"^(?:file:)?/+", "").alias("run"), "submission_path")
    answers = files.answers(spark, f"{root}/*/prepared/private/answers.json", r"/([^/]+)/prepared/private/[^/]+$")
    known = listed.join(files.task_specs(spark, f"{root}/*/competition.json").withColumnRenamed("competition_id", "task"), "task")
    kinds = [(r["metric"], bool(r["is_lower_better"]), r["id_column"] or "id", r["target_column"] or "target") for r in known.select("metric", "is_lower_better", "id_column", "target_column").distinct().collect()]
    graded = None
    for metric, lower, id_column, target_column in kinds:  # tasks of one metric and header are graded in one plan
        of_kind = known.where((F.col("metric") == metric) & (F.coalesce("is_lower_better", F.lit(False)) == lower) & (F.coalesce("id_column", F.lit("id")) == id_column) & (F.coalesce("target_column", F.lit("target")) == target_column))
        paths = [r["submission_path"] for r in of_kind.select("submission_path").distinct().collect()]
        rows = files.submission(spark, files.any_of(spark, paths), id_column, target_column, r"^(?:file:/+)?(.*)$").join(of_kind.select("run", "task"), "run")
        scores = of_kind.select("run", "task", "seed").join(grading.graded(rows, answers, metric).drop("task"), "run", "left").withColumn("error", F.coalesce("error", F.when(F.col("score").isNull(), "no file")))
        limits = of_kind.select("task", "thresholds.*").drop("n_teams").distinct()
        part = grading.awarded(scores, limits, ["task"], not lower)
        graded = part if graded is None else graded.unionByName(part)
    if graded is None:
        print("no submission of a known task")
        return 2
    out = graded.select(F.col("task").alias("item"), "seed", "score", F.col("any_medal").alias("medal"), F.col("medal").alias("award"), "error")
    sinks.as_documents(out).write.mode("errorifexists").text(f"{a.out}/reports")
    sinks.as_documents(sinks.grading_summary(out)).write.mode("errorifexists").text(f"{a.out}/summary")
    show(out.orderBy("item", "seed"))
    return 0


def do_skills(spark, a) -> int:
    """pairs: a CSV of agent, challenge, unit, control and challenged; an empty score is a failed run."""
    found = skills.cells(spark.read.option("header", True).schema("agent string, challenge string, unit string, control double, challenged double").csv(a.pairs), a.alpha)
    show(found.orderBy("agent", "challenge"))
    show(skills.robustness(found).orderBy("agent"))
    show(skills.dominant(found).withColumnRenamed("agent", "dominant"))
    return 0


def probe(spark, a) -> int:
    """rows: JSON lines of agent, item, is_clone, transform, percentile, medal, valid and recalled; deltas: of transform and delta."""
    rows = spark.read.schema("agent string, item string, is_clone boolean, transform string, percentile double, medal boolean, valid boolean, recalled boolean").json(a.rows)
    deltas = spark.read.schema("transform string, delta double").json(a.deltas)
    for transform in ("relabel", "rescale"):
        show(skills.probe_gap(rows, transform).withColumn("transform", F.lit(transform)).orderBy("agent"))
    battery = skills.controls(rows, deltas, a.honest, a.memoriser, most_delta=a.max_delta)
    show(battery)
    return int(battery.where("not passed").limit(1).count())


def conform(spark, a) -> int:
    """ours, theirs: JSON lines of run and score."""
    sides = [spark.read.schema("run string, score double").json(p) for p in (a.ours, a.theirs)]
    out = grading.agreement(*sides, a.tolerance)
    show(out.orderBy("run"))
    return int(out.where("not agree").limit(1).count())


def swe_conform(spark, a) -> int:
    """ours, theirs: JSON lines of run, four lists of tests and resolved."""
    lists = ", ".join(f"{k}_{v} array<string>" for k in ("f2p", "p2p") for v in ("success", "failure"))
    out = swe.agreement(*[spark.read.schema(f"run string, {lists}, resolved boolean").json(p) for p in (a.ours, a.theirs)])
    show(out.orderBy("run"))
    return int(out.where("not agree").limit(1).count())


def bench(spark, a) -> int:
    spec = features.TaskSpec(a.task, kind=a.kind, difficulty=a.difficulty, pathologies=tuple(a.pathology))
    task = features.generated(spark, spec)
    sinks.write_csv(task.where("part = 'train'").drop("part"), f"{a.out}/train")
    sinks.write_csv(task.where("part = 'test'").drop("part", "target"), f"{a.out}/test")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallywork", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, run, *args):
        c = sub.add_parser(name)
        for flags, kw in args:
            c.add_argument(*flags, **kw)
        c.set_defaults(run=run)

    path, trials = (["path"], {}), (["--trials"], {"type": int, "default": 3})
    add("compare", compare, (["before"], {}), (["after"], {}), (["--alpha"], {"type": float, "default": 0.05}), (["--allow-mismatch"], {"action": "store_true"}), (["--pairs"], {}))
    add("triage", do_triage, path, (["--runs"], {"action": "store_true"}))
    add("report", do_report, path, (["out"], {}), (["--title"], {"default": "Runs"}))
    add("dashboard", dashboard, path, (["out"], {}), (["--title"], {"default": "Agents"}))
    add("instrument", instrument, path, trials)
    add("irt", do_irt, path, trials)
    add("anchor", anchor, path, trials, (["--k"], {"type": int, "nargs": "+", "default": [5, 10]}), (["--rounds"], {"type": int, "default": 40}))
    base, sims, spread = (["--base-rate"], {"type": float, "default": 0.17}), (["--sims"], {"type": int, "default": 500}), (["--heterogeneity"], {"type": float, "default": 0.5})
    target = (["--target"], {"type": float, "default": 0.8})
    add("power", power, (["--design"], {"choices": sorted(inference.DESIGNS)}), (["--units"], {"type": int, "default": 22}), (["--seeds"], {"type": int, "default": 3}), (["--effects"], {"type": float, "nargs": "+", "default": [-0.05, -0.1, -0.15, -0.2, -0.3, -0.4, -0.55]}), (["--tolerance"], {"type": float, "default": 0.005}), target, base, spread, sims)
    add("seeds", seeds, (["--units"], {"type": int, "default": 22}), (["--effect"], {"type": float, "required": True}), (["--most"], {"type": int, "default": 12}), target, base, spread, sims)
    add("grade", grade, (["submissions"], {}), (["data"], {}), (["out"], {}))
    add("skills", do_skills, (["pairs"], {}), (["--alpha"], {"type": float, "default": 0.05}))
    add("probe", probe, (["rows"], {}), (["deltas"], {}), (["--honest"], {"default": "honest"}), (["--memoriser"], {"default": "memorizer"}), (["--max-delta"], {"type": float, "default": 0.005}))
    graders = ((["ours"], {}), (["theirs"], {}))
    add("conform", conform, *graders, (["--tolerance"], {"type": float, "default": 1e-5}))
    add("swe-conform", swe_conform, *graders)
    add("bench", bench, (["task"], {}), (["out"], {}), (["--kind"], {"default": "binary"}), (["--difficulty"], {"type": float, "default": 0.3}), (["--pathology"], {"nargs": "*", "default": []}))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"tallywork {a.command}").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    return a.run(spark, a)


if __name__ == "__main__":
    sys.exit(main())
