"""Test logs to resolutions: statuses, expected tests, before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Markers in a log.
START, END, NO_PATCH = ">>>>> Start Test Output", ">>>>> End Test Output", ">>>>> Patch Apply Failed"
STATUS = r"(?m)^(PASSED|FAILED|ERROR|SKIPPED|XFAIL|XPASS)\s+(\S+)"


def has_output(log: Column) -> Column:
    return log.contains(START) & log.contains(END)


def body(log: Column) -> Column:
    """What stands between the markers if both are there, else all."""
    return F.when(has_output(log), F.split_part(F.substr(log, F.instr(log, START) + len(START)), F.lit(END), F.lit(1))).otherwise(log)


def statuses(logs: DataFrame) -> DataFrame:
    """run, test, status: the last status of each test; an unexpected pass counts as an expected failure."""
    text = body(F.col("log"))
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(STATUS), F.lit(1)).alias("s"), F.regexp_extract_all(text, F.lit(STATUS), F.lit(2)).alias("t"))
    rows = logs.select("run", F.posexplode(both).alias("pos", "x")).select("run", "pos", F.col("x.s").alias("status"), F.col("x.t").alias("test"))
    return rows.groupBy("run", "test").agg(F.max_by(F.when(F.col("status") == "XPASS", "XFAIL").otherwise(F.col("status")), "pos").alias("status"))


def resolved(logs: DataFrame, expected: DataFrame) -> DataFrame:
    """run, applied, four sorted lists of tests, resolved, regressed and a summary. expected: run, test, kind (f2p, p2p).

    A test that the log doesn't name has failed. Without both markers, or where the patch didn't apply, nothing ran.
    """
    ran = logs.select("run", (has_output(F.col("log")) & ~F.col("log").contains(NO_PATCH)).alias("applied"))
    met = expected.join(ran.where("applied").select("run"), "run", "left_semi").join(statuses(logs), ["run", "test"], "left").withColumn("ok", F.coalesce(F.col("status") == "PASSED", F.lit(False)))
    pick = lambda kind, ok: F.sort_array(F.collect_list(F.when((F.col("kind") == kind) & (F.col("ok") == ok), F.col("test"))))
    sets = met.groupBy("run").agg(pick("f2p", True).alias("f2p_success"), pick("f2p", False).alias("f2p_failure"), pick("p2p", True).alias("p2p_success"), pick("p2p", False).alias("p2p_failure"))
    out = ran.join(sets, "run", "left")
    none = lambda c: F.coalesce(F.size(c) == 0, F.lit(True))
    good = F.col("applied") & none("f2p_failure") & none("p2p_failure")
    regressed = F.col("applied") & ~none("p2p_failure") & none("f2p_failure")
    said = F.when(~F.col("applied"), "patch not applied").when(good, "resolved").when(regressed, "regressed").otherwise("not resolved")
    return out.select("run", "applied", "f2p_success", "f2p_failure", "p2p_success", "p2p_failure", good.alias("resolved"), regressed.alias("regressed"), said.alias("summary"))


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """run, test, kind: f2p (now passes), p2p (still passes), regressed (passed, doesn't now), other. A test absent hasn't passed."""
    both = before.withColumnRenamed("status", "b").join(after.withColumnRenamed("status", "a"), ["run", "test"], "full_outer")
    b, a = F.coalesce(F.col("b") == "PASSED", F.lit(False)), F.coalesce(F.col("a") == "PASSED", F.lit(False))
    return both.select("run", "test", F.when(~b & a, "f2p").when(b & a, "p2p").when(b & ~a, "regressed").otherwise("other").alias("kind"))


#: The five ways to answer an instance, whether the patch applies, and the verdict.
EXPECTED = (("gold", True, "resolved"), ("noop", True, "not resolved"), ("regressive", True, "regressed"), ("broken", False, "patch not applied"), ("irrelevant", True, "not resolved"))


def unexpected(reports: DataFrame) -> DataFrame:
    """run, strategy, summary, expected: graded runs (run, strategy, applied, summary) that came out otherwise than their strategy must."""
    want = reports.sparkSession.createDataFrame(list(EXPECTED), "strategy string, should_apply boolean, expected string")
    both = reports.join(want, "strategy")
    return both.where(~(F.col("summary").eqNullSafe(F.col("expected")) & F.col("applied").eqNullSafe(F.col("should_apply")))).select("run", "strategy", "summary", "expected")


def valid_instances(found: DataFrame) -> DataFrame:
    """run, valid: an instance needs a test that it fixes and none that it breaks."""
    return found.groupBy("run").agg(F.count_if(F.col("kind") == "f2p").alias("n_f2p"), F.count_if(F.col("kind") == "regressed").alias("n_regressed")).withColumn("valid", (F.col("n_f2p") > 0) & (F.col("n_regressed") == 0))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """run, agree: two graders' four lists and verdicts are the same."""
    names = ["f2p_success", "f2p_failure", "p2p_success", "p2p_failure"]
    both = a.alias("a").join(b.alias("b"), "run", "full_outer")
    same = F.col("a.resolved").eqNullSafe(F.col("b.resolved"))
    for n in names:
        same = same & (F.size(F.array_except(f"a.{n}", f"b.{n}")) == 0) & (F.size(F.array_except(f"b.{n}", f"a.{n}")) == 0)
    return both.select("run", F.coalesce(same, F.lit(False)).alias("agree"))
