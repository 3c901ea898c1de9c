"""Outcomes of runs by ordered rules.

Infrastructure signatures are looked for in the harness's own log only, memory signatures in the agent's only; the two
are never joined. The order of the rules decides, not the order of lines in a log.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OUTCOMES = ("valid", "invalid_submission", "no_submission", "timeout", "oom", "crash", "infra")
TIERS = {"valid": "signal", "infra": "excluded"}
AGENT_TIER = "agent"
#: Share of a time cap from which it counts as hit; share of mechanical failures that calls for a warning.
CAP_SHARE, MECHANICAL_SHARE = 0.99, 0.15
TIMEOUT_EXIT, KILLED_EXIT = 124, 137


@dataclass(frozen=True)
class Signature:
    signal: str
    pattern: str
    ambiguous: bool = False


#: What infrastructure failures look like in a harness log, in order of precedence.
INFRA = (
    Signature("spot-interruption", r"""/latest/meta-data/spot/instance-action|"action"\s*:\s*"(?:terminate|stop|hibernate)"|EC2\s+Spot\s+Instance\s+Interruption\s+Warning|Spot\s+ITN\s+received|aws-node-termination-handler/spot-itn"""),
    Signature("gcp-preemption", r"computeMetadata/v1/instance/preempted|\bcompute\.instances\.preempted\b"),
    Signature("preemption", r"Preempted\s+by\s+(?:pod\s+)?\S+\s+on\s+node\s+\S+|preempting\s+to\s+accommodate\s+a\s+higher\s+priority|Pod\s+was\s+terminated\s+in\s+response\s+to\s+imminent\s+node\s+shutdown|\bPreemptionByScheduler\b|\bTerminationByKubelet\b"),
    Signature("node-pressure-eviction", r"The\s+node\s+was\s+low\s+on\s+resource:|The\s+node\s+had\s+condition:|Cannot\s+evict\s+pod\s+as\s+it\s+would\s+violate"),
    Signature("image-pull", r"\bErrImagePull\b|\bImagePullBackOff\b|\bErrImageNeverPull\b|\bInvalidImageName\b|\bImageInspectError\b|Back-off\s+pulling\s+image|Failed\s+to\s+pull\s+image|failed\s+to\s+pull\s+and\s+unpack\s+image|failed\s+to\s+resolve\s+reference|\bmanifest\s+unknown\b|manifest\s+for\s+\S+\s+not\s+found|pull\s+access\s+denied|requested\s+access\s+to\s+the\s+resource\s+is\s+denied|unauthorized:\s*authentication\s+required"),
    Signature("mount", r"""invalid\s+mount\s+config\s+for\s+type\s+"bind"|bind\s+source\s+path\s+does\s+not\s+exist|error\s+while\s+creating\s+mount\s+source\s+path|invalid\s+mount\s+path|error\s+mounting\s+"[^"]*"\s+to\s+rootfs\s+at|\bFailedMount\b|unmounted\s+volumes="""),
    Signature("docker-daemon", r"Cannot\s+connect\s+to\s+the\s+Docker\s+daemon|docker\s+daemon.{0,40}(?:not\s+running|connection\s+refused)|Error\s+response\s+from\s+daemon:"),
    Signature("disk-full", r"No\s+space\s+left\s+on\s+device|\[Errno\s+28\]|\bENOSPC\b|Disk\s+quota\s+exceeded|\bDiskPressure\b", ambiguous=True),
)
#: What running out of memory looks like in an agent's log, in order of precedence.
MEMORY = (
    Signature("cuda-oom", r"CUDA\s+out\s+of\s+memory|torch\.(?:cuda\.)?OutOfMemoryError|CUDA\s+error:\s*out\s+of\s+memory"),
    Signature("tensorflow-oom", r"OOM\s+when\s+allocating\s+tensor|Allocator\s+\([^)]*\)\s+ran\s+out\s+of\s+memory\s+trying\s+to\s+allocate|\bResourceExhaustedError\b", ambiguous=True),
    Signature("host-oom", r"Memory\s+cgroup\s+out\s+of\s+memory|Out\s+of\s+memory(?:\s*\([^)]*\))?:\s*Kill(?:ed)?\s+process\s+\d+|Killed\s+process\s+\d+\s+\([^)]*\)\s+total-vm:|\boom-kill:constraint=|invoked\s+oom-killer:|\bOOMKilled\b"),
)


#: The two logs, and the columns of a table of rules.
HARNESS, AGENT = "harness", "agent"
RULES = "log string, rank int, signal string, pattern string, ambiguous boolean"


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules above as a table, to which a user can add rows."""
    return spark.createDataFrame([(log, k, s.signal, s.pattern, s.ambiguous) for log, signatures in ((HARNESS, INFRA), (AGENT, MEMORY)) for k, s in enumerate(signatures)], RULES)


def signatures(rules: DataFrame, log: str) -> tuple[Signature, ...]:
    """A log's rules in order of rank: a table that a user keeps, not one that grows with the logs."""
    return tuple(Signature(r["signal"], r["pattern"], r["ambiguous"]) for r in rules.where(F.col("log") == log).orderBy("rank", "signal").collect())


#: Characters of a line that are told.
TOLD = 160


def matches(log: Column, rules: tuple[Signature, ...]) -> Column:
    """array of struct(rank, signal, ambiguous, place, line): the rules that match anywhere in a log, with their first place and its line.

    One pattern of all rules goes through a log once; only where it matches is each rule's own place sought.
    """
    any_ = re.compile("|".join(f"(?:{r.pattern})" for r in rules) or r"(?!)", re.IGNORECASE)
    each = [re.compile(r.pattern, re.IGNORECASE) for r in rules]

    def line(text: str, start: int, end: int) -> str:
        stop = text.find("\n", end)
        whole = text[text.rfind("\n", 0, start) + 1 : stop if stop >= 0 else len(text)].strip()
        return whole if len(whole) <= TOLD else whole[: TOLD - 3] + "..."

    @F.pandas_udf("array<struct<rank: int, signal: string, ambiguous: boolean, place: int, line: string>>")
    def search(logs: pd.Series) -> pd.Series:
        return logs.map(lambda t: [{"rank": k, "signal": r.signal, "ambiguous": r.ambiguous, "place": m.start(), "line": line(t, *m.span())} for k, (r, p) in enumerate(zip(rules, each, strict=True)) if (m := p.search(t))] if t and any_.search(t) else [])

    return search(log)


def first_match(log: Column, rules: tuple[Signature, ...]) -> Column:
    """struct(rank, signal, ambiguous, place, line) of the first rule in order that matches anywhere, or null."""
    return F.array_min(matches(log, rules))


def hit_cap(wall: Column, cap: Column) -> Column:
    return F.coalesce(wall >= cap * CAP_SHARE, F.lit(False))


def classified(artifacts: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """artifacts with outcome, signal, detail, ambiguous and truncated. rules (RULES) takes the place of the signatures above.

    Columns: harness_error, harness_log, agent_log, has_submission, submission_rows, validation_error, exit_code,
    wall_clock, time_cap.
    """
    infra, memory = (INFRA, MEMORY) if rules is None else (signatures(rules, HARNESS), signatures(rules, AGENT))
    found = artifacts.withColumns({"_infra": first_match(F.col("harness_log"), infra), "_memory": first_match(F.col("agent_log"), memory)})
    capped = hit_cap(F.col("wall_clock"), F.col("time_cap"))
    submitted = F.col("has_submission") & F.col("validation_error").isNull()
    code = F.col("exit_code")
    none = F.lit(None).cast("string")

    def is_(outcome: str, signal=none, detail=none, ambiguous=F.lit(False), truncated=F.lit(False)) -> Column:
        return F.struct(F.lit(outcome).alias("outcome"), (F.lit(signal) if isinstance(signal, str) else signal).alias("signal"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"), ambiguous.alias("ambiguous"), truncated.alias("truncated"))

    clock = F.concat(F.format_string("%.0f", "wall_clock"), F.lit("s of "), F.format_string("%.0f", "time_cap"), F.lit("s cap"))
    verdict = (
        F.when(F.col("harness_error").isNotNull(), is_("infra", "harness-error", F.col("harness_error")))
        .when(F.col("_infra").isNotNull(), is_("infra", F.col("_infra.signal"), F.col("_infra.line"), F.col("_infra.ambiguous")))
        .when(submitted & (F.col("submission_rows") == 0), is_("invalid_submission", "empty-submission", "no rows"))
        .when(submitted, is_("valid", truncated=capped | (code != 0)))
        .when(F.col("validation_error").isNotNull(), is_("invalid_submission", "grader-rejected", F.col("validation_error")))
        .when(capped, is_("timeout", "wall-clock", clock))
        .when(F.col("_memory").isNotNull(), is_("oom", F.col("_memory.signal"), F.col("_memory.line"), F.col("_memory.ambiguous")))
        .when(code == TIMEOUT_EXIT, is_("timeout", "exit-code", f"exit {TIMEOUT_EXIT}"))
        .when(code == KILLED_EXIT, is_("oom", "exit-code", f"exit {KILLED_EXIT}", ambiguous=F.lit(True)))
        .when(code != 0, is_("crash", "exit-code", F.concat(F.lit("exit "), code.cast("string"))))
        .otherwise(is_("no_submission", "clean-exit", "exit 0 without a submission"))
    )
    return found.withColumn("_v", verdict).select(*artifacts.columns, "_v.*")


def tier(outcome: Column) -> Column:
    out = F.lit(AGENT_TIER)
    for k, v in TIERS.items():
        out = F.when(outcome == k, v).otherwise(out)
    return out


def attributable(outcome: Column) -> Column:
    """Whether the agent brought the outcome about by failing."""
    return ~outcome.isin("valid", "infra")


def counts(triaged: DataFrame) -> DataFrame:
    """outcome, n in fixed order, zeros included."""
    spark = triaged.sparkSession
    all_ = spark.createDataFrame(list(enumerate(OUTCOMES)), "ord int, outcome string")
    return all_.join(triaged.groupBy("outcome").count(), "outcome", "left").select("ord", "outcome", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def shares(triaged: DataFrame, keys: list[str]) -> DataFrame:
    """By keys: runs, gradeable, infra, valid and mechanical shares, and whether mechanical failures call for a warning."""
    o = F.col("outcome")
    mechanical = F.avg(attributable(o).cast("double"))
    return triaged.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(o != "infra").alias("gradeable"), F.count_if(o == "infra").alias("infra"), F.avg((o == "valid").cast("double")).alias("valid_rate"), mechanical.alias("mechanical_rate"), (mechanical > MECHANICAL_SHARE).alias("warning"))


def isolation(triaged: DataFrame, keys: list[str]) -> DataFrame:
    kinds = F.count_distinct("isolation")
    return triaged.groupBy(*keys).agg(F.when(kinds == 0, "unknown").when(kinds == 1, F.first("isolation", ignorenulls=True)).otherwise("mixed").alias("isolation"))


def retryable(triaged: DataFrame) -> DataFrame:
    return triaged.where("outcome = 'infra'")


class RetryNotAllowed(ValueError):
    """The run ended for a reason that is its own."""


def only_outcome(triaged: DataFrame, keys: list[str]) -> DataFrame:
    """keys, outcome: the one outcome that all runs of a group have, null where they have several."""
    both = F.array_distinct(F.array(F.min("outcome"), F.max("outcome")))
    return triaged.groupBy(*keys).agg(F.when(F.size(both) == 1, both[0]).alias("outcome"))


def assert_retry_allowed(triaged: DataFrame, run: str) -> None:
    row = triaged.where(F.col("run") == run).select("outcome").first()
    if row is None or row["outcome"] != "infra":
        raise RetryNotAllowed(f"{run}: {row['outcome'] if row else 'unknown'}")


def headroom(triaged: DataFrame) -> DataFrame:
    """max_time (5 % above the longest run, 1 if none), time_cap and cap_headroom in one row."""
    longest, cap = F.max(F.when(F.col("wall_clock") > 0, F.col("wall_clock"))), F.max(F.when(F.col("time_cap") > 0, F.col("time_cap")))
    return triaged.agg(F.coalesce(longest * 1.05, F.lit(1.0)).alias("max_time"), cap.alias("time_cap"), (longest / cap).alias("cap_headroom"))


def one_outcome(triaged: DataFrame, keys: list[str]) -> DataFrame:
    """keys, is_one and least: whether all runs of a key ended alike, and the first outcome by name."""
    return triaged.groupBy(*keys).agg((F.min("outcome") == F.max("outcome")).alias("is_one"), F.min("outcome").alias("least"))
