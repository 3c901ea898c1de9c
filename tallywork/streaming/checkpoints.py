"""Checkpoints of running evaluations: as-of marks and unchanged snapshots in batch, windows and state in streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Default marks in seconds, doubling from a quarter of an hour up to a day.
MARKS = (900, 1800, 3600, 7200, 14400, 28800, 57600, 86400)


def as_of(states: DataFrame, marks: DataFrame) -> DataFrame:
    """run, mark, sha: the last state (run, at, sha) at or before each mark (run, mark); runs without one are absent.

    States and marks are one sorted series by run, and the last state is carried forward to the marks.
    """
    both = states.select("run", "at", F.lit(0).alias("kind"), "sha").unionByName(marks.select("run", F.col("mark").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("sha")))
    w = Window.partitionBy("run").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("known", F.last("sha", ignorenulls=True).over(w)).where("kind = 1 and known is not null").select("run", F.col("at").alias("mark"), F.col("known").alias("sha"))


def changed(snapshots: DataFrame, by: str = "mark") -> DataFrame:
    """Snapshots whose content differs from the run's one before."""
    w = Window.partitionBy("run").orderBy(by)
    return snapshots.withColumn("was", F.lag("sha").over(w)).where("was is null or was <> sha").drop("was")


def last_changes(snapshots: DataFrame, limit: int = 30) -> DataFrame:
    """The runs that changed last: run, last, n, latest first; ties by run."""
    return snapshots.groupBy("run").agg(F.max("mark").alias("last"), F.count("*").alias("n")).orderBy(F.desc("last"), "run").limit(limit)


def newest(files: DataFrame) -> DataFrame:
    """run, path of the newest file that isn't empty; ties by path."""
    return files.where("length > 0").groupBy("run").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def timed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """events with ts as a TIMESTAMP under a watermark; in batch the watermark is without effect."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, size: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def fresh(checkpoints: DataFrame) -> DataFrame:
    """A stream of checkpoints (run, ts, sha) without repeats of a content within the watermark."""
    return checkpoints.dropDuplicatesWithinWatermark(["run", "sha"])


class LastChange(StatefulProcessor):
    """Passes on a run's checkpoint only where its content changed; the state is the last content and its time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sha string, at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values("ts")
        sha, out = (self.last.get()[0] if self.last.exists() else None), []
        for r in got.itertuples():
            if r.sha != sha:
                sha = r.sha
                out.append((key[0], r.ts, r.sha))
        if out:
            self.last.update((sha, out[-1][1].to_pydatetime()))
        yield pd.DataFrame(out, columns=["run", "ts", "sha"])

    def close(self) -> None:
        pass


def changes(stream: DataFrame) -> DataFrame:
    """run, ts, sha of a stream of checkpoints, kept where the content changed. Needs the RocksDB state store."""
    return stream.select(F.col("run").cast("string").alias("run"), "ts", "sha").groupBy("run").transformWithStateInPandas(LastChange(), "run string, ts timestamp, sha string", "Append", "None")


class MarkedStates(StatefulProcessor):
    """A run's content as of each mark, told when the watermark passes the mark and only where it changed.

    A run keeps the checkpoints since its last mark and one before it, the content told last and the number of its next mark,
    for which a timer in event time is set. After its last mark a run has no state; checkpoints beyond that mark are left out.
    """

    def __init__(self, marks: tuple[int, ...]) -> None:
        self.marks = marks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, sha string")
        self.known = handle.getValueState("known", "started long, place int, sha string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows))
        started = int(got["started"].min().timestamp() * 1000)
        if self.known.exists():
            started = self.known.get()[0]
        at = [int(t.timestamp() * 1000) for t in got["ts"]]
        new = [(t, sha) for t, sha in zip(at, got["sha"], strict=True) if t <= started + 1000 * self.marks[-1]]
        if new:
            self.waiting.appendList(new)
            if not self.known.exists():
                self.known.update((started, 0, None))
                self.handle.registerTimer(started + 1000 * self.marks[0])
        yield pd.DataFrame({"run": [], "mark": [], "sha": []}).astype({"run": str, "mark": "int64", "sha": str})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        started, place, told = self.known.get()
        rows = sorted((r[0], r[1]) for r in self.waiting.get())
        past, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        sha = past[-1][1] if past else None
        out = [(key[0], self.marks[place], sha)] if past and sha != told else []
        if place + 1 < len(self.marks):
            self.waiting.put([*past[-1:], *later])
            self.known.update((started, place + 1, sha if past else told))
            self.handle.registerTimer(started + 1000 * self.marks[place + 1])
        else:
            self.waiting.clear()
            self.known.clear()
        yield pd.DataFrame(out, columns=["run", "mark", "sha"]).astype({"mark": "int64"})

    def close(self) -> None:
        pass


def marked(stream: DataFrame, cap: int | None = None, marks: tuple[int, ...] = MARKS) -> DataFrame:
    """run, mark (seconds since its start), sha of a stream (run, started, ts, sha) under a watermark on ts.

    Marks are those below cap, a run's time limit, if there is one. What it gives is changed(as_of(...)) of the rows that
    weren't late. Needs the RocksDB state store.
    """
    use = tuple(m for m in sorted(marks) if cap is None or m < cap)
    if not use or use[0] <= 0:
        raise ValueError("marks lie after a run's start and before its cap")
    rows = stream.select(F.col("run").cast("string").alias("run"), "started", "ts", "sha")
    return rows.groupBy("run").transformWithStateInPandas(MarkedStates(use), "run string, mark long, sha string", "Append", "EventTime")


def live_outcomes(stream: DataFrame, outcome: Column, gap: str = "30 minutes") -> DataFrame:
    """user_id, start, end, n, outcome of a stream of events: a session is over after a gap, and outcome says what its last event type means.

    outcome is an expression over last, the type of the session's latest event.
    """
    s = stream.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.max_by("event_type", "ts").alias("last"), F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", outcome.alias("outcome"))
