"""Streams give what the batch gives."""

from pyspark.sql import functions as F

from tallywork.streaming import checkpoints as ck


def run(spark, df, name, mode="append", checkpoint=None):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def events(spark, small):
    raw = spark.readStream.schema(spark.read.parquet(f"{small}/events.parquet").schema).parquet(f"{small}/events.parque[t]")
    return ck.timed(raw, "0 seconds")


def test_tumbling_matches_batch(spark, small, tmp_path):
    got = run(spark, ck.tumbling(events(spark, small)), "tumbled", checkpoint=tmp_path / "c").select("start", "event_type", "n")
    want = ck.tumbling(spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))).select("start", "event_type", "n")
    assert got.exceptAll(want).count() == 0
    assert got.count() >= want.count() - 5  # the last window is still open


def test_sessions_match_batch(spark, small, tmp_path):
    got = run(spark, ck.sessions(events(spark, small)), "sessions", checkpoint=tmp_path / "c")
    want = ck.sessions(spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    assert got.exceptAll(want).count() == 0 and got.count() > 0


def test_state_keeps_changes_only(spark, small, tmp_path):
    stream = events(spark, small).select(F.col("user_id").alias("run"), "ts", F.col("event_type").alias("sha"))
    got = run(spark, ck.changes(stream), "changes", checkpoint=tmp_path / "c")
    batch = spark.read.parquet(f"{small}/events.parquet").select(F.col("user_id").alias("run"), F.col("ts").cast("timestamp").alias("mark"), F.col("event_type").alias("sha"))
    assert got.count() == ck.changed(batch).count()


def test_late_rows_are_left_out_and_old_content_may_come_again(spark, tmp_path):
    import time

    kind = "ts timestamp, event_type string, value double, user_id long, sha string, run string"
    for k, hour in enumerate((0, 5, 5, 0, 9)):  # the fourth file is late
        spark.createDataFrame([(hour, k)], "hour int, k int").selectExpr("timestamp'2024-01-01 00:10:00' + make_interval(0, 0, 0, 0, hour) as ts", "'a' as event_type", "1.0D as value", "1L as user_id", "'same' as sha", "'r' as run").coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
        time.sleep(1.1)
    stream = lambda: ck.timed(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")), "1 hour")
    got = run(spark, ck.tumbling(stream()), "late", checkpoint=tmp_path / "c1")
    assert sorted((r["start"].hour, r["n"]) for r in got.collect()) == [(0, 1), (5, 2)]
    again = run(spark, ck.fresh(stream()).select("run", "ts", "sha"), "again", checkpoint=tmp_path / "c2")
    hours = [r["ts"].hour for r in again.collect()]
    assert hours.count(0) == 1 and 9 in hours and len(hours) < 5  # what the watermark has passed is forgotten


def test_sessions_end_with_their_last_event(spark, small, tmp_path):
    said = F.when(F.col("last") == "error", "crash").otherwise("other")
    got = run(spark, ck.live_outcomes(events(spark, small), said), "outcomes", checkpoint=tmp_path / "c")
    assert {r["outcome"] for r in got.select("outcome").distinct().collect()} == {"crash", "other"}


def test_marks_are_told_by_timers_and_runs_are_forgotten(spark, tmp_path):
    """Three runs in five files, one row late: what the stream tells is what the batch tells without that row, and no state stays."""
    import time

    start = {"a": 0, "b": 600, "end": 90_000}
    rows = [[("a", 100, "x"), ("b", 700, "p")], [("a", 1000, "y"), ("a", 1900, "y"), ("b", 1300, "q")], [("b", 5000, "q"), ("a", 4000, "z")], [("a", 200, "late"), ("b", 9000, "r")], [("end", 120_000, "beyond")]]
    kind = "run string, started timestamp, ts timestamp, sha string"
    for k, part in enumerate(rows):
        df = spark.createDataFrame([(r, start[r], at, sha) for r, at, sha in part], "run string, s long, at long, sha string").selectExpr("run", "timestamp_seconds(s) as started", "timestamp_seconds(at) as ts", "sha")
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
        time.sleep(1.1)
    stream = ck.timed(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")), "10 seconds")
    q = ck.marked(stream, 10_000).writeStream.format("memory").queryName("marked").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {(r["run"], r["mark"]): r["sha"] for r in spark.table("marked").collect()}
    states = spark.createDataFrame([(r, at - start[r], sha) for part in rows for r, at, sha in part if sha not in ("late", "beyond")], "run string, at long, sha string")
    marks = states.select("run").distinct().crossJoin(spark.createDataFrame([(m,) for m in ck.MARKS if m < 10_000], "mark long"))
    assert got == {(r["run"], r["mark"]): r["sha"] for r in ck.changed(ck.as_of(states, marks)).collect()} and len(got) > 3
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
