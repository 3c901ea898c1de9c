"""Files in, tables out, and back."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from tallywork.operators import triage
from tallywork.sources import files, sinks


def run(root, name, meta=None, submission=None, logs=()):
    d = root / name
    (d / "logs").mkdir(parents=True)
    (d / "submission").mkdir()
    if meta is not None:
        (d / "metadata.json").write_text(meta if isinstance(meta, str) else json.dumps(meta))
    if submission is not None:
        (d / "submission" / "submission.csv").write_text(submission)
    for k, v in logs:
        (d / "logs" / k).write_bytes(v)


def test_run_directories(spark, tmp_path):
    run(tmp_path, "c__seed1", {"competition_id": "c", "seed": 1, "exit_code": 0, "unknown": 5}, "id,y\n1,2\n2,3\n", [("agent.log", b"\xffok"), ("harness.log", b"fine")])
    run(tmp_path, "d__seed2", "{broken", None, [("agent.log", b"Spot ITN received")])
    run(tmp_path, "e__seed0", {"seed": 0, "exit_code": 3}, None, [("harness.log", b"Spot ITN received")])
    rows = {r["run"]: r for r in triage.classified(files.run_directories(spark, str(tmp_path))).collect()}
    assert rows["c__seed1"]["outcome"] == "valid" and rows["c__seed1"]["submission_rows"] == 2 and rows["c__seed1"]["agent_log"].endswith("ok")
    assert rows["d__seed2"]["item"] == "d" and rows["d__seed2"]["outcome"] == "no_submission"
    assert rows["e__seed0"]["outcome"] == "infra"


def test_run_sets(spark, tmp_path):
    doc = {"fingerprint": {"split_id": "s"}, "runs": [{"competition_id": "a", "any_medal": True, "medal": False}, {"competition_id": "b", "seed": 2, "infra_failure": True}]}
    (tmp_path / "mine.json").write_text(json.dumps(doc))
    rows = {r["item"]: r for r in files.run_sets(spark, str(tmp_path / "mine.json")).collect()}
    assert rows["a"]["medal"] and rows["a"]["seed"] == 0 and rows["a"]["run_set"] == "mine" and rows["b"]["infra_failure"]
    assert rows["a"]["fingerprint"]["container_config"] == "default"
    (tmp_path / "bad.json").write_text(json.dumps({"fingerprint": {}, "runs": [{"competition_id": "a"}]}))
    with pytest.raises(Exception, match="split_id"):
        files.run_sets(spark, str(tmp_path / "bad.json")).collect()


def test_small_files(spark, tmp_path):
    (tmp_path / "pairs.json").write_text('[["a", "b"], ["c", "d"]]')
    assert [(r["pre"], r["post"]) for r in files.pairs(spark, str(tmp_path / "pairs.json")).orderBy("place").collect()] == [("a", "b"), ("c", "d")]
    (tmp_path / "none.json").write_text("[]")
    with pytest.raises(ValueError):
        files.pairs(spark, str(tmp_path / "none.json"))
    (tmp_path / "subs.jsonl").write_text('# note\n\n{"competition_id": "a", "seed": 1, "submission_path": "x.csv"}\n// more\n')
    assert files.submissions_jsonl(spark, str(tmp_path / "subs.jsonl")).count() == 1
    (tmp_path / "m.csv").write_text("who,i1,i2\na,0.5,1\nb,0.25,0\n")
    assert files.matrix(spark, str(tmp_path / "m.csv")).count() == 4
    (tmp_path / "names.txt").write_text("a\n\n# b\n c \n")
    assert {r["name"] for r in files.names(spark, str(tmp_path / "names.txt")).collect()} == {"a", "c"}
    (tmp_path / "sub.csv").write_text('id,y\n"1",0.5\n2,x\n')
    assert [(r["line_no"], r["id"], r["raw"]) for r in files.submission(spark, str(tmp_path / "sub.csv"), "id", "y").orderBy("line_no").collect()] == [(2, "1", "0.5"), (3, "2", "x")]
    assert files.submission(spark, str(tmp_path / "sub.csv"), "id", "z").first()["line_no"] == 1


def test_quoted_fields_of_submissions(spark, tmp_path):
    cells = [["y", "x", "id"], ["0.5", "", "a,b"], ["1", 'say "hi"', "line\none"], ["", "long " * 5000, '"'], ["2", "x,y\r\nz", ""]]
    with (tmp_path / "q.csv").open("w", newline="") as out:
        csv.writer(out).writerows(cells)
    got = files.submission(spark, str(tmp_path / "q.csv"), "id", "y").orderBy("line_no").collect()
    with (tmp_path / "q.csv").open(newline="") as back:
        want = [(k + 1, r[2].replace("\r\n", "\n"), r[0]) for k, r in enumerate(csv.reader(back)) if k]
    assert [(r["line_no"], r["id"], r["raw"]) for r in got] == want and got[0]["run"] == "q.csv"
    (tmp_path / "empty.csv").write_text("\n")
    assert [r["line_no"] for r in files.submission(spark, str(tmp_path / "empty.csv"), "id", "y").collect()] == [1]


def test_round_trip_of_a_run_set(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, True, False), ("b", 1, False, True)], "item string, seed int, medal boolean, infra_failure boolean")
    (tmp_path / "r.json").write_text(sinks.run_set_document(rows, "mine", "s", "docker").first()["value"])
    back = files.run_sets(spark, str(tmp_path / "r.json")).select("item", "seed", "medal", "infra_failure")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_six_decimals_and_no_overwriting(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.1234567)], "id int, y double")
    sinks.write_csv(rows, str(tmp_path / "out"))
    lines = [x.read_text().splitlines() for x in (tmp_path / "out").glob("part-*.csv")]
    assert ["id,y", "1,0.123457"] in lines and all(x[:1] == ["id,y"] for x in lines)
    with pytest.raises(Exception):
        sinks.write_csv(rows, str(tmp_path / "out"))


SUBMISSIONS = "competition_id string, seed int, submission_path string, has_submission boolean"


def test_submissions_are_read_once_and_counted_as_they_are_written(spark, tmp_path, monkeypatch):
    rows, read = [("a", k, f"s/{k}.csv", k % 3 > 0) for k in range(60)], spark.sparkContext.accumulator(0)
    counted = spark.sparkContext.parallelize(rows, 4).map(lambda r: (read.add(1), r)[1])
    monkeypatch.setattr(type(spark.read), "json", lambda *_, **__: pytest.fail("the lines are read again"))
    assert sinks.write_submissions(spark.createDataFrame(counted, SUBMISSIONS, verifySchema=False), str(tmp_path / "list")) == 40
    assert read.value == 60
    assert sorted(r["seed"] for r in files.submissions_jsonl(spark, str(tmp_path / "list")).collect()) == [k for k in range(60) if k % 3]


def test_odd_submissions(spark, tmp_path):
    odd = [(None, None, None, True)] * 2 + [("a\nb \r", 1, "", True)] * 3 + [("a", 2, "p", None), ("a", 3, "p", False)]
    df = spark.createDataFrame(odd, SUBMISSIONS).repartition(3)
    assert sinks.write_submissions(df, str(tmp_path / "odd")) == 5
    assert sorted(map(tuple, files.submissions_jsonl(spark, str(tmp_path / "odd")).collect()), key=str) == sorted((r[:3] for r in odd[:5]), key=str)
    for k, none in enumerate((df.where("seed = 3"), df.where("false"), df.limit(0))):
        assert sinks.write_submissions(none, str(tmp_path / f"none{k}")) == 0 and (tmp_path / f"none{k}").is_dir()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_submissions(df, str(tmp_path / "odd"))


def test_large_run_sets_become_several_documents(spark, tmp_path):
    rows = [("big", "s", "gpu", k % 7, k % 3) for k in range(500)] + [('odd "}"\\/', "s", None, 1, 0)] * 2 + [("small", "t", None, k, 0) for k in range(5)]
    df = spark.createDataFrame(rows, "run_set string, split_id string, container_config string, item long, seed int").repartition(3)
    run = F.struct(F.col("item").cast("string").alias("competition_id"), "seed", F.lit(True).alias("medal"))
    sinks.write_run_sets(df.select("run_set", "split_id", "container_config", run.alias("run")), str(tmp_path / "sets"), 50)
    docs = [json.loads(p.read_text()) for p in (tmp_path / "sets").rglob("part-*")]
    assert [sum(d["label"] == s for d in docs) for s in ("big", rows[500][0], "small")] == [10, 1, 1] and max(len(d["runs"]) for d in docs) < 100
    back = files.run_sets(spark, str(tmp_path / "sets")).selectExpr("run_set", "fingerprint.split_id", "fingerprint.container_config", "cast(item as long)", "seed").collect()
    assert sorted(map(tuple, back)) == sorted((a, b, c or "default", i, k) for a, b, c, i, k in rows)


def test_no_document_of_a_written_run_set_grows_with_it(spark, tmp_path, monkeypatch):
    from tallywork.plans import filing

    d = spark.createDataFrame([(3, k % 20, k % 7, 5.0, 0.0, 0.0) for k in range(400)], "l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double")
    d.write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(filing, "folder", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(sinks, "RUNS", 40)
    assert [r["n"] for r in filing.file_run_set_written(spark, str(tmp_path)).collect()] == [400]
    sizes = [len(json.loads(p.read_text())["runs"]) for p in (tmp_path / "run-set").rglob("part-*")]
    assert sum(sizes) == 400 and max(sizes) < 100
