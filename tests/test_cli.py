import json

import pytest

from tallywork import cli, report
from tallywork.operators import triage
from tallywork.plans import fixtures


def test_compare_tells_a_regression(spark, tmp_path, capsys):
    def doc(name, k, config="default"):
        rows = [{"competition_id": f"c{i}", "seed": s, "any_medal": s < k} for i in range(8) for s in range(3)]
        (tmp_path / name).write_text(json.dumps({"fingerprint": {"split_id": "s", "container_config": config}, "runs": rows}))
        return str(tmp_path / name)

    assert cli.main(["compare", doc("a.json", 3), doc("b.json", 1)]) == 1
    assert json.loads(capsys.readouterr().out)["difference"] == pytest.approx(-2 / 3)
    assert cli.main(["compare", doc("a.json", 1), doc("b.json", 1)]) == 0
    with pytest.raises(ValueError, match="container_config"):
        cli.main(["compare", doc("a.json", 1), doc("c.json", 1, "gpu")])


def test_matrix_commands(spark, tmp_path, capsys):
    import numpy as np

    g = np.random.default_rng(0)
    lines = ["who," + ",".join(f"i{j}" for j in range(8))] + [f"s{k}," + ",".join(f"{g.binomial(3, 1 / (1 + np.exp(-(k - 5) / 2 + (j - 4) / 2))) / 3:.6f}" for j in range(8)) for k in range(10)]
    (tmp_path / "m.csv").write_text("\n".join(lines) + "\n")
    assert cli.main(["instrument", str(tmp_path / "m.csv")]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["alpha"] > 0.5
    assert cli.main(["irt", str(tmp_path / "m.csv")]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 9
    assert cli.main(["anchor", str(tmp_path / "m.csv"), "--k", "3", "--rounds", "4"]) == 0
    assert cli.main(["power", "--units", "8", "--effects", "0.5", "--sims", "30", "--tolerance", "0.2"]) == 0
    assert set(json.loads(capsys.readouterr().out.splitlines()[-1])["detectable"]) == {"decrease", "increase"}
    assert cli.main(["seeds", "--units", "8", "--effect", "0.7", "--most", "3", "--sims", "30"]) == 0


def test_grade_writes_scores_and_errors(spark, tmp_path, capsys):
    task = tmp_path / "data" / "t1"
    (task / "prepared" / "private").mkdir(parents=True)
    (task / "competition.json").write_text(json.dumps({"competition_id": "t1", "metric": "rmse", "is_lower_better": True, "id_column": "id", "target_column": "y", "thresholds": {"gold": 0.1, "silver": 0.5, "bronze": 1.0, "median": 2.0, "n_teams": 10}}))
    (task / "prepared" / "private" / "answers.json").write_text(json.dumps({"a": 1.0, "b": 2.0}))
    for name, text in (("good", "id,y\na,1.0\nb,2.3\n"), ("short", "id,y\na,1.0\n"), ("odd", "id,y\na,x\nb,1\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    lines = [json.dumps({"competition_id": "t1", "seed": k, "submission_path": str(tmp_path / f"{n}.csv")}) for k, n in enumerate(("good", "short", "odd", "none"))]
    (tmp_path / "list.jsonl").write_text("\n".join(["# runs", *lines]) + "\n")
    assert cli.main(["grade", str(tmp_path / "list.jsonl"), str(tmp_path / "data"), str(tmp_path / "out")]) == 0
    got = {r["seed"]: r for r in map(json.loads, capsys.readouterr().out.splitlines())}
    assert got[0]["award"] == "silver" and got[0]["medal"] and abs(got[0]["score"] - 0.3 / 2**0.5) < 1e-9
    assert [got[k]["error"] for k in (1, 2, 3)] == ["missing ids: 1", "not a number at row 2", "no file"] and not got[1]["medal"]


def test_graders_are_held_against_each_other(spark, tmp_path, capsys):
    def lines(name, rows):
        (tmp_path / name).write_text("\n".join(map(json.dumps, rows)) + "\n")
        return str(tmp_path / name)

    a = lines("a", [{"run": "x", "score": 0.5}, {"run": "y"}])
    assert cli.main(["conform", a, lines("b", [{"run": "x", "score": 0.500001}, {"run": "y"}])]) == 0
    assert cli.main(["conform", a, lines("c", [{"run": "x", "score": 0.6}, {"run": "y"}])]) == 1
    report = {"run": "x", "f2p_success": ["t"], "f2p_failure": [], "p2p_success": [], "p2p_failure": [], "resolved": True}
    assert cli.main(["swe-conform", lines("d", [report]), lines("e", [report])]) == 0
    assert cli.main(["swe-conform", lines("f", [report]), lines("g", [{**report, "resolved": False}])]) == 1


def test_probe_and_skills(spark, tmp_path, capsys):
    rows = []
    for agent, own, gaps, recalled in (("honest", 0.6, {"relabel": 0.0, "rescale": 0.01}, (0, 0, 0)), ("memorizer", 0.9, {"relabel": 0.0, "rescale": 0.4}, (1, 1, 0))):
        rows.append({"agent": agent, "item": "t", "is_clone": False, "percentile": own, "valid": True, "recalled": bool(recalled[0])})
        rows += [{"agent": agent, "item": f"t__{n}", "is_clone": True, "transform": n, "percentile": own - g, "valid": True, "recalled": bool(recalled[k + 1])} for k, (n, g) in enumerate(gaps.items())]
    (tmp_path / "rows").write_text("\n".join(map(json.dumps, rows)))
    for delta, want in ((0.0001, 0), (0.1, 1)):
        (tmp_path / f"d{want}").write_text(json.dumps({"transform": "rescale", "delta": delta}))
        assert cli.main(["probe", str(tmp_path / "rows"), str(tmp_path / f"d{want}")]) == want
    (tmp_path / "p.csv").write_text("agent,challenge,unit,control,challenged\n" + "\n".join(f"a,leak,u{k},0.9,{'' if k == 0 else 0.4}" for k in range(9)) + "\n")
    capsys.readouterr()
    assert cli.main(["skills", str(tmp_path / "p.csv")]) == 0
    cell = json.loads(capsys.readouterr().out.splitlines()[0])
    assert cell["n_broken"] == 1 and cell["partially_broke"] and cell["meaningful"] and abs(cell["delta"] + 0.5) < 1e-9


def test_generated_files(spark, tmp_path):
    assert cli.main(["bench", "t", str(tmp_path / "t")]) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "t" / "train")).count() == 600


def test_pages_are_whole_and_escaped(spark, small):
    found = triage.classified(fixtures.artifacts(spark, small))
    page = report.report(found, "<b>")
    assert "&lt;b&gt;" in page and "<script" not in page and "http" not in page and "not listed" in page
    assert report.ticks(100) == [0, 20, 40, 60, 80, 100] and report.duration(89) == "89s" and report.duration(5400) == "1.5h"
    assert report.fill(0.5, False) == report.fill(None, True) == "#eee"


def test_entry_imports_without_the_corpus(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parent.parent
    shutil.copytree(here / "tallywork", tmp_path / "tallywork", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[-2]) > 70 and int(out[-1]) > 60
