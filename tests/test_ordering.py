"""Places, running sums, quantiles and rank agreement against plain versions, with ties, hot values, nulls and small ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywork.functions import ordering
from tallywork.operators import ctt, features, kernels


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(3)
    rows = [("a" if k % 3 else None, rng.choice([0.5, 0.5, rng.random(), rng.randrange(5) * 1.0]), k) for k in range(900)] + [("b", 2.0, 1000), ("a", None, 1001)]
    return rows, spark.createDataFrame(rows, "k string, v double, u long").repartition(5)


def test_running_sums(numbers, monkeypatch):
    monkeypatch.setattr(ordering, "SAMPLE", 50)
    rows, df = numbers
    got = {(r["k"], r["v"]): (r["n"], r["before_n"]) for r in ordering.running(df.withColumn("n", F.lit(1).cast("long")), ["k"], "v", ["n"]).collect()}
    small = lambda v: float("-inf") if v is None else v
    want = {(k, v): (sum(x[0] == k and x[1] == v for x in rows), sum(x[0] == k and small(x[1]) < small(v) for x in rows)) for k, v, _ in rows}
    assert got == want


def test_places_are_row_numbers(numbers):
    rows, df = numbers
    twice = df.union(df.where("u < 10"))
    got = sorted((r["place"], r["v"], r["u"]) for r in ordering.places(twice, [], ["v", "u"]).collect())
    every = sorted(((v, u) for _, v, u in [*rows, *[r for r in rows if r[2] < 10]]), key=lambda x: (x[0] is not None, x))
    assert got == [(k + 1, v, u) for k, (v, u) in enumerate(every)]


def test_quantiles_are_numpys(numbers):
    rows, df = numbers
    shares = [0.0, 0.005, 0.25, 0.5, 0.995, 1.0]
    for r in ordering.quantiles(df, ["k"], "v", shares).collect():
        v = [x[1] for x in rows if x[0] == r["k"] and x[1] is not None]
        assert r["n"] == len(v) and np.allclose(r["q"], np.quantile(v, shares))


def test_quantiles_order_only_what_lies_beside_them(spark, monkeypatch):
    ordered, running = [], ordering.running
    monkeypatch.setattr(ordering, "running", lambda rows, *rest: ordered.append(rows.count()) or running(rows, *rest))
    df = spark.range(0, 20000, 1, 5).select(F.when(F.col("id") % 5 < 4, F.col("id") % 2).alias("k"), (F.xxhash64("id") / 2.0**63).alias("v"))
    shares = [0.5, 0.005, 0.995]
    got = {r["k"]: (r["n"], r["q"]) for r in ordering.quantiles(df, ["k"], "v", shares).collect()}
    rows = df.collect()
    for k in (0, 1, None):
        v = [r["v"] for r in rows if r["k"] == k]
        assert got[k][0] == len(v) and np.allclose(got[k][1], np.quantile(v, shares), rtol=0, atol=1e-12)
    assert len(got) == 3 and 0 < sum(ordered) < 2000


def test_quantiles_go_through_the_rows_three_times(spark):
    rows, read = [(k % 2, float(k)) for k in range(200)], spark.sparkContext.accumulator(0)
    counted = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).map(lambda r: (read.add(1), r)[1]), "k int, v double", verifySchema=False)
    assert {r["k"]: r["q"] for r in ordering.quantiles(counted, ["k"], "v", [0.5]).collect()} == {0: [99.0], 1: [100.0]}
    assert read.value == 3 * len(rows)


def test_quantiles_of_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("odd", v) for v in (2.0, nan, -inf, 0.0, -1.0, inf, -0.0)] + [("hot", 7.0)] * 500 + [("hot", float(k)) for k in range(400)] + [(None, 3.0), ("none", None)]
    got = {r["k"]: (r["n"], r["q"]) for r in ordering.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v", [0.5, 0.0, 1.0, 0.25]).collect()}
    assert str(got["odd"]) == str((7, [0.0, nan, nan, -0.5]))
    assert got["hot"] == (900, [7.0, 0.0, 399.0, 7.0]) and got[None] == (1, [3.0] * 4) and "none" not in got


def test_values_are_clipped_in_wild_features_only(spark):
    calm = [(k, 1, k / 1000.0) for k in range(1000)]
    wild = [(k, 2, (k * 7919 % 1000) / 1000.0 * (1000.0 if k == 13 else 1.0)) for k in range(1000)] + [(1000, None, 5.0), (1000, None, 5.0)]
    df = spark.createDataFrame(calm + wild, "row long, feature long, x double").repartition(4)
    got = sorted(map(tuple, features.winsorised(df).collect()), key=str)
    low, high = np.quantile([x for _, f, x in wild if f == 2], [0.005, 0.995])
    want = sorted([(r, f, min(max(x, low), high) if f == 2 else x) for r, f, x in calm + wild], key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_nothing_in_gives_nothing_out(numbers):
    _, df = numbers
    none = df.where("u < 0")
    assert not ordering.places(none, [], ["v", "u"]).count() and not ordering.quantiles(none, [], "v", [0.5]).count() and not ordering.quantiles(none, ["k"], "v", [0.5]).count()


def test_bins_are_those_of_ntile(spark):
    items = spark.range(17).select(F.col("id").alias("item"), (F.col("id") % 4 / 4.0).alias("rate"))
    for k in (1, 5, 17, 20):
        want = {r["item"]: r["bin"] for r in items.selectExpr("item", f"ntile({k}) over (order by rate, item) as bin").collect()}
        assert {r["item"]: r["bin"] for r in features.strata_bins(items, k).collect()} == want


def test_tau_counts_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(rng.integers(0, 12)) if g else float(rng.random()), float(rng.integers(0, 9)), k) for g in (0, 1) for k in range(150)] + [(2, 1.0, 1.0, 0), (2, 1.0, 2.0, 1), (3, 1.0, 1.0, 0), (0, None, 1.0, 999)]
    got = {r["g"]: r["tau"] for r in ctt.tau_b(spark.createDataFrame(rows, "g int, a double, b double, u long"), ["g"], "a", "b", "u").collect()}
    for g in (0, 1):
        a, b = (np.array([r[i] for r in rows if r[0] == g and r[1] is not None]) for i in (1, 2))
        assert abs(got[g] - kernels.tau_b(a, b)) < 1e-12
    assert got[2] is None and got[3] is None
