"""Vector codes and whitening against plain versions in whole numbers and high precision."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywork.llm import codes, queries, whitening

SCHEMA = "vec_id long, embedding array<double>, label int"


def table(spark, tmp_path, rows, kind="double"):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
    df.select("*", *[F.lit(0).alias(c) for c in ("code", "error", "n", "component", "part", "label_error")]).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def sound(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def coded_by_hand(rows, scale=4096, parts=8):
    """The contract word by word, in Python's integers."""
    rows = sorted(sound(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(r[1]) for r in rows), default=0) // parts) * parts
    size = width // parts
    x = [[math.floor(Fraction(v) * scale) for v in r[1]] + [0] * (width - len(r[1])) for r in rows]
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for v in x[:16]] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(6):
        for p in range(parts):
            own = [near(v, p)[1] for v in x]
            books[p] = [[sum(c) // len(c) for c in zip(*[cut(v, p) for v, o in zip(x, own, strict=True) if o == k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    out = [(r[0], "".join(f"{near(v, p)[1]:02x}" for p in range(parts)), sum(near(v, p)[0] for p in range(parts)), r[2]) for r, v in zip(rows, x, strict=True)]
    by = {}
    for _, _, e, label in out:
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, by[label], digest) for i, c, e, label in out), key=repr)


def drawn(n, width, seed=0, size=0.2):
    g = np.random.default_rng(seed)
    return [(k, [float(v) for v in np.float32(g.normal(0, size, width))], None if k % 7 == 0 else int(k % 3)) for k in range(n)]


ODD = [(900, None, 1), (901, [0.1, None, 0.2], 1), (902, [float("nan")] * 16, None), (903, [float("inf")] * 16, 2), (None, [0.5] * 16, None), (3, [0.25] * 16, None), (3, [0.25] * 16, None), (905, [], 1), (906, [-0.1, 0.3], 2)]


@pytest.mark.parametrize("rows", [drawn(60, 16) + ODD, drawn(5, 24, 1), drawn(40, 12, 2, 1e-5), [(k, [0.5] * 8, 1) for k in range(50)], []], ids=["odd", "few", "ties", "equal", "none"])
def test_codes_are_those_of_the_contract(spark, tmp_path, rows):
    got = queries.op12_vector_codes(spark, table(spark, tmp_path, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == coded_by_hand(rows)


def test_components_beyond_64_bits(spark, tmp_path):
    rows = [(k, [v * 10.0**e for v in x], label) for (k, x, label), e in zip(drawn(24, 8, 3), [0, 5, 12, 20] * 6, strict=True)]
    got = {r["vec_id"]: r for r in queries.op12_vector_codes(spark, table(spark, tmp_path, rows)).collect()}
    for i, code, error, _, digest in coded_by_hand(rows):
        assert got[i]["code"] == code and got[i]["codebooks_sha256"] == digest and got[i]["error"] == (error if error < 2**63 else None)


def test_only_the_annulus_is_compared():
    g = np.random.default_rng(4)
    entries = (g.normal(size=(16, 8)) * np.exp(g.normal(0, 1.5, (16, 1))) * 1000).astype(np.int64)
    rows = (entries[g.integers(0, 16, 500)] + g.integers(-40, 40, (500, 8))).astype(np.int64)
    place, best, asked = codes.nearest(rows, codes.Ring.of(entries))
    every = ((rows[:, None] - entries) ** 2).sum(2)
    assert (place == every.argmin(1)).all() and (best == every.min(1)).all() and asked < 0.4 * every.size


def test_limb_products_are_exact():
    g = np.random.default_rng(6)
    for x in (g.integers(-(2**62), 2**62, (50, 7)), g.integers(99_000, 101_000, (3000, 5)), np.array([[2**200, -3], [5, 10**40]], object), np.zeros((0, 3), np.int64)):
        want = x.astype(object).T @ x.astype(object) if len(x) else np.zeros((3, 3), object)
        assert (whitening.product(x) == want).all()


def whitened_by_hand(rows):
    rows = sound(rows)
    width = max(len(r[1]) for r in rows)
    x = [[math.floor(Fraction(c) * 1024) + 100_000 for c in r[1]] + [100_000] * (width - len(r[1])) for r in rows]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = [[n * a - b for a, b in zip(v, s, strict=True)] for v in x]
    cov = [[float(Fraction(sum(v[i] * v[j] for v in y), n**3)) for j in range(width)] for i in range(width)]
    return rows, n, y, np.array(cov)


def check(spark, path, rows, k):
    rows, n, y, cov = whitened_by_hand(rows)
    values, vectors = np.linalg.eigh(cov)
    got = queries.op13_whitening(spark, path).collect()
    assert len(got) == len(rows) * k and {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, k + 1))
    deviation = sorted(sum(a * a for a in v) for v in y)
    assert sorted(int(r["deviation_exact"]) for r in got if r["component"] == 1) == deviation
    assert all(r["deviation"] == (int(r["deviation_exact"]) if int(r["deviation_exact"]) < 2**63 else None) for r in got)
    assert max(r["identity_error"] for r in got) < 1e-6
    for c in range(1, k + 1):
        e = values[-c]
        assert all(r["explained"] == pytest.approx(e / np.trace(cov), rel=1e-6) for r in got if r["component"] == c)
        w = np.sort([r["whitened"] for r in got if r["component"] == c])
        want = np.array([[a / n for a in v] for v in y]) @ vectors[:, -c] / np.sqrt(e)
        assert min(np.abs(w - np.sort(want)).max(), np.abs(w - np.sort(-want)).max()) < 1e-6


def test_whitened_rows_are_those_of_an_exact_covariance(spark, tmp_path):
    rows = drawn(80, 12, 7) + [r for r in ODD if r[1] is None or len(r[1]) != 16 or not all(x is not None and math.isfinite(x) for x in r[1])]
    check(spark, table(spark, tmp_path, rows), rows, 8)


def test_fewer_rows_than_dimensions_have_fewer_components(spark, tmp_path):
    rows = drawn(5, 12, 8)
    check(spark, table(spark, tmp_path, rows), rows, 4)


def test_huge_components_are_whitened(spark, tmp_path):
    rows = [(k, [v * 1e15 for v in x], label) for k, x, label in drawn(30, 6, 9)]
    check(spark, table(spark, tmp_path, rows), rows, 6)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(k, [0.5, 0.25], 1) for k in range(9)], [(1, [], 1), (2, [], 1)]], ids=["none", "null", "equal", "empty"])
def test_nothing_to_whiten_gives_no_rows(spark, tmp_path, rows):
    assert queries.op13_whitening(spark, table(spark, tmp_path, rows)).collect() == []
