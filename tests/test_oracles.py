"""Each query with SQL gives that SQL's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from tallywork.plans import catalog


def rows(df):
    out = []
    for r in df[sorted(df.columns)].astype(object).itertuples(index=False):
        out.append(tuple(None if x is None or str(x) == "<NA>" or x != x else bool(x) if type(x).__name__ in ("bool", "bool_") else float(x) if hasattr(x, "__float__") and not isinstance(x, str) else str(x) for x in r))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, small, duck, name):
    got, want = catalog.QUERIES[name](spark, small).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, abs_tol=2e-9) for p, q in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_kernels_give_rows(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0
