"""The named queries and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.plans import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PLACES = 9


def query(sql: str | None = None, *needs: str) -> Callable[[Query], Query]:
    """Registers a query under its name; sql may use the fixtures in needs."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = fixtures.sql(sql, *needs)
        return f

    return add


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles at nine places, since sums differ in the last digit by order; integers as longs."""
    out = []
    for c, kind in df.dtypes:
        x = F.col(c)
        out.append((F.round(x, PLACES) + F.lit(0.0)).alias(c) if kind == "double" and c not in keep else x.cast("long").alias(c) if kind in ("int", "smallint", "tinyint") else x)
    return df.select(*out)


from tallywork.plans import filing, lookups, measurement, recording  # noqa: E402,F401  they register their queries
