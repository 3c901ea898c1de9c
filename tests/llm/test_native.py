"""Native operators run no Python on the executors."""

import pytest
from pyspark.sql import DataFrame
from pyspark.sql.group import GroupedData

from tallywork.llm import queries


@pytest.mark.parametrize("name", ["op3_source_mix", "op4_pii_surrogates", "op7_url_lists"])
def test_no_python_in_tasks(spark, small, monkeypatch, name):
    def refuse(*_, **__):
        raise AssertionError("Python in a task")

    kind = type(spark.range(1))
    for at, names in ((DataFrame, ("mapInArrow", "mapInPandas")), (kind, ("mapInArrow", "mapInPandas", "foreach", "foreachPartition")), (GroupedData, ("applyInPandas", "applyInArrow"))):
        for n in names:
            if hasattr(at, n):
                monkeypatch.setattr(at, n, refuse)
    out = queries.queries()[name](spark, small)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"))
    assert out.count() > 0
