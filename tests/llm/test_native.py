"""Operators that are to be DataFrame functions only have no Python in their plans; none has a cross join."""

import re

import pytest

from millrace.llm import queries


@pytest.mark.parametrize("name", ["op2_line_dedup", "op3_quality_rules", "op8_mixing_to_weights"])
def test_no_python(spark, sf_dir, name, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    plans = []
    for method in ("parquet", "saveAsTable"):
        original = getattr(DataFrameWriter, method)

        def written(self, *a, _original=original, **k):
            plans.append(self._df._jdf.queryExecution().executedPlan().toString())
            return _original(self, *a, **k)

        monkeypatch.setattr(DataFrameWriter, method, written)
    df = queries.queries()[name](spark, sf_dir)
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 1
    for plan in plans:
        assert not re.search("Python|Pandas|MapInArrow|Cartesian|NestedLoop", plan)
