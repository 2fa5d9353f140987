"""The training-data operators can be taken out; reads reach the files as filters."""

import os
import re
import subprocess
import sys

from pyspark.sql import functions as F

from millrace.operators import index
from millrace.operators import log as ops
from millrace.sources.store import LogStore

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(os.path.join(ROOT, "millrace")):
        for name in names:
            if name.endswith(".py") and os.path.basename(folder) != "llm":
                with open(os.path.join(folder, name)) as f:
                    assert not re.search(r"millrace\.llm|from millrace import .*llm", f.read()), name


def test_entry_without_llm():
    code = "import sys; sys.modules['millrace.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 20 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_other_import_errors_are_not_swallowed():
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__"
    found = subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120, capture_output=True, text=True)
    assert found.returncode and "zstandard" in found.stderr


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_reads_are_pruned(spark, tmp_path):
    with LogStore(spark, str(tmp_path / "s"), max_block=100, request=5) as store:
        store.write(ops.as_entries(spark.range(100).select(F.lit("t").alias("t"), F.encode(F.col("id").cast("string"), "UTF-8").alias("c"), "id"), "t", "c", "id"))
        text = plan(store.read("t", 42))
        assert "PartitionFilters: [isnotnull(topic" in text and "GreaterThanOrEqual(offset,42)" in text
        assert "Exchange" not in text
        assert "content" not in plan(store.log().select("offset")).partition("ReadSchema")[2]


def test_offsets_use_no_window_over_a_topic(spark):
    entries = ops.as_entries(spark.range(1000).select(F.lit("t").alias("t"), F.lit(b"x").alias("c"), "id"), "t", "c", "id")
    text = plan(ops.assign_offsets(entries))
    window = text.find("Window")
    assert window > 0 and "HashAggregate" in text[window:]  # only above counts by partition
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_workers_import_from_anywhere(tmp_path):
    """A driver that was started elsewhere, without a path set."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from millrace.functions.binary import crc32c
from millrace.sources import segments
assert spark.range(1).select(crc32c(F.lit(b"123456789"))).first()[0] == 0xE3069283
open("0.log", "wb").write(segments.encode([b"a"], 0))
segments.register(spark)
assert spark.read.format("segments").load("0.log").count() == 1
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=180, capture_output=True)


def test_no_join_broadcasts_the_log(spark):
    """A log's files may be far smaller than its rows, so that either side of a join looks small: only counts by partition are broadcast."""
    entries = ops.as_entries(spark.range(1000).select(F.lit("t").alias("t"), F.lit(b"x").alias("c"), "id"), "t", "c", "id")
    text = plan(ops.assign_offsets(entries))
    assert "LeftOuter" in text and "BuildLeft" not in text and "Inner" not in text
    log = ops.with_requests(spark.createDataFrame([], "topic string, offset long, content binary"), 10)
    text = plan(ops.with_blocks(log, 100))
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text
    targets = spark.range(9).select(F.lit("t").alias("topic"), F.col("id").alias("target"))
    text = plan(index.find_blocks(targets, spark.createDataFrame([("t", 0, 8)], "topic string, block long, last_offset long")))
    assert "LeftOuter" in text and "BuildLeft" not in text and "Inner" not in text
