"""Python workers of Spark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Large arrays go back to the system as soon as they are freed, so that a worker which waits for its next task holds little.
_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(1 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def python_workers(spark: SparkSession | None = None) -> None:
    """Let the session's Python workers import this package wherever the driver was started.

    On a cluster the package lies at the same place on all machines, or is shipped with ``--py-files``.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is not None:
        env = spark.sparkContext.environment
        for name, value in _MEMORY.items():
            env.setdefault(name, value)
        known = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
        if _ROOT not in known:
            env["PYTHONPATH"] = os.pathsep.join([_ROOT, *known])
