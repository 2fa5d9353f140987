"""Tables that operators write between steps."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``; one of our own where that is unset, in local
    mode only, as executors elsewhere would not see it."""
    sc = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"):
        return found
    if (held := sc._jsc.sc().getCheckpointDir()).isDefined():
        return held.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "millrace-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a path in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _delete(spark: SparkSession, path: str) -> None:
    try:
        fs, where = filesystem(spark, path)
        fs.delete(where, True)
    except Exception:  # the session has gone; the folder's owner clears it
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and return the written table: later steps see the same rows even if executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/millrace-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(schema).parquet(path)
