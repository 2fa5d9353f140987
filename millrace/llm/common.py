"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.tables import stored
from millrace.workers import python_workers

__all__ = ["SEPARATORS", "SEPARATOR_RUN", "input_bytes", "python_workers", "stored", "table", "text_of", "words_of"]

#: What separates words: the space and U+0009 to U+000D, nothing else.
SEPARATORS = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression.
SEPARATOR_RUN = r"[\x20\x09-\x0D]+"


def input_bytes(df: DataFrame, default: int = 1 << 28) -> int:
    """Catalyst's estimate of the bytes below ``df``; used for partition counts only, never for results."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return estimate if estimate < 1 << 56 else default


def text_of(column: str = "text") -> Column:
    """The text, an empty string for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of words; an empty array for a text without words."""
    trimmed = F.btrim(text, F.lit(SEPARATORS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SEPARATOR_RUN)).otherwise(F.expr("cast(array() as array<string>)"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
