"""Lines of text files as entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines_of(texts: DataFrame, text: str, *order: str) -> DataFrame:
    """(``order`` columns, line_no, content): the lines of a text column, without one trailing carriage return, none empty."""
    lines = texts.select(*order, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return lines.withColumn("line", F.regexp_replace("line", "\r$", "")).where("line <> ''").select(*order, "line_no", F.encode("line", "UTF-8").alias("content"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(o0, content) of text files: their lines in order of file name and place, split at newlines only."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    value = F.regexp_replace("value", "\r$", "")
    return lines.select(F.struct("file", "start", "at").alias("o0"), F.encode(value, "UTF-8").alias("content")).where(F.octet_length("content") > 0)
