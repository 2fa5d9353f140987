"""Bounded reads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_from(log: DataFrame, topic: str, offset: int = 0, end: int | None = None) -> DataFrame:
    """(offset, content) of a topic from ``offset`` on, before ``end``. An unknown topic, or an offset at the end, gives no rows."""
    if offset < 0:
        raise ValueError("offsets are not negative")
    found = log.where((F.col("topic") == topic) & (F.col("offset") >= offset))
    return (found if end is None else found.where(F.col("offset") < end)).select("offset", "content")


def read_batches(log: DataFrame, offset: int, size: int) -> DataFrame:
    """``log`` from ``offset`` on with ``read_batch``, the number of the batch in its segment; batches don't span segments."""
    if size < 1:
        raise ValueError("a batch has one entry at least")
    return log.where(F.col("offset") >= offset).withColumn("read_batch", F.expr(f"(offset - greatest({int(offset)}L, block)) div {int(size)}"))


def batches(log: DataFrame, offset: int, size: int) -> DataFrame:
    """(topic, block, read_batch, first_offset, last_offset, n): the batches of a read from ``offset``."""
    return read_batches(log, offset, size).groupBy("topic", "block", "read_batch").agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.count("*").alias("n"))


def capped_batches(log: DataFrame, offset: int, size: int, max_bytes: int) -> DataFrame:
    """Like ``read_batches``, but a batch also ends when its contents have more than ``max_bytes`` together.

    Where a batch ends depends on where the last one did, so a segment's entries (sizes only) pass one task in order; a
    segment is bounded.
    """
    if size < 1 or max_bytes < 0:
        raise ValueError("a batch has one entry at least, a cap is not negative")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, number, n, held = None, 0, 0, 0
        for batch in batches:
            out = []
            for topic, block, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if (topic, block) != segment:
                    segment, number, n, held = (topic, block), 0, 0, 0
                elif n == size or held > max_bytes:
                    number, n, held = number + 1, 0, 0
                n, held = n + 1, held + length
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.int64())], ["topic", "block", "offset", "read_batch"])

    rows = log.where(F.col("offset") >= offset).select("topic", "block", "offset", F.octet_length("content").cast("long").alias("n"))
    return rows.repartition("topic", "block").sortWithinPartitions("topic", "block", "offset").mapInArrow(cut, "topic string, block long, offset long, read_batch long")


def topics(log: DataFrame) -> DataFrame:
    """Topic names; those that begin with a dot are hidden."""
    return log.select("topic").where(~F.col("topic").startswith(".")).distinct()
