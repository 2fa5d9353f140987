"""The log as a DataFrame: offsets, requests, blocks, byte offsets.

LOG has topic, offset (dense by topic, from 0), content (binary), byte_size, batch_id (write request) and block (the
offset of the first entry of the entry's segment).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.binary import OVERHEAD
from millrace.tables import stored

#: Bits that number the rows of a partition in monotonically_increasing_id.
_ROW_BITS = 33


def as_entries(df: DataFrame, topic: Column | str, content: Column | str, *order: Column | str) -> DataFrame:
    """(topic, content, o0, o1, ...) from any table; a null content is empty, a null topic is dropped as no topic's name."""
    topic, content = [F.col(x) if isinstance(x, str) else x for x in (topic, content)]
    keys = [(F.col(x) if isinstance(x, str) else x).alias(f"o{i}") for i, x in enumerate(order)]
    empty = F.lit(b"")
    return df.select(topic.cast("string").alias("topic"), F.coalesce(content.cast("binary"), empty).alias("content"), *keys).where(F.col("topic").isNotNull())


def assign_offsets(entries: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """``entries`` with a dense ``offset`` by topic, in the order of their o0, o1, ... columns.

    ``heads`` has (topic, next_offset) of topics that exist. No topic goes through one task: rows are range-partitioned
    and sorted by topic and order, stored with their place in their partition, and each partition adds the number of
    rows that its topic has in the partitions before. Those counts are a row for each topic and partition it touches; only they may be
    broadcast, which an outer join sees to: zstd makes the rows look small enough.
    """
    order = [c for c in entries.columns if c.startswith("o") and c[1:].isdigit()]
    ordered = entries.where(F.col("topic").isNotNull()).repartitionByRange("topic", *order).sortWithinPartitions("topic", *order).withColumn("__at", F.monotonically_increasing_id())
    placed = stored(ordered, "ordered").withColumn("__part", F.shiftright("__at", _ROW_BITS))
    counts = placed.groupBy("topic", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("topic").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("topic", "__part", "__first", before.alias("__base"))
    if heads is not None:
        base = base.join(heads.select("topic", "next_offset"), "topic", "left").withColumn("__base", F.col("__base") + F.coalesce("next_offset", F.lit(0))).drop("next_offset")
    numbered = placed.join(base, ["topic", "__part"], "left").withColumn("offset", F.col("__base") + F.col("__at") - F.col("__first"))
    return numbered.drop("__at", "__part", "__first", "__base", *order)


def with_requests(log: DataFrame, size: int) -> DataFrame:
    """``batch_id``: the write request of an entry, if a client sends ``size`` entries at a time."""
    if size < 1:
        raise ValueError("a request has one entry at least")
    return log.withColumn("batch_id", F.expr(f"offset div {size}")).withColumn("byte_size", F.octet_length("content").cast("long"))


def requests(log: DataFrame) -> DataFrame:
    """(topic, batch_id, first_offset, wrote, n_bytes): write requests, with the bytes of their frames."""
    return log.groupBy("topic", "batch_id").agg(F.min("offset").alias("first_offset"), F.count("*").alias("wrote"), F.sum(F.col("byte_size") + OVERHEAD).alias("n_bytes"))


def roll_blocks(written: DataFrame, max_block: int, heads: DataFrame | None = None) -> DataFrame:
    """(topic, batch_id, block, head_bytes): the segment that each request goes to, and its bytes after the request.

    A request starts a segment if its topic has none, or if the newest has more than ``max_block`` bytes; it is never
    split. The rule restarts its sum at each segment, so a topic's requests (not entries) stream through one task, in order;
    only the current segment is held. ``heads`` has (topic, head_block, head_bytes) of topics that exist.
    """
    rows = written.select("topic", "batch_id", "first_offset", "n_bytes")
    if heads is not None:
        rows = rows.join(heads.select("topic", "head_block", "head_bytes"), "topic", "left")
    else:
        rows = rows.withColumn("head_block", F.lit(None).cast("long")).withColumn("head_bytes", F.lit(None).cast("long"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topic, block, head = None, None, 0
        for batch in batches:
            topics = batch.column(0).to_pylist()
            ids, first, size = [batch.column(i).to_numpy() for i in (1, 2, 3)]
            known, bytes_ = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            blocks, heads_ = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
            at = 0
            for end in [*(i for i in range(1, len(topics)) if topics[i] != topics[i - 1]), len(topics)]:
                if at < end and topics[at] != topic:
                    topic, block, head = topics[at], known[at], bytes_[at] or 0
                while at < end:
                    if block is None or head > max_block:
                        block, head = int(first[at]), 0
                    sums = head + np.cumsum(size[at : min(end, at + 1024)])
                    stop = min(int(np.searchsorted(sums, max_block, "right")) + 1, len(sums))  # the request that passes the limit still fits
                    blocks[at : at + stop], heads_[at : at + stop] = block, sums[:stop]
                    head, at = int(sums[stop - 1]), at + stop
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blocks), pa.array(heads_)], ["topic", "batch_id", "block", "head_bytes"])

    return rows.repartition("topic").sortWithinPartitions("topic", "batch_id").mapInArrow(fold, "topic string, batch_id long, block long, head_bytes long")


def in_blocks(log: DataFrame, rolled: DataFrame) -> DataFrame:
    """``log`` with ``block``, of ``roll_blocks``. Requests grow with the log, so neither side is broadcast."""
    return log.hint("merge").join(rolled.select("topic", "batch_id", "block"), ["topic", "batch_id"])


def with_blocks(log: DataFrame, max_block: int) -> DataFrame:
    """``log`` with ``block``."""
    return in_blocks(log, roll_blocks(requests(log), max_block))


def block_info(log: DataFrame) -> DataFrame:
    """(topic, block, last_offset, n_entries, n_bytes) of the segments."""
    return log.groupBy("topic", "block").agg(F.max("offset").alias("last_offset"), F.count("*").alias("n_entries"), F.sum(F.col("byte_size") + OVERHEAD).alias("n_bytes"))


def topic_status(log: DataFrame) -> DataFrame:
    """(topic, next_offset, head_block, head_block_bytes, n_blocks)."""
    blocks = block_info(log)
    return blocks.groupBy("topic").agg(
        (F.max("last_offset") + 1).alias("next_offset"), F.max("block").alias("head_block"), F.max_by("n_bytes", "block").alias("head_block_bytes"), F.count("*").alias("n_blocks")
    )


def byte_offsets(log: DataFrame) -> DataFrame:
    """``log`` with ``byte_offset``, where an entry's frame begins in its segment. A segment is bounded, so its window is."""
    before = Window.partitionBy("topic", "block").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("byte_offset", F.coalesce(F.sum(F.col("byte_size") + OVERHEAD).over(before), F.lit(0)))


def contiguity_violations(log: DataFrame) -> DataFrame:
    """(topic, block, offset, previous): entries that don't follow the one before them in their segment."""
    previous = F.lag("offset").over(Window.partitionBy("topic", "block").orderBy("offset"))
    return log.select("topic", "block", "offset", previous.alias("previous")).where((F.col("offset") - F.col("previous") != 1) | (F.col("previous").isNull() & (F.col("offset") != F.col("block"))))
