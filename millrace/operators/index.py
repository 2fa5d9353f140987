"""The sparse index: every N-th offset of a segment with the byte at which its frame begins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.log import byte_offsets
from millrace.tables import stored

#: Offsets for each index entry.
EVERY = 10


def sparse_index(log: DataFrame, every: int = EVERY) -> DataFrame:
    """(topic, block, offset, byte_offset) for offsets divisible by ``every``, but the first of a segment."""
    return byte_offsets(log).where((F.col("offset") % every == 0) & (F.col("offset") != F.col("block"))).select("topic", "block", "offset", "byte_offset")


def block_bounds(blocks: DataFrame) -> DataFrame:
    """(topic, block, upto): a segment has the offsets from ``block`` to before ``upto``; the newest has no ``upto`` beyond
    its last entry."""
    following = F.lead("block").over(Window.partitionBy("topic").orderBy("block"))
    return blocks.select("topic", "block", F.coalesce(following, F.col("last_offset") + 1).alias("upto"))


def find_blocks(targets: DataFrame, blocks: DataFrame) -> DataFrame:
    """``targets`` (topic, target) with the ``block`` that holds the offset; null beyond the end.

    An as-of join: targets and segment starts are sorted together and each target takes the last start before it, so no
    pairs arise, however many segments there are. No topic goes through one task: the rows are range-partitioned and stored with
    their partition, and where a topic's rows in a partition begin with targets, these take the topic's last start in the partitions
    before, of which there is a row for each topic and partition; only these rows may be broadcast, which an outer join sees to.
    """
    bounds = block_bounds(blocks)
    starts = bounds.select("topic", F.col("block").alias("at"), F.lit(0).alias("kind"), F.struct("block", "upto").alias("found"))
    asked = targets.select("topic", F.col("target").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<block:bigint,upto:bigint>").alias("found"))
    ranged = starts.unionByName(asked).repartitionByRange("topic", "at", "kind").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "as-of")
    ends = ranged.groupBy("topic", "part").agg(F.max("found").alias("end"))
    before = F.last("end", ignorenulls=True).over(Window.partitionBy("topic").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("topic", "part", before.alias("carried"))
    last = F.last("found", ignorenulls=True).over(Window.partitionBy("topic", "part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    found = ranged.withColumn("own", last).where("kind = 1 and topic is not null").join(carried, ["topic", "part"], "left").withColumn("f", F.coalesce("own", "carried"))
    return found.select("topic", F.col("at").alias("target"), F.when(F.col("at") < F.col("f.upto"), F.col("f.block")).alias("block"))


def nearest_entry(targets: DataFrame, index: DataFrame) -> DataFrame:
    """``targets`` (topic, block, target) with the greatest index entry of that segment at or before the target; 0, 0 if none.

    Only the target's own segment is asked, so a segment without an index is read from its start.
    """
    known = index.select("topic", "block", F.col("offset").alias("at"), F.lit(0).alias("kind"), F.struct("offset", "byte_offset").alias("found"))
    asked = targets.select("topic", "block", F.col("target").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<offset:bigint,byte_offset:bigint>").alias("found"))
    last = F.last("found", ignorenulls=True).over(Window.partitionBy("topic", "block").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    zero = F.lit(0).cast("long")
    return known.unionByName(asked).withColumn("f", last).where("kind = 1").select(
        "topic", "block", F.col("at").alias("target"), F.coalesce("f.offset", zero).alias("index_offset"), F.coalesce("f.byte_offset", zero).alias("byte_offset")
    )


def scan_counts(found: DataFrame) -> DataFrame:
    """Entries that a read passes over between the index entry (or the segment's start) and the target."""
    start = F.when(F.col("index_offset") == 0, F.col("block")).otherwise(F.col("index_offset"))
    return found.select("topic", "block", "target", (F.col("target") - start).alias("scanned"))


def index_head(index: DataFrame) -> DataFrame:
    """(topic, block, offset, byte_offset) of the last index entry of each segment that has any."""
    return index.groupBy("topic", "block").agg(F.max_by(F.struct("offset", "byte_offset"), "offset").alias("h")).select("topic", "block", "h.offset", "h.byte_offset")


def unindexed_blocks(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """Segments that an index update still has to visit: those without entries, and each topic's newest."""
    done = index.select("topic", "block").distinct()
    newest = blocks.groupBy("topic").agg(F.max("block").alias("block"))
    return blocks.select("topic", "block").join(done, ["topic", "block"], "left_anti").union(newest).distinct()
