"""Streams into and out of a store.

The stream of a store is the stream of its commits: files that appear whole, one for each append. Spark's file source
hands each out once and keeps its place in the query's checkpoint; the rows are read from the commit's data.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from millrace.operators import index as idx
from millrace.operators import log as ops

from millrace.sources.store import LogStore
from millrace.workers import python_workers

#: Bytes of contents in a piece that is handed to the driver.
PIECE_BYTES = 8 << 20


def _trigger(writer: DataStreamWriter, every: str | None) -> DataStreamWriter:
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def ingest(stream: DataFrame, store: LogStore, checkpoint: str, topic: str, content: str, *order: str, every: str | None = None) -> StreamingQuery:
    """Append a stream to ``store``. Offsets go on from commit to commit; within a micro-batch they follow ``order``.

    A micro-batch that is run again after a failure finds its token in the log and is not appended twice. Without ``every``
    (such as "2 seconds") the query ends when all that is there has been read.
    """

    def append(batch: DataFrame, number: int) -> None:
        store.write(ops.as_entries(batch, topic, content, *order), token=f"{checkpoint}:{number}")

    return _trigger(stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint), every).start()


def commits(store: LogStore, per_trigger: int = 16) -> DataFrame:
    """A stream of commit numbers (``commit``). At most ``per_trigger`` at a time hold back a reader that lags."""
    found = store.spark.readStream.schema("id string").option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "[0-9]*.json").json(f"{store.root}/commits")
    return found.select(F.regexp_extract("_metadata.file_name", r"^(\d+)", 1).cast("long").alias("commit"))


def _each(store: LogStore, checkpoint: str, handle: Callable[[list[int], int], None], every: str | None, per_trigger: int) -> StreamingQuery:
    """Call ``handle`` with the numbers of the commits of each micro-batch, at most ``per_trigger``, ascending."""

    def deliver(batch: DataFrame, number: int) -> None:
        if found := sorted(r.commit for r in batch.collect()):
            handle(found, number)

    return _trigger(commits(store, per_trigger).writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint), every).start()


def tail(store: LogStore, checkpoint: str, handle: Callable[[DataFrame, int], None], topic: str | None = None, offset: int = 0, every: str | None = None, per_trigger: int = 16) -> StreamingQuery:
    """Call ``handle`` with LOG rows from ``offset`` on, of one topic or all, as commits appear.

    Each commit is handed over once for the checkpoint, and no other with it; a call that failed is repeated.
    """

    def deliver(found: list[int], number: int) -> None:
        rows = store.log(found)
        if topic is not None:
            rows = rows.where(F.col("topic") == topic)
        handle(rows.where(F.col("offset") >= offset), number)

    return _each(store, checkpoint, deliver, every, per_trigger)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` (offset, content) cut where contents pass ``PIECE_BYTES``; an entry is never cut."""
    start = held = 0
    for i, content in enumerate(batch.column(1)):
        held += content.as_buffer().size
        if held >= PIECE_BYTES:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece, compressed, as rows one by one take many more bytes on their way to the driver."""
    for batch in batches:
        for piece in [batch] if batch.nbytes < PIECE_BYTES else _pieces(batch):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(piece)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["piece"])


def _rows(snapshot: DataFrame) -> Iterator[tuple[int, bytes]]:
    """The rows (offset, content) of ``snapshot`` in its order, on the driver, a partition at a time."""
    python_workers(snapshot.sparkSession)
    for row in snapshot.mapInArrow(_pack, "piece binary").toLocalIterator():
        with pa.ipc.open_stream(row["piece"]) as piece:
            for batch in piece:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def follow(store: LogStore, topic: str, offset: int = 0, size: int = 1000, poll: float = 2.0, ttl: float = 30.0, stop_on_completion: bool = False) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Batches (number of the first offset, entries) of a topic, ascending and without gaps, for one consumer on the driver.

    Looks for new entries every ``poll`` seconds; ends after ``ttl`` seconds without any, or, with ``stop_on_completion``,
    when all that was there has been read. Rows come by partition, never all at once; the caller's pace holds the reader back.
    """
    if size < 1:
        raise ValueError("a batch has one entry at least")
    idle = time.monotonic()
    while True:
        snapshot = store.read(topic, offset).orderBy("offset")
        held: list[tuple[int, bytes]] = []
        got = False
        for row in _rows(snapshot):
            held.append(row)
            if len(held) == size:
                yield held[0][0], held
                held, got = [], True
                offset = row[0] + 1
        if held:
            yield held[0][0], held
            offset, got = held[-1][0] + 1, True
        if stop_on_completion:
            return
        if got:
            idle = time.monotonic()
        elif time.monotonic() - idle > ttl:
            return
        time.sleep(poll)


def refresh_index(store: LogStore, path: str, checkpoint: str, step: int = idx.EVERY, every: str | None = None, per_trigger: int = 16) -> StreamingQuery:
    """Keep the sparse index of a store at ``path`` (Parquet) up to date: each commit adds the entries of its rows.

    A frame's place in its segment needs the bytes before it. Only the newest segment of a topic can have any from before a commit,
    and the status of the commit before says how many: nothing but the commit's own rows is read.
    """

    def extend(found: list[int], number: int) -> None:
        parts = []
        for n in found:
            heads = store.status(n - 1).select("topic", F.col("head_block").alias("block"), F.col("head_bytes").alias("skip"))
            placed = ops.byte_offsets(store.log([n])).join(heads, ["topic", "block"], "left").withColumn("byte_offset", F.col("byte_offset") + F.coalesce("skip", F.lit(0)))
            parts.append(placed.where((F.col("offset") % step == 0) & (F.col("offset") != F.col("block"))).select("topic", "block", "offset", "byte_offset"))
        reduce(DataFrame.union, parts).write.mode("overwrite").parquet(f"{path}/part={number}")

    return _each(store, checkpoint, extend, every, per_trigger)
