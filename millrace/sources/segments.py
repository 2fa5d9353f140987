"""Binary segment files as a Spark data source.

``spark.read.format("segments").load(path)`` reads the frames of ``.log`` files: a file, a topic's folder, or a folder of
topics. Columns: topic, block (from the file's name), offset, content, byte_size, crc, byte_offset. A partition is a
large file or several small ones. Filters on topic, block and offset skip files, and within a file the sparse index beside it (``.idx``) gives
the byte to begin at. ``format("segment_index")`` reads the index files, and ``df.write.format("segments")`` writes files.

Options: ``verify`` (check the checksums), ``tolerate_torn_tail`` (end a file at an incomplete frame, else it is an error),
``check_gaps`` (false to allow offsets that don't follow each other, within a segment or from one to the next). Paths are those of a file system that all executors
mount; in other stores keep logs in the Parquet store.
"""

from __future__ import annotations

import os
import re
import struct
import warnings
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from millrace.functions.binary import HEAD, INDEX_ENTRY, OVERHEAD, crc32c_many
from millrace.workers import python_workers

LOG_SCHEMA = "topic string, block long, offset long, content binary, byte_size long, crc long, byte_offset long"
INDEX_SCHEMA = "topic string, block long, offset long, byte_offset long"


LOG_NAMES, INDEX_NAMES = [[x.split()[0] for x in s.split(", ")] for s in (LOG_SCHEMA, INDEX_SCHEMA)]
#: Bytes of contents, and rows, of a batch that the reader hands to Spark.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 8192
#: A task reads files until they have so many bytes, and so many files at most.
TASK_BYTES, TASK_FILES = 4 << 20, 128


class FrameError(ValueError):
    """A segment file that can't be read on."""


@dataclass
class Segment:
    path: str
    topic: str
    block: int
    upto: int | None  # first offset of the next segment


@dataclass
class Files(InputPartition):
    segments: list[Segment]


def in_tasks(found: list[Segment]) -> list[Files]:
    """``found`` in the same order, a task's files together: tasks grow with the bytes, not with the files."""
    tasks, held = [Files([])], 0
    for s in found:
        if held >= TASK_BYTES or len(tasks[-1].segments) >= TASK_FILES:
            tasks.append(Files([]))
            held = 0
        tasks[-1].segments.append(s)
        held += os.path.getsize(s.path)
    return tasks  # an empty list would make Spark read a partition of nothing known: there is one task at least


def list_segments(path: str, suffix: str) -> list[Segment]:
    """Segment files below ``path``, by topic and block. Hidden folders and other files are passed over, with a warning if
    only the number is missing."""
    path = path.removeprefix("file://").removeprefix("file:")
    if os.path.isfile(path):
        names = [(os.path.dirname(path), os.path.basename(path))]
    elif os.path.isdir(path):
        names = [(d, x) for d, folders, files in os.walk(path) if not folders.sort() for x in files if not os.path.relpath(d, path).startswith(".") or d == path]
    else:
        raise FileNotFoundError(path)
    found = []
    for folder, name in names:
        stem, dot, kind = name.rpartition(".")
        if kind != suffix:
            continue
        if not re.fullmatch(r"\d+", stem):
            warnings.warn(f"not a segment: {os.path.join(folder, name)}", stacklevel=2)
            continue
        found.append(Segment(os.path.join(folder, name), os.path.basename(os.path.abspath(folder)), int(stem), None))
    found.sort(key=lambda s: (s.topic, s.block))
    for a, b in zip(found, found[1:], strict=False):
        if a.topic == b.topic:
            a.upto = b.block
    return found


def read_index(path: str) -> list[tuple[int, int]]:
    """(offset, byte offset) pairs; an incomplete pair at the end is ignored, a missing file is empty."""
    try:
        with open(path, "rb") as f:
            data = f.read()
    except FileNotFoundError:
        return []
    return list(struct.iter_unpack("<QQ", data[: len(data) // INDEX_ENTRY * INDEX_ENTRY]))


def frames(path: str, start: int = 0, expected: int | None = None, tolerate_torn_tail: bool = False) -> Iterator[tuple[int, int, int, bytes]]:
    """(byte offset, offset, checksum, content) of the frames from byte ``start`` on; ``expected`` is the first offset, if
    offsets must follow each other."""
    with open(path, "rb", buffering=1 << 20) as f:
        size = os.fstat(f.fileno()).st_size
        f.seek(start)
        at = start
        while at < size:
            head = f.read(HEAD)
            length = struct.unpack("<IQ", head)[1] if len(head) == HEAD else None
            if length is None or at + OVERHEAD + length > size:
                if tolerate_torn_tail:
                    return
                raise FrameError(f"{path}: incomplete frame at byte {at}")
            content = f.read(length)
            (offset,) = struct.unpack("<Q", f.read(8))
            if offset >= 1 << 63:
                raise FrameError(f"{path}: offset beyond 63 bits at byte {at}")
            if expected is not None:
                if offset != expected:
                    raise FrameError(f"{path}: offset {offset} where {expected} follows, at byte {at}")
                expected += 1
            yield at, offset, struct.unpack("<I", head[:4])[0], content
            at += OVERHEAD + length


def tail(path: str) -> tuple[int | None, int]:
    """(last offset, size) of a segment file, from its last eight bytes; no offset if it is empty."""
    with open(path, "rb") as f:
        size = os.fstat(f.fileno()).st_size
        if size < OVERHEAD:
            return None, size
        f.seek(-8, os.SEEK_END)
        return struct.unpack("<Q", f.read(8))[0], size


def position_of(path: str, offset: int, start: int = 0) -> tuple[int, int]:
    """(byte, frames passed) where ``offset`` begins, looking from byte ``start``, a frame's begin. The end of the frame
    before it is enough; so the offset that comes next in a file is found at its end."""
    if offset == 0:
        return 0, 0
    if start >= 8:
        with open(path, "rb") as f:
            f.seek(start - 8)
            if struct.unpack("<Q", f.read(8))[0] == offset - 1:
                return start, 0
    for n, (at, found, _, content) in enumerate(frames(path, start), 1):
        if found == offset - 1:
            return at + OVERHEAD + len(content), n
    raise FrameError(f"{path}: no offset {offset}")


def build_index(path: str, every: int = 10) -> bytes:
    """The sparse index of a segment file, as its file holds it."""
    block = None
    out = []
    for at, offset, _, _ in frames(path):
        block = offset if block is None else block
        if offset % every == 0 and offset != block:
            out.append(struct.pack("<QQ", offset, at))
    return b"".join(out)


def encode(contents: list[bytes], first: int) -> bytes:
    """Frames of ``contents`` with offsets from ``first`` on."""
    bodies = [struct.pack("<Q", len(c)) + c + struct.pack("<Q", first + i) for i, c in enumerate(contents)]
    return b"".join(struct.pack("<I", crc) + body for crc, body in zip(crc32c_many(bodies).tolist(), bodies, strict=True))


def _flag(options: dict, name: str, default: bool) -> bool:
    return str(options.get(name, default)).lower() == "true"


class _Bounds:
    """What pushed filters say of topic, block and offset."""

    def __init__(self):
        self.topic: str | None = None
        self.low: dict[str, int] = {}
        self.high: dict[str, int] = {}

    def take(self, f) -> bool:
        """Whether the filter is met by what is read, so that Spark needs not apply it."""
        name, value = (f.attribute[0], f.value) if hasattr(f, "attribute") and hasattr(f, "value") else (None, None)
        if name == "topic" and isinstance(f, EqualTo):
            if self.topic in (None, value):
                self.topic = value
                return True
            return False
        if name not in ("offset", "block") or not isinstance(value, int):
            return False
        low, high = {GreaterThanOrEqual: (value, None), GreaterThan: (value + 1, None), LessThan: (None, value - 1), LessThanOrEqual: (None, value), EqualTo: (value, value)}.get(type(f), (None, None))
        if low is None and high is None:
            return False
        if low is not None:
            self.low[name] = max(low, self.low.get(name, low))
        if high is not None:
            self.high[name] = min(high, self.high.get(name, high))
        return True

    def within(self, name: str, value: int) -> bool:
        return self.low.get(name, value) <= value <= self.high.get(name, value)


class SegmentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.verify, self.torn, self.gaps = _flag(options, "verify", False), _flag(options, "tolerate_torn_tail", False), _flag(options, "check_gaps", True)
        self.bounds = _Bounds()

    def pushFilters(self, filters):
        for f in filters:
            if not self.bounds.take(f):
                yield f

    def partitions(self):
        b = self.bounds
        found = [s for s in list_segments(self.path, "log") if b.topic in (None, s.topic) and b.within("block", s.block)]
        low, high = b.low.get("offset", 0), b.high.get("offset")
        return in_tasks([s for s in found if (s.upto is None or s.upto > low) and (high is None or s.block <= high)])

    def read(self, partition: Files):
        for s in partition.segments:
            yield from self._segment(s)

    def _segment(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        low, high = self.bounds.low.get("offset", 0), self.bounds.high.get("offset")
        start, expected = 0, partition.block
        if low > partition.block:
            index = read_index(partition.path.removesuffix(".log") + ".idx")
            if at := bisect_right(index, (low, 1 << 64)):
                expected, start = index[at - 1]
        rows: list[tuple] = []
        held = 0
        last = None
        for frame in frames(partition.path, start, expected if self.gaps else None, self.torn):
            at, last, crc, content = frame
            if high is not None and last > high:
                break
            if last < low:
                continue
            rows.append(frame)
            held += len(content)
            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield self._batch(partition, rows)
                rows, held = [], 0
        else:
            following = expected if last is None else last + 1
            if self.gaps and partition.upto is not None and following != partition.upto:
                raise FrameError(f"{partition.path}: ends before offset {following}, and the next segment begins at {partition.upto}")
        if rows:
            yield self._batch(partition, rows)

    def _batch(self, segment: Segment, rows: list[tuple]) -> pa.RecordBatch:
        places, offsets, sums, contents = zip(*rows, strict=True)
        if self.verify:
            found = crc32c_many([struct.pack("<Q", len(c)) + c + struct.pack("<Q", o) for c, o in zip(contents, offsets, strict=True)])
            if len(wrong := np.flatnonzero(found != np.array(sums, np.uint32))):
                raise FrameError(f"{segment.path}: checksum of offset {offsets[wrong[0]]}")
        n = len(rows)
        long = lambda x: pa.array(x, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([segment.topic] * n), long([segment.block] * n), long(offsets), pa.array(contents, pa.binary()), long(list(map(len, contents))), long(sums), long(places)], LOG_NAMES)


class IndexReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self):
        return in_tasks(list_segments(self.path, "idx"))

    def read(self, partition: Files):
        for s in partition.segments:
            with open(s.path, "rb") as f:
                data = f.read()
            pairs = np.frombuffer(data, "<i8", len(data) // INDEX_ENTRY * 2).reshape(-1, 2)
            if (pairs < 0).any():
                raise FrameError(f"{s.path}: a number beyond 63 bits")
            for part in (pairs[i : i + BATCH_ROWS] for i in range(0, len(pairs), BATCH_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array([s.topic] * len(part)), pa.array(np.full(len(part), s.block)), pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], INDEX_NAMES)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class SegmentWriter(DataSourceArrowWriter):
    """Writes rows with topic, block, offset, content, sorted so by the caller, to ``path``/topic/block.log with its index.

    A task writes under other names; the commit renames. A segment must come from one task."""

    def __init__(self, options: dict, schema):
        self.path, self.every = options["path"].removeprefix("file://").removeprefix("file:"), int(options.get("every", 10))
        names = schema.fieldNames()
        self.at = [names.index(x) for x in ("topic", "block", "offset", "content")]

    def write(self, batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        mark = f".tmp-{TaskContext.get().taskAttemptId()}"
        done, current, f = [], None, None
        held: list[bytes] = []
        index: list[bytes] = []
        first = expected = size = place = 0

        def flush():
            nonlocal held, first, size
            if held:
                f.write(encode(held, first))
            held, size, first = [], 0, expected

        def close():
            if f is not None:
                flush()
                f.close()
                with open(done[-1][0].replace(".log" + mark, ".idx" + mark), "wb") as g:
                    g.write(b"".join(index))

        for batch in batches:
            for topic, block, offset, content in zip(*(batch.column(i).to_pylist() for i in self.at), strict=True):
                if (topic, block) != current:
                    close()
                    if "/" in topic or topic.startswith("."):
                        raise ValueError(f"not a topic's name: {topic}")
                    if current is None or topic != current[0]:
                        os.makedirs(os.path.join(self.path, topic), mode=0o744, exist_ok=True)
                    name = os.path.join(self.path, topic, f"{block:020d}.log")
                    f = open(name + mark, "wb")  # noqa: SIM115
                    done.append((name + mark, name))
                    current, first, expected, index, place = (topic, block), offset, offset, [], 0
                if offset != expected:
                    raise ValueError(f"offset {offset} of {topic} where {expected} follows")
                if offset % self.every == 0 and place:  # as ``build_index`` finds it
                    index.append(struct.pack("<QQ", offset, place))
                held.append(content)
                size += len(content)
                place += OVERHEAD + len(content)
                expected += 1
                if size > 8 << 20:
                    flush()
        close()
        return Written(done)

    def commit(self, messages):
        for m in messages:
            for temporary, name in m.files if m else ():
                os.replace(temporary.replace(".log.", ".idx."), name.replace(".log", ".idx"))
                os.replace(temporary, name)

    def abort(self, messages):
        for m in messages:
            for temporary, _ in m.files if m else ():
                for x in (temporary, temporary.replace(".log.", ".idx.")):
                    if os.path.exists(x):
                        os.remove(x)


def segment_tails(spark: SparkSession, path: str) -> DataFrame:
    """(topic, block, last_offset, n_bytes) of the segment files below ``path``, each from its last bytes; an empty one has no last offset."""
    python_workers(spark)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, size = zip(*[tail(p) for p in batch.column(2).to_pylist()], strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(last, pa.int64()), pa.array(size, pa.int64())], ["topic", "block", "last_offset", "n_bytes"])

    return _files(spark, path).mapInArrow(look, "topic string, block long, last_offset long, n_bytes long")


def find_positions(spark: SparkSession, path: str, every: int) -> DataFrame:
    """(topic, block, offset, byte_offset, passed): for the offsets divisible by ``every`` of the segment files below ``path``, the byte
    at which their frame begins, looked for from the nearest index entry before, and the frames passed over from there."""
    python_workers(spark)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for topic, block, file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                index, (last, _) = read_index(file.removesuffix(".log") + ".idx"), tail(file)
                wanted = range(-(-block // every) * every, (block if last is None else last + 1), every)
                found = []
                for offset in wanted:
                    i = bisect_right(index, (offset, 1 << 64))
                    found.append((offset, *position_of(file, offset, index[i - 1][1] if i else 0)) if offset != block else (offset, 0, 0))
                columns = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([topic] * len(found), pa.string()), *[pa.array(x, pa.int64()) for x in ([block] * len(found), *columns)]], ["topic", "block", "offset", "byte_offset", "passed"])

    return _files(spark, path).mapInArrow(look, "topic string, block long, offset long, byte_offset long, passed long")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(topic, block, path) of segment files, a few a task."""
    found = [(s.topic, s.block, s.path) for s in list_segments(path, "log")]
    return spark.createDataFrame(found, "topic string, block long, path string").repartition(max(1, min(len(found), 1024)))


class Segments(DataSource):
    @classmethod
    def name(cls):
        return "segments"

    def schema(self):
        return LOG_SCHEMA

    def reader(self, schema):
        return SegmentReader(self.options)

    def writer(self, schema, overwrite):
        return SegmentWriter(self.options, schema)


class SegmentIndex(DataSource):
    @classmethod
    def name(cls):
        return "segment_index"

    def schema(self):
        return INDEX_SCHEMA

    def reader(self, schema):
        return IndexReader(self.options)


def register(spark: SparkSession) -> None:
    """Make both formats known to the session, filters pushed down."""
    python_workers(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Segments)
    spark.dataSource.register(SegmentIndex)
