"""The log in Parquet: append, read, list, follow.

``root/data/commit=<id>`` holds the entries that a write added, partitioned by topic and sorted by offset, with their block as a column:
so files grow with the bytes, not with the segments. (Commits without ``layout`` in their file have a folder for each block; they
are read all the same.) ``root/status`` has the state of every topic after it; ``root/commits/<n>.json`` publishes both. A commit's file is created under a new number or not at all, so of
two writers one comes first, and readers see whole commits only. A read fixes its commits when it is planned. Lease files say
who may write, to all topics or to some.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import log as ops
from millrace.operators import read
from millrace.tables import filesystem, stored

#: How a commit's data lies: 2 has the block in the files; None, as written before, in the folders.
LAYOUT = 2
SCHEMA = "offset long, content binary, byte_size long, batch_id long, topic string, block long"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
STATUS = "topic string, next_offset long, head_block long, head_bytes long, next_batch long"


class ReadOnlyError(PermissionError):
    """A write to a store that was opened for reading."""


class LeaseError(RuntimeError):
    """Another writer holds the store."""


@dataclass
class Lease:
    """A writer's claim: a file with the owner's name, stale ``seconds`` after it was last written.

    While the owner works (``kept``) it is written again each third of that time. The file is empty while it is written, so
    the owner's threads take turns."""

    spark: SparkSession
    path: str
    seconds: float = 10.0

    def __post_init__(self):
        self.owner = uuid.uuid4().hex
        self._turn = threading.RLock()

    def _put(self, overwrite: bool) -> bool:
        fs, path = filesystem(self.spark, self.path)
        with self._turn:
            try:
                out = fs.create(path, overwrite)
            except Exception as e:
                if "AlreadyExists" in str(e):
                    return False
                raise
            out.write(bytearray(self.owner.encode()))
            out.close()
        return True

    def holder(self) -> str | None:
        fs, path = filesystem(self.spark, self.path)
        with self._turn:
            return _text(self.spark, self.path) if fs.exists(path) else None

    def acquire(self) -> bool:
        """Take the claim if it is free, stale, or already ours (then it is renewed)."""
        if self._put(False):
            return True
        fs, path = filesystem(self.spark, self.path)
        if self.holder() == self.owner:
            return self._put(True)
        if fs.exists(path) and time.time() - fs.getFileStatus(path).getModificationTime() / 1000 > self.seconds:
            taken = filesystem(self.spark, f"{self.path}.{self.owner}")[1]
            if fs.rename(path, taken):  # of several that find it stale, one moves it away
                fs.delete(taken, False)
            return self._put(False)
        return False

    def renew(self) -> bool:
        return self.holder() == self.owner and self._put(True)

    def release(self) -> None:
        """Give the claim up, if it is ours."""
        if self.holder() == self.owner:
            fs, path = filesystem(self.spark, self.path)
            fs.delete(path, False)


    @contextmanager
    def kept(self) -> Iterator[Callable[[], bool]]:
        """Renew the claim from now on; the value says whether it is still ours."""
        lost, done = threading.Event(), threading.Event()
        if not self.renew():
            raise LeaseError(f"{self.path}: the lease was lost")

        def renew() -> None:
            while not done.wait(max(self.seconds, 0.3) / 3):
                try:
                    if self.renew():
                        continue
                except Exception:  # a claim that can't be renewed is as good as lost
                    pass
                lost.set()
                return

        thread = threading.Thread(target=renew, daemon=True)
        thread.start()
        try:
            yield lambda: not lost.is_set() and self.holder() == self.owner
        finally:
            done.set()
            thread.join()


class NoLease:
    """For stores that have one writer by other means: every claim is granted."""

    def acquire(self) -> bool:
        return True

    renew = acquire

    def holder(self) -> None:
        return None

    def release(self) -> None:
        pass

    @contextmanager
    def kept(self) -> Iterator[Callable[[], bool]]:
        yield lambda: True


def _text(spark: SparkSession, path: str) -> str:
    fs, where = filesystem(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


class LogStore:
    """Topics below ``root``, a path in any store that Spark reads and writes.

    A writer claims the whole store, or with ``topics`` only these: so several write at a time, each to topics of its own.
    ``lease_seconds`` None does without claims.
    """

    def __init__(self, spark: SparkSession, root: str, max_block: int = 1000 << 20, request: int = 1000, read_only: bool = False, lease_seconds: float | None = 10.0, topics: list[str] | None = None):
        self.spark, self.root, self.max_block, self.request, self.read_only = spark, root.rstrip("/"), max_block, request, read_only
        self.only = sorted(set(topics)) if topics is not None else None
        names = ["all"] if self.only is None else [f"topic-{hashlib.sha256(t.encode()).hexdigest()[:16]}" for t in self.only]
        self.leases = [NoLease()] if lease_seconds is None else [Lease(spark, f"{self.root}/leases/{n}", lease_seconds) for n in names]
        self._known: dict[int, dict] = {}
        if request < 1:
            raise ValueError("a request has one entry at least")
        if not read_only:
            self._claim()

    def _claim(self) -> None:
        """All claims or none. A claim on the whole store and one on a topic exclude each other."""
        taken = []
        for lease in self.leases:
            if not lease.acquire():
                break
            taken.append(lease)
        if len(taken) < len(self.leases) or self._others():
            for lease in taken:
                lease.release()
            raise LeaseError(f"{self.root} has a writer")

    def _others(self) -> bool:
        """Whether a claim of the other kind is held that is not stale."""
        lease = self.leases[0]
        if isinstance(lease, NoLease):
            return False
        fs, path = filesystem(self.spark, f"{self.root}/leases")
        mine = {x.path.rpartition("/")[2] for x in self.leases}
        for s in fs.listStatus(path):
            name = s.getPath().getName()
            if name not in mine and "." not in name and (self.only is None or name == "all") and time.time() - s.getModificationTime() / 1000 <= lease.seconds:
                return True
        return False

    @property
    def lease(self) -> Lease | NoLease:
        return self.leases[0]

    def close(self) -> None:
        if not self.read_only:
            for lease in self.leases:
                lease.release()

    def __enter__(self) -> LogStore:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def commits(self) -> list[int]:
        """Numbers of the published commits; they have no gap."""
        fs, path = filesystem(self.spark, f"{self.root}/commits")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def _manifests(self) -> dict[int, dict]:
        """What was published, by number. A file never changes: each is read once, many new ones by one job."""
        new = [n for n in self.commits() if n not in self._known]
        paths = {n: f"{self.root}/commits/{n:020d}.json" for n in new}
        if len(new) > 16:
            rows = self.spark.read.schema("id string, wrote long, token string, layout long").json(list(paths.values())).select(F.regexp_extract("_metadata.file_name", r"^(\d+)", 1).cast("long").alias("n"), "id", "wrote", "token", "layout")
            self._known |= {r.n: {"id": r.id, "wrote": r.wrote, "token": r.token} | ({"layout": r.layout} if r.layout else {}) for r in rows.collect()}
        else:
            self._known |= {n: json.loads(_text(self.spark, p)) for n, p in paths.items()}
        return self._known

    def status(self, commit: int | None = None) -> DataFrame:
        """(topic, next_offset, head_block, head_bytes, next_batch) as of the newest commit, or of a given one."""
        found = self._manifests()
        last = commit if commit is not None else max(found, default=None)
        if last is None or last < 0:
            return self.spark.createDataFrame([], STATUS)
        return self.spark.read.schema(STATUS).parquet(f"{self.root}/status/{found[last]['id']}-{last}")

    def topics(self) -> DataFrame:
        return read.topics(self.status().select("topic"))

    def list(self) -> list[str]:
        """Topic names, sorted."""
        return sorted(r.topic for r in self.topics().collect())

    def log(self, commits: list[int] | None = None) -> DataFrame:
        """LOG of the given commits, or of all that are published now."""
        found = self._manifests()
        paths: dict[int | None, list[str]] = {}
        for n in sorted(found) if commits is None else commits:
            if found[n]["wrote"]:
                paths.setdefault(found[n].get("layout"), []).append(f"{self.root}/data/commit={found[n]['id']}")
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        # one scan of all commits of a layout: ``commit`` is a partition column, read and dropped again
        read = self.spark.read.schema(SCHEMA + ", commit string").option("basePath", f"{self.root}/data")
        return reduce(DataFrame.union, [read.parquet(*p).select(*COLUMNS) for p in paths.values()])

    def write(self, entries: DataFrame, token: str | None = None) -> int:
        """Append ``entries`` (topic, content, o0, o1, ...: see ``as_entries``); returns how many. Nothing is published
        for none. With ``token``, a write that a commit already has under it is not repeated. The claim is renewed as long as it takes."""
        if self.read_only:
            raise ReadOnlyError(self.root)
        with ExitStack() as stack:
            ours = [stack.enter_context(lease.kept()) for lease in self.leases]
            if token is not None:
                for m in self._manifests().values():
                    if m["token"] == token:
                        return m["wrote"]
            return self._append(entries, token, lambda: all(held() for held in ours))

    def _append(self, entries: DataFrame, token: str | None, ours: Callable[[], bool]) -> int:
        name = uuid.uuid4().hex
        heads = self.status()
        numbered = ops.assign_offsets(entries, heads)
        first = heads.select("topic", F.col("next_offset").alias("was"), F.col("next_batch").alias("nb"))
        log = numbered.join(first, "topic", "left").withColumn("batch_id", F.expr(f"coalesce(nb, 0L) + (offset - coalesce(was, 0L)) div {int(self.request)}")).withColumn("byte_size", F.octet_length("content").cast("long")).drop("was", "nb")
        rolled = stored(ops.roll_blocks(ops.requests(log), self.max_block, heads), "requests")
        touched = rolled.select("topic").distinct()
        if self.only is not None and not touched.where(~F.col("topic").isin(self.only)).isEmpty():
            raise LeaseError(f"{self.root}: entries of a topic that this writer has not claimed")
        if rolled.isEmpty():
            return 0
        target = f"{self.root}/data/commit={name}"
        placed = ops.in_blocks(log, rolled).select(*COLUMNS)
        placed.repartitionByRange("topic", "block", "offset").sortWithinPartitions("topic", "block", "offset").write.partitionBy("topic").parquet(target)
        new = self.spark.read.schema(SCHEMA).parquet(target)
        now = new.groupBy("topic").agg((F.max("offset") + 1).alias("next_offset"), F.max("block").alias("head_block"), (F.max("batch_id") + 1).alias("next_batch"), F.count("*").alias("n"))
        ends = rolled.groupBy("topic").agg(F.max_by("head_bytes", "batch_id").alias("head_bytes"))
        now = stored(now.join(ends, "topic"), "heads")
        changed = now.select("topic", "next_offset", "head_block", "head_bytes", "next_batch")
        wrote = now.agg(F.sum("n")).first()[0]
        while True:  # a writer of other topics may publish first: then the next number is tried
            commit = max(self._manifests(), default=-1) + 1
            changed.unionByName(self.status().join(changed, "topic", "left_anti")).coalesce(8).write.parquet(f"{self.root}/status/{name}-{commit}")
            if not ours():
                raise LeaseError(f"{self.root}: the lease was lost")
            if self._publish(commit, {"id": name, "wrote": wrote, "token": token, "layout": LAYOUT}):
                return wrote
            if self.only is None:
                raise LeaseError(f"{self.root}: commit {commit} is another writer's")

    def _publish(self, commit: int, manifest: dict) -> bool:
        """Create the commit's file, whole; False if there is one."""
        fs, path = filesystem(self.spark, f"{self.root}/commits/{commit:020d}.json")
        hidden = filesystem(self.spark, f"{self.root}/commits/.{manifest['id']}-{commit}")[1]
        if fs.exists(path):
            return False
        out = fs.create(hidden, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return fs.rename(hidden, path)

    def read(self, topic: str, offset: int = 0, end: int | None = None) -> DataFrame:
        """(offset, content) of ``topic`` from ``offset`` up to the newest commit, or before ``end``; empty for an unknown topic.

        Catalyst skips what lies before: ``topic`` is a partition column, and Parquet has the least and greatest offset of each
        row group, rows being sorted by offset.
        """
        return read.read_from(self.log(), topic, offset, end)

    def read_batches(self, topic: str, offset: int = 0, size: int = 1000) -> DataFrame:
        """(block, read_batch, entries): the batches of a read, entries an ordered array of (offset, content)."""
        log = read.read_batches(self.log().where(F.col("topic") == topic), offset, size)
        return log.groupBy("block", "read_batch").agg(F.sort_array(F.collect_list(F.struct("offset", "content"))).alias("entries"))
