"""The Parquet store: appends, reads, leases, streams."""

import os
import random
import threading
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import log as ops
from millrace.sources.store import Lease, LeaseError, LogStore, ReadOnlyError
from millrace.sources.text import read_lines
from millrace.streaming import follow


def entries(spark, rows):
    return ops.as_entries(spark.createDataFrame([(t, i, bytearray(c)) for t, i, c in rows], "t string, i long, c binary"), "t", "c", "i")


def test_appends(spark, tmp_path):
    rng = random.Random(2)
    letters = "abcæøåXYZ019"
    seen: dict[str, list[bytes]] = {}
    with LogStore(spark, str(tmp_path / "s"), max_block=300, request=10) as store:
        assert store.list() == [] and store.read("a").count() == 0 and store.write(entries(spark, []).limit(0)) == 0
        for _ in range(3):
            rows = [(rng.choice(["a", "b", ".h"]), i, "".join(rng.choice(letters) for _ in range(rng.randrange(30))).encode()) for i in range(60)]
            assert store.write(entries(spark, rows)) == 60
            for t, _, c in rows:
                seen.setdefault(t, []).append(c)
        assert store.list() == ["a", "b"] and len(store.commits()) == 3
        for t, contents in seen.items():
            for offset in (0, 1, 7, len(contents) - 1, len(contents), len(contents) + 9):
                got = [(r.offset, bytes(r.content)) for r in store.read(t, offset).orderBy("offset").collect()]
                assert got == list(enumerate(contents))[offset:]
            status = {r.topic: r for r in store.status().collect()}[t]
            mine = store.log().where(F.col("topic") == t)
            info = ops.block_info(mine).orderBy("block").collect()
            assert status.next_offset == len(contents) and status.head_block == info[-1].block and status.head_bytes == info[-1].n_bytes
            assert sum(r.n_entries for r in info) == len(contents) and all(r.n_bytes > 300 for r in info[:-1])
            batches = store.read_batches(t, 0, 4).collect()
            assert sorted(e.offset for b in batches for e in b.entries) == list(range(len(contents))) and all(len(b.entries) <= 4 for b in batches)
        assert ops.contiguity_violations(store.log()).count() == 0
        again = store.write(entries(spark, [("a", 0, b"x")]), token="once")
        assert again == store.write(entries(spark, [("a", 0, b"x")]), token="once") == 1 and len(store.commits()) == 4


def test_lease_and_read_only(spark, tmp_path):
    root = str(tmp_path / "s")
    store = LogStore(spark, root, lease_seconds=60)
    with pytest.raises(LeaseError):
        LogStore(spark, root, lease_seconds=60)
    reader = LogStore(spark, root, read_only=True)
    store.write(entries(spark, [("a", 0, b"x")]))
    assert reader.list() == ["a"]  # a reader sees later writes
    with pytest.raises(ReadOnlyError):
        reader.write(entries(spark, [("a", 0, b"x")]))
    reader.close()
    thief = LogStore(spark, root, lease_seconds=-1)  # finds any claim stale
    with pytest.raises(LeaseError):
        store.write(entries(spark, [("a", 0, b"x")]))
    store.close()
    assert thief.lease.holder() == thief.lease.owner
    thief.close()
    with LogStore(spark, root) as later:
        assert later.write(entries(spark, [("a", 0, b"y")])) == 1 and later.read("a").count() == 2


def test_large_entry(spark, tmp_path):
    with LogStore(spark, str(tmp_path / "s")) as store:
        store.write(entries(spark, [("big", 0, b"0123456789" * 2_000_000)]))
        assert store.read("big").select(F.octet_length("content")).first()[0] == 20_000_000


def test_streams(spark, tmp_path):
    root = str(tmp_path / "s")
    source = tmp_path / "in"
    for i in range(3):
        spark.range(i * 50, i * 50 + 50).select("id", F.concat(F.lit("t"), F.col("id") % 2).alias("t"), F.encode(F.col("id").cast("string"), "UTF-8").alias("c")).coalesce(1).write.mode("append").parquet(str(source))
    with LogStore(spark, root, max_block=200, request=5) as store:
        stream = spark.readStream.schema("id long, t string, c binary").option("maxFilesPerTrigger", 1).parquet(str(source))
        follow.ingest(stream, store, f"{root}/in", "t", "c", "id").awaitTermination()
        assert len(store.commits()) == 3 and {r.topic: r.next_offset for r in store.status().collect()} == {"t0": 75, "t1": 75}
        got: list = []
        handle = lambda df, n: got.extend((r.topic, r.offset, bytes(r.content)) for r in df.collect())
        follow.tail(store, f"{root}/tail", handle, "t1", 10, per_trigger=1).awaitTermination()
        assert sorted(o for _, o, _ in got) == list(range(10, 75)) and {t for t, _, _ in got} == {"t1"}
        follow.refresh_index(store, f"{root}/index", f"{root}/ix").awaitTermination()
        got.clear()
        store.write(entries(spark, [("t1", i, b"new") for i in range(40)]))
        follow.tail(store, f"{root}/tail", handle, "t1", 10).awaitTermination()
        assert sorted(o for _, o, _ in got) == list(range(75, 115))  # each commit once
        follow.refresh_index(store, f"{root}/index", f"{root}/ix").awaitTermination()
        expected = ops.byte_offsets(store.log()).where("offset % 10 = 0 and offset <> block").select("topic", "block", "offset", "byte_offset")
        assert sorted(map(tuple, spark.read.parquet(f"{root}/index").select("topic", "block", "offset", "byte_offset").collect())) == sorted(map(tuple, expected.collect()))


def test_follow(spark, tmp_path):
    with LogStore(spark, str(tmp_path / "s")) as store:
        assert list(follow.follow(store, "a", stop_on_completion=True)) == []
        store.write(entries(spark, [("a", i, str(i).encode()) for i in range(25)]))
        batches = list(follow.follow(store, "a", 3, 10, stop_on_completion=True))
        assert [n for n, _ in batches] == [3, 13, 23] and [o for _, b in batches for o, _ in b] == list(range(3, 25))
        timer = threading.Timer(1.0, lambda: store.write(entries(spark, [("a", 0, b"late")])))
        timer.start()
        live = [o for _, b in follow.follow(store, "a", 24, 10, poll=0.2, ttl=8) for o, _ in b]
        timer.join()
        assert live == [24, 25]


def test_text_lines(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes("one\r\n\ntwo\rstill two\nthree æ".encode())
    rows = [bytes(r.content).decode() for r in read_lines(spark, str(tmp_path / "x.txt")).orderBy("o0").collect()]
    assert rows == ["one", "two\rstill two", "three æ"]


def test_lease_is_renewed_while_writing(spark, tmp_path):
    lease = LogStore(spark, str(tmp_path / "s"), lease_seconds=0.9).lease
    other = Lease(spark, lease.path, 0.9)
    with lease.kept() as ours:
        time.sleep(2.5)
        assert ours() and not other.acquire()
    time.sleep(1.5)
    assert other.acquire() and not lease.renew()
    with pytest.raises(LeaseError), lease.kept():
        pass


def test_writers_of_different_topics(spark, tmp_path):
    """Both write at the same time; commits come one after the other and none is lost."""
    root = str(tmp_path / "s")
    stores = [LogStore(spark, root, lease_seconds=60, topics=[t]) for t in "ab"]
    failed = []

    def write(store, topic):
        try:
            for k in range(3):
                store.write(entries(spark, [(topic, i, f"{k}-{i}".encode()) for i in range(5)]))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=x) for x in zip(stores, "ab", strict=True)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and len(stores[0].commits()) == 6
    for t in "ab":
        assert [bytes(r.content).decode() for r in stores[0].read(t).orderBy("offset").collect()] == [f"{k}-{i}" for k in range(3) for i in range(5)]
    assert {r.topic: r.next_offset for r in stores[0].status().collect()} == {"a": 15, "b": 15}
    with pytest.raises(LeaseError):
        stores[0].write(entries(spark, [("c", 0, b"x")]))


def test_a_batch_hands_over_its_commits_only(spark, tmp_path):
    """Commits come by time of their files: one that was published late is not handed over with its neighbours."""
    root = str(tmp_path / "s")
    with LogStore(spark, root) as store:
        for i in range(3):
            store.write(entries(spark, [("a", 0, str(i).encode())]))
        now = time.time()
        for i, back in enumerate((300, 100, 200)):
            os.utime(f"{root}/commits/{i:020d}.json", (now - back, now - back))
        got = []
        follow.tail(store, f"{root}/tail", lambda df, n: got.append(sorted(r.offset for r in df.collect())), per_trigger=2).awaitTermination()
        assert got == [[0, 2], [1]]


def test_many_commits_are_read_by_one_job(spark, tmp_path):
    root = str(tmp_path / "s")
    with LogStore(spark, root, lease_seconds=None) as store:
        store.write(entries(spark, [("a", 0, b"0")]), token="first")
        manifest = store._manifests()[0]
        for n in range(1, 20):  # empty commits
            assert store._publish(n, {"id": manifest["id"], "wrote": 0, "token": str(n)})
        assert not store._publish(7, manifest)
        fresh = LogStore(spark, root, read_only=True)
        assert len(fresh._manifests()) == 20 and fresh._manifests()[0] == manifest and fresh.log().count() == 1


def test_files_do_not_grow_with_segments(spark, tmp_path):
    root = tmp_path / "s"
    with LogStore(spark, str(root), max_block=100, request=5) as store:
        for _ in range(2):
            store.write(entries(spark, [("ab"[i % 2], i, str(i).encode()) for i in range(1500)]))
        assert store.log().select("topic", "block").distinct().count() > 300
        assert len(list(root.glob("data/**/*.parquet"))) < 40
        assert sorted((r.topic, r.offset) for r in store.log().collect()) == [(t, o) for t in "ab" for o in range(1500)]


def test_commits_with_a_folder_for_each_block_are_read(spark, tmp_path):
    """As stores had them before: between commits of now, and read by one job with others."""
    root = str(tmp_path / "s")
    with LogStore(spark, root, max_block=100, request=5) as store:
        store.write(entries(spark, [("a", i, str(i).encode()) for i in range(30)]))
        first = store._manifests()[0]
        was = sorted(map(tuple, store.log().collect()))
        store.log().write.partitionBy("topic", "block").parquet(f"{root}/data/commit=old")
        (tmp_path / "s/commits" / f"{0:020d}.json").write_text('{"id": "old", "wrote": 30, "token": null}')
        (tmp_path / "s/commits" / f".{0:020d}.json.crc").unlink(missing_ok=True)
        os.rename(f"{root}/status/{first['id']}-0", f"{root}/status/old-0")
    with LogStore(spark, root, max_block=100, request=5) as store:
        assert sorted(map(tuple, store.log().collect())) == was
        store.write(entries(spark, [("a", i, b"new") for i in range(30)]))
        for n in range(2, 20):
            assert store._publish(n, {"id": "none", "wrote": 0, "token": None, "layout": 2})
    store = LogStore(spark, root, read_only=True)
    assert store.log().columns == ["offset", "content", "byte_size", "batch_id", "topic", "block"]
    assert [r.offset for r in store.read("a", 20).orderBy("offset").collect()] == list(range(20, 60)) and ops.contiguity_violations(store.log()).count() == 0


def test_owner_sees_its_claim_while_it_is_renewed(spark, tmp_path):
    """index_refresh once lost its lease so: the file is empty between its creation and its close."""
    lease = LogStore(spark, str(tmp_path / "s"), lease_seconds=60).lease
    done = threading.Event()
    failed = []

    def renew():
        try:
            while not done.is_set():
                assert lease.renew()
        except BaseException as e:
            failed.append(e)

    thread = threading.Thread(target=renew)
    thread.start()
    try:
        seen = {lease.holder() for _ in range(300)}
    finally:
        done.set()
        thread.join()
    assert seen == {lease.owner} and not failed


def test_follow_takes_compressed_pieces(spark, tmp_path, monkeypatch):
    """What a follower gets, in order, across partitions and pieces; rows reach the driver in pieces, not one by one."""
    rows = [(o, bytes(range(o % 40)) * 5) for o in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array([o for o, _ in rows], pa.int64()), pa.array([c for _, c in rows])], ["offset", "content"])
    packed = [x for b in follow._pack(iter([batch])) for x in b.column(0).to_pylist()]
    assert len(packed) == 1 and len(packed[0]) < batch.nbytes / 5
    monkeypatch.setattr(follow, "PIECE_BYTES", 1000)
    pieces = list(follow._pieces(batch))
    assert len(pieces) > 100 and pa.Table.from_batches(pieces).equals(pa.Table.from_batches([batch]))
    assert [p.num_rows for p in follow._pieces(batch.slice(0, 0))] == []
    with LogStore(spark, str(tmp_path / "s"), max_block=5000, request=10) as store:
        store.write(entries(spark, [("a", o, c) for o, c in rows]))
        store.write(entries(spark, [("a", 0, b""), ("b", 0, b"x")]))
        got = list(follow.follow(store, "a", 7, 100, stop_on_completion=True))
        assert [first for first, _ in got] == list(range(7, 3001, 100)) and [r for _, b in got for r in b] == [*rows, (3000, b"")][7:]
