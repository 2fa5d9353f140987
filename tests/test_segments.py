"""Segment and index files, by hand and through Spark."""

import struct

import pytest
from pyspark.sql import functions as F

from millrace.sources import segments


@pytest.fixture
def three(tmp_path):
    path = tmp_path / "topic" / f"{0:020d}.log"
    path.parent.mkdir()
    path.write_bytes(segments.encode([b"dummy1", b"dummy2", b"dummy3"], 0))
    return str(path)


def test_tail_and_positions(three):
    assert segments.tail(three) == (2, 78)
    wanted = {(0, 0): (0, 0), (1, 0): (26, 1), (2, 0): (52, 2), (1, 26): (26, 0), (2, 26): (52, 1), (2, 52): (52, 0), (3, 52): (78, 1), (3, 78): (78, 0)}
    assert {k: segments.position_of(three, *k) for k in wanted} == wanted
    with pytest.raises(segments.FrameError):
        segments.position_of(three, 9)


def test_index_of_ten(tmp_path):
    path = tmp_path / "0.log"
    path.write_bytes(segments.encode([f"dummy{i}".encode() for i in range(10)], 0))
    data = segments.build_index(str(path), 1)
    (tmp_path / "0.idx").write_bytes(data + b"torn")
    assert segments.read_index(str(tmp_path / "0.idx")) == [(i, 26 * i) for i in range(1, 10)]
    assert segments.read_index(str(tmp_path / "no.idx")) == [] and path.stat().st_size == 260


@pytest.fixture
def logs(spark, tmp_path):
    segments.register(spark)
    root = str(tmp_path / "logs")
    rows = [(t, o // 40 * 40, o, f"{t}{o}æ".encode() * (o % 5)) for t in ("a", "b") for o in range(100)]
    df = spark.createDataFrame([(t, b, o, bytearray(c)) for t, b, o, c in rows], "topic string, block long, offset long, content binary")
    df.repartition("topic", "block").sortWithinPartitions("topic", "block", "offset").write.format("segments").mode("append").option("path", root).save()
    return root, rows


def test_round_trip(spark, logs):
    root, rows = logs
    df = spark.read.format("segments").option("verify", "true").load(root)
    assert sorted((r.topic, r.block, r.offset, bytes(r.content)) for r in df.collect()) == sorted(rows)
    index = spark.read.format("segment_index").load(root)
    assert index.where("topic = 'a'").count() == 7  # 10, 20, 30, 50, 60, 70, 90
    for o in (0, 1, 39, 40, 55, 99, 100):
        got = df.where((F.col("topic") == "b") & (F.col("offset") >= o))
        assert sorted(r.offset for r in got.collect()) == list(range(o, 100))
        assert df.where((F.col("offset") > o) & (F.col("offset") <= o + 3) & (F.col("topic") == "a")).count() == len([x for x in range(100) if o < x <= o + 3])
    plan = df.where((F.col("topic") == "b") & (F.col("offset") >= 70))._jdf.queryExecution().executedPlan().toString()
    assert "offset" not in plan.split("BatchScan")[0] or ">= 70" not in plan.split("BatchScan")[0]
    assert df.where("block = 80").count() == 40


def test_torn_and_odd_files(spark, logs, tmp_path):
    root, _ = logs
    name = f"{root}/a/{80:020d}.log"
    with open(name, "ab") as f:
        f.write(b"\1\2\3")
    (tmp_path / "logs/a/note.log").write_bytes(b"")
    (tmp_path / "logs/a/1.dummy").write_bytes(b"x")
    (tmp_path / "logs/.git").mkdir()
    with pytest.warns(UserWarning):
        assert [s.block for s in segments.list_segments(f"{root}/a", "log")] == [0, 40, 80]
    with pytest.raises(Exception, match="incomplete frame"):
        spark.read.format("segments").load(name).count()
    assert spark.read.format("segments").option("tolerate_torn_tail", "true").load(name).count() == 20
    with open(name, "r+b") as f:
        f.seek(0)
        f.write(b"\0\0\0\0")
    with pytest.raises(Exception, match="checksum"):
        spark.read.format("segments").option("verify", "true").option("tolerate_torn_tail", "true").load(name).collect()
    with pytest.raises(FileNotFoundError):
        segments.list_segments(f"{root}/none", "log")


def test_gap(spark, tmp_path):
    segments.register(spark)
    path = tmp_path / "7.log"
    path.write_bytes(segments.encode([b"a"], 7) + segments.encode([b"b"], 9))
    with pytest.raises(Exception, match="offset 9 where 8 follows"):
        spark.read.format("segments").load(str(path)).collect()
    assert spark.read.format("segments").option("check_gaps", "false").load(str(path)).count() == 2


def test_missing_segment(spark, tmp_path):
    """A gap between files is an error, unless gaps are allowed; not where the reader stops before it."""
    segments.register(spark)
    (tmp_path / "0.log").write_bytes(segments.encode([b"a", b"b", b"c"], 0))
    (tmp_path / "5.log").write_bytes(segments.encode([b"f", b"g"], 5))
    df = spark.read.format("segments").load(str(tmp_path))
    with pytest.raises(Exception, match="ends before offset 3, and the next segment begins at 5"):
        df.collect()
    assert sorted(r.offset for r in spark.read.format("segments").option("check_gaps", "false").load(str(tmp_path)).collect()) == [0, 1, 2, 5, 6]
    assert sorted(r.offset for r in df.where("offset < 2").collect()) == [0, 1] and df.where("offset >= 5").count() == 2
    (tmp_path / "3.log").write_bytes(segments.encode([b"d", b"e"], 3))
    assert spark.read.format("segments").load(str(tmp_path)).count() == 7


def test_batches(spark, tmp_path, monkeypatch):
    segments.register(spark)
    (tmp_path / "0.log").write_bytes(segments.encode([bytes([i % 251]) * (i % 50) for i in range(20_000)], 0))
    rows = spark.read.format("segments").option("verify", "true").load(str(tmp_path)).collect()
    assert [(r.offset, bytes(r.content)) for r in rows] == [(i, bytes([i % 251]) * (i % 50)) for i in range(20_000)]


def test_tails_and_positions_by_spark(spark, logs):
    root, rows = logs
    tails = {(r.topic, r.block): (r.last_offset, r.n_bytes) for r in segments.segment_tails(spark, root).collect()}
    assert tails == {(t, b): (max(o for x, y, o, _ in rows if (x, y) == (t, b)), sum(20 + len(c) for x, y, _, c in rows if (x, y) == (t, b))) for t in "ab" for b in (0, 40, 80)}
    at = {(r.topic, r.offset): r.byte_offset for r in spark.read.format("segments").load(root).collect()}
    found = segments.find_positions(spark, root, 7).collect()
    assert {(r.topic, r.offset): r.byte_offset for r in found} == {k: v for k, v in at.items() if k[1] % 7 == 0} and all(r.passed <= 10 for r in found)


def test_tasks_do_not_grow_with_files(spark, tmp_path):
    """Thousands of small files are read by a few tasks, in either format; large ones by a task each."""
    segments.register(spark)
    root = str(tmp_path / "logs")
    df = spark.range(3000).selectExpr("'t' as topic", "id div 3 * 3 as block", "id as offset", "encode(cast(id as string), 'UTF-8') as content")
    df.repartition(4, "topic", "block").sortWithinPartitions("topic", "block", "offset").write.format("segments").mode("append").option("path", root).option("every", 2).save()
    rows = spark.read.format("segments").option("verify", "true").load(root)
    assert rows.rdd.getNumPartitions() == 8 and sorted((r.block, r.offset, bytes(r.content)) for r in rows.collect()) == [(i // 3 * 3, i, str(i).encode()) for i in range(3000)]
    index = spark.read.format("segment_index").load(root)
    assert index.rdd.getNumPartitions() == 8
    found = segments.list_segments(root, "log")
    wanted = [("t", s.block, *x) for s in found for x in struct.iter_unpack("<QQ", segments.build_index(s.path, 2))]
    assert len(found) == 1000 and sorted(map(tuple, index.collect())) == wanted and len(wanted) == 1000
    assert [len(x.segments) for x in segments.in_tasks(found)] == [128] * 7 + [104]
    with open(found[1].path, "ab") as f:
        f.truncate(segments.TASK_BYTES)
    assert [len(x.segments) for x in segments.in_tasks(found[:3])] == [2, 1] and [x.segments for x in segments.in_tasks([])] == [[]]
