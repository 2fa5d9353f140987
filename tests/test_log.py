"""Offsets, segments, index and reads, against plain Python and DuckDB."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from millrace.operators import index, log, read
from millrace.plans import queries


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), i, bytes(rng.randrange(300))) for i in range(3000)]
    entries = log.as_entries(spark.createDataFrame([(t, i, bytearray(c)) for t, i, c in rows], "t string, i long, c binary"), "t", "c", "i")
    return rows, log.with_blocks(log.with_requests(log.assign_offsets(entries), 7), 5000).cache()


def by_hand(rows, request, most):
    out = []
    for t in sorted({t for t, _, _ in rows}):
        mine = [c for x, _, c in sorted(rows, key=lambda r: r[1]) if x == t]
        block, head = None, 0
        for at in range(0, len(mine), request):
            if block is None or head > most:
                block, head = at, 0
            for o in range(at, min(at + request, len(mine))):
                out.append((t, o, block, head, at // request))
                head += len(mine[o]) + 20
    return out


def test_segments_and_bytes(made):
    rows, df = made
    assert sorted((r.topic, r.offset, r.block, r.byte_offset, r.batch_id) for r in log.byte_offsets(df).collect()) == by_hand(rows, 7, 5000)
    assert log.contiguity_violations(df).count() == 0


def test_index_lookups(spark, made):
    _, df = made
    rows = {(r.topic, r.offset): (r.block, r.byte_offset) for r in log.byte_offsets(df).collect()}
    idx = index.sparse_index(df)
    expected = {(t, b, o): x for (t, o), (b, x) in rows.items() if o % 10 == 0 and o != b}
    assert {(r.topic, r.block, r.offset): r.byte_offset for r in idx.collect()} == expected
    info = log.block_info(df)
    targets = df.select("topic", F.col("offset").alias("target")).union(spark.createDataFrame([("a", 10**6)], "t string, o long"))
    found = index.find_blocks(targets, info)
    assert {(r.topic, r.target): r.block for r in found.collect()} == {**{k: b for k, (b, _) in rows.items()}, ("a", 10**6): None}
    for r in index.nearest_entry(found.where("block is not null"), idx).collect():
        known = [(o, x) for (t, b, o), x in expected.items() if t == r.topic and b == r.block and o <= r.target]
        assert (r.index_offset, r.byte_offset) == (max(known) if known else (0, 0))
    counts = index.scan_counts(index.nearest_entry(found.where("block is not null"), idx))
    assert counts.agg(F.max("scanned")).first()[0] <= 19


def test_lookup_fixture(spark):
    entries = spark.createDataFrame([("t", 0, 10 * k, 100 * k) for k in range(1, 10)], "topic string, block long, offset long, byte_offset long")
    asked = spark.createDataFrame([("t", 0, x) for x in (3, 45, 40, 1999)], "topic string, block long, target long")
    assert {r.target: (r.index_offset, r.byte_offset) for r in index.nearest_entry(asked, entries).collect()} == {3: (0, 0), 45: (40, 400), 40: (40, 400), 1999: (90, 900)}
    assert [tuple(r)[2:] for r in index.index_head(entries).collect()] == [(90, 900)] and index.index_head(entries.limit(0)).count() == 0


@pytest.mark.parametrize("n,most,head,blocks", [(1, 20000, 190, [0]), (3, 2000, 2990, [0, 1000, 2000])])
def test_index_heads(spark, n, most, head, blocks):
    size = 200 if n == 1 else 1000
    rows = spark.range(n * size).select(F.lit("t").alias("t"), "id", F.encode(F.concat(F.lit("dummy"), (F.col("id") % (100 if n == 1 else 1000)).cast("string")), "UTF-8").alias("c"))
    df = log.with_blocks(log.with_requests(log.assign_offsets(log.as_entries(rows, "t", "c", "id")), 100 if n == 1 else 1000), most)
    assert index.sparse_index(df).agg(F.max("offset")).first()[0] == head
    assert sorted(r.block for r in log.block_info(df).collect()) == blocks


@pytest.mark.parametrize("size", [1, 10, 1000, 5000])
def test_reads(made, size):
    rows, df = made
    total = sum(t == "a" for t, _, _ in rows)
    for offset in (0, 1, 9, 10, 500, total - 1, total, total + 5):
        assert read.read_from(df, "a", offset).count() == max(0, total - offset)
        got = read.batches(df.where("topic = 'a'"), offset, size).collect()
        assert sum(r.n for r in got) == max(0, total - offset) and all(r.n <= size and r.last_offset - r.first_offset == r.n - 1 for r in got)
    assert read.read_from(df, "unknown", 0).count() == 0
    with pytest.raises(ValueError):
        read.read_batches(df, 0, 0)


def test_capped_batches(made):
    rows, df = made
    got = {(r.topic, r.offset): (r.block, r.read_batch) for r in read.capped_batches(df, 5, 10, 600).collect()}
    size = {}
    for t, _, c in sorted(rows, key=lambda r: r[1]):
        size.setdefault(t, []).append(len(c))
    block = {(r.topic, r.offset): r.block for r in df.select("topic", "offset", "block").collect()}
    for t, sizes in size.items():
        at, number, n, held = None, 0, 0, 0
        for o in range(5, len(sizes)):
            if block[t, o] != at:
                at, number, n, held = block[t, o], 0, 0, 0
            elif n == 10 or held > 600:
                number, n, held = number + 1, 0, 0
            n, held = n + 1, held + sizes[o]
            assert got[t, o] == (at, number)
    with pytest.raises(ValueError):
        read.capped_batches(df, 0, 0, 1)


def test_empty_and_null(spark):
    empty = log.as_entries(spark.createDataFrame([], "t string, c binary, i long"), "t", "c", "i")
    assert log.with_blocks(log.with_requests(log.assign_offsets(empty), 3), 10).count() == 0
    odd = log.as_entries(spark.createDataFrame([(None, None, 1), ("t", None, 2), (".hidden", bytearray(b"x"), 3)], "t string, c binary, i long"), "t", "c", "i")
    got = log.assign_offsets(odd)
    assert sorted((r.topic, r.offset, bytes(r.content)) for r in got.collect()) == [(".hidden", 0, b"x"), ("t", 0, b"")]
    assert [r.topic for r in read.topics(got).collect()] == ["t"]


def test_queries_equal_their_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("events", "documents"):
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    sql = queries.oracle_sql()
    for name, query in queries.queries().items():
        df = query(spark, sf_dir)
        got = df.collect()
        if name not in sql:
            assert got
            continue
        cur = con.execute(sql[name])
        at = [[d[0] for d in cur.description].index(c) for c in df.columns]
        assert sorted(repr(tuple(r)) for r in got) == sorted(repr(tuple(r[i] for i in at)) for r in cur.fetchall()), name


def test_whole_log_is_rendered(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type is not null")
    got = queries.render_lines(spark, sf_dir)
    assert got.distinct().count() == got.count() == events.count()


def test_every_offset_is_looked_up(spark, sf_dir):
    rows = queries.numbered(spark, sf_dir).select("topic", "offset")
    n, topics = rows.count(), rows.select("topic").distinct().count()
    assert queries.offset_to_block(spark, sf_dir).distinct().count() == n + topics
    for query in (queries.index_lookup, queries.scan_count):
        assert query(spark, sf_dir).select("topic", F.col("target").alias("offset")).exceptAll(rows).count() == 0 and query(spark, sf_dir).count() == n
    assert queries.contiguity_check(spark, sf_dir).count() == 0 < queries.contiguity_gaps(spark, sf_dir).count()


def test_blocks_are_found_across_partitions(spark):
    """Many partitions of targets between two starts; before the first, beyond the last, and in a topic without segments."""
    blocks = spark.createDataFrame([("t", 5, 99), ("t", 100, 5000), ("u", 0, 3)], "topic string, block long, last_offset long")
    targets = spark.range(0, 5100, 1, 16).select(F.lit("t").alias("topic"), F.col("id").alias("target")).union(spark.createDataFrame([("u", 2), ("u", 4), ("v", 0)], "topic string, target long"))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.topic, r.target): r.block for r in index.find_blocks(targets, blocks).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert got == {("t", i): None if i < 5 or i > 5000 else 5 if i < 100 else 100 for i in range(5100)} | {("u", 2): 0, ("u", 4): None, ("v", 0): None}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(queries.queries()) <= set(__spark_entry__.queries())
