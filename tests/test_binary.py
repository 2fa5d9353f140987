"""Frames, checksums and little-endian integers."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import binary, render
from millrace.sources import segments

GOLDEN = {
    (b"dummy", 0): "77b20daf050000000000000064756d6d790000000000000000",
    (b"dummy1", 0): "f03f9c78060000000000000064756d6d79310000000000000000",
    (b"dummy2", 1): "fe4e0f28060000000000000064756d6d79320100000000000000",
    (b"dummy3", 2): "df1f7507060000000000000064756d6d79330200000000000000",
}


def slow_crc(data: bytes) -> int:
    x = 0xFFFFFFFF
    for b in data:
        x ^= b
        for _ in range(8):
            x = x >> 1 ^ (0x82F63B78 if x & 1 else 0)
    return x ^ 0xFFFFFFFF


def test_checksum():
    values = [b"", b"123456789", b"a", b"x" * 4095, b"y" * 4096, bytes(range(256)) * 17, bytes(range(256)) * 100 + b"z", b"\0" * 9000]
    assert binary.crc32c_many(values).tolist() == [slow_crc(v) for v in values]
    assert binary.crc32c_many([b"123456789"])[0] == 0xE3069283
    assert len(binary.crc32c_many([])) == 0


@settings(deadline=None)
@given(st.lists(st.binary(max_size=30), max_size=8), st.integers(0, 9000))
def test_any_checksum(values, n):
    values.append(bytes(i * i % 251 for i in range(n)))
    assert binary.crc32c_many(values).tolist() == [slow_crc(v) for v in values]


def test_golden_frames(spark):
    df = spark.createDataFrame([(bytearray(c), o) for c, o in GOLDEN], "content binary, offset long")
    got = {(bytes(r.content), r.offset): bytes(r.frame).hex() for r in df.withColumn("frame", binary.frame(F.col("content"), F.col("offset"))).collect()}
    assert got == GOLDEN
    assert all(segments.encode([c], o).hex() == x for (c, o), x in GOLDEN.items())


@pytest.mark.parametrize("n", [0, 1, 255, 256, 1 << 31, (1 << 63) - 1])
def test_little_endian(spark, n):
    row = spark.range(1).select(binary.le64(F.lit(n)).alias("a"), binary.from_le(binary.le64(F.lit(n)), 1, 8).alias("b"), binary.le32(F.lit(n % (1 << 32))).alias("c")).first()
    assert bytes(row.a) == n.to_bytes(8, "little") and row.b == n and bytes(row.c) == (n % (1 << 32)).to_bytes(4, "little")


def test_lines(spark):
    df = spark.createDataFrame([(3, bytearray("æ x".encode()), 40)], "offset long, content binary, at long")
    assert df.select(render.entry_line(F.col("offset"), F.col("content"))).first()[0] == "3\tæ x"
    assert df.select(render.index_line(F.col("offset"), F.col("at"))).first()[0] == "3 -> 40"
