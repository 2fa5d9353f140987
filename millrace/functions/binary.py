"""Bytes of the log format: little-endian integers, frames, CRC-32C.

A frame is ``crc32c u32 | size u64 | content | offset u64``, little-endian; the checksum covers size, content and offset.
All but the checksum are built-in functions; the checksum is an Arrow function, vectorised over the rows of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.workers import python_workers

#: Bytes of a frame besides its content; bytes before the content; bytes of an index entry.
OVERHEAD, HEAD, INDEX_ENTRY = 20, 12, 16
#: Fixed value: the reflected Castagnoli polynomial.
_POLYNOMIAL = 0x82F63B78


def _table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(_POLYNOMIAL), x >> 1)
    return x


_TABLE = _table()


def _shift_tables() -> np.ndarray:
    """tables[k][j][b]: what byte j of a register, being b, contributes after 2 ** k zero bytes."""
    basis = np.array([[1 << (8 * j + i) for i in range(8)] for j in range(4)], np.uint32)
    out = []
    for _ in range(40):
        if not out:
            moved = _TABLE[basis & 0xFF] ^ (basis >> 8)
        else:
            moved = _apply(out[-1], _apply(out[-1], basis))
        table = np.zeros((4, 256), np.uint32)
        for i in range(8):
            table ^= np.where((np.arange(256)[None, :] >> i) & 1, moved[:, i : i + 1], 0).astype(np.uint32)
        out.append(table)
    return np.array(out)


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 0xFF] ^ table[1][(x >> 8) & 0xFF] ^ table[2][(x >> 16) & 0xFF] ^ table[3][x >> 24]


_SHIFTS = _shift_tables()
#: Values longer than this are cut into lanes that are run side by side and joined by shifting.
_LANE = 4096


def _lanes(data: np.ndarray) -> int:
    """CRC-32C register after ``data``, from zero, its lanes in step."""
    n = len(data) // _LANE
    body = data[: n * _LANE].reshape(n, _LANE)
    register = np.zeros(n, np.uint32)
    for i in range(_LANE):
        register = _TABLE[(register ^ body[:, i]) & 0xFF] ^ (register >> 8)
    k = _LANE.bit_length() - 1
    while len(register) > 1:  # neighbours join: the left one is moved past the right one
        if len(register) % 2:
            register = np.concatenate([np.zeros(1, np.uint32), register])
        register = _apply(_SHIFTS[k], register[::2]) ^ register[1::2]
        k += 1
    state = register[0] if n else np.uint32(0)
    for b in data[n * _LANE :]:
        state = _TABLE[(state ^ b) & 0xFF] ^ (state >> 8)
    return int(state)


def _zeros(register: int, n: int) -> int:
    x = np.array([register], np.uint32)
    for k in range(n.bit_length()):
        if n >> k & 1:
            x = _apply(_SHIFTS[k], x)
    return int(x[0])


def crc32c_many(values: list[bytes]) -> np.ndarray:
    """CRC-32C of each value. Short values run side by side, byte column by byte column; long ones in lanes."""
    sizes = np.array([len(v) for v in values], np.int64)
    out = np.zeros(len(values), np.uint32)
    short = np.flatnonzero(sizes <= _LANE)
    for group in np.array_split(short[np.argsort(sizes[short], kind="stable")], max(1, int(sizes[short].sum()) // (1 << 22))):
        if not len(group):
            continue
        width = int(sizes[group].max())
        block = np.zeros((width, len(group)), np.uint8)
        for j, i in enumerate(group.tolist()):
            if sizes[i]:
                block[width - sizes[i] :, j] = np.frombuffer(values[i], np.uint8)
        start = width - sizes[group]
        register = np.zeros(len(group), np.uint32)
        for p in range(width):
            register[start == p] = 0xFFFFFFFF
            register = _TABLE[(register ^ block[p]) & 0xFF] ^ (register >> 8)
        register[start == width] = 0xFFFFFFFF
        out[group] = register ^ 0xFFFFFFFF
    for i in np.flatnonzero(sizes > _LANE).tolist():
        out[i] = _lanes(np.frombuffer(values[i], np.uint8)) ^ _zeros(0xFFFFFFFF, int(sizes[i])) ^ 0xFFFFFFFF
    return out


def crc32c(data: Column) -> Column:
    """CRC-32C of a binary column, as a long; null for null."""
    python_workers()

    @F.pandas_udf("long")
    def checksum(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            found = crc32c_many([b"" if v is None else bytes(v) for v in s]).astype(np.int64)
            yield pd.Series(found).where(s.notna().to_numpy(), None).astype("Int64")

    return checksum(data)


def _swapped(x: Column, size: int) -> Column:
    digits = F.lpad(F.hex(x), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]))


def le64(x: Column) -> Column:
    """8 bytes, lowest first, of a non-negative long."""
    return _swapped(x.cast("long"), 8)


def le32(x: Column) -> Column:
    return _swapped(x.cast("long"), 4)


def from_le(data: Column, start: int, size: int) -> Column:
    """The number in ``size`` bytes of ``data`` from byte ``start`` (1 is the first); below 2 ** 63."""
    digits = F.hex(F.substring(data, start, size))
    return F.conv(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]), 16, 10).cast("long")


def frame_size(content: Column) -> Column:
    return (F.octet_length(content) + OVERHEAD).cast("long")


def covered(content: Column, offset: Column) -> Column:
    """What the checksum of a frame covers."""
    return F.concat(le64(F.octet_length(content)), content, le64(offset))


def frame(content: Column, offset: Column) -> Column:
    body = covered(content, offset)
    return F.concat(le32(crc32c(body)), body)
