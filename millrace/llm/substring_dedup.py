"""Substring dedup by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the least hash of its runs of ANCHOR words; consecutive windows of a
text that share a minimiser form a super-k-mer, which travels as one packed string of words to the bucket of the
minimiser. Equal windows have equal minimisers, so a bucket sees all of them: it sorts its windows by a hash, compares the
words of equal neighbours, and so knows exactly which window started earlier.

An anchor that very many super-k-mers would share (the edge of a passage that a third of the documents quote) would make one bucket
grow with the corpus. A first pass counts anchors over all documents; the common ones, a list of bounded length, come last in
the order, so a window that has any other anchor goes by that. Windows that have none go to one of several buckets of their
minimiser, by mapper; what is first there goes on to the minimiser's own bucket in a second, small round.

Mappers work on blocks of some megabytes. A window that already started earlier in its block is settled there and does
not travel, so a group of copies sends a bucket one window a block at most, however many copies a block holds. What a block
sends to a partition is packed and compressed together, whatever its buckets; a partition's buckets are then sorted and taken one by one.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import input_bytes, python_workers, stored, text_of

WINDOW, ANCHOR = 20, 4
#: Bytes of text of a mapper's block; bytes of the (compressed) input that make one bucket, and one partition of buckets.
BLOCK_BYTES, BUCKET_BYTES, PART_BYTES = 8 << 20, 1 << 20, 32 << 20
#: Bucket of spans that are settled.
SETTLED = -1

#: An anchor is counted in a block that has it FEW times, and common if all have it COMMON times, or, if that is more, a MOST-th of all is it.
FEW, COMMON, MOST = 8, 4096, 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_ODD = np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD
    return x ^ (x >> np.uint64(27))


def _window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash of every ``size`` consecutive word hashes, wrapping at 64 bits; spans are doubled, then joined."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    out, done, span, length, power = None, 0, words, 1, _BASE
    while True:
        if size & length:  # the spans done so far, then this one
            out = span if out is None else out[: len(span) - done] * power + span[done:]
            done += length
        if done == size:
            return out
        span, length, power = span[:-length] * power + span[length:], 2 * length, np.uint64(int(power) ** 2 % (1 << 64))


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values."""
    done = 1
    while 2 * done <= size:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (size - done)], x[size - done :]) if size > done else x


def later(codes: np.ndarray, at: np.ndarray, hashes: np.ndarray, place: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """For windows of ``codes`` that begin at ``at``, ascending in ``place``: whether an equal one has a smaller place.

    Exact: the words of windows with equal hashes are compared.
    """
    order = np.argsort(hashes)
    sorted_ = hashes[order]
    same = sorted_[1:] == sorted_[:-1]
    pairs = np.flatnonzero(same)
    out = np.zeros(len(at), bool)
    if len(pairs):
        begins = np.flatnonzero(np.append(True, ~same))
        least = np.minimum.reduceat(place[order], begins)
        run = np.cumsum(np.append(False, ~same))
        out[order] = place[order] != least[run]
        a, b = at[order[pairs]], at[order[pairs + 1]]
        equal = np.ones(len(pairs), bool)
        for i in range(size):
            equal &= codes[a + i] == codes[b + i]
        for r in set(run[pairs[~equal]].tolist()):  # different windows of one hash: the words themselves settle the run
            seen: dict[bytes, int] = {}
            end = begins[r + 1] if r + 1 < len(begins) else len(order)
            for k in np.sort(order[begins[r] : end]).tolist():
                out[k] = seen.setdefault(codes[at[k] : at[k] + size].tobytes(), int(place[k])) != place[k]
    return out


def _runs(flags: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true ``flags``; a true ``breaks[i]`` starts a new run at i."""
    begin = flags.copy()
    begin[1:] &= ~flags[:-1] | breaks[1:]
    starts = np.flatnonzero(begin)
    stop = flags.copy()
    stop[:-1] &= ~flags[1:] | breaks[1:]
    return starts, np.flatnonzero(stop) - starts + 1


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, then those of starts[1], and so on."""
    total = int(sizes.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.cumsum(sizes) - sizes
    return np.arange(total) + np.repeat(starts - first, sizes)


def _pack(parts: list[bytes]) -> bytes:
    head = np.array([len(parts), *map(len, parts)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def _unpack(blob: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(data, np.int64, n, 8))
    return [data[e - s : e] for e, s in zip(ends.tolist(), np.frombuffer(data, np.int64, n, 8).tolist(), strict=True)]


def _planes(x: np.ndarray) -> bytes:
    """The bytes of the numbers, lowest bytes first: they compress better apart."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _coded(texts: list[bytes], joined: list[bytes] | None = None) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Words of all ``texts`` that have a window, in a row: their codes, the words by code, the lengths of the texts, and which
    texts these are. ``joined``, if given, gets their words joined by one space."""
    numbers = count()
    vocabulary: dict[bytes, int] = defaultdict(numbers.__next__)
    pieces, used, lengths = [], [], []
    for d, text in enumerate(texts):
        words = text.split()
        if len(words) >= WINDOW:
            pieces.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
            used.append(d)
            lengths.append(len(words))
            if joined is not None:
                joined.append(b" ".join(words))
    codes = np.concatenate(pieces) if pieces else np.empty(0, np.int32)
    return codes, list(vocabulary), np.array(lengths, np.int64), np.array(used, np.int64)


def _word_hashes(codes: np.ndarray, names: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64)[codes]


def _anchors(word_hashes: np.ndarray) -> np.ndarray:
    return _mix(_window_hashes(_mix(word_hashes), ANCHOR)) >> np.uint64(1)


def _minimisers(word_hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Of every window the least anchor; the sorted ``common`` ones come after all others."""
    anchors = _anchors(word_hashes)
    if len(common):
        at = np.minimum(np.searchsorted(common, anchors), len(common) - 1)
        anchors |= (common[at] == anchors).astype(np.uint64) << np.uint64(63)
    return _least(anchors, WINDOW - ANCHOR + 1)


def count_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """Anchors that a block has FEW times or more, how often each, and the number of all."""
    codes, names, lengths, _ = _coded(texts)
    if not len(lengths):
        return np.empty(0, np.uint64), np.empty(0, np.int64), 0
    word_hashes = _word_hashes(codes, names)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    anchors = np.sort(_anchors(word_hashes)[owner[: 1 - ANCHOR] == owner[ANCHOR - 1 :]])
    starts = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
    n = np.diff(np.append(starts, len(anchors)))
    return anchors[starts[n >= FEW]], n[n >= FEW], len(anchors)


class Kmers(NamedTuple):
    """Super-k-mers, or settled spans (bucket SETTLED): by entry its bucket, key and tie of its document, the word at which it
    starts, its number of windows, and where its words begin and end in a text."""

    bucket: np.ndarray
    key: np.ndarray
    tie: np.ndarray
    start: np.ndarray
    size: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    def at(self, order: np.ndarray) -> Kmers:
        return Kmers(*[x[order] for x in self])


class Buckets(NamedTuple):
    """How minimisers are dealt: ``count`` buckets, and for common minimisers ``salts`` further ones each, in ``parts`` partitions."""

    count: int
    parts: int
    salts: int = 1

    def of(self, minimiser: np.ndarray, salt: int) -> np.ndarray:
        own = (minimiser % np.uint64(self.count)).astype(np.int64)
        return np.where(minimiser >> np.uint64(63) > 0, self.count + own * self.salts + salt % self.salts, own)

    def home(self, bucket: int) -> int | None:
        """The bucket to which what is first in ``bucket`` goes on, None if there is no further round."""
        return (bucket - self.count) // self.salts if bucket >= self.count else None

    def part(self, bucket: np.ndarray) -> np.ndarray:
        return bucket % self.parts


def super_kmers(keys: np.ndarray, ties: np.ndarray, texts: list[bytes], buckets: Buckets, salt: int = 0, common: np.ndarray = np.empty(0, np.uint64)) -> tuple[Kmers, bytes]:
    """What a block of documents sends, and the text of its words, each with a space behind it."""
    order = np.lexsort((ties, keys))
    joined: list[bytes] = []
    codes, names, lengths, used = _coded([texts[i] for i in order.tolist()], joined)
    none = np.empty(0, np.int64)
    if not len(lengths):
        return Kmers(*[none] * 7), b""
    word_hashes = _word_hashes(codes, names)
    text = b" ".join([*joined, b""])
    word_at = np.cumsum(np.append(0, np.array([len(w) + 1 for w in names], np.int64)[codes]))
    d = order[used]
    first = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(lengths)), lengths)
    minimiser = _minimisers(word_hashes, common)
    hashes = _window_hashes(word_hashes, WINDOW)
    valid = owner[: len(hashes)] == owner[WINDOW - 1 :]
    # rows that share key and tie are one document: what its first row in the block sends holds for all
    repeat = np.zeros(len(lengths), bool)
    repeat[1:] = (keys[d[1:]] == keys[d[:-1]]) & (ties[d[1:]] == ties[d[:-1]])
    valid &= ~repeat[owner[: len(hashes)]]
    at = np.flatnonzero(valid)
    known = np.zeros(len(hashes), bool)
    known[at] = later(codes, at, hashes[at], at)
    owner = owner[: len(hashes)]
    change = np.ones(len(hashes), bool)
    change[1:] = owner[1:] != owner[:-1]
    settled, settled_sizes = _runs(known, change)
    change[1:] |= minimiser[1:] != minimiser[:-1]
    sent, sent_sizes = _runs(valid & ~known, change)
    starts, sizes = np.concatenate([settled, sent]), np.concatenate([settled_sizes, sent_sizes])
    o = owner[starts]
    nothing = np.zeros(len(settled), np.int64)
    begin, end = np.concatenate([nothing, word_at[sent]]), np.concatenate([nothing, word_at[sent + sent_sizes + WINDOW - 1]])
    bucket = np.concatenate([nothing + SETTLED, buckets.of(minimiser[sent], salt)])
    return Kmers(bucket, keys[d[o]], ties[d[o]], starts - first[o], sizes, begin, end), text


def _groups(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    if not len(sorted_):
        return []
    bounds = np.append(np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])), len(sorted_)).tolist()
    return list(zip(bounds[:-1], bounds[1:], strict=True))


def map_block(keys: np.ndarray, ties: np.ndarray, texts: list[bytes], buckets: Buckets, salt: int = 0, common: np.ndarray = np.empty(0, np.uint64)) -> Iterator[tuple[int, bytes]]:
    """(partition, packed super-k-mers and settled spans, sorted by bucket) of a block of documents."""
    found, text = super_kmers(keys, ties, texts, buckets, salt, common)
    part = buckets.part(np.where(found.bucket == SETTLED, salt, found.bucket))
    order = np.lexsort((found.bucket, part))
    found, part = found.at(order), part[order]
    for lo, hi in _groups(part):
        one = found.at(slice(lo, hi))
        groups = np.array([(one.bucket[a], b - a, (one.end[a:b] - one.begin[a:b]).sum()) for a, b in _groups(one.bucket)], np.int64)
        words = b"".join([text[i:j] for i, j in zip(one.begin.tolist(), one.end.tolist(), strict=True)])
        yield int(part[lo]), _pack([groups.tobytes(), *[_planes(x.astype(np.int64)) for x in (one.key, one.tie, one.start, one.size)], words])


def unpack_block(blob: bytes) -> Iterator[tuple[int, bytes]]:
    """(bucket, its entries) of what ``map_block`` packed: their number, keys, ties, starts and sizes, and the words."""
    groups, *columns, words = _unpack(blob)
    columns = [_from_planes(x, np.int64) for x in columns]
    at = byte = 0
    for bucket, n, size in np.frombuffer(groups, np.int64).reshape(-1, 3).tolist():
        yield bucket, _raw([x[at : at + n] for x in columns], words[byte : byte + size])
        at, byte = at + n, byte + size


def _raw(columns: list[np.ndarray], words: bytes) -> bytes:
    # sorted by Spark next: compressed again, if lightly, a partition takes less than half the memory
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.int64(len(columns[0])).tobytes(), *[x.astype(np.int64).tobytes() for x in columns], words]))


def _from_raw(raw: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.frombuffer(raw, np.int64, 4 * n, 8).reshape(4, n), raw[8 + 32 * n :]


def reduce_bucket(raws: list[bytes], go_on: bool = False) -> tuple[np.ndarray, bytes | None]:
    """Spans (key, tie, first word, windows: a row each) of the windows of a bucket that started earlier elsewhere; with
    ``go_on`` also the others, as an entry of another bucket."""
    numbers = count()
    vocabulary: dict[bytes, int] = defaultdict(numbers.__next__)
    columns, coded = [], []
    for raw in raws:
        entries, words = _from_raw(raw)
        columns.append(entries)
        coded.append(np.fromiter(map(vocabulary.__getitem__, words.split()), np.int32))
    keys, ties, starts, sizes = np.concatenate(columns, axis=1)
    codes = np.concatenate(coded)
    del columns, coded
    spans = sizes + WINDOW - 1
    place = np.cumsum(spans) - spans
    order = np.lexsort((starts, ties, keys))
    at = _spread(place[order], sizes[order])
    owner = np.repeat(order, sizes[order])
    seeds = _mix(np.arange(1, len(vocabulary) + 1, dtype=np.uint64) * _BASE)
    hashes = _window_hashes(seeds[codes], WINDOW)
    new = np.append(True, (np.diff(keys[order]) != 0) | (np.diff(ties[order]) != 0))
    word = starts[owner] + at - place[owner]
    # a number for each (document, word) in order: the documents before have as many words as their last window's place says
    document = np.cumsum(new) - 1
    lengths = np.zeros(document[-1] + 1, np.int64)
    np.maximum.at(lengths, document, starts[order] + sizes[order])
    before = np.cumsum(lengths) - lengths
    known = later(codes, at, hashes[at], before[np.repeat(document, sizes[order])] + word)
    change = np.ones(len(at), bool)
    change[1:] = owner[1:] != owner[:-1]

    def entries(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, n = _runs(flags, change)
        o = owner[begin]
        return np.array([keys[o], ties[o], word[begin], n]), at[begin]

    out, _ = entries(known)
    if not go_on:
        return out, None
    rest, places = entries(~known)
    names = list(vocabulary)
    words = [b" ".join([names[c] for c in codes[i : i + n + WINDOW - 1].tolist()]) + b" " for i, n in zip(places.tolist(), rest[3].tolist(), strict=True)]
    return out, _raw(list(rest), b"".join(words))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows, the last column a text, in lists of about BLOCK_BYTES of text."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        *others, texts = batch.columns
        for row in zip(*[c.to_pylist() for c in others], texts.cast(pa.binary()).to_pylist(), strict=True):
            held.append(row)
            size += len(row[-1])
            if size >= BLOCK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def common_anchors(docs: DataFrame) -> np.ndarray:
    """The anchors that come last, sorted: at most MOST, whatever the size of the corpus."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            found, n, total = count_anchors([x for (x,) in rows])
            yield pa.RecordBatch.from_arrays([pa.array([None, *found.astype(np.int64).tolist()], pa.int64()), pa.array([total, *n.tolist()], pa.int64())], ["anchor", "n"])

    counts = stored(docs.select("text").mapInArrow(tally, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")), "anchors")
    total = counts.where("anchor is null").agg(F.max("n")).first()[0] or 0
    found = counts.where(F.col("anchor").isNotNull() & (F.col("n") >= max(COMMON, total // MOST))).select("anchor").collect()
    return np.sort(np.array([r.anchor for r in found], np.int64).astype(np.uint64))


def _reduced(rows: DataFrame, buckets: Buckets) -> DataFrame:
    """(key, tie, start, n) of spans, or (home, raw) of what goes on, from ``rows`` (bucket, raw) sorted by bucket within partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["key", "tie", "start", "n", "home", "raw"], [pa.int64()] * 5 + [pa.binary()]
        bucket, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            home, rest = buckets.home(bucket), None
            if bucket == SETTLED:
                columns = np.concatenate([_from_raw(x)[0] for x in held], axis=1)
            else:
                columns, rest = reduce_bucket(held, home is not None)
            key, tie, start, n = columns
            if len(key):
                yield pa.RecordBatch.from_arrays([*map(pa.array, (key, tie, start, n + WINDOW - 1)), *[pa.nulls(len(key), x) for x in kinds[4:]]], names)
            if rest is not None:
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, x) for x in kinds[:4]], pa.array([home], pa.int64()), pa.array([rest], pa.binary())], names)

        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != bucket:
                    if held:
                        yield from out()
                    bucket, held = b, []
                held.append(raw.as_py())
                if b == SETTLED and len(held) >= 1000:  # nothing to compare
                    yield from out()
                    held = []
        if held:
            yield from out()

    return rows.mapInArrow(run, "key long, tie long, start long, n long, home long, raw binary")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(key, tie, spans): for documents with windows that started earlier, their spans of (first word, words).

    ``docs`` has ``key`` (long), ``tie`` (long) and ``text``; earlier means smaller in (key, tie, first word).
    """
    python_workers(docs.sparkSession)
    size = input_bytes(docs)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-size // PART_BYTES))
    # of as many blocks as the input has, a common minimiser's bucket gets the square root at most, and so its own bucket
    buckets = Buckets(max(least, -(-size // BUCKET_BYTES)), parts, max(1, math.isqrt(size // BLOCK_BYTES)))
    common = common_anchors(docs)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, rows in enumerate(_blocks(batches)):
            keys, ties, texts = zip(*rows, strict=True)
            for part, blob in map_block(np.array(keys, np.int64), np.array(ties, np.int64), list(texts), buckets, task + i * 7919, common):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([blob], pa.binary())], ["part", "blob"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(1):
                found, raws = zip(*unpack_block(blob.as_py()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(raws, pa.binary())], ["bucket", "raw"])

    blobs = docs.select("key", "tie", "text").mapInArrow(split, "part int, blob binary").repartitionById(parts, "part")
    spans = _reduced(blobs.mapInArrow(unpack, "bucket long, raw binary").sortWithinPartitions("bucket"), buckets)
    if len(common):
        spans = stored(spans, "spans")
        rest = spans.where("home is not null").select(F.col("home").alias("bucket"), "raw").repartition(parts, "bucket").sortWithinPartitions("bucket")
        spans = spans.where("home is null").union(_reduced(rest, buckets))
    return spans.groupBy("key", "tie").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def _with_ties(slim: DataFrame) -> DataFrame:
    """``slim`` with ``tie``, a hash of the text where rows share a key, so that texts of one key are told apart."""
    repeated = stored(slim.groupBy("key").agg(F.count("*").alias("__n")).where("__n > 1").select("key", F.lit(True).alias("__repeated")), "repeated-keys")
    if repeated.isEmpty():
        return slim.withColumn("tie", F.lit(0).cast("long"))
    return slim.join(repeated, "key", "left").withColumn("tie", F.when(F.col("__repeated"), F.xxhash64("text")).otherwise(0)).drop("__repeated")


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256``; ``kept`` (the words left) with ``with_text``.

    A word goes if a window that covers it has the word sequence of a window that starts earlier: in a smaller doc_id, or
    earlier in the same document. Windows are judged on the input. Null texts have no words. A null doc_id counts as the
    largest; rows of one doc_id but different texts are ordered by a hash of the text (64 bits), rows of one doc_id and text are one
    document and get the same result. Further columns are ignored; an empty table gives an empty one.
    """
    largest = (1 << 63) - 1
    slim = _with_ties(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(largest)).alias("key"), text_of().alias("text")))
    joined = slim.join(repeated_spans(slim), ["key", "tie"], "left").select("doc_id", "text", "spans")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, texts = [], [], [], []
            for text, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                n_words.append(len(words))
                if spans:
                    keep = np.ones(len(words), bool)
                    for s in spans:
                        keep[s["start"] : s["start"] + s["n"]] = False
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept = b" ".join(words)
                digests.append(sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode())
            out = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(texts, pa.string())] * with_text, names + ["kept"] * with_text)

    return joined.mapInArrow(rebuild, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


SQL = r"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, row_number() over () as k from documents),
win as (select k, doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') as s from (select k, doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
late as (select k, i from (select k, i, row_number() over (partition by s order by doc_id, i) as r from win) where r > 1),
gone as (select distinct k, i + o as j from late, (select unnest(range(20)) as o)),
word as (select k, j, w[j] as x from (select k, w, unnest(range(1, len(w) + 1)) as j from d)),
kept as (select k, count(*) as n, string_agg(x, ' ' order by j) as s from word anti join gone using (k, j) group by k)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(kept.n, 0))::bigint as n_removed, sha256(coalesce(s, '')) as kept_sha256 from d left join kept using (k)"""
