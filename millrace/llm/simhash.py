"""SimHash near-duplicates by covering locality-sensitive hashing.

Each bit of a fingerprint gets a non-zero vector of RADIUS + 1 bits, and each non-zero vector v of that length makes a
table, whose mask has the bits with an odd product with v. Any RADIUS differing bits have vectors that some v is
orthogonal to, so two fingerprints within the radius agree under that mask: no pair is missed. Tables hold distinct
fingerprints only. Within a bucket a search forest, not all pairs, carries the links on: it has the same components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import python_workers, stored, text_of

BITS, SHINGLE, SEED, RADIUS = 64, 4, 42, 4
#: Shingles whose bits are counted at once; places among which the members of a component are dealt.
_BLOCK, SALTS = 1 << 16, 64


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The covering family: 2 ** (radius + 1) - 1 masks of ``bits`` bits."""
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((i % vectors + 1) & v).bit_count() % 2) for v in range(1, vectors + 1)]


def simhash(text: bytes) -> int:
    """Fingerprint of a UTF-8 text: bit i is set if it is set in over half of the hashes of the word shingles."""
    words = text.lower().split()  # of bytes: only A-Z change, only the six separators split
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    first, last = starts[:n].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, _BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + _BLOCK], last[at : at + _BLOCK], strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *keep: str | Column) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed long; a null text has no words and the fingerprint 0."""
    python_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, texts = batch.columns
            prints = np.array([simhash(x) for x in texts.cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*kept, pa.array(prints)], [*batch.schema.names[:-1], "fp"])

    slim = docs.select(*keep, text_of().alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema[:-1])
    return slim.mapInArrow(run, f"{fields}, fp long")


def forest(prints: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected among ``prints`` (distinct, uint64) by steps of at most ``radius`` bits."""
    rest, links = prints, []
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            one = todo.pop()
            near = np.bitwise_count(rest ^ one) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                links.append((np.full(len(found), one, np.uint64), found))
                todo += found.tolist() if len(rest) else []
                todo = [np.uint64(x) for x in todo]
    return links


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp``, enough to connect all that steps within ``radius`` connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = [np.empty(0, np.int64)] * 3

        def linked(t: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            new = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate([[0], new]) if len(t) else np.empty(0, np.int64)
            sizes = np.diff(np.append(starts, len(t)))
            two = starts[sizes == 2]
            bits = fp.view(np.uint64)
            near = two[np.bitwise_count(bits[two] ^ bits[two + 1]) <= radius]
            a, b = [bits[near]], [bits[near + 1]]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                for x, y in forest(bits[s : s + n], radius):
                    a.append(x)
                    b.append(y)
            a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

        for batch in batches:
            now = [np.concatenate([c, x.to_numpy().astype(np.int64)]) for c, x in zip(carried, batch.columns, strict=True)]
            if not len(now[0]):
                continue
            last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            cut = len(last) - int(last.sum())  # rows are sorted: the last bucket may go on
            carried = [x[cut:] for x in now]
            yield linked(*[x[:cut] for x in now])
        yield linked(*carried)

    def signed(mask: int) -> int:
        return mask - (1 << 64) if mask >> 63 else mask

    rows = distinct.select(F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"), "fp") for t, m in enumerate(masks(radius))])).alias("x")).select("x.*")
    dealt = rows.repartition("t", "key").sortWithinPartitions("t", "key")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a > b): label is the smallest node of its component.

    Alternates large-star and small-star steps until nothing changes; every round is a written table. Joins and minima
    only: no neighbourhood is gathered.
    """
    now, before = stored(edges.select("a", "b"), "edges"), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b").distinct())
        before = state
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = stored(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = stored(small.distinct(), "small-star")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per row: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest doc_id reachable by links.

    Two documents link if their fingerprints differ in at most ``radius`` bits; texts without words (null too) have
    fingerprint 0 and link like others. Repeated rows keep a row each. A null doc_id is never the smallest, unless all of
    a component are null. Further columns are ignored; an empty table gives an empty one.
    """
    prints = stored(fingerprints(docs, F.col("doc_id").cast("long").alias("doc_id")), "fingerprints")
    # written, so that the join below stands alone and Spark may split the rows of a fingerprint that very many have
    found = stored(classes(prints, F.col("doc_id"), radius), "classes")
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def classes(prints: DataFrame, order: Column, radius: int = RADIUS) -> DataFrame:
    """(fp, least): for each fingerprint the smallest ``order`` within its component."""
    distinct = stored(prints.groupBy("fp").agg(F.min(order).alias("least")), "distinct")
    label = components(links(distinct.select("fp"), radius)).select(F.col("node").alias("fp"), "label")
    linked = stored(distinct.join(label, "fp"), "linked")  # those that have a link at all
    # a component may hold a large part of them: what it has in common meets its members in SALTS places
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    common = linked.groupBy("label").agg(F.min("least").alias("common")).select("label", "common", salts)
    found = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(common.hint("merge"), ["label", "salt"]).select("fp", "common")
    return distinct.join(found, "fp", "left").select("fp", F.coalesce("common", "least").alias("least"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` but one of each component only: the one of the smallest (doc_id, hash of the text)."""
    row = ["__none", "__id", "__th"]  # plain equality on these: the join leaves rows dealt as dropDuplicates wants them
    keyed = docs.withColumn("__none", F.col("doc_id").isNull()).withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn("__th", F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.lit(1)))
    prints = stored(fingerprints(keyed, *row), "fingerprints")
    first = stored(classes(prints, F.struct(*row), radius).select("least.*").distinct(), "first")
    return keyed.join(first, row).dropDuplicates(row).select(*[F.col(f"`{c}`") for c in docs.columns])
