"""Near copies by the Jaccard similarity of five-word shingles: SimHash with covering locality-sensitive hashing, then an exact check.

Texts of the same words are one node. The method is operator 9's (``simhash``), with a fingerprint wide enough for the similarity: WORDS
words of 64 bits, each in PARTS parts of BITS bits. Every part has the covering masks for RADIUS bits, so fingerprints that differ in
fewer than WORDS * PARTS * (RADIUS + 1) of the bits of all parts agree under some mask: of the parts, one has at most RADIUS of them. Texts of similarity
0.8 differ in about 15 % of the bits or less; of such pairs 0.9998 are found, 0.995 of those under 20 shingles. Within a bucket a search
forest links fingerprints that differ in at most DIFFER bits of COMPARED words; links make components, as in operator 9.

Only texts that are not alone in their component are moved, as sorted hashes of their shingles, and a search forest links those of similarity
SIMILARITY or more: no pairs are listed. A component of over HOT texts is dealt into parts, and each two parts are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import python_workers, stored, text_of
from millrace.llm.simhash import SALTS, components, masks

#: Words of a shingle; the least similarity as a fraction; seed.
SHINGLE, SIMILARITY, SEED = 5, (4, 5), 42
#: Words of a fingerprint, parts of a word, bits of a part, bits that its masks cover.
WORDS, PARTS, BITS, RADIUS = 5, 3, 21, 2
#: Words that are compared within a bucket, the first of them naming the node; bits that may differ there.
COMPARED, DIFFER = 3, 51
#: Texts that are compared at once, about.
HOT = 1024
#: Shingles whose bits are counted at once, in bytes; pairs of fingerprints that are compared at once.
_BLOCK, _PAIRS = 255, 1 << 18
_TERMS = np.random.default_rng(SEED).integers(0, 1 << 64, WORDS, np.uint64)
_MASKS = np.array(masks(RADIUS, BITS), np.int32)
_WORDS = [f"w{i}" for i in range(WORDS)]


def shingles(text: bytes) -> np.ndarray:
    """Sorted hashes of the shingles of a UTF-8 text; one of all its words if they are fewer than SHINGLE."""
    words = text.lower().split()  # of bytes: only A-Z change, only the six separators split
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(SHINGLE, len(words))
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, len(first)))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS words: a bit is set if it is set in over half of the mixed hashes (sorted, at least one), or in half and in the least."""
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        x = hashes[at : at + _BLOCK, None] + _TERMS
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ x >> np.uint64(31)).view(np.uint8), axis=1, bitorder="little")
        counts += 2 * bits.sum(axis=0, dtype=np.uint8).astype(np.int64)
        if at == 0:
            counts += bits[0]
    return np.packbits(counts > len(hashes), bitorder="little").view(np.uint64)


def covering_keys(prints: np.ndarray) -> np.ndarray:
    """For each of ``prints`` (a row of WORDS words each) its buckets: a number for each mask of each part."""
    shifts = np.arange(PARTS, dtype=np.uint64) * np.uint64(BITS)
    parts = (prints[:, :, None] >> shifts & np.uint64((1 << BITS) - 1)).astype(np.int32).reshape(len(prints), WORDS * PARTS, 1)
    tables = np.arange(WORDS * PARTS * len(_MASKS), dtype=np.int32) << BITS
    return (parts & _MASKS).reshape(len(prints), -1) + tables


def band_keys(hashes: np.ndarray) -> list[int]:
    """The buckets of a text; none for no shingles."""
    return covering_keys(fingerprint(hashes)[None])[0].tolist() if len(hashes) else []


def print_forest(words: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (indexes) of the first of each component to its others, by steps of at most DIFFER bits; ``words`` has COMPARED arrays (uint64),
    a value a fingerprint."""
    size = len(words[0])
    step = max(1, _PAIRS // size)
    linked = [np.count_nonzero(sum(np.bitwise_count(w[at : at + step, None] ^ w) for w in words) <= DIFFER, axis=1) for at in range(0, size, step)]
    rest, todo, links = np.flatnonzero(np.concatenate(linked) > 1), [], []
    while len(rest):
        if not todo:
            first, rest = int(rest[0]), rest[1:]
            todo = [first]
        one = todo.pop()
        close = sum(np.bitwise_count(w[rest] ^ w[one]) for w in words) <= DIFFER
        if close.any():
            found, rest = rest[close].tolist(), rest[~close]
            links += [(first, x) for x in found]
            todo += found
    return links


def near(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILARITY[1] >= (len(a) + len(b) - both) * SIMILARITY[0]


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (indexes) that connect what is connected among ``sets`` by steps of SIMILARITY or more."""
    if len(sets) == 2:
        return [(0, 1)] if near(*sets) else []
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    names, every = np.unique(np.concatenate(sets), return_inverse=True)
    flat, owner = every, np.repeat(np.arange(len(sets)), sizes)
    mine, rest = np.zeros(len(names), bool), np.arange(len(sets))
    todo, links = [], []
    while len(rest):
        if not todo:
            todo, rest = [int(rest[0])], rest[1:]
        one = todo.pop()
        own = every[ends[one] - sizes[one] : ends[one]]
        mine[own] = True
        both = np.bincount(owner[mine[flat]], minlength=len(sets))[rest]
        mine[own] = False
        close = both * SIMILARITY[1] >= (sizes[rest] + sizes[one] - both) * SIMILARITY[0]
        if close.any():
            found, rest = rest[close].tolist(), rest[~close]
            links += [(one, x) for x in found]
            todo += found
            stays = np.zeros(len(sets), bool)
            stays[rest] = True
            stays = stays[owner]
            flat, owner = flat[stays], owner[stays]
    return links


def _prints(keyed: DataFrame, row: list[str]) -> DataFrame:
    """``row``, h (hash of the words) and the words of the fingerprint, null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, texts = batch.columns
            whole, prints, none = [], np.zeros((len(texts), WORDS), np.uint64), np.zeros(len(texts), bool)
            for i, text in enumerate(texts.cast(pa.binary()).to_pylist()):
                whole.append(xxhash.xxh3_64_intdigest(b" ".join(text.lower().split())) - (1 << 63))
                hashes = shingles(text)
                if len(hashes):
                    prints[i] = fingerprint(hashes)
                else:
                    none[i] = True
            words = [pa.array(np.ascontiguousarray(w).view(np.int64), pa.int64(), mask=none) for w in prints.T]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(whole, pa.int64()), *words], [*batch.schema.names[:-1], "h", *_WORDS])

    slim = keyed.select(*row, text_of().alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema[:-1])
    return slim.mapInArrow(run, f"{fields}, h long, {', '.join(f'{w} long' for w in _WORDS)}")


def print_links(prints: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, between nodes (w0), enough to connect all that fingerprints of a common bucket connect."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = np.stack([np.asarray(c[at : at + 1024]).view(np.uint64) for c in batch.columns], axis=1)
                keys = covering_keys(some)
                compared = [pa.array(np.repeat(some[:, i].view(np.int64), keys.shape[1])) for i in range(COMPARED)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), *compared], ["bucket", *_WORDS[:COMPARED]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = [np.empty(0, np.int32), *[np.empty(0, np.int64)] * COMPARED]

        def linked(bucket: np.ndarray, *words: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
            sizes = np.diff(np.append(starts, len(bucket)))
            edges = []
            for s, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                edges += [(s + i, s + j) for i, j in print_forest([w[s : s + n].view(np.uint64) for w in words])]
            a, b = words[0][np.array(edges, np.int64).reshape(-1, 2).T]
            other = a != b
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)[other]), pa.array(np.minimum(a, b)[other])], ["a", "b"])

        for batch in batches:
            now = [np.concatenate([c, np.asarray(x)]) for c, x in zip(carried, batch.columns, strict=True)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))  # rows are sorted: the last bucket may go on
            carried = [x[cut:] for x in now]
            yield linked(*[x[:cut] for x in now])
        yield linked(*carried)

    rows = prints.mapInArrow(dealt, f"bucket int, {', '.join(f'{w} long' for w in _WORDS[:COMPARED])}")
    # by node, too: buckets of a large component then link to the same few small nodes, so there are few edges
    return rows.repartition("bucket").sortWithinPartitions("bucket", "w0").mapInArrow(run, "a long, b long").distinct()


def _buckets(distinct: DataFrame) -> DataFrame:
    """(h, buckets): for each text that is not alone in its component, the buckets to compare it in; any two of a component share one."""
    prints = distinct.where("w0 is not null").select(*_WORDS).distinct()
    label = components(print_links(prints)).select(F.col("node").alias("w0"), "label")
    labelled = stored(distinct.select("h", "w0").join(label, "w0", "left").select("h", F.coalesce("label", "w0", "h").alias("label")), "labelled")
    n = F.col("n")
    many = labelled.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label", F.when(n > HOT, F.ceil(2 * n / HOT)).otherwise(1).cast("long").alias("parts"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")  # as in simhash.classes: a component may hold a large part of the texts
    salted = labelled.withColumn("salt", F.pmod(F.xxhash64("h", F.lit(0)), F.lit(SALTS)).cast("int")).join(many.select("*", salts).hint("merge"), ["label", "salt"])
    members = salted.withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts")))
    others = "filter(sequence(0L, parts - 1), x -> parts = 1 or x <> part)"
    return members.select("h", F.expr(f"transform({others}, x -> xxhash64(label, least(part, x), greatest(part, x)))").alias("buckets"))


def _sets(texts: DataFrame) -> DataFrame:
    """(bucket, h, hashes): a row for each of the ``buckets`` of each of ``texts`` (h, buckets, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "h", "hashes"])

        kinds, rows, held = [pa.int64(), pa.int64(), pa.binary()], [], 0
        for batch in batches:
            for h, buckets, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes = shingles(text.encode()).tobytes()
                for b in buckets:
                    rows.append((b, h, hashes))
                    held += len(hashes)
                    if held > 8 << 20:
                        yield out()
                        rows, held = [], 0
        if rows:
            yield out()

    return texts.select("h", "buckets", "text").mapInArrow(run, "bucket long, h long, hashes binary")


def links(sets: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, between hashes of texts, enough to connect all that the buckets of ``sets`` connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            edges = [(texts[i], texts[j]) for i, j in forest(hashes)] if len(texts) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array(map(max, edges), pa.int64()), pa.array(map(min, edges), pa.int64())], ["a", "b"])

        bucket, texts, hashes = None, [], []
        for batch in batches:
            for b, h, x in zip(*batch.columns, strict=True):
                if b.as_py() != bucket:
                    yield out()
                    bucket, texts, hashes = b.as_py(), [], []
                if not texts or texts[-1] != h.as_py():
                    texts.append(h.as_py())
                    hashes.append(np.frombuffer(x.as_py(), np.uint64))
        yield out()

    return sets.repartition("bucket").sortWithinPartitions("bucket", "h").mapInArrow(run, "a long, b long").distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but one of each group of near copies only: the one of the smallest (doc_id, hash of the text).

    Two texts are near copies if their sets of SHINGLE words in a row (A-Z in lower case) have a Jaccard similarity of SIMILARITY or
    more; texts of fewer words if they have the same words, so all without words are a group. Groups are what near copies connect.
    """
    python_workers(docs.sparkSession)
    row = ["__none", "__id", "__th"]  # plain equality on these: the join leaves rows dealt as dropDuplicates wants them
    keyed = docs.withColumn("__none", F.col("doc_id").isNull()).withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn("__th", F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.lit(1)))
    prints = stored(_prints(keyed, row), "prints")
    distinct = stored(prints.groupBy("h").agg(F.min(F.struct(*row)).alias("least"), *[F.min(w).alias(w) for w in _WORDS]), "distinct")
    needed = stored(_buckets(distinct).join(distinct, "h").select("least.*", "h", "buckets"), "needed")
    texts = keyed.select(*row, text_of().alias("text")).join(needed, row)
    label = components(links(_sets(texts))).select(F.col("node").alias("h"), "label")
    labelled = distinct.join(label, "h", "left").withColumn("label", F.coalesce("label", "h"))
    first = stored(labelled.groupBy("label").agg(F.min("least").alias("least")).select("least.*"), "first")
    return keyed.join(first, row).dropDuplicates(row).select(*[F.col(f"`{c}`") for c in docs.columns])
