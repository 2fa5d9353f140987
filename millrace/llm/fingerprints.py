"""Document fingerprints: a Merkle tree over paragraphs and sections.

Leaves are the clauses of a paragraph (a line), cut behind punctuation and after 160 characters; a section ends at an
empty line or at a paragraph whose hash says so, so its bounds move with the content. The concatenated leaves and line ends
are the text, so equal roots mean equal texts. The fingerprint writes the tree out, inner hashes cut to 32 bits, and differing branches
locate edits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import input_bytes, python_workers, text_of

_LEAF = re.compile(r"[^.,;:!?|]{1,160}[.,;:!?| ]*|[.,;:!?|][.,;:!?| ]*")
#: A paragraph ends a section if its hash is a multiple of this.
SECTION = 8
#: Bytes of input dealt to a partition; partitions at most, four ranges each, whose bounds (a number each) the driver holds.
PARTITION_BYTES, MOST_PARTITIONS = 16 << 20, 50_000


def fingerprint(text: str) -> str:
    """``root;section=paragraph:leaves,paragraph:leaves;section=...``: 32 hex digits for the root, 8 for other nodes."""
    digest = xxhash.xxh3_128_digest
    root, sections = sha256(), []
    held: list[str] = []
    inner: list[bytes] = []

    def close() -> None:
        node = digest(b"s" + b"".join(inner))
        root.update(node)
        sections.append(f"{node[:4].hex()}={','.join(held)}")
        held.clear()
        inner.clear()

    for line in text.split("\n") if text else ():
        leaves = [digest(x.encode()) for x in _LEAF.findall(line)]
        node = digest(b"p" + b"".join(leaves))
        inner.append(node)
        held.append(f"{node[:4].hex()}:{''.join([x[:4].hex() for x in leaves])}")
        if not line or node[15] % SECTION == 0:
            close()
    if inner:
        close()
    return ";".join([root.hexdigest()[:32], *sections])


def _tree(print_: str) -> list[tuple[str, list[tuple[str, str]]]]:
    out = []
    for section in print_.split(";")[1:]:
        name, _, rest = section.partition("=")
        out.append((name, [tuple(p.split(":")) for p in rest.split(",")]))
    return out


def leaves_of(print_: str) -> Counter:
    found: Counter = Counter()
    for section in print_.split(";")[1:]:
        for paragraph in section.partition("=")[2].split(","):
            leaves = paragraph.partition(":")[2]
            found.update([leaves[i : i + 8] for i in range(0, len(leaves), 8)])
    return found


def _alike(a: str, b: str, of_a: Counter, of_b: Counter) -> float:
    if a.partition(";")[0] == b.partition(";")[0]:
        return 1.0
    total = of_a.total() + of_b.total()
    if len(of_a) > len(of_b):
        of_a, of_b = of_b, of_a
    return 2.0 * sum(min(n, of_b[x]) for x, n in of_a.items() if x in of_b) / total if total else 0.0


def likeness(a: str, b: str) -> float:
    """1 for equal roots, else the share of leaves, repeats counted, that the two trees have in common (Dice)."""
    return _alike(a, b, leaves_of(a), leaves_of(b))


def differing_paragraphs(a: str, b: str) -> list[int]:
    """Numbers of the paragraphs of ``a`` that ``b`` lacks; sections that both have are not entered."""
    if a.partition(";")[0] == b.partition(";")[0]:
        return []
    other = _tree(b)
    sections, paragraphs = {name for name, _ in other}, {p[0] for _, inner in other for p in inner}
    out, at = [], 0
    for name, inner in _tree(a):
        if name not in sections:
            out += [at + i for i, p in enumerate(inner) if p[0] not in paragraphs]
        at += len(inner)
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down, in code points) replaced by as many first ones of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and ``fingerprint``. Null texts count as empty. Row by row, without a shuffle."""
    python_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x) for x in batch.column(1).to_pylist()], pa.string())], ["id", "fingerprint"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return slim.mapInArrow(run, "id long, fingerprint string").withColumnRenamed("id", id_col)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with likenesses to the edited text and the next document.

    Next is the document that follows in descending order of doc_id, after the last one the first; rows of equal ids
    follow each other by a hash of the text, and a null id comes last. Null texts are empty. Further columns are ignored.
    An empty table gives an empty one; a single row is its own next.

    Approximate quantiles of the ids, themselves ids of the table, deal rows into ranges; the row that heads a range also
    travels, as the next document only, to the range before it. So one shuffle of compressed texts is enough, and a task
    streams through its sorted ranges with two documents in hand.
    """
    spark = docs.sparkSession
    python_workers(spark)
    lowest = -(1 << 63)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("key"), text_of().alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTITIONS, -(-input_bytes(docs) // PARTITION_BYTES)))
    ranges = 4 * parts
    got = slim.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)] + [1.0], 10 * ranges).alias("q"), F.max("key").alias("top")).first()
    cuts = np.array(sorted({*(got["q"] or ()), got["top"]}) if got["top"] is not None else [0], dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            keys = batch.column(1).to_numpy()
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            tie = pa.array([xxhash.xxh3_64_intdigest(x) >> 1 for x in texts], pa.int64())
            packed = pa.array([pack(x) for x in texts], pa.binary())
            where = np.searchsorted(cuts, keys, "left")
            heads = np.flatnonzero(cuts[where] == keys)
            rows = np.concatenate([np.arange(len(keys)), heads])
            bucket = np.concatenate([where, (where[heads] + 1) % len(cuts)])
            only_next = np.arange(len(rows)) >= len(keys)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.astype(np.int64)), pa.array(only_next), batch.column(0).take(take), pa.array(keys).take(take), tie.take(take), packed.take(take)],
                ["bucket", "only_next", "doc_id", "key", "tie", "packed"],
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        pending: tuple | None = None
        at = None
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for bucket, only_next, doc_id, packed in zip(*(batch.column(x).to_pylist() for x in ("bucket", "only_next", "doc_id", "packed")), strict=True):
                if bucket != at:
                    at, pending = bucket, None
                elif pending is None:
                    continue  # a further row of the range that follows
                text = unpack(packed).decode()
                own = fingerprint(text)
                leaves = leaves_of(own)
                if pending is not None:
                    i, t, p, ls = pending
                    e = edited(t, text)
                    ep = fingerprint(e)
                    out.append((i, len(t), sha256(e.encode()).hexdigest(), p, ep, _alike(p, ep, ls, leaves_of(ep)), _alike(p, own, ls, leaves)))
                    held += 2 * len(p)
                pending = None if only_next else (doc_id, text, own, leaves)
                if held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    dealt = slim.mapInArrow(deal, "bucket long, only_next boolean, doc_id long, key long, tie long, packed binary")
    ordered = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "only_next", F.desc("key"), "tie")
    return ordered.mapInArrow(compare, _OUT)
