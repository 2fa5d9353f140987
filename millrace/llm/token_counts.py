"""Token counts by batch encoding in Arrow functions that return lengths only.

A text is cut at its ASCII white space, which no token of the vocabulary spans and which the tokenizer drops, so the
count of a text is the sum over its pieces. Pieces new to a worker are encoded by the tokenizers library in batches of
about equal bytes; their lengths stay in a bounded cache. A long text is walked in segments that end at white space.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import python_workers, text_of

#: Bytes of text that are cut into pieces at once, and bytes of new pieces that the library encodes at once.
SEGMENT_BYTES, BATCH_BYTES = 1 << 20, 1 << 18
#: Lengths kept by a worker, and the longest piece that is kept.
CACHE_ENTRIES, CACHE_PIECE = 400_000, 64
_SPACES = b" \t\n\x0b\x0c\r"


def segments(text: bytes, size: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """Cut ``text`` behind about each ``size`` bytes, always at ASCII white space; a longer run without any stays whole."""
    at, end = 0, len(text)
    while end - at > size:
        cut = at + size
        while cut < end and text[cut] not in _SPACES:
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


class PieceLengths:
    """Token counts of white-space-free pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self._length(" \t\n a") != self._length("a") or self._length("a\n don't 12") != sum(map(self._length, ("a", "don't", "12"))):
            raise ValueError(f"{path}: a tokenizer that drops white space is expected")
        self.known: dict[bytes, int] = {}

    def _length(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def learn(self, pieces: set[bytes]) -> dict[bytes, int]:
        """Encode in batches balanced by bytes; only lengths are kept."""
        found: dict[bytes, int] = {}
        batch, held = [], 0
        for piece in pieces:
            batch.append(piece)
            held += len(piece)
            if held >= BATCH_BYTES:
                self._encode(batch, found)
                batch, held = [], 0
        if batch:
            self._encode(batch, found)
        return found

    def _encode(self, batch: list[bytes], found: dict[bytes, int]) -> None:
        encoded = self.tokenizer.encode_batch_fast([x.decode() for x in batch], add_special_tokens=False)
        found.update(zip(batch, map(len, encoded), strict=True))

    def count(self, texts: list[bytes]) -> list[int]:
        counts = []
        for text in texts:
            total = 0
            for part in segments(text):
                words = part.split()
                try:
                    total += sum(map(self.known.__getitem__, words))
                except KeyError:
                    new = self.learn({w for w in words if w not in self.known})
                    if len(self.known) + len(new) > CACHE_ENTRIES:
                        self.known.clear()
                        new |= self.learn({w for w in words if w not in new})
                    total += sum(self.known[w] if w in self.known else new[w] for w in words)
                    self.known.update((k, v) for k, v in new.items() if len(k) <= CACHE_PIECE)
            counts.append(total)
        return counts


_READY: dict[str, PieceLengths] = {}


def _counter(path: str) -> PieceLengths:
    if path not in _READY:
        _READY[path] = PieceLengths(path)
    return _READY[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``tokenizer`` is the path of a tokenizers file, readable by the workers. A null text counts as empty (0 tokens);
    repeated rows and null ids keep one row each; other columns are ignored, whatever their names; an empty table gives
    an empty one. Row by row, without a shuffle: partitions are the scan's.
    """
    python_workers(docs.sparkSession)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return slim.mapInArrow(lengths, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
