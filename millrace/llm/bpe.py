"""BPE encoding and decoding by a pair occurrence index.

Texts become words by the tokenizer file's own rules, and words new to a worker are encoded together: every symbol pair is
mapped to all its positions, the active ranks are taken in ascending order, and each merge updates the lists of the pairs
that it touches. A rank with many positions is merged by array operations, one with few step by step. Texts then are
sequences of known words. Text of ASCII and Latin-1 letters is cut into words here, other text by the tokenizers library.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain, count, groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import python_workers, text_of

#: Words kept by a worker and bytes of their encodings; characters of text whose new words are encoded together, and of a part of it.
CACHE_ENTRIES, CACHE_BYTES, SLICE_CHARS, SEGMENT_CHARS = 300_000, 32 << 20, 6 << 20, 1 << 20
#: Rows of an Arrow batch that are in hand as Python objects at once.
ROWS = 4096
#: Positions from which a rank is merged by array operations.
BULK = 128
_SPACES = re.compile(r"[ \t\n\x0b\x0c\r]+")
#: Text of these characters (printable ASCII, letters of Latin-1) is normalised and cut into words here, by the file's rules.
_PLAIN = re.compile(r"[\x20-\x7e\t\n\x0b\x0c\rÀ-ÖØ-öø-ÿ]*")
#: By Latin-1 byte of such a text in lower case: 0 white space, 1 letter, 2 digit, 3 other.
_KIND = np.array([0 if chr(b) in " \t\n\x0b\x0c\r" else 1 if chr(b).isalpha() else 2 if chr(b) in "0123456789" else 3 for b in range(256)], np.uint8)
_PLAIN_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class PairIndexBPE:
    """The vocabulary and merges of a tokenizers file with a BPE model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("decoder") or model.get("byte_fallback") or model.get("unk_token"):
            raise ValueError("a BPE file without decoder, byte fallback and unknown token is expected")
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.token = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("plain added tokens are expected")
        self.token |= {i: t for t, i in self.special.items()}
        #: By id, how it is written among decimal ids, and in decoded text.
        self.written = [pa.array([f(i) for i in range(max(self.token) + 1)], pa.large_binary()) for f in (lambda i: str(i).encode(), lambda i: self.token.get(i, "").encode())]
        self.special_run = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.plain = {k: spec[k] for k in _PLAIN_RULES} == _PLAIN_RULES
        # byte-level form: a printable byte stands for itself, the others for the characters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        char = {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}
        self.byte_id = [self.vocab.get(char[b]) for b in range(256)]
        self.last_id = [self.vocab.get(char[b] + self.suffix) for b in range(256)]
        self.plain = self.plain and None not in self.byte_id and None not in self.last_id
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: Pair of ids: its rank; rank: the pair and the id that it becomes.
        self.rank = {(self.vocab[a], self.vocab[b]): r for r, (a, b) in enumerate(pairs)}
        ordered = sorted((a << 20 | b, r) for (a, b), r in self.rank.items())
        self.pair_keys, self.pair_ranks = np.array([k for k, _ in ordered], np.int64), np.array([r for _, r in ordered], np.int64)
        self.merge = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs]
        self.byte_ids, self.last_ids = (np.array([-1 if x is None else x for x in ids], np.int32) for ids in (self.byte_id, self.last_id))
        self.forget()

    def forget(self) -> None:
        #: Word: its number. By number: ids and tokens as they are written out, whether there are any, whether a later slice had the word again.
        self.code: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.known = [pa.array([], pa.large_binary())] * 2
        self.silent = np.empty(0, bool)
        self.again = np.empty(0, bool)

    def merged(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Apply all merges to words at once: their symbols in a row and the words' sizes, before and after.

        ``where[rank]`` lists the positions at which the pair of that rank begins; entries that a merge has overtaken
        are skipped when their rank comes up. A pair made by a merge joins its list and activates its rank.
        """
        if not len(flat):
            return flat, sizes
        rank, merge = self.rank, self.merge
        ends = np.cumsum(sizes)
        starts = ends - sizes
        full = sizes > 0
        # the same memory, for single steps and for array operations
        symbol, after, before = (array("i", x.astype(np.int32).tobytes()) for x in (flat, np.arange(1, len(flat) + 1), np.arange(-1, len(flat) - 1)))
        symbols, afters, befores = (np.frombuffer(x, np.int32) for x in (symbol, after, before))
        afters[ends[full] - 1] = befores[starts[full]] = -1
        where: dict[int, list[int]] = {}
        active: list[int] = []

        def note(left: np.ndarray, right: np.ndarray, places: np.ndarray) -> None:
            keys = left.astype(np.int64) << 20 | right
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            known = np.flatnonzero(self.pair_keys[at] == keys)
            ranks = self.pair_ranks[at[known]]
            order = np.argsort(ranks, kind="stable")
            ranks, found = ranks[order], places[known[order]].tolist()
            cuts = np.append(np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1])), len(ranks)) if len(ranks) else np.zeros(1, np.int64)
            for r, lo, hi in zip(ranks[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if r in where:
                    where[r] += found[lo:hi]
                else:
                    where[r] = found[lo:hi]
                    heapq.heappush(active, r)

        joined = np.flatnonzero(afters >= 0)
        note(symbols[joined], symbols[joined + 1], joined)
        while active:
            r = heapq.heappop(active)
            a, b, c = merge[r]
            places = where.pop(r)
            if len(places) >= BULK and a != b:  # positions of a pair of different symbols don't overlap
                i = np.unique(np.array(places, np.int32))
                i = i[(symbols[i] == a) & (afters[i] >= 0)]
                i = i[symbols[afters[i]] == b]
                j = afters[i]
                symbols[i], symbols[j] = c, -1
                k = afters[i] = afters[j]
                more = k >= 0
                befores[k[more]] = i[more]
                h = befores[i]
                h = h[h >= 0]
                made = np.concatenate([i[more], h])
                note(symbols[made], symbols[afters[made]], made)
                continue
            for i in sorted(set(places)):
                if symbol[i] != a or (j := after[i]) < 0 or symbol[j] != b:
                    continue
                symbol[i], symbol[j] = c, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    if (x := rank.get((c, symbol[k]))) is not None:
                        if x not in where:
                            where[x] = []
                            heapq.heappush(active, x)
                        where[x].append(i)
                if (h := before[i]) >= 0 and (x := rank.get((symbol[h], c))) is not None:
                    if x not in where:
                        where[x] = []
                        heapq.heappush(active, x)
                    where[x].append(h)
        alive = symbols >= 0
        left = np.concatenate([[0], np.cumsum(alive)])
        return symbols[alive], left[ends] - left[starts]

    def symbols(self, word: str) -> list[int]:
        last = len(word) - 1
        found = [self.vocab.get(c + self.suffix if i == last else c) for i, c in enumerate(word)]
        return [x for x in found if x is not None]

    def is_plain(self, text: str) -> bool:
        return self.plain and _PLAIN.fullmatch(text) is not None and not (self.special_run and "<|" in text)

    def words(self, text: str) -> list[bytes]:
        """The words of a text: in Latin-1 if they are plain, else in byte-level form behind a line end; special tokens behind two."""
        out: list[bytes] = []
        for plain, pieces in groupby(_SPACES.split(text), self.is_plain):  # no word spans white space
            run = " ".join(pieces)
            if plain:
                out += plain_words(run.lower().encode("latin-1"))[0].to_pylist()
                continue
            for part in self.special_run.split(run) if self.special_run else [run]:
                if part in self.special:
                    out.append(f"\n\n{part}".encode())
                elif part:
                    out += [f"\n{word}".encode() for word, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part))]
        return out

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words`` in a row, and how many each has."""
        is_odd = np.array([w[:1] == b"\n" for w in words], bool)
        plain = [w for w in words if w[:1] != b"\n"]
        latin = b"".join(plain)
        flat = np.frombuffer(latin.decode("latin-1").encode(), np.uint8)
        lengths = np.array(list(map(len, plain)), np.int64)
        wide = np.concatenate([[0], np.cumsum(np.frombuffer(latin, np.uint8) >= 128)])  # two bytes in UTF-8
        ends = np.cumsum(lengths)
        sizes = lengths + wide[ends] - wide[ends - lengths]
        ends = np.cumsum(sizes) - 1
        ids = self.byte_ids[flat]
        ids[ends] = self.last_ids[flat[ends]]
        odd = [self.symbols(w[1:].decode()) if w[:2] != b"\n\n" else [self.special[w[2:].decode()]] for w in words if w[:1] == b"\n"]
        ids, done = self.merged(np.concatenate([ids, np.fromiter(chain.from_iterable(odd), np.int32)]), np.concatenate([sizes, np.array(list(map(len, odd)), np.int64)]))
        if not odd:
            return ids, done
        # plain words came first there: back into the order of ``words``
        at = np.empty(len(words), np.int64)
        at[np.concatenate([np.flatnonzero(~is_odd), np.flatnonzero(is_odd)])] = np.arange(len(words))
        ends = np.cumsum(done)
        return np.concatenate([ids[e - n : e] for e, n in zip(ends[at].tolist(), done[at].tolist(), strict=True)]), done[at]

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without the worker's known words."""
        words = self.words(text)
        return self.encoded(words)[0].tolist() if words else []

    def decode(self, ids: list[int]) -> str:
        """As the library decodes without a decoder: the tokens joined by one space."""
        return " ".join(self.token[i] for i in ids if i in self.token)

    def _coded(self, parts: list[str]) -> list[np.ndarray]:
        """The numbers of the words of each part. Plain parts are cut into words together."""
        code = self.code.__getitem__
        plain = [i for i, x in enumerate(parts) if self.is_plain(x)]
        words, starts = plain_words("\n".join([parts[i] for i in plain]).lower().encode("latin-1"))
        words = words.dictionary_encode()
        numbers = np.fromiter(map(code, words.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int32)[words.indices.to_numpy()]
        ends = np.cumsum([len(parts[i]) + 1 for i in plain])
        cuts = np.searchsorted(starts, ends[:-1]) if plain else []
        found = dict(zip(plain, np.split(numbers, cuts), strict=True)) if plain else {}
        return [found[i] if i in found else np.fromiter(map(code, self.words(x)), np.int32) for i, x in enumerate(parts)]

    def look_up(self, parts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """For each part its ids and its tokens, joined by one space. The new words of all parts are encoded together."""
        coded = self._coded(parts)
        known = len(self.again)
        if len(self.code) > known:
            ids, sizes = self.encoded(list(islice(self.code, known, None)))
            self.known = [pa.concat_arrays([old, _joined(names.take(pa.array(ids)), sizes)]) for old, names in zip(self.known, self.written, strict=True)]
            self.silent = np.concatenate([self.silent, sizes == 0])
            self.again = np.concatenate([self.again, np.zeros(len(sizes), bool)])
        if self.silent.any():  # the file's vocabulary lacks all of a word
            coded = [x[~self.silent[x]] for x in coded]
        numbers = np.concatenate(coded)
        self.again[numbers[numbers < known]] = True
        sizes = np.array(list(map(len, coded)), np.int64)
        yield from zip(*[_joined(x.take(pa.array(numbers)), sizes).to_pylist() for x in self.known], strict=True)
        if len(self.code) > CACHE_ENTRIES or sum(x.nbytes for x in self.known) > CACHE_BYTES:
            self.trim()

    def trim(self) -> None:
        """Keep the words that came up in more than one slice, if they are not too many."""
        keep = np.flatnonzero(self.again)
        words, known, silent = list(self.code), [x.take(pa.array(keep)) for x in self.known], self.silent[keep]
        self.forget()
        if 2 * len(keep) <= CACHE_ENTRIES and 2 * sum(x.nbytes for x in known) <= CACHE_BYTES:
            for x in keep.tolist():
                self.code[words[x]]  # numbers it
            self.known, self.silent, self.again = known, silent, np.zeros(len(keep), bool)


def plain_words(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of a plain text in lower case and Latin-1, and where they begin: runs of letters, single digits, runs of
    other characters, and the contractions 's 't 'm 'd 're 've 'll; white space is dropped."""
    data = np.frombuffer(text, np.uint8)
    kind = _KIND[data]
    begin = np.ones(len(data), bool)
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    quotes = np.flatnonzero((data == 39) & begin)
    for ends in (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"):
        at = quotes[quotes + len(ends) < len(data)]
        for i, c in enumerate(ends, 1):
            at = at[data[at + i] == c]
        begin[at + 1] = False
        after = at + 1 + len(ends)
        begin[after[after < len(data)]] = True
    bounds = np.flatnonzero(begin)
    solid = kind[bounds] != 0
    starts, sizes = bounds[solid], np.diff(np.append(bounds, len(data)))[solid]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[kind != 0])]), starts


def _joined(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    """The first sizes[0] of ``values`` joined by one space, the next sizes[1], and so on."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values), pa.scalar(b" ", pa.large_binary()))


def segments(text: str, size: int) -> Iterator[str]:
    """Cut ``text`` behind about each ``size`` characters, always at ASCII white space; a longer run without any stays whole."""
    at = 0
    while len(text) - at > size and (cut := _SPACES.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def slices(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """(number of the text, part) in order, in lists of about SLICE_CHARS."""
    held: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        for part in segments(text, SEGMENT_CHARS):
            held.append((i, part))
            size += len(part)
            if size >= SLICE_CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


_READY: dict[str, PairIndexBPE] = {}


def _model(path: str) -> PairIndexBPE:
    if path not in _READY:
        _READY[path] = PairIndexBPE(path)
    return _READY[path]


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Encode each text, decode the ids again, and return ``n_tokens`` with digests of both.

    ``ids_sha256`` is over the decimal ids joined by one space, ``decoded_sha256`` over the decoded text. With
    ``with_text``, ``ids`` (array of int) and ``decoded`` follow. A null text counts as empty; repeated rows and null ids
    keep one row each; further columns are ignored; an empty table gives an empty one. Row by row, without a shuffle.
    """
    python_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(tokenizer)
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            texts = batch.column(1).to_pylist()
            n, joint, kept = [0] * len(texts), [b""] * len(texts), [[] for _ in texts]
            ids_hash, text_hash = [sha256() for _ in texts], [sha256() for _ in texts]
            for held in slices(texts):
                for (i, _), (ids, tokens) in zip(held, model.look_up([x for _, x in held]), strict=True):
                    if ids:
                        n[i] += ids.count(b" ") + 1
                        ids_hash[i].update(joint[i] + ids)
                        text_hash[i].update(joint[i] + tokens)
                        joint[i] = b" "
                        if with_text:
                            kept[i].append((ids, tokens))
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array([x.hexdigest() for x in ids_hash], pa.string()), pa.array([x.hexdigest() for x in text_hash], pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_text:
                ids = [[int(x) for one, _ in parts for x in one.split()] for parts in kept]
                decoded = [b" ".join(two for _, two in parts).decode() for parts in kept]
                out += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names)
        model.trim()  # a worker that waits for its next task holds little

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_text else "")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)
