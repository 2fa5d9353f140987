"""Token operators against the tokenizers library."""

import random
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bpe, queries, token_counts

tokenizers = pytest.importorskip("tokenizers")
DOCS = "doc_id long, text string, n_tokens string, id string, ids string"
ODD = [
    "", " ", "\n\t \x0b\x0c\r", "a", "don't DON'T it'll we've I'm", "ab<|endoftext|>cd <|startoftext|><|startoftext|>", "<|endoftext|", "naïve é ́x", "x y z\x1cq\x85r​s",
    "日本語 テスト 𝒳 😀👍🏽", "İstanbul ΣΑΣ ẞ ǅ", "12345 1.5e10 ½ ²", "!!! ... ??? --- ***", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "the the the", "\x00\x01 ﻿", "word " * 3000, "x" * 5000, "क्ष กำ",
]


def library():
    t = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_model_equals_library():
    model, lib = bpe.PairIndexBPE(queries.tokenizer_path()), library()
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcdefghijklmnoprst'  eéß1!<|") for _ in range(rng.randrange(200))) for _ in range(300)]
    for text in texts:
        ids = model.encode(text)
        expected = lib.encode(text, add_special_tokens=False).ids
        assert ids == expected, text
        assert model.decode(ids) == lib.decode(expected, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    model, lib = bpe._model(queries.tokenizer_path()), library_once()
    assert model.encode(text) == lib.encode(text, add_special_tokens=False).ids


_LIB = []


def library_once():
    if not _LIB:
        _LIB.append(library())
    return _LIB[0]


def test_merges_come_after_their_parts():
    """Ascending ranks equal the word-by-word order because no merge uses a symbol that a later merge makes."""
    model = bpe._model(queries.tokenizer_path())
    made = {}
    for r, (_, _, c) in enumerate(model.merge):
        made.setdefault(c, []).append(r)
    assert all(max(made.get(x, [-1])) < r for r, (a, b, _) in enumerate(model.merge) for x in (a, b))


def test_queries(spark):
    rows = [(i, x, "clash", "clash", "clash") for i, x in enumerate(ODD)] + [(None, "null id", "", "", ""), (99, None, "", "", ""), (0, "", "", "", ""), (7, "again", "", "", ""), (7, "again", "", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    lib = library()
    want = {(i, x or "") for i, x, *_ in rows}
    enc = {x: lib.encode(x, add_special_tokens=False).ids for _, x in want}
    got = bpe.encode_decode(docs, queries.tokenizer_path(), with_text=True).collect()
    assert len(got) == len(rows)
    expected = sorted(repr((i, len(enc[x or ""]), sha256(" ".join(map(str, enc[x or ""])).encode()).hexdigest(), sha256(lib.decode(enc[x or ""], skip_special_tokens=False).encode()).hexdigest())) for i, x, *_ in rows)
    assert sorted(repr((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in got) == expected
    assert sorted(r.ids for r in got) == sorted(enc[x or ""] for _, x, *_ in rows)
    counts = token_counts.count_tokens(docs, queries.tokenizer_path(), 100).collect()
    assert sorted(repr(tuple(r)) for r in counts) == sorted(repr((i, len((x or "").encode()), len(enc[x or ""]), len(enc[x or ""]) > 100)) for i, x, *_ in rows)
    empty = spark.createDataFrame([], DOCS)
    assert bpe.encode_decode(empty, queries.tokenizer_path()).count() == 0
    assert token_counts.count_tokens(empty, queries.tokenizer_path(), 100).count() == 0


def test_whole_table(spark, sf_dir):
    lib = library()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    enc = {k: lib.encode(x, add_special_tokens=False).ids for k, x in docs.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op10_token_counts(spark, sf_dir).collect()} == {k: (len(x.encode()), len(enc[k]), len(enc[k]) > 2048) for k, x in docs.items()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op6_bpe_encode_decode(spark, sf_dir).collect()}
    assert got == {k: (len(x), sha256(" ".join(map(str, x)).encode()).hexdigest(), sha256(lib.decode(x, skip_special_tokens=False).encode()).hexdigest()) for k, x in enc.items()}


def test_small_caches_and_slices(monkeypatch):
    """Words forgotten in between, texts over several slices, and ranks merged by arrays and by steps give the same."""
    lib = library_once()
    rng = random.Random(4)
    texts = ODD + [" ".join(rng.choice(["the", "theré", "Ünter", "a,b", "日本", "<|endoftext|>", "zz" * 40, "9", f"w{i}", f"tion{i % 7}"]) for i in range(rng.randrange(400))) for _ in range(40)]
    want = [lib.encode(x, add_special_tokens=False).ids for x in texts]
    for entries, size, segment, bulk in ((5, 50, 20, 1), (300, 500, 64, 3), (10_000, 1 << 20, 1 << 20, 1 << 30)):
        monkeypatch.setattr(bpe, "CACHE_ENTRIES", entries)
        monkeypatch.setattr(bpe, "SLICE_CHARS", size)
        monkeypatch.setattr(bpe, "SEGMENT_CHARS", segment)
        monkeypatch.setattr(bpe, "BULK", bulk)
        model = bpe.PairIndexBPE(queries.tokenizer_path())
        got: list[list] = [[] for _ in texts]
        for held in bpe.slices(texts):
            for (i, _), (ids, tokens) in zip(held, model.look_up([x for _, x in held]), strict=True):
                got[i] += [int(x) for x in ids.split()]
                assert tokens.decode() == model.decode([int(x) for x in ids.split()])
            assert len(model.code) <= max(entries, len(set(w for _, x in held for w in model.words(x))) + entries)
        assert got == want


def test_segments():
    parts = list(bpe.segments("ab cd " * 1000 + "x" * 500 + " y", 64))
    assert "".join(parts) == "ab cd " * 1000 + "x" * 500 + " y" and max(map(len, parts)) <= 600
    text = b"ab cd " * 1000 + b"x" * 500 + b" y"
    parts = list(token_counts.segments(text, 64))
    assert b"".join(parts) == text and [w for p in parts for w in p.split()] == text.split()
    assert list(token_counts.segments(b"")) == [b""]


def test_small_batches_of_counts(monkeypatch):
    """Lengths forgotten in between, and texts counted segment by segment, add up to the library's counts."""
    rng = random.Random(6)
    texts = ODD + [" ".join(rng.choice(["the", "Ünter", "a,b", "日本", "<|endoftext|>", f"w{i}"]) for i in range(rng.randrange(300))) for _ in range(30)]
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 5)
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 20)
    monkeypatch.setattr(token_counts.segments, "__defaults__", (64,))
    lib = library_once()
    assert token_counts.PieceLengths(queries.tokenizer_path()).count([x.encode() for x in texts]) == [len(lib.encode(x, add_special_tokens=False).ids) for x in texts]


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="white space"):
        token_counts.PieceLengths(public_tokenizers.path("byte_bpe_50k.json"))
