"""The near-copies stage goes by operator 9's covering masks, and compares all of a large component."""

import random

import corpus_pipeline
import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from test_near_copies import SCHEMA, brute

from millrace.llm import near_copies


@given(st.sets(st.integers(0, 314), max_size=44), st.lists(st.integers(0, 2**64 - 1), min_size=5, max_size=5))
def test_masks_cover(flipped, words):
    a = np.array([words], np.uint64)
    b = a.copy()
    for bit in flipped:  # of the 63 bits of each word that are in parts
        b[0, bit // 63] ^= np.uint64(1 << bit % 63)
    assert (near_copies.covering_keys(a) == near_copies.covering_keys(b)).any()


def test_bits_are_majorities():
    hashes = np.unique(np.random.default_rng(3).integers(0, 1 << 64, 1000, np.uint64))
    for n in (1, 2, 3, 255, 256, 1000):
        some = hashes[:n]
        mixed = []
        for term in near_copies._TERMS.tolist():
            for h in some.tolist():
                x = (h + term) % 2**64
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
                mixed.append(x ^ x >> 31)
        for i, word in enumerate(near_copies.fingerprint(some).tolist()):
            own = mixed[i * n : (i + 1) * n]
            assert word == sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in own) + (own[0] >> k & 1) > n)


def test_pairs_within_a_large_component(spark, monkeypatch):
    """Each text has one near copy and many likely candidates, far more than are compared at once."""
    monkeypatch.setattr(near_copies, "HOT", 4)
    rng = random.Random(2)
    common, docs = [f"c{i}" for i in range(330)], []
    for g in range(60):
        own = [f"g{g}x{i}" for i in range(8)]
        docs += [" ".join([*common, *own, *[f"e{g}y{s}x{i}" for i in range(36)]]) for s in range(2)]
    rng.shuffle(docs)
    stays, linked = brute(list(enumerate(docs)))
    assert len(linked) == 60 and max(linked) < 0.9
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(docs)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, df, "").collect()) == stays
