"""Near copies against the exact Jaccard similarity of all pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest

from millrace.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(docs):
    """The doc_ids that stay, and the similarities of the linked pairs."""
    sets, root, linked = [shingles(t) for _, t in docs], list(range(len(docs))), []

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
                linked.append(similarity(sets[i], sets[j]))
    least = {}
    for i, (k, _) in enumerate(docs):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted(least.values()), linked


def made():
    rng = random.Random(8)
    docs = []
    for g in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(100, 500))]
        docs.append(base)
        for share in (0.005, 0.02, 0.03, 0.05):
            docs.append([f"x{rng.randrange(3000)}" if rng.random() < share else w for w in base])
    one = [f"v{i}" for i in range(80)]
    docs += [[*one[:p], f"y{p}", *one[p + 1 :]] for p in range(80)]  # a group of many, each a word from the first
    docs += [[], [], ["one"], ["ONE"], ["one", "two"], ["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "f"]]
    order = list(range(len(docs)))
    rng.shuffle(order)
    return [(k, " ".join(docs[i])) for k, i in enumerate(order)]


@pytest.mark.parametrize("hot", [1024, 8])
def test_stage_finds_similar_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(near_copies, "HOT", hot)
    docs = made()
    stays, linked = brute(docs)
    assert len(linked) > 300 and sum(x < 0.9 for x in linked) > 30
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in docs], SCHEMA)
    got = corpus_pipeline.near_copies(spark, df, "")
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == stays
    assert corpus_pipeline.near_copies(spark, df.limit(0), "").count() == 0


def test_forest_connects_what_all_pairs_connect():
    docs = [d for d in made() if d[1]]
    sets = [near_copies.shingles(t.encode()) for _, t in docs]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in near_copies.forest(sets):
        assert near_copies.near(sets[i], sets[j])
        root[find(i)] = find(j)
    assert len({find(i) for i in range(len(sets))}) == len(brute(docs)[0])


def test_candidates_at_the_threshold():
    rng = np.random.default_rng(5)
    hit = 0
    for _ in range(2000):
        base = rng.integers(0, 1 << 63, 450, np.uint64)
        a, b = np.unique(base[:405]), np.unique(base[45:])  # 360 of 450 shared: 0.8
        hit += bool(set(near_copies.band_keys(a)) & set(near_copies.band_keys(b)))
    assert hit >= 1996
