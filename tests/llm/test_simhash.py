"""SimHash links against all pairs."""

import random

import numpy as np
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import queries, simhash


def brute_print(text):
    words = [w for w in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(docs, radius=4):
    prints = [brute_print(t) for _, t in docs]
    a = np.array(prints, np.uint64)
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= radius):
            root[find(i)] = find(int(j))
    least = {}
    for i, (k, _) in enumerate(docs):
        r = find(i)
        known = [x for x in (least.get(r), k) if x is not None]
        least[r] = min(known) if known else None
    return sorted(repr((k, f"{p:016x}", least[find(i)])) for i, ((k, _), p) in enumerate(zip(docs, prints)))


def result(df):
    return sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in df.collect())


@given(st.sets(st.integers(0, 63), max_size=4), st.integers(0, 2**64 - 1))
def test_masks_cover(flipped, x):
    y = x
    for b in flipped:
        y ^= 1 << b
    assert len(simhash.masks()) == 31 and any(x & m == y & m for m in simhash.masks())


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = result(queries.op9_simhash_near_dedup(spark, sf_dir))
    assert got == brute(docs) and len({x.split(", ")[2] for x in got}) < len(got)


def test_chains_and_odd_rows(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    docs = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(100)}"
        docs.append((1000 - i, "\t ".join(words).upper() + "É"))
    docs += [(None, None), (5, ""), (None, " \n"), (7, "one"), (7, "one"), (8, "ONE"), (9, "one two"), (None, "solo null id")]
    schema = "doc_id long, text string, fp string, label string, least string, node string"
    df = spark.createDataFrame([(*d, "", "", "", "") for d in docs], schema)
    assert result(simhash.near_duplicates(df)) == brute(docs)
    kept = simhash.keep_one(df).collect()
    assert len(kept) == len({x.rpartition(", ")[2] for x in brute(docs)}) and kept[0].label == ""
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_components_of_a_path(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).union(spark.createDataFrame([(-1, -9)], "a long, b long"))
    got = {r.node: r.label for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(200)}, -1: -9, -9: -9}


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = " ".join(f"w{i * 31 % 977}" for i in range(70_000)).encode()
    whole = simhash.simhash(text)
    monkeypatch.setattr(simhash, "_BLOCK", 1000)
    assert simhash.simhash(text) == whole
