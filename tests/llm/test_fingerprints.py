"""Fingerprints against a plain pass over the sorted documents."""

from collections import Counter
from hashlib import sha256

import xxhash
from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import fingerprints as f
from millrace.llm import queries


def brute(docs):
    order = sorted(docs, reverse=True)
    out = {}
    for i, (k, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1] or ""
        text = text or ""
        half = len(text) // 2
        e = text[: len(text) - half] + following[:half]
        a, b = f.fingerprint(text), f.fingerprint(e)
        out[k] = (len(text), sha256(e.encode()).hexdigest(), a, b, f.likeness(a, b), f.likeness(a, f.fingerprint(following)))
    return out


def clauses(line):
    """The leaves of a paragraph, character by character: up to 160 characters, then all punctuation, bars and spaces that follow
    punctuation or the cut; what begins with punctuation is a leaf of its own."""
    stops, out, at = ".,;:!?|", [], 0
    while at < len(line):
        begin = at
        if line[at] in stops:
            at += 1
        else:
            while at < len(line) and line[at] not in stops and at - begin < 160:
                at += 1
        while at < len(line) and line[at] in stops + " ":
            at += 1
        out.append(line[begin:at])
    return out


def digest(kind, parts):
    return xxhash.xxh3_128(kind + b"".join(parts)).digest()


def by_hand(text):
    """(root, leaves with repeats) of the tree: built level by level from nested lists."""
    paragraphs = [(line, [xxhash.xxh3_128(c.encode()).digest() for c in clauses(line)]) for line in text.split("\n")] if text else []
    nodes = [(line, digest(b"p", leaves)) for line, leaves in paragraphs]
    sections = [[]]
    for line, node in nodes:
        sections[-1].append(node)
        if line == "" or node[-1] % 8 == 0:
            sections.append([])
    root = sha256(b"".join(digest(b"s", s) for s in sections if s)).hexdigest()[:32]
    return root, Counter(c[:4] for _, leaves in paragraphs for c in leaves)


def dice(a, b):
    (root, x), (other, y) = by_hand(a), by_hand(b)
    if root == other:
        return 1.0
    both = sum((x & y).values())
    return 2.0 * both / (sum(x.values()) + sum(y.values())) if both else 0.0


def test_against_trees_by_hand(spark, sf_dir):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()), reverse=True)
    got = result(queries.op4_document_fingerprints(spark, sf_dir))
    for i, (k, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        e = text[: len(text) - half] + following[:half]
        n, sha, own, edited, near_edited, near_next = got[k]
        assert (n, sha) == (len(text), sha256(e.encode()).hexdigest())
        assert own.split(";")[0] == by_hand(text)[0] and edited.split(";")[0] == by_hand(e)[0]
        assert abs(near_edited - dice(text, e)) < 1e-12 and abs(near_next - dice(text, following)) < 1e-12


def result(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in df.collect()}


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = result(queries.op4_document_fingerprints(spark, sf_dir))
    assert got == brute(docs)
    assert all(0 <= x <= 1 for r in got.values() for x in r[4:])
    assert sum(r[4] for r in got.values()) > sum(r[5] for r in got.values()) + 0.3 * len(got)


def test_odd_rows(spark):
    schema = "doc_id long, text string, key string, bucket string, tie string"
    rows = [(i * i, ("word, " * i + "end.\n") * (i % 4), "", "", "") for i in range(60)] + [(-5, None, "", "", ""), (100000, "é😀" * 50000, "", "", "")]
    assert result(f.compare_with_next(spark.createDataFrame(rows, schema))) == brute([r[:2] for r in rows])
    assert f.compare_with_next(spark.createDataFrame([], schema)).count() == 0
    one = result(f.compare_with_next(spark.createDataFrame([(3, "a b c", "", "", "")], schema)))
    assert one == brute([(3, "a b c")]) and one[3][5] == 1.0
    doubled = f.compare_with_next(spark.createDataFrame([*rows, *rows, (None, "x", "", "", ""), (None, None, "", "", "")], schema))
    assert doubled.count() == 2 * len(rows) + 2


@given(st.text(alphabet="ab .,\n", max_size=80), st.text(alphabet="ab .,\n", max_size=80))
def test_roots_test_equality(a, b):
    assert (f.fingerprint(a) == f.fingerprint(b)) == (a == b) == (f.likeness(f.fingerprint(a), f.fingerprint(b)) == 1.0 and a == b)
    assert 0 <= f.likeness(f.fingerprint(a), f.fingerprint(b)) <= 1


def test_edits_are_located():
    lines = [f"Paragraph number {i}, with words; and more words." for i in range(100)]
    other = [*lines]
    other[40] = "Something else."
    assert f.differing_paragraphs(f.fingerprint("\n".join(lines)), f.fingerprint("\n".join(other))) == [40]
    assert f.likeness(f.fingerprint("\n".join(lines)), f.fingerprint("\n".join(other))) > 0.9
