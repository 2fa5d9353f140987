"""Line dedup against DuckDB and against all pairs of lines."""

import random
import re
from hashlib import sha256

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import line_dedup, queries


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs):
    docs = sorted(((1 << 63) - 1 if k is None else k, k, t or "") for k, t in docs)
    seen, gone, out = [], set(), []
    place = {}
    for i, k, t in docs:
        for no, line in enumerate(t.split("\n")):
            if re.search(r"[^\x20\x09-\x0D]", line) and line not in place:
                place[line] = (i, no)
                if any(abs(len(x) - len(line)) < 2 and edits(x, line) < 2 for x in seen):
                    gone.add(line)
                seen.append(line)
    for i, k, t in docs:
        lines = t.split("\n")
        word = [bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in lines]
        kept = [x for no, (x, w) in enumerate(zip(lines, word)) if not w or place[x] == (i, no) and x not in gone]
        out.append(repr((k, sum(word), len(lines) - len(kept), sha256("\n".join(kept).encode()).hexdigest())))
    return sorted(out)


def result(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_query_and_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    expected = sorted(map(repr, con.execute(queries.oracle_sql()["op2_line_dedup"]).fetchall()))
    assert result(queries.op2_line_dedup(spark, sf_dir)) == expected


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.text("abé😀", max_size=6), st.text("abé😀", max_size=6)), min_size=60, max_size=60))
def test_banded_distance(spark, pairs):
    pairs = [(x, y) for x, y in pairs if abs(len(x) - len(y)) < 2] or [("", "")]
    df = spark.createDataFrame(pairs, "x string, y string")
    expected = sorted(p for p in pairs if edits(*p) < 2)
    assert sorted((r.x, r.y) for r in df.selectExpr("*", f"{line_dedup._banded('x', 'y')} as near").where("near").collect()) == expected
    assert sorted((r.x, r.y) for r in df.where(line_dedup._within_one_edit("x", "y")).collect()) == expected


@pytest.mark.parametrize("hot", [0, 2, 1000])
def test_near_lines(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = random.Random(4)
    base = ["the quick brown fox jumps over it", "été à la plage 😀😀 encore et encore", "x" * 40, "a b c"]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(6)):
            line = rng.choice(base)
            for _ in range(rng.randrange(3)):
                p = rng.randrange(len(line) + 1)
                line = line[:p] + rng.choice(["", "z", "é😀"[rng.randrange(2)]]) + line[p + rng.randrange(2) :]
            lines.append(line)
        lines.insert(rng.randrange(len(lines) + 1), rng.choice(["", " ", "\t\r"]))
        docs.append((i * 13 % 60, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "long " * 60000), (104, "line\n" * 20000), (None, "a b c\nnew line")]
    df = spark.createDataFrame([(*d, "", "", 5, "") for d in docs], "doc_id long, text string, id string, line string, n_chars int, c0 string").repartition(3)
    assert result(line_dedup.dedup(df)) == brute(docs)
    if hot == 2:
        both = result(line_dedup.dedup(df.union(df)))
        assert both == sorted(2 * brute(docs))
        clean = line_dedup.cleaned(df)
        assert clean.columns == df.columns and sorted(sha256(r.text.encode()).hexdigest() for r in clean.collect()) == sorted(x[-66:-2] for x in brute(docs))
        assert line_dedup.dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [2, 4])
def test_several_edits(spark, most):
    rng = random.Random(most)
    base = ["the quick brown fox jumps over it", "été à la plage 😀😀 encore et encore", "ab" * 14, "".join(rng.choice("abcdefgh ") for _ in range(150))]
    docs = []
    for i in range(50):
        lines = []
        for _ in range(4):
            line = rng.choice(base)
            for _ in range(rng.randrange(7)):
                p = rng.randrange(len(line) + 1)
                line = line[:p] + rng.choice(["", "z", "é😀"[rng.randrange(2)]]) + line[p + rng.randrange(2) :]
            lines.append(line)
        docs.append((i * 13 % 50, "\n".join(lines)))
    seen, gone = [], 0
    for _, text in sorted(docs):
        for line in text.split("\n"):
            gone += line in seen or any(edits(x, line) <= most for x in seen)
            seen.append(line)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    per = {r.doc_id: r.n_removed for r in line_dedup.dedup(df, most).collect()}
    kept = []
    seen = []
    for k, text in sorted(docs):
        left = [x for x in text.split("\n") if not (x in seen or seen.append(x)) and not any(edits(x, y) <= most for y in seen[:-1])]
        kept.append((k, sha256("\n".join(left).encode()).hexdigest()))
    assert sum(per.values()) == gone > sum(r.n_removed for r in line_dedup.dedup(df).collect())
    assert sorted((r.doc_id, r.kept_sha256) for r in line_dedup.dedup(df, most).collect()) == kept
    with pytest.raises(ValueError):
        line_dedup.cleaned(df, 20)
