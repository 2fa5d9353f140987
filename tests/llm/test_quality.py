"""Quality rules against DuckDB and against a plain count."""

import re

import duckdb

from millrace.llm import quality_rules as q
from millrace.llm import queries


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def result(rows):
    return sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in rows)


def test_query_and_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    expected = con.execute(queries.oracle_sql()["op3_quality_rules"]).fetchall()
    got = queries.op3_quality_rules(spark, sf_dir).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert result(got) == sorted(repr((k, *brute(t))) for k, t in docs.items())


def test_odd_rows(spark):
    long = " ".join(f"w{i % 4001}" for i in range(30000))
    texts = [None, "", " \n\t", "a b c d e f g h", "x " * 500, "same line\nsame line\n \n \nsame line", "é ½ #*$ %&|<>  nbsp", long, "a b c d e f g h i j k l " * 2 + " ".join(f"q{i}" for i in range(40))]
    rows = [(i, t, s, "", "", "", 0) for i, t in enumerate(texts) for s in (None, "s", "t")] + [(None, "word " * 3, None, "", "", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, host string, rate string, rejected string, n int")
    got = q.assess(df).collect()
    assert result(got) == sorted(repr((r[0], *brute(r[1]))) for r in rows)
    assert all(not r.kept for r in got if r.base_failed)
    assert q.assess(df.limit(0)).count() == 0 and q.passing(df.limit(0)).count() == 0


def test_hosts(spark):
    good = " ".join(f"v{i}" for i in range(60))
    rows = [(i, good if i % 10 else "short", f"h{i % 20}") for i in range(4000)]
    rows += [(10000 + i, "short" if i % 8 else good, "bad") for i in range(800)] + [(20000, "short", "new"), (20001, good, "new"), (20002, good, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in q.assess(df).collect() if r.kept}
    assert kept == {i for i, t, s in rows if t == good and s != "bad"}  # one failure of two does not condemn a host
    passed = q.passing(df)
    assert {r.doc_id for r in passed.collect()} == kept and passed.columns == df.columns
