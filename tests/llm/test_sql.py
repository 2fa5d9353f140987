"""Queries that have SQL, against it."""

import duckdb
import pytest

from millrace.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, sf_dir)
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in cur.fetchall())
