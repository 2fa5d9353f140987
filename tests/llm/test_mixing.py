"""Mixing: targets against the sharing rule done by hand, takes against targets, quotas against their sums."""

import glob
import re
from math import comb
from statistics import NormalDist

import corpus_pipeline
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing, queries


def by_hand(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in target]
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        target |= {s: 3 * sizes[s] for s in over}


def check(rows, docs, near):
    sizes, of, size = {}, {}, {}
    for k, text, source in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] = sizes.get(source, 0) + n
        of[k], size[k] = source, n
    expected = by_hand(sizes)
    took = {s: 0 for s in sizes}
    assert len(rows) == len(docs)
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[of[r.doc_id]]
        assert abs(r.target - expected[of[r.doc_id]]) <= 1e-6 * max(1, r.target)
        assert r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"]) and (len(r.shards) * r["size"] == r.taken)
        took[of[r.doc_id]] += r.taken
    for s in sizes:
        assert abs(took[s] - expected[s]) <= max(near * expected[s], 3), (s, took[s], expected[s])


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = queries.op8_mixing_to_weights(spark, sf_dir).collect()
    check(rows, docs, 0.02)
    assert sorted(map(repr, rows)) == sorted(map(repr, queries.op8_mixing_to_weights(spark, sf_dir).collect()))


def test_odd_rows(spark):
    schema = "doc_id long, text string, source string, size string, rank string, block string, target string"
    docs = [(i, "w " * (i % 37), ["a", "b", "B", "é", None, "hot"][min(i % 11, 5)]) for i in range(900)] + [(1000, None, "only null"), (1001, "x y", "tiny"), (1002, "z " * 3000, "hot")]
    df = spark.createDataFrame([(*d, "", "", "", "") for d in docs], schema)
    check(mixing.taken(df).collect(), docs, 0.02)
    assert mixing.taken(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0
    assert len({str(r.shards) for r in mixing.taken(df.where("doc_id = 7").union(df.where("doc_id = 7"))).collect()}) == 1
    took = {r.doc_id: len(r.shards) for r in mixing.taken(df).collect()}
    out = mixing.mixed(df, place=True).collect()
    assert {k: n for k, n in took.items() if n} == {k: sum(r.doc_id == k for r in out) for k in {r.doc_id for r in out}}
    assert out[0].block == "" and mixing.mixed(df).columns == df.columns


def test_tree(spark):
    quotas = {0: 1, 1: 0, 2: 1000, 3: 57, 4: 100000}
    df = spark.createDataFrame(list(quotas.items()), "rank int, n int")
    rows = mixing.split_tree(df, 5).collect()
    assert all(r.n >= 0 for r in rows)
    assert {k: sum(r.n for r in rows if r["rank"] == k) for k in quotas} == quotas
    per = [sum(r.n for r in rows if r.shard == s) for s in range(32)]
    assert max(per) - min(per) <= 1 and sum(per) == sum(quotas.values())
    assert len({r.n for r in rows if r["rank"] == 2}) > 5 and all(10 < r.n < 60 for r in rows if r["rank"] == 2)


def test_draws_are_disjoint(spark, sf_dir):
    sizes = mixing.sized(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sources, draws = mixing.plan(sizes)
    rows = draws.select("rank", "block", F.explode("draws").alias("d")).select("rank", "block", "d.*")
    assert rows.count() == rows.dropDuplicates(["rank", "block", "epoch"]).count()
    per = [r["count"] for r in rows.groupBy("shard").count().collect()]
    assert max(per) - min(per) <= 1


def test_shards_are_shuffled(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mixed(docs, place=True).withColumn("at", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()).orderBy("nth").collect()
    placed = [(r["__shard"], r["__place"]) for r in rows]
    assert placed == sorted(placed) and len({s for s, _ in placed}) == 16
    of = {}
    for r in rows:
        of.setdefault(r["at"], set()).add(r["__shard"])
    assert all(len(x) == 1 for x in of.values())
    corpus_pipeline.mix(spark, docs, sf_dir).write.parquet(f"{tmp_path}/mix")
    written = [k for f in sorted(glob.glob(f"{tmp_path}/mix/part-*")) for k in pq.read_table(f)["doc_id"].to_pylist()]
    assert written == [r["doc_id"] for r in rows]


def exact(total, marked, drawn):
    low, high = max(0, drawn - (total - marked)), min(drawn, marked)
    return {x: comb(marked, x) * comb(total - marked, drawn - x) / comb(total, drawn) for x in range(low, high + 1)}


@pytest.mark.parametrize("case", [(20, 8, 5), (50, 25, 25), (10, 10, 3), (10, 0, 4), (7, 3, 7), (400, 30, 120), (0, 0, 0), (5, 2, 0), (4096, 256, 1000)])
def test_draws_are_hypergeometric(spark, case):
    """Evenly spaced numbers give every value as often as its probability says."""
    n = 20_000
    draw = mixing.hypergeometric(*[f"{x}L" for x in case], f"(id + 0.5D) / {n}")
    got = {r.x: r["count"] / n for r in spark.range(n).select(F.expr(draw).alias("x")).groupBy("x").count().collect()}
    expected = exact(*case)
    assert set(got) <= set(expected)
    assert all(abs(got.get(x, 0) - p) <= 2 / n for x, p in expected.items())


def test_large_draw(spark):
    total, marked, drawn = 10**9, 62_500_000, 500_000_000
    draw = mixing.hypergeometric(f"{total}L", f"{marked}L", f"{drawn}L", "(id + 0.5D) / 16")
    mean = drawn * marked / total
    spread = (mean * (1 - marked / total) * (total - drawn) / (total - 1)) ** 0.5
    off = sorted((r.x - mean) / spread for r in spark.range(16).select(F.expr(draw).alias("x")).collect())
    assert all(abs(x - NormalDist().inv_cdf((i + 0.5) / 16)) < 0.25 for i, x in enumerate(off))


def test_tables_of_quotas_are_multivariate_hypergeometric(spark, monkeypatch):
    """Over many seeds, the table of two sources and two shards has the distribution that shuffling all blocks gives."""
    quotas = spark.createDataFrame([(0, 6), (1, 10)], "rank int, n int")
    seen = {}
    for seed in range(24):
        monkeypatch.setattr(mixing, "SEED", seed)
        rows = {(r.shard, r["rank"]): r.n for r in mixing.split_tree(quotas, 1).collect()}
        assert rows[0, 0] + rows[0, 1] == rows[1, 0] + rows[1, 1] == 8 and rows[0, 0] + rows[1, 0] == 6
        seen[rows[0, 0]] = seen.get(rows[0, 0], 0) + 1
    expected = exact(16, 6, 8)
    grouped = [(sum(seen.get(x, 0) for x in g), 24 * sum(expected[x] for x in g)) for g in ((0, 1, 2), (3,), (4, 5, 6))]
    assert sum((n - e) ** 2 / e for n, e in grouped) < 13.8  # two degrees of freedom, one in a thousand


def test_many_sources(spark):
    """Several levels of groups of sources."""
    quotas = spark.range(5000).select(F.col("id").alias("rank"), (F.col("id") % 7).alias("n"))
    rows = mixing.split_tree(quotas, 2)
    assert rows.groupBy("rank").agg(F.sum("n").alias("n")).where("n <> rank % 7").count() == 0 and rows.where("n < 0").count() == 0
    assert sorted(r["sum(n)"] for r in rows.groupBy("shard").sum("n").collect()) == sorted(sum(i % 7 for i in range(5000)) // 4 + (k < sum(i % 7 for i in range(5000)) % 4) for k in range(4))
    docs = [(i, "w " * (1 + i % 9), f"host{i * 7919 % 300}") for i in range(1500)]
    check(mixing.taken(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect(), docs, 0.02)
