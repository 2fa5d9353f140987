"""The pipeline stage by stage, each against a plain version of its own input."""

import collections
from hashlib import sha256

import corpus_pipeline
import test_lines
import test_mixing
import test_near_copies
import test_quality
import test_tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    lib = test_tokens.library()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "mix", "encode"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "encode":
            break
        assert docs.columns == COLUMNS
        got = [tuple(r) for r in docs.collect()]
        if name == "quality":
            assert sorted(got) == sorted(r for r in rows if not test_quality.brute(r[1])[-1])  # no host is rejected here
        elif name == "lines":
            expected = test_lines.brute([r[:2] for r in rows])
            assert sorted(sha256(r[1].encode()).hexdigest() for r in got) == sorted(x[-66:-2] for x in expected)
            assert sorted((r[0], r[2], r[3]) for r in got) == sorted((r[0], r[2], r[3]) for r in rows) and all(len(r[1]) == r[4] for r in got)
        elif name == "near_copies":
            stays = set(test_near_copies.brute([r[:2] for r in rows])[0])
            assert sorted(got) == sorted(r for r in rows if r[0] in stays) and len(got) < len(rows)
        elif name == "mix":
            times = collections.Counter(got)
            assert set(times) <= set(rows) and max(times.values()) <= 3
            size = {r[0]: test_quality.brute(r[1])[0] for r in rows}
            per, taken = collections.Counter(), collections.Counter()
            for r in rows:
                per[r[3]] += size[r[0]]
                taken[r[3]] += size[r[0]] * times[r]
            for s, target in test_mixing.by_hand(per).items():
                assert abs(taken[s] - target) <= max(0.05 * target, 3)
        rows = got
    encoded = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in docs.collect())
    expected = collections.Counter()
    for r in rows:
        ids = lib.encode(r[1], add_special_tokens=False).ids
        expected[r[0], len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert encoded == expected
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()) == expected


def test_odd_rows_through_all_stages(spark, sf_dir, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows, a rejected host, and columns of clashing names."""
    long_text = " ".join(f"w{i * 7919 % 50_000}" for i in range(60_000))
    good = [" ".join(f"g{k}x{i}" for i in range(40 + k)) for k in range(30)]
    rows = [(k, t, "en", "good") for k, t in enumerate(good)] + [(100 + k, t.replace("g", "h"), None, None) for k, t in enumerate(good[:10])]
    rows += [(200 + k, "too short" if k % 3 else good[k].replace("g", "k"), "en", "bad") for k in range(12)]  # eight of twelve fail
    rows += [(None, good[0].replace("g", "n"), "en", "good"), (300, None, "en", "good"), (301, "", "en", "good"), (302, "\n\n", "en", "good"), (303, long_text, "en", "good")]
    rows += [(5, "tie " + good[5].replace("g", "t"), "en", "good"), (400, good[7].replace("g", "r"), "en", "good"), (400, good[7].replace("g", "r"), "en", "good")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, tie string, size string, hash string, id string, line string, block string, fp string, `a.b` string"
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *["clash"] * 9) for r in rows], schema).repartition(5)
    empty, columns = docs.limit(0), docs.columns
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        for which, df in (("some", docs), ("none", empty)):
            stage(spark, df, sf_dir).write.parquet(f"{tmp_path}/{which}-{name}")
        docs, empty = (spark.read.parquet(f"{tmp_path}/{which}-{name}") for which in ("some", "none"))
        assert empty.count() == 0
        if name != "encode":
            assert docs.columns == empty.columns == columns and docs.select("`a.b`").distinct().collect()[0][0] == "clash"
            left[name] = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect())
    kept = [r for r in rows if not test_quality.brute(r[1])[-1] and r[3] != "bad"]
    assert left["quality"] == sorted((r[0] is None, r[0] or 0, r[1]) for r in kept)
    assert len(left["lines"]) == len(kept)
    assert {x[:2] for x in left["near_copies"]} == {(r[0] is None, r[0] or 0) for r in kept} and len(left["near_copies"]) == len(kept) - 1  # the repeated row is one
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and docs.count() == len(left["mix"])
