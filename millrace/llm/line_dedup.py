"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line goes if the same line, or one within EDITS edits, occurs earlier. Equal lines are settled first, by a minimum over a hash of
128 bits. Each line left is split into EDITS + 1 = 2 segments; a line within one edit of it has one of them unchanged, at
the same place from the start or from the end. So a line is indexed by (length, segment) and probes the index of its own
length and of the length below with the substrings that lie where the segments of such a line would. Candidates are narrowed by
halves and verified by a banded bit-parallel edit distance.

An index key that many lines share is refined: its lines are split into FINE segments, of which all but one must
agree; lines that still share a key are matched by what is left without one character, where the earliest line of a group stands for
all. So no group's pairs are listed, and no link is lost that decides whether a line stays.

That is the case of one edit, which the query has. For several, lines are split into edits + 1 segments, one of which is unchanged,
shifted by what was put in or taken out before it: lines probe with all substrings that such a shift allows. All pairs of
a key are listed there, and verified by a band of that width.

Texts are moved once, into a table bucketed by document, which all later steps join without moving them again.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import SEPARATORS, input_bytes, stored

#: Edits within which a line repeats an earlier one, unless told otherwise, and at most.
EDITS, MOST_EDITS = 1, 19
#: Segments of the lines of a key that more than HOT lines index.
FINE, HOT = 32, 64
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 100_000


def _drop(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"drop table if exists {name}")
    except Exception:  # the session has gone, and with it its catalog
        pass


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    spark = df.sparkSession
    n = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // BUCKET_BYTES)))
    name = f"millrace_lines_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).option("compression", "zstd").saveAsTable(name)
    atexit.register(_drop, spark, name)
    return spark.table(name)


def _has_word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(SEPARATORS))) > 0


def _segment_keys(blocks: int) -> Column:
    """Structs (key, probe): for each segment, what the line has before and behind it, as indexed, and as a line of one
    character less would be indexed."""

    def of(length: str, probe: str) -> str:
        def key(j: str) -> str:
            start, end = f"cast({j} * ({length}) div {blocks} as int)", f"cast(({j} + 1) * ({length}) div {blocks} as int)"
            # for a line of one character more than the indexed ones, what is behind the segment begins one later
            behind = f"{end} + {2 if probe == 'true' else 1}"
            return f"struct(xxhash64({blocks}, {length}, {j}, substring(line, 1, {start}), substring(line, {behind})) as key, {probe} as probe)"

        if blocks > 4:
            return f"transform(sequence(0, {blocks - 1}), j -> {key('j')})"
        return f"array({', '.join(key(str(j)) for j in range(blocks))})"  # compiled, as a lambda is not

    return F.expr(f"concat({of('length(line)', 'false')}, {of('length(line) - 1', 'true')})")


def _pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` (key, probe, id, no, h): candidate pairs, and (id, no, h) of the lines with a key that is hot."""
    keys = rows.groupBy("key").agg(F.sum(F.when(F.col("probe"), 0).otherwise(1)).alias("n"), F.min("h").alias("a"), F.max("h").alias("b"))
    shared = keys.where((F.col("n") > 0) & (F.col("a") != F.col("b"))).select("key", (F.col("n") > HOT).alias("hot"))
    live = stored(rows.join(shared, "key"), "shared-keys")
    cool = live.where(~F.col("hot"))
    return _ordered(cool.where(~F.col("probe")), cool), live.where("hot").select("id", "no", "h").distinct()


def _ordered(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct pairs of different lines with a common key, the earlier one first."""
    a = left.select("key", *[F.col(c).alias(f"a_{c}") for c in ("id", "no", "h")])
    b = right.select("key", *[F.col(c).alias(f"b_{c}") for c in ("id", "no", "h")])
    pairs = a.join(b, "key").where("a_h <> b_h")
    first = F.struct("a_id", "a_no") < F.struct("b_id", "b_no")
    either = [F.when(first, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(f"{x}_{c}") for x, y in ("ab", "ba") for c in ("id", "no", "h")]
    return pairs.select(*either).distinct()


def _shifted_pairs(lines: DataFrame, edits: int) -> DataFrame:
    """Candidate pairs among ``lines``: those that share a segment, at a place that ``edits`` edits allow."""
    # (characters less than the probing line, segment, shift): edits before the segment are at most its number, those behind the rest
    looks = [(d, j, s) for d in range(edits + 1) for j in range(edits + 1) for s in range(max(-j, d - (edits - j)), min(j, d + edits - j) + 1)]
    places = [(False, 0, j, 0) for j in range(edits + 1)] + [(True, *x) for x in looks]
    listed = F.expr("array(" + ", ".join(f"struct({str(p).lower()} as probe, {d} as d, {j} as j, {s} as s)" for p, d, j, s in places) + ")")
    at = lines.select("id", "no", "h", "line", F.length("line").alias("n"), F.explode(listed).alias("x")).select("id", "no", "h", "line", "n", "x.*")
    at = at.withColumn("l", F.col("n") - F.col("d")).where("l > 0")
    at = at.withColumn("start", F.expr(f"cast(j * l div {edits + 1} as int)")).withColumn("size", F.expr(f"cast((j + 1) * l div {edits + 1} as int) - start"))
    at = at.where("start + s >= 0 and start + s + size <= n")
    keyed = stored(at.select(F.expr("xxhash64(l, j, substring(line, start + s + 1, size))").alias("key"), "probe", "id", "no", "h"), "line-keys")
    keys = keyed.groupBy("key").agg(F.max(~F.col("probe")).alias("indexed"), F.min("h").alias("a"), F.max("h").alias("b"))
    live = stored(keyed.join(keys.where("indexed and a <> b").select("key"), "key").distinct(), "shared-keys")
    return _ordered(live.where(~F.col("probe")), live)


def _lines_of(texts: DataFrame, found: DataFrame, prefix: str = "") -> DataFrame:
    """``found`` with ``line``: the line of number ``no`` and hash ``h`` of document ``id``."""
    return texts.select("id", "text").join(found, F.col("id") == F.col(f"{prefix}id")).withColumn("line", F.get(F.split("text", "\n"), F.col(f"{prefix}no"))).where(F.xxhash64("line") == F.col(f"{prefix}h")).drop("text")


def _without_one(lines: DataFrame) -> DataFrame:
    """Candidate pairs among ``lines`` by what is left of them without one character."""
    places = "sequence(1, length(line))"
    same = lines.select("id", "no", "h", F.explode(F.expr(f"transform({places}, p -> xxhash64('s', p, left(line, p - 1), right(line, length(line) - p)))")).alias("key"))
    first = same.groupBy("key").agg(F.min(F.struct("id", "no", "h")).alias("f"), F.count("*").alias("n")).where("n > 1").select("key", "f.*")
    whole = lines.select("id", "no", "h", F.xxhash64(F.lit("i"), "line").alias("key"))
    less = lines.select("id", "no", "h", F.explode(F.expr(f"transform({places}, p -> xxhash64('i', concat(left(line, p - 1), right(line, length(line) - p))))")).alias("key")).distinct()
    return _ordered(first, same).union(_ordered(whole, less))


def _within_one_edit(x: str, y: str) -> str:
    """Whether two texts, of lengths at most one apart, are at most one edit apart.

    If they are, either the first halves are equal, or the rest is from the end: so halves are taken off while one is,
    and the bit-parallel distance is left with a core.
    """
    k, rest = "length(t.x) div 2", "cast(length(t.x) - length(t.x) div 2 as int)"
    halve = f"""case when not t.ok then t
        when left(t.x, cast({k} as int)) = left(t.y, cast({k} as int)) then struct(substring(t.x, cast({k} as int) + 1) as x, substring(t.y, cast({k} as int) + 1) as y, true as ok)
        when right(t.x, {rest}) = right(t.y, {rest}) then struct(left(t.x, cast({k} as int)) as x, left(t.y, length(t.y) - {rest}) as y, true as ok)
        else struct('' as x, '' as y, false as ok) end"""
    return f"transform(array(aggregate(sequence(1, 5), struct({x} as x, {y} as y, true as ok), (t, i) -> {halve})), u -> u.ok and {_banded('u.x', 'u.y')})[0]"


def _banded(x: str, y: str) -> str:
    """Whether the edit distance of two texts, of lengths at most one apart, is at most one.

    Bit d + 1 of s0 and s1 says that diagonal d (-1, 0, 1) is reached with no edit, with at most one; a character of y
    moves all diagonals of the band at once, m having the bits of those on which it equals the character of x.
    """
    chars = "transform(filter(sequence(0, length({0})), i -> i > 0), i -> substring({0}, i, 1))"
    match = "(case when get(v, j - 1) <=> c then 1 else 0 end) + (case when get(v, j) <=> c then 2 else 0 end) + (case when get(v, j + 1) <=> c then 4 else 0 end)"
    step = f"""transform(array({match}), m -> transform(array(s.s0 & m), z ->
        struct(s.j + 1 as j, z as s0, ((s.s1 & m) | s.s0 | shiftright(s.s0, 1) | (shiftleft(z, 1) & 7)) as s1))[0])[0]""".replace("get(v, j", "get(v, s.j")
    end = f"shiftright(s.s1, length({x}) - length({y}) + 1) & 1 = 1"
    return f"transform(array({chars.format(x)}), v -> aggregate({chars.format(y)}, struct(0 as j, 2 as s0, 6 as s1), (s, c) -> {step}, s -> {end}))[0]"


def _candidates(texts: DataFrame, each: DataFrame) -> DataFrame:
    """Candidate pairs among the lines ``each`` for one edit."""
    keyed = stored(each.select("id", "no", "h", F.explode(_segment_keys(2)).alias("k")).select("k.*", "id", "no", "h"), "line-keys")
    coarse, hot = _pairs(keyed)
    fine, hotter = _pairs(_lines_of(texts, hot.withColumnsRenamed({"id": "l_id", "no": "l_no", "h": "l_h"}), "l_").select("id", F.col("l_no").alias("no"), F.col("l_h").alias("h"), F.explode(_segment_keys(FINE)).alias("k")).select("k.*", "id", "no", "h"))
    last = _without_one(_lines_of(texts, hotter.withColumnsRenamed({"id": "l_id", "no": "l_no", "h": "l_h"}), "l_").select("id", F.col("l_no").alias("no"), F.col("l_h").alias("h"), "line"))
    return coarse.union(fine).union(last)


def _deduped(docs: DataFrame, edits: int) -> DataFrame:
    """``docs`` with __text (what is left), __lines (those with a word) and __removed."""
    if not 1 <= edits <= MOST_EDITS:
        raise ValueError(f"edits must be from 1 to {MOST_EDITS}, not {edits}")
    largest = (1 << 63) - 1
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = names[docs.columns.index("text")]
    plain = docs.toDF(*names).withColumn("id", F.coalesce(F.col(names[docs.columns.index("doc_id")]).cast("long"), F.lit(largest))).withColumn("text", F.coalesce(F.col(at).cast("string"), F.lit("")))
    texts = _bucketed(plain.drop(at), "id")
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(_has_word(F.col("line")))
    first = lines.groupBy(F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("h2")).agg(F.min(F.struct("id", "no")).alias("p"))
    owned = stored(first.select("p.id", "p.no", "h").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("no", "h"))).alias("owned")), "owned-lines")
    # every line once, at its first place, with its keys
    split = texts.select("id", "text").join(owned.withColumnRenamed("id", "o"), F.col("id") == F.col("o"))
    each = split.withColumn("lines", F.split("text", "\n")).select("id", F.explode(F.expr("transform(owned, x -> struct(x.no as no, x.h as h, get(lines, x.no) as line))")).alias("x")).select("id", "x.*")
    each = each.where(F.xxhash64("line") == F.col("h"))
    pairs = (_candidates(texts, each) if edits == 1 else _shifted_pairs(each, edits)).distinct()
    both = _lines_of(texts, _lines_of(texts, pairs, "a_").drop("id").withColumnRenamed("line", "x"), "b_").withColumnRenamed("line", "y")
    close = _within_one_edit("x", "y") if edits == 1 else f"levenshtein(x, y, {edits}) >= 0"
    near = both.where(f"abs(length(x) - length(y)) <= {edits}").where(F.expr(close))
    removed = stored(near.select("b_id", "b_no").distinct().groupBy(F.col("b_id").alias("r")).agg(F.collect_list("b_no").alias("gone")), "near-lines")
    found = texts.join(owned.withColumnRenamed("id", "o"), F.col("id") == F.col("o"), "left").join(removed, F.col("id") == F.col("r"), "left").withColumn("lines", F.split("text", "\n"))
    none = F.expr("cast(array() as array<int>)")
    stay = F.transform(F.filter(F.coalesce("owned", F.expr("cast(array() as array<struct<no:int,h:bigint>>)")), lambda x: F.xxhash64(F.get("lines", x["no"])) == x["h"]), lambda x: x["no"])
    blank = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: ~_has_word(F.get("lines", i)))
    found = found.withColumn("stay", F.array_except(stay, F.coalesce("gone", none))).withColumn("blank", blank)
    kept = F.array_join(F.transform(F.array_sort(F.concat("stay", "blank")), lambda i: F.get("lines", i)), "\n")
    n = F.size("lines") - F.size("blank")
    out = found.select(*[F.col(c) for c in names if c != at], kept.alias("__text"), n.cast("long").alias("__lines"), (n - F.size("stay")).cast("long").alias("__removed"))
    back = {n_: c for n_, c in zip(names, docs.columns, strict=True) if n_ != at}
    return out.withColumnsRenamed(back)


def dedup(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """Per row: doc_id, n_lines (lines with a word), n_removed and kept_sha256 (of the lines left, joined by newlines).

    Lines are what newlines split; of those with a word, one goes if an equal line occurs earlier (smaller doc_id, or earlier
    in the document), or if its first occurrence has a line within ``edits`` edits before it, however short
    they are; lines are judged on the input. Lines without a word stay. Null texts are empty. A null doc_id counts as the
    largest; rows of one doc_id are one document: equal rows get the same result, and a line that differing rows share stays where it has
    the smaller number. Further columns are ignored; an empty table gives an empty one.
    """
    found = _deduped(docs.select("doc_id", "text"), edits)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.sha2(F.col("__text").cast("binary"), 256).alias("kept_sha256"))


def cleaned(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """``docs`` with the lines that ``dedup`` leaves as text and their code points as n_chars; same columns, same rows."""
    found = _deduped(docs, edits)
    new = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


SQL = r"""with d as (select doc_id, coalesce(doc_id, 9223372036854775807) as id, coalesce(text, '') as text, row_number() over () as k from documents),
lines as (select k, id, unnest(range(0, len(string_split(text, chr(10))))) as no, unnest(string_split(text, chr(10))) as line from d),
judged as (select *, regexp_matches(line, '[^\x20\x09-\x0D]') as word from lines),
firsts as (select line, min((id, no)) as p from judged where word group by line),
sized as (select line, p, length(line) as n from firsts),
lesser as (select *, unnest([n, n - 1]) as m from sized),
halves as (select line, p, n, m, unnest([0, 1]) as part, unnest([left(line, m // 2), right(line, m - m // 2)]) as half from lesser),
pairs as (select distinct a.line as x, b.line as y from halves a join halves b on a.m = b.m and a.part = b.part and a.half = b.half and a.p < b.p and least(a.n, b.n) = a.m),
-- code points, which levenshtein() does not count: what follows the common beginning is equal but for one of them
begun as (select x, y, list_max([i for i in range(0, least(length(x), length(y)) + 1) if left(x, i) = left(y, i)]) as p from pairs),
near as (select distinct y from begun where case length(x) - length(y) when 0 then substr(x, p + 2) = substr(y, p + 2) when 1 then substr(x, p + 2) = substr(y, p + 1) when -1 then substr(x, p + 1) = substr(y, p + 2) end),
marked as (select j.k, j.no, j.line, j.word, not j.word or (f.p = (j.id, j.no) and j.line not in (select y from near)) as stays
    from judged j left join firsts f on f.line = j.line and j.word),
texts as (select k, count(*) filter (word) as n_lines, count(*) filter (not stays) as n_removed, coalesce(string_agg(line, chr(10) order by no) filter (stays), '') as kept from marked group by k)
select doc_id, n_lines::bigint as n_lines, n_removed::bigint as n_removed, sha256(kept) as kept_sha256 from d join texts using (k)"""
