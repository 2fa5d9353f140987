"""Quality rules with host-level verdicts, in DataFrame functions only.

Every document gets counts and fails or passes the base rules. Failures are summed by host (``source``); an empirical
beta prior, fitted to all hosts by moments, shrinks each host's failure rate; hosts whose shrunken rate is too high are
rejected, and the verdicts join back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SEPARATORS, stored, text_of, words_of

#: Least words; most percent of words in repeated windows; words of a window; characters that count as symbols.
LEAST_WORDS, MOST_REPEATED, REPEAT_WINDOW, SYMBOLS = 20, 30, 8, "#*$%&|<>"
#: A host is rejected if its shrunken failure rate is above this.
HOST_RATE = 0.5


def _repeat_words(words: str, n: str) -> Column:
    """Words in windows that occur twice or more, first occurrences included.

    Windows of different 64-bit hashes differ, so a text without equal hashes has none. Else hashes are sorted with their places, and
    neighbours of one hash compared word by word; a pass over the places of the equal ones adds up what they cover. No window is
    written out, so a long text takes two numbers a word. Arrays are bound as lambda variables, which are evaluated once.
    """
    k = REPEAT_WINDOW
    equal = f"(get(p, {{0}}).s = x.s and slice(w, get(p, {{0}}).i, {k}) = slice(w, x.i, {k}))"
    exact = f"""transform(array(array_sort(transform(h, (s, j) -> struct(s as s, j + 1 as i)))), p ->
        aggregate(
            array_sort(transform(filter(p, (x, j) -> (j > 0 and {equal.format("j - 1")}) or (j < size(p) - 1 and {equal.format("j + 1")})), x -> x.i)),
            struct(0 as covered, -{k} as last),
            (a, i) -> struct(a.covered + least({k}, i - a.last) as covered, i as last),
            a -> a.covered))[0]"""
    return F.expr(
        f"""case when {n} <= {k} then 0 else transform(array({words}), w ->
        transform(array(transform(sequence(1, {n} - {k - 1}), i -> xxhash64(slice(w, i, {k})))), h -> case when size(array_distinct(h)) = size(h) then 0 else {exact} end)[0])[0] end"""
    ).cast("long")


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` and the columns __words, __chars, __symbols, __dup_lines, __repeat (counts) and __failed."""
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SEPARATORS))) > 0)
    counted = (
        docs.withColumn("__w", words_of(text))
        .withColumn("__lines", lines)
        .withColumn("__words", F.size("__w").cast("long"))
        .withColumn("__chars", F.length(F.translate(text, SEPARATORS, "")).cast("long"))
        .withColumn("__symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
        .withColumn("__dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn("__repeat", _repeat_words("__w", "size(__w)"))
    )
    failed = (F.col("__words") < LEAST_WORDS) | (100 * F.col("__repeat") > MOST_REPEATED * F.col("__words"))
    return counted.withColumn("__failed", failed).drop("__w", "__lines")


def host_verdicts(counted: DataFrame, host: str, failed: str) -> DataFrame:
    """(host, rate, rejected): failure rates shrunk by the beta prior of all hosts. Null is a host like others."""
    hosts = counted.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("f"))
    hosts = stored(hosts, "hosts")
    # four sums over hosts, one row: mean rate, and its variance between hosts beyond that of drawing n documents
    total = hosts.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum(F.col("f") * F.col("f") / F.col("n")).alias("ff")).first()
    n, mean, strength = total["n"] or 0, 0.0, 1.0
    if n:
        mean = total["f"] / n
        within = mean * (1 - mean)
        between = total["ff"] / n - mean * mean - within * total["k"] / n
        strength = min(max(within / between - 1, 1.0), 1e6) if between > 0 and within > 0 else 1e6
    rate = (F.col("f") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.select("host", rate.alias("rate"), (rate > HOST_RATE).alias("rejected"))


def assess(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    ``kept`` is false for a document that fails a base rule or whose host is rejected. Null texts have no words, so they
    fail; a null source is a host of its own; repeated rows count as often as they occur; further columns are ignored,
    whatever their names; an empty table gives an empty one.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("source").cast("string").alias("source"))
    counted = stored(with_counts(slim).drop("text"), "counts")
    hosts = host_verdicts(counted, "source", "__failed")
    joined = counted.join(hosts, counted["source"].eqNullSafe(hosts["host"]))
    return joined.select(
        "doc_id",
        F.col("__words").alias("n_words"),
        F.col("__chars").alias("word_chars"),
        F.col("__symbols").alias("n_symbols"),
        F.col("__dup_lines").alias("n_dup_lines"),
        F.col("__repeat").alias("n_repeat_words"),
        F.col("__failed").alias("base_failed"),
        (~F.col("__failed") & ~F.col("rejected")).alias("kept"),
    )


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with all their columns."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = stored(with_counts(docs).drop("__words", "__chars", "__symbols", "__dup_lines", "__repeat"), "counted")
    hosts = host_verdicts(kept, "source", "__failed").select(F.col("host").alias("__host"), F.col("rejected").alias("__rejected"))
    good = kept.where(~F.col("__failed"))
    return good.join(hosts, good["source"].eqNullSafe(hosts["__host"])).where(~F.col("__rejected")).select(*columns)


_SQL_COUNTS = r"""
d as (select doc_id, source, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d),
keyed as (select *, row_number() over () as k from w),
win as (select k, i, list_slice(words, i, i + 7) as win from (select k, words, unnest(range(1, len(words) - 6)) as i from keyed where len(words) >= 8)),
rep as (select k, i from (select k, i, count(*) over (partition by k, win) as c from win) where c > 1),
cov as (select k, sum(least(8, coalesce(i - prev, 8))) as n from (select k, i, lag(i) over (partition by k order by i) as prev from rep) group by k),
lines as (select k, sum(c - 1) as n from (select k, line, count(*) as c from (select k, unnest(string_split(text, chr(10))) as line from keyed) where regexp_matches(line, '[^\x20\x09-\x0D]') group by k, line) group by k),
counted as (
    select doc_id, source, len(words)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(lines.n, 0)::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words
    from keyed left join cov using (k) left join lines using (k)),
judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counted),
hosts as (select source as host, count(*) as n, sum(base_failed::int) as f from judged group by source),
sums as (select count(*)::double as k, sum(n)::double as n, sum(f)::double as f, sum(f::double * f / n) as ff from hosts),
prior as (select f / n as m, ff / n - (f / n) * (f / n) - (f / n) * (1 - f / n) * k / n as between_ from sums),
fitted as (select m, case when between_ > 0 and m * (1 - m) > 0 then least(greatest(m * (1 - m) / between_ - 1, 1.0), 1e6) else 1e6 end as strength from prior),
verdict as (select host, (f + m * strength) / (n + strength) > 0.5 as rejected from hosts, fitted)
"""
SQL = f"""with {_SQL_COUNTS}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not rejected as kept
from judged join verdict on source is not distinct from host"""
