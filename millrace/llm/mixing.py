"""Mixing sources to target weights, in DataFrame functions only.

Documents are cut into blocks: a document's block is the hash of its content modulo the number of blocks of its source. A
source's target gives its quota, an exact number of blocks: whole epochs, which draw all its blocks, and a rest, the first
blocks of a permutation, as many as come nearest. A tree splits the quotas among output shards by multivariate
hypergeometric draws: groups of sources get places in every shard, and hand them down to smaller groups and at last to
sources. A shard then takes its quota, the next blocks of each source's permutation, disjoint ones, and sorts their documents by a hash.
What a document gives to the mix is what the shards took of its block.

No row or task has all sources, and a source has at most BLOCKS blocks; documents are never grouped by source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored, text_of, words_of

#: Blocks of a source at most; times a document is taken at most; levels of halving that make the shards (2 ** LEVELS); seed.
BLOCKS, EPOCHS, LEVELS, SEED = 4096, 3, 4, 20240
#: Groups of sources, or sources, into which a group is split.
FAN = 64
#: Permutations of a source's blocks that are tried, the nearest counts: so many, and more for few documents, up to the second number.
STARTS, MOST_STARTS = 8, 256


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns with source, size (words) and hash (identity of the row)."""
    text = text_of()
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("source").cast("string").alias("__source"), F.size(words_of(text)).cast("long").alias("__size"), F.xxhash64("doc_id", text, F.lit(SEED)).alias("__hash"))


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` (a written table) with ``rank``, from 0 by code point, null last: sorted by ranges, each counted on from those before."""
    ranged = sources.withColumn("__null", F.col("__source").isNull()).repartitionByRange("__null", "__source").withColumn("__part", F.spark_partition_id())
    ranged = stored(ranged, "source-ranges")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("n"))  # a row a range
    before = counts.select(F.col("__part").alias("__p"), (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy("__null", "__source")) - 1
    return ranged.withColumn("nth", nth).join(before, F.col("__part") == F.col("__p")).withColumn("rank", F.col("nth") + F.col("__before")).drop("__part", "__p", "__null", "__before", "nth")


def targets(sizes: DataFrame) -> DataFrame:
    """Per source: rank (code points, null last), size, target, whole epochs, quota of the rest in words, blocks, documents.

    Weights are 1, 2, 3, repeating. Targets share the total size by weight, no source above EPOCHS times its size: what is
    above goes back and is shared again among the others, in rounds of one aggregate, until nothing is.
    """
    sources = stored(sizes.groupBy("__source").agg(F.sum("__size").alias("size"), F.count("*").alias("docs")), "sources")
    ranked = _ranked(sources).withColumn("weight", (F.col("rank") % 3 + 1).cast("double")).withColumn("cap", F.lit(EPOCHS) * F.col("size").cast("double"))
    ranked = stored(ranked, "ranked-sources")
    share, known = 0.0, None
    while True:
        capped = F.col("weight") * F.lit(share) > F.col("cap")
        row = ranked.agg(F.sum("size").alias("total"), F.sum(F.when(capped, F.col("cap"))).alias("full"), F.sum(F.when(~capped, F.col("weight"))).alias("weight"), F.count(F.when(capped, 1)).alias("n")).first()
        if row["n"] == known or not row["weight"]:
            break
        known, share = row["n"], (row["total"] - (row["full"] or 0.0)) / row["weight"]
    target = F.least(F.col("cap"), F.col("weight") * F.lit(share))
    out = ranked.withColumn("target", target).withColumn("epochs", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("int"))
    quota = F.round(F.col("target") - F.col("epochs") * F.col("size")).cast("long")
    return out.select("__source", "rank", "size", "target", "epochs", quota.alias("quota"), F.least(F.lit(BLOCKS), 256 * F.col("docs")).cast("int").alias("blocks"), "docs")


#: The blocks of ``all`` that have words, in the order of permutation ``start``.
_PERMUTED = f"sort_array(transform(filter(all, x -> x.size > 0), x -> struct(xxhash64({SEED}, start, rank, x.block) as o, x.block as block, x.size as size)))"
#: How many first ones of ``of`` come nearest to ``quota``, and how near.
_NEAREST = """aggregate(of, struct(0L as taken, 0 as n, quota as gap, 0 as best), (a, x) -> transform(array(a.taken + x.size), t ->
    struct(t as taken, a.n + 1 as n, least(a.gap, abs(quota - t)) as gap, case when abs(quota - t) < a.gap then a.n + 1 else a.best end as best))[0],
    a -> struct(a.gap as gap, start as start, a.best as best))"""


def hypergeometric(total: str, marked: str, drawn: str, uniform: str, name: str = "h") -> str:
    """SQL of a hypergeometric draw: of ``total`` things ``marked`` are marked; how many of them are among ``drawn`` ones.

    By inversion, exact but for the rounding of doubles: weights, the likeliest number's being 1, are added up to both sides,
    as far as 12 standard deviations and 60 more, and ``uniform`` (in [0, 1)) says at which number that sum is passed. ``name`` keeps nested draws apart.
    """
    x, v = f"{name}x", f"{name}v"
    bound = f"""array(struct(cast({total} as bigint) as total, cast({marked} as bigint) as marked, cast({drawn} as bigint) as drawn, cast({uniform} as double) as u))"""
    low, high = f"greatest(0L, {v}.drawn - ({v}.total - {v}.marked))", f"least({v}.drawn, {v}.marked)"
    spread = f"sqrt(cast({v}.drawn as double) * {v}.marked * ({v}.total - {v}.marked) / greatest({v}.total, 1) / greatest({v}.total, 1) * ({v}.total - {v}.drawn) / greatest({v}.total - 1, 1))"
    mode = f"cast(floor((cast({v}.drawn as double) + 1) * ({v}.marked + 1) / (cast({v}.total as double) + 2)) as bigint)"
    middle = f"transform({bound}, {v} -> struct({v}.total as total, {v}.marked as marked, {v}.drawn as drawn, {v}.u as u, {low} as low, {high} as high, cast(ceil(12 * {spread}) as bigint) + 60 as reach, greatest({low}, least({high}, {mode})) as m))"
    up = f"(cast({v}.marked - {x} as double) * ({v}.drawn - {x})) / ((cast({x} as double) + 1) * ({v}.total - {v}.marked - {v}.drawn + {x} + 1))"
    down = f"(cast({x} as double) * ({v}.total - {v}.marked - {v}.drawn + {x})) / ((cast({v}.marked - {x} as double) + 1) * ({v}.drawn - {x} + 1))"
    above, below = f"sequence({v}.m, least({v}.high, {v}.m + {v}.reach))", f"sequence({v}.m, greatest({v}.low, {v}.m - {v}.reach))"

    def weights(numbers: str, ratio: str) -> str:
        return f"aggregate({numbers}, struct(1D as w, 0D as t), (a, {x}) -> struct(a.w * {ratio} as w, a.t + a.w as t), a -> a.t)"

    def passed(numbers: str, ratio: str, at: str, skip: str) -> str:
        start = f"struct(1D as w, {skip} as t, {v}.m as f)"
        return f"aggregate({numbers}, {start}, (a, {x}) -> struct(a.w * {ratio} as w, a.t + a.w as t, case when a.t <= {at} then {x} else a.f end as f), a -> a.f)"

    # below the likeliest number, which counts above, the sum begins at -1
    summed = f"transform({middle}, {v} -> struct({v}.total as total, {v}.marked as marked, {v}.drawn as drawn, {v}.low as low, {v}.high as high, {v}.reach as reach, {v}.m as m, {weights(above, up)} as above, {weights(below, down)} - 1 as below, {v}.u as u))"
    at = f"{v}.u * ({v}.above + {v}.below)"
    return f"transform({summed}, {v} -> case when {at} < {v}.above or {v}.below <= 0 then {passed(above, up, at, '0D')} else {passed(below, down, f'({at} - {v}.above)', '-1D')} end)[0]"


def split_tree(quotas: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(shard, rank, n): ``quotas`` (rank, n) split among 2 ** levels shards, exactly, by multivariate hypergeometric draws.

    All places are halved again and again: they are the shards' (the first ones get what is over). A node of the tree is a group of
    sources with its places in every shard; its FAN parts draw theirs one after the other, each shard after shard, so
    that what is left is always exactly enough. The leaves are sources.
    """
    shards = 1 << levels
    quotas = stored(quotas.select(F.col("rank").cast("long").alias("rank"), F.col("n").cast("long").alias("n")), "quotas")
    row = quotas.agg(F.max("rank").alias("last"), F.sum("n").alias("n")).first()
    if row["n"] is None:
        return quotas.select(F.lit(0).alias("shard"), "rank", "n")
    height = 1
    while FAN**height <= row["last"]:
        height += 1
    places = [row["n"] // shards + (k < row["n"] % shards) for k in range(shards)]
    nodes = None
    uniform = f"shiftrightunsigned(xxhash64({SEED}, height, c.id, k), 11) / 9007199254740992D"
    one = hypergeometric("b.rest", "element_at(b.free, k)", "b.need", uniform)
    # a part's places: shard after shard, of those that are left from there on
    share = f"""aggregate(sequence(1, {shards}), struct(aggregate(p.free, 0L, (s, y) -> s + y) as rest, c.n as need, p.free as free, cast(array() as array<bigint>) as got),
        (b, k) -> transform(array({one}), d -> struct(b.rest - element_at(b.free, k) as rest, b.need - d as need, b.free as free, concat(b.got, array(d)) as got))[0], b -> b.got)"""
    parts = f"""aggregate(parts, struct(free as free, cast(array() as array<struct<id:bigint,free:array<bigint>>>) as out),
        (p, c) -> transform(array({share}), g -> struct(zip_with(p.free, g, (y, z) -> y - z) as free, concat(p.out, array(struct(c.id as id, g as free))) as out))[0], p -> p.out)"""
    for level in range(height - 1, -1, -1):
        groups = quotas.groupBy(F.expr(f"rank div {FAN**level}L").alias("part")).agg(F.sum("n").alias("n"))
        listed = groups.groupBy(F.expr(f"part div {FAN}L").alias("above")).agg(F.sort_array(F.collect_list(F.struct(F.col("part").alias("id"), "n"))).alias("parts"))
        # the root has all parts of the highest level
        asked = listed.withColumn("free", F.array(*[F.lit(x).cast("long") for x in places])) if nodes is None else nodes.join(listed.hint("merge"), F.col("id") == F.col("above"))
        nodes = stored(asked.withColumn("height", F.lit(level)).select(F.explode(F.expr(parts)).alias("x")).select("x.*"), "tree")
    return nodes.select(F.col("id").alias("rank"), F.posexplode("free").alias("shard", "n")).select("shard", "rank", "n")


def plan(sizes: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(sources, draws): the table of ``targets``, and (rank, block, draws) with an array of (epoch, shard) a drawn block.

    Blocks without words come with whole epochs only.
    """
    sources = stored(targets(sizes), "targets")
    at = sizes.join(sources, sizes["__source"].eqNullSafe(sources["__source"])).select("rank", "__size", F.pmod("__hash", F.col("blocks")).cast("int").alias("block"))
    blocks = at.groupBy("rank", "block").agg(F.sum("__size").alias("size"))
    # arrays compress so well that their files say little of their size: joins of them are by sorting, never by broadcast
    listed = stored(sources.join(blocks.groupBy("rank").agg(F.collect_list(F.struct("block", "size")).alias("all")).hint("merge"), "rank").select("rank", "epochs", "quota", "all", "docs"), "source-blocks")
    starts = F.greatest(F.lit(STARTS), F.least(F.lit(MOST_STARTS), F.expr(f"{BLOCKS} div docs"))).cast("int")
    tries = listed.select("rank", "quota", "all", F.explode(F.sequence(F.lit(1), starts)).alias("start"))
    # few bytes, but much work a row: a number keeps them from being put together again
    tries = tries.repartition(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rank", "start")
    nearest = tries.select("rank", "quota", "start", F.expr(_PERMUTED).alias("of")).select("rank", F.expr(_NEAREST).alias("x")).groupBy("rank").agg(F.min("x").alias("x")).select("rank", "x.start", "x.best")
    chosen = listed.join(nearest.hint("merge"), "rank").select("rank", "epochs", "all", F.slice(F.expr(_PERMUTED), F.lit(1), F.col("best")).alias("picked"))
    drawn = F.concat(
        F.flatten(F.transform(F.sequence(F.lit(0), F.lit(EPOCHS - 1)), lambda e: F.when(e < F.col("epochs"), F.transform("all", lambda x: F.struct(e.alias("epoch"), x["block"].alias("block")))).otherwise(F.expr("cast(array() as array<struct<epoch:int,block:int>>)")))),
        F.transform("picked", lambda x: F.struct(F.col("epochs").alias("epoch"), x["block"].alias("block"))),
    )
    drawn = stored(chosen.select("rank", drawn.alias("drawn")), "drawn")
    leaves = split_tree(drawn.select("rank", F.size("drawn").alias("n")), levels)
    quotas = leaves.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("quotas"))
    # a source's drawn blocks in permuted order; a shard takes the next ones up to its quota
    order = F.sort_array(F.transform("drawn", lambda x: F.struct(F.xxhash64(F.lit(SEED + 1), "rank", x["epoch"], x["block"]).alias("o"), x["epoch"].alias("epoch"), x["block"].alias("block"))))
    shards = F.flatten(F.transform("quotas", lambda q: F.array_repeat(q["shard"], q["n"].cast("int"))))
    dealt = drawn.join(quotas.hint("merge"), "rank").select("rank", F.explode(F.arrays_zip(order.alias("of"), shards.alias("shard"))).alias("x")).select("rank", "x.of.block", "x.of.epoch", "x.shard")
    return sources, stored(dealt.groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("draws")), "draws")


def _with_draws(sizes: DataFrame, sources: DataFrame, draws: DataFrame) -> DataFrame:
    s = sources.select(F.col("__source").alias("__s"), F.col("rank").alias("__rank"), F.col("size").alias("__source_size"), F.col("target").alias("__target"), F.col("blocks").alias("__blocks"))
    d = draws.select(F.col("rank").alias("__r"), F.col("block").alias("__b"), F.col("draws").alias("__draws"))
    at = sizes.join(s, sizes["__source"].eqNullSafe(s["__s"])).withColumn("__block", F.pmod("__hash", F.col("__blocks")).cast("int"))
    # draws compress so well that their files say little of their size: never broadcast
    return at.join(d.hint("merge"), (F.col("__rank") == F.col("__r")) & (F.col("__block") == F.col("__b")), "left")


def taken(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, size, source_size, target (of its source), taken (words, repeats counted) and its output shards.

    Whole documents are taken, none more than EPOCHS times. Null texts have size 0 and null is a source of its own; repeated
    rows are taken alike; further columns are ignored; an empty table gives an empty one. Hashes decide, so reruns agree.
    """
    sizes = stored(sized(docs, "doc_id"), "sizes")
    found = _with_draws(sizes, *plan(sizes))
    times = F.when(F.col("__draws").isNull(), 0).otherwise(F.size("__draws"))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * times).cast("long").alias("taken"),
        F.coalesce(F.transform("__draws", lambda x: x["shard"]), F.expr("cast(array() as array<int>)")).alias("shards"),
    )


def mixed(docs: DataFrame, place: bool = False) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, shard after shard, each in shuffled order.

    Rows are dealt to partitions by shard and by range of ``__place``, a hash, and sorted by it: partitions in order, and so
    the files written from them, are the shards in order. With ``place``, the shard and the place are columns.
    """
    columns = docs.columns
    sizes = stored(sized(docs.select("doc_id", "source", "text")), "sizes")
    found = _with_draws(sized(docs, *columns), *plan(sizes))
    kept = [F.col(f"`{c}`") for c in columns]
    rows = found.select(*kept, "__hash", F.explode("__draws").alias("__draw"))
    rows = rows.select(*kept, F.col("__draw.shard").alias("__shard"), F.xxhash64(F.lit(SEED + 2), "__hash", "__draw.epoch").alias("__place"))
    # partitions of a shard: places are uniform, so equal ranges of them are even
    ranges = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) >> LEVELS)
    part = F.least(F.floor((F.col("__place") / F.lit(2.0**64) + 0.5) * ranges), F.lit(ranges - 1))
    dealt = rows.repartitionById(ranges << LEVELS, (F.col("__shard") * ranges + part).cast("int")).sortWithinPartitions("__shard", "__place")
    return dealt if place else dealt.select(*kept)
