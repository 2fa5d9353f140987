"""The registered queries of the log engine, over the events table as the log, with their SQL.

Topics are event types, entries the UTF-8 properties in the order of event_id; a client sends REQUEST entries at a time, and
segments have MAX_BLOCK bytes, so that small tables have several.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import binary, render
from millrace.operators import index, log, read
from millrace.sources import segments
from millrace.sources.store import LeaseError, LogStore, ReadOnlyError
from millrace.sources.text import lines_of
from millrace.streaming import follow, stateful
from millrace.tables import shared_dir, stored

REQUEST, MAX_BLOCK, EVERY, START, END, BATCH, MAX_BYTES = 10, 20_000, 10, 137, 612, 100, 3000


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return log.as_entries(events, "event_type", F.encode("props", "UTF-8"), "event_id")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.with_requests(log.assign_offsets(entries(spark, sf_dir)), REQUEST)


def blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.with_blocks(numbered(spark, sf_dir), MAX_BLOCK)


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("content", F.decode("content", "UTF-8"))


def topic_list(spark, sf_dir):
    return read.topics(entries(spark, sf_dir))


def assign_offsets(spark, sf_dir):
    return _text(numbered(spark, sf_dir)).select("topic", "offset", "content")


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/millrace-store-{uuid.uuid4().hex}"


def _store(spark, sf_dir) -> LogStore:
    """A read-only store to which the log was written in one commit."""
    root = _place(spark)
    with LogStore(spark, root, MAX_BLOCK, REQUEST) as store:
        store.write(entries(spark, sf_dir))
    return LogStore(spark, root, MAX_BLOCK, REQUEST, read_only=True)


def read_from_offset(spark, sf_dir):
    return _text(_store(spark, sf_dir).read("click", START))


def read_range(spark, sf_dir):
    return _text(_store(spark, sf_dir).read("click", START, END))


def read_at_end_empty(spark, sf_dir):
    """By topic, what reads from its last entry, from its end and from beyond give; and what an unknown topic gives."""
    store = _store(spark, sf_dir)
    counts = []
    for row in store.status().collect():
        reads = [("last", store.read(row.topic, row.next_offset - 1)), ("end", store.read(row.topic, row.next_offset)), ("beyond", store.read(row.topic, row.next_offset + 5))]
        counts += [df.agg(F.count("*").alias("n")).select(F.lit(row.topic).alias("topic"), F.lit(name).alias("start"), "n") for name, df in reads]
    counts.append(store.read("no such topic").agg(F.count("*").alias("n")).select(F.lit("no such topic").alias("topic"), F.lit("first").alias("start"), "n"))
    return reduce(DataFrame.union, counts)


def store_read_batches(spark, sf_dir):
    """The batches of a read of a store: their bounds and the digest of their contents in order."""
    rows = _store(spark, sf_dir).read_batches("click", START, BATCH)
    contents = F.transform("entries", lambda e: F.decode(e["content"], "UTF-8"))
    return rows.select("block", "read_batch", F.element_at("entries", 1)["offset"].alias("first_offset"), F.size("entries").cast("long").alias("n"), F.md5(F.array_join(contents, "\n").cast("binary")).alias("digest"))


def capped_batches(spark, sf_dir):
    return read.capped_batches(blocked(spark, sf_dir), START, BATCH, MAX_BYTES)


def follow_batches(spark, sf_dir):
    """The batches that a following reader gets, in the order in which it gets them."""
    got = [(i, first, len(rows), hashlib.md5(b"\n".join(c for _, c in rows)).hexdigest()) for i, (first, rows) in enumerate(follow.follow(_store(spark, sf_dir), "click", START, BATCH, poll=0, ttl=0))]
    return spark.createDataFrame(got, "nth long, first_offset long, n long, digest string")


def _segment_files(spark, sf_dir) -> str:
    """A folder of binary segment files with the log."""
    segments.register(spark)
    root = f"{shared_dir(spark)}/millrace-segments-{uuid.uuid4().hex}"
    rows = blocked(spark, sf_dir).select("topic", "block", "offset", "content")
    rows.repartition("topic", "block").sortWithinPartitions("topic", "block", "offset").write.format("segments").mode("append").option("path", root).save()
    return root


def segment_scan(spark, sf_dir):
    found = spark.read.format("segments").option("verify", "true").load(_segment_files(spark, sf_dir))
    return _text(found.select("topic", "block", "offset", "byte_size", "byte_offset", "content"))


def segment_read_from(spark, sf_dir):
    """Filters on topic and offset, which choose files and where to begin in them."""
    found = spark.read.format("segments").load(_segment_files(spark, sf_dir))
    return _text(found.where((F.col("topic") == "click") & (F.col("offset") >= START)).select("offset", "content"))


def segment_index_files(spark, sf_dir):
    return spark.read.format("segment_index").load(_segment_files(spark, sf_dir))


def segment_tails(spark, sf_dir):
    return segments.segment_tails(spark, _segment_files(spark, sf_dir))


def segment_positions(spark, sf_dir):
    return segments.find_positions(spark, _segment_files(spark, sf_dir), 3)


def index_refresh(spark, sf_dir):
    """The sparse index kept by a stream of three commits, brought up to date twice."""
    root = _place(spark)
    with LogStore(spark, root, MAX_BLOCK, REQUEST) as store:
        rows = stored(entries(spark, sf_dir), "entries")
        third = rows.agg(F.max("o0")).first()[0] // 3 + 1
        for i in range(3):
            store.write(rows.where(F.floor(F.col("o0") / third) == i))
            if i:
                follow.refresh_index(store, f"{root}/index", f"{root}/cursor", EVERY, per_trigger=1).awaitTermination()
        kept = spark.read.parquet(f"{root}/index").select("topic", "block", "offset", "byte_offset")
        every = index.sparse_index(store.log(), EVERY)
    both = kept.withColumn("a", F.lit(1)).unionByName(every.withColumn("a", F.lit(-1))).groupBy("topic", "block", "offset", "byte_offset").agg(F.sum("a").alias("d"))
    return kept.groupBy("topic").agg(F.count("*").alias("n")).join(both.where("d <> 0").groupBy("topic").agg(F.count("*").alias("wrong")), "topic", "left").select("topic", "n", F.coalesce("wrong", F.lit(0)).cast("long").alias("wrong"))


def writer_rules(spark, sf_dir):
    """Who may write: each step, and whether it was let through."""
    root, rows, steps = _place(spark), entries(spark, sf_dir).limit(5), []

    def tried(step: str, do) -> object:
        try:
            got = do()
            steps.append((step, True))
            return got
        except (LeaseError, ReadOnlyError):
            steps.append((step, False))

    first = tried("first writer", lambda: LogStore(spark, root, lease_seconds=60))
    tried("second writer", lambda: LogStore(spark, root, lease_seconds=60))
    tried("writer of a topic beside a writer of all", lambda: LogStore(spark, root, lease_seconds=60, topics=["click"]))
    reader = tried("reader", lambda: LogStore(spark, root, read_only=True))
    tried("write by the first", lambda: first.write(rows))
    tried("write by the reader", lambda: reader.write(rows))
    tried("read by the reader", lambda: reader.read("click").count())
    first.close()
    click = tried("writer of a topic", lambda: LogStore(spark, root, lease_seconds=60, topics=["click"]))
    view = tried("writer of another topic", lambda: LogStore(spark, root, lease_seconds=60, topics=["view"]))
    tried("writer of both", lambda: LogStore(spark, root, lease_seconds=60, topics=["click", "view"]))
    tried("write to the own topic", lambda: click.write(rows.withColumn("topic", F.lit("click"))))
    tried("write to the other's topic", lambda: click.write(rows.withColumn("topic", F.lit("view"))))
    tried("write by the other", lambda: view.write(rows.withColumn("topic", F.lit("view"))))
    tried("writer without a claim", lambda: LogStore(spark, root, lease_seconds=None))
    thief = tried("writer that finds claims stale", lambda: LogStore(spark, root, lease_seconds=-1, topics=["click"]))
    tried("write with a lost claim", lambda: click.write(rows.withColumn("topic", F.lit("click"))))
    for store in (click, view, thief):
        store.close()
    tried("writer after all have left", lambda: LogStore(spark, root).close())
    return spark.createDataFrame(steps, "step string, allowed boolean")


def write_batches(spark, sf_dir):
    return log.requests(numbered(spark, sf_dir)).select("topic", "batch_id", "first_offset", "wrote", "n_bytes")


def frame_sizes(spark, sf_dir):
    return numbered(spark, sf_dir).select("topic", "offset", binary.frame_size(F.col("content")).alias("frame_bytes"))


def block_rollover(spark, sf_dir):
    return log.roll_blocks(log.requests(numbered(spark, sf_dir)), MAX_BLOCK)


def block_info(spark, sf_dir):
    return log.block_info(blocked(spark, sf_dir))


def topic_status(spark, sf_dir):
    return log.topic_status(blocked(spark, sf_dir))


def byte_offsets(spark, sf_dir):
    return log.byte_offsets(blocked(spark, sf_dir)).select("topic", "block", "offset", "byte_offset")


def sparse_index(spark, sf_dir):
    return index.sparse_index(blocked(spark, sf_dir), EVERY)


def _every(rows: DataFrame) -> DataFrame:
    return rows.select("topic", F.col("offset").alias("target"))


def offset_to_block(spark, sf_dir):
    """Every offset, and the one beyond the end of each topic."""
    rows = stored(blocked(spark, sf_dir).drop("content"), "log")
    beyond = rows.groupBy("topic").agg((F.max("offset") + 1).alias("target"))
    return index.find_blocks(_every(rows).unionByName(beyond), log.block_info(rows))


def index_lookup(spark, sf_dir):
    """Every offset; the one beyond the end has no block to look in."""
    rows = stored(blocked(spark, sf_dir).drop("content"), "log")
    return index.nearest_entry(index.find_blocks(_every(rows), log.block_info(rows)), index.sparse_index(rows, EVERY))


def scan_count(spark, sf_dir):
    return index.scan_counts(index_lookup(spark, sf_dir))


def index_head(spark, sf_dir):
    return index.index_head(sparse_index(spark, sf_dir))


def unindexed_blocks(spark, sf_dir):
    rows = stored(blocked(spark, sf_dir).drop("content"), "log")
    return index.unindexed_blocks(log.block_info(rows), index.sparse_index(rows, 150))


def read_batches(spark, sf_dir):
    return read.batches(blocked(spark, sf_dir), START, BATCH)


def contiguity_check(spark, sf_dir):
    """The log as it is: no rows unless it has gaps."""
    return log.contiguity_violations(blocked(spark, sf_dir))


def contiguity_gaps(spark, sf_dir):
    """A log into which gaps were put: every entry of an offset that leaves 3 when divided by 50 is missing."""
    rows = blocked(spark, sf_dir).where("offset % 50 <> 3")
    return log.contiguity_violations(rows)


def render_lines(spark, sf_dir):
    return numbered(spark, sf_dir).select("topic", render.entry_line(F.col("offset"), F.col("content")).alias("line"))


def render_index(spark, sf_dir):
    return sparse_index(spark, sf_dir).select("topic", "block", render.index_line(F.col("offset"), F.col("byte_offset")).alias("line"))


def render_blocks(spark, sf_dir):
    blocks = log.block_info(blocked(spark, sf_dir)).groupBy("topic").agg(F.sort_array(F.collect_set("block")).alias("b"))
    return blocks.select("topic", F.posexplode("b").alias("i", "block")).select("topic", F.concat_ws(" -> ", "i", "block").alias("line"))


def le_encode_offset(spark, sf_dir):
    rows = numbered(spark, sf_dir)
    return rows.select("topic", "offset", F.hex(binary.le64(F.col("offset"))).alias("le64"), F.hex(binary.le32(F.col("byte_size"))).alias("le32"))


def frame_encode_crc32c(spark, sf_dir):
    rows = numbered(spark, sf_dir)
    return rows.select("topic", "offset", F.hex(binary.frame(F.col("content"), F.col("offset"))).alias("frame"))


def frame_roundtrip(spark, sf_dir):
    frames = numbered(spark, sf_dir).select("topic", binary.frame(F.col("content"), F.col("offset")).alias("f"))
    size = binary.from_le(F.col("f"), 5, 8)
    back = frames.select("topic", size.alias("byte_size"), F.expr("substring(f, 13, length(f) - 20)").alias("content"), binary.from_le(F.expr("substring(f, length(f) - 7, 8)"), 1, 8).alias("offset"), "f")
    ok = binary.from_le(F.col("f"), 1, 4) == binary.crc32c(F.expr("substring(f, 5, length(f) - 4)"))
    return back.where(ok).select("topic", "offset", "byte_size", F.decode("content", "UTF-8").alias("content"))


def text_lines_ingest(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    lines = lines_of(docs, "text", "source", "doc_id")
    rows = log.assign_offsets(log.as_entries(lines, "source", "content", "doc_id", "line_no"))
    return rows.select("topic", "offset", F.octet_length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest"))


def write_status(spark, sf_dir):
    with LogStore(spark, _place(spark), MAX_BLOCK, REQUEST) as store:
        wrote = store.write(entries(spark, sf_dir))
        return spark.createDataFrame([(wrote,)], "wrote long")


def store_append(spark, sf_dir):
    """Two appends: what the store holds equals one log of both, blocks included."""
    with LogStore(spark, _place(spark), MAX_BLOCK, REQUEST) as store:
        rows = entries(spark, sf_dir)
        store.write(rows.where("o0 % 1000 < 500"))
        store.write(rows.where("o0 % 1000 >= 500"))
        return _text(store.log()).select("topic", "offset", "content")


def stream_offsets(spark, sf_dir):
    root = _place(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # as a pattern: the file source takes folders and patterns, and the table may be one file
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("data", F.encode("props", "UTF-8"))
    with LogStore(spark, root, MAX_BLOCK, REQUEST) as store:
        follow.ingest(stream, store, f"{root}/ingest", "event_type", "data", "event_id").awaitTermination()
        return _text(store.log()).select("topic", "offset", "content")


def stream_offsets_stateful(spark, sf_dir):
    """The same by a stateful operator, from stream to stream."""
    root = f"{shared_dir(spark)}/millrace-stateful-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("data", F.encode("props", "UTF-8"))
    numbered_ = stateful.with_offsets(stream, "event_type", "data", "event_id")
    numbered_.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return _text(spark.read.schema(numbered_.schema).parquet(f"{root}/out")).select("topic", "offset", "content")


def stream_tail_replay(spark, sf_dir):
    """Appends in three commits, followed from an offset on into a table."""
    root = _place(spark)
    with LogStore(spark, root, MAX_BLOCK, REQUEST) as store:
        rows = stored(entries(spark, sf_dir), "entries")
        third = rows.agg(F.max("o0")).first()[0] // 3 + 1
        for i in range(3):
            store.write(rows.where(F.floor(F.col("o0") / third) == i))

        def keep(new: DataFrame, number: int) -> None:
            new.write.mode("overwrite").parquet(f"{root}/out/part={number}")

        follow.tail(store, f"{root}/tail", keep, "view", START, per_trigger=1).awaitTermination()
        return _text(spark.read.parquet(f"{root}/out")).select("offset", "content")


QUERIES = [
    topic_list, assign_offsets, read_from_offset, read_range, read_at_end_empty, store_read_batches, capped_batches, follow_batches, segment_scan, segment_read_from, segment_index_files, segment_tails, segment_positions, index_refresh, writer_rules, write_batches, frame_sizes, block_rollover, block_info, topic_status, byte_offsets, sparse_index, offset_to_block, index_lookup, scan_count, index_head,
    unindexed_blocks, read_batches, contiguity_check, contiguity_gaps, render_lines, render_index, render_blocks, le_encode_offset, frame_encode_crc32c, frame_roundtrip, text_lines_ingest, write_status, store_append, stream_offsets, stream_offsets_stateful, stream_tail_replay,
]


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


_LOG = """log as (select event_type as topic, row_number() over (partition by event_type order by event_id) - 1 as "offset", coalesce(props, '') as content,
    strlen(coalesce(props, '')) as byte_size from events where event_type is not null)"""
_REQUESTS = f"""{_LOG}, req as (select topic, "offset" // {REQUEST} as batch_id, min("offset") as first_offset, count(*) as wrote, sum(byte_size + 20)::bigint as n_bytes from log group by 1, 2)"""
_ROLLED = f"""{_REQUESTS}, rolled as (select topic, batch_id, first_offset as block, n_bytes as head_bytes from req where batch_id = 0
    union all select req.topic, req.batch_id, case when head_bytes > {MAX_BLOCK} then first_offset else block end, case when head_bytes > {MAX_BLOCK} then n_bytes else head_bytes + n_bytes end
    from rolled join req on req.topic = rolled.topic and req.batch_id = rolled.batch_id + 1)"""
_BLOCKED = f"""{_ROLLED}, blk as (select log.*, block from log join rolled on log.topic = rolled.topic and "offset" // {REQUEST} = batch_id)"""
_INFO = f"""{_BLOCKED}, info as (select topic, block, max("offset") as last_offset, count(*) as n_entries, sum(byte_size + 20)::bigint as n_bytes from blk group by 1, 2)"""
_BYTES = f"""{_INFO}, bo as (select topic, block, "offset", coalesce(sum(byte_size + 20) over (partition by topic, block order by "offset" rows between unbounded preceding and 1 preceding), 0)::bigint as byte_offset from blk)"""
_INDEX = f"""{_BYTES}, idx as (select * from bo where "offset" % {EVERY} = 0 and "offset" <> block)"""
_FOUND = f"""{_INDEX}, found as (select t.topic, t.block, t."offset" as target, coalesce(max(i."offset"), 0) as index_offset, coalesce(arg_max(i.byte_offset, i."offset"), 0) as byte_offset
        from blk t left join idx i on i.topic = t.topic and i.block = t.block and i."offset" <= t."offset" group by 1, 2, 3)"""


def _hex_le(x: str, size: int) -> str:
    digits = f"lpad(to_hex({x}), {2 * size}, '0')"
    return "concat(" + ", ".join(f"substr({digits}, {2 * i + 1}, 2)" for i in reversed(range(size))) + ")"


def oracle_sql() -> dict[str, str]:
    everything = f'with {_LOG} select topic, "offset", content from log'
    return {
        "topic_list": "select distinct event_type as topic from events where event_type is not null and not starts_with(event_type, '.')",
        "assign_offsets": everything,
        "read_from_offset": f"with {_LOG} select \"offset\", content from log where topic = 'click' and \"offset\" >= {START}",
        "read_range": f"with {_LOG} select \"offset\", content from log where topic = 'click' and \"offset\" >= {START} and \"offset\" < {END}",
        "read_at_end_empty": f"""with {_LOG} select distinct topic, start, n::bigint as n from log, (values ('last', 1), ('end', 0), ('beyond', 0)) as v(start, n) union all select 'no such topic', 'first', 0""",
        "store_read_batches": f"""with recursive {_BLOCKED} select block, ("offset" - greatest({START}, block)) // {BATCH} as read_batch, min("offset") as first_offset, count(*) as n, md5(string_agg(content, chr(10) order by "offset")) as digest
            from blk where topic = 'click' and "offset" >= {START} group by 1, 2""",
        "capped_batches": f"""with recursive {_BLOCKED}, todo as (select topic, block, "offset", byte_size as n, row_number() over (partition by topic, block order by "offset") as r from blk where "offset" >= {START}),
            cut as (select topic, block, "offset", r, 0 as read_batch, 1 as held, n as bytes from todo where r = 1
                union all select t.topic, t.block, t."offset", t.r, case when held = {BATCH} or bytes > {MAX_BYTES} then read_batch + 1 else read_batch end,
                    case when held = {BATCH} or bytes > {MAX_BYTES} then 1 else held + 1 end, case when held = {BATCH} or bytes > {MAX_BYTES} then t.n else bytes + t.n end
                from cut c join todo t on t.topic = c.topic and t.block = c.block and t.r = c.r + 1)
            select topic, block, "offset", read_batch::bigint as read_batch from cut""",
        "follow_batches": f"""with {_LOG} select ("offset" - {START}) // {BATCH} as nth, min("offset") as first_offset, count(*) as n, md5(string_agg(content, chr(10) order by "offset")) as digest
            from log where topic = 'click' and "offset" >= {START} group by 1""",
        "segment_scan": f"with recursive {_BYTES} select blk.topic, blk.block, blk.\"offset\", byte_size::bigint as byte_size, byte_offset, content from blk join bo using (topic, block, \"offset\")",
        "segment_read_from": f"with {_LOG} select \"offset\", content from log where topic = 'click' and \"offset\" >= {START}",
        "segment_index_files": f"with recursive {_INDEX} select * from idx",
        "segment_tails": f"with recursive {_INFO} select topic, block, last_offset, n_bytes from info",
        "segment_positions": f"""with recursive {_INDEX}, t as (select * from bo where "offset" % 3 = 0),
            spots as (select t.topic, t.block, t."offset", t.byte_offset, max(i."offset") as near from t left join idx i on i.topic = t.topic and i.block = t.block and i."offset" <= t."offset" group by all)
            select topic, block, "offset", byte_offset, ("offset" - coalesce(near, block))::bigint as passed from spots""",
        "index_refresh": f"""with recursive th as (select max(event_id) // 3 + 1 as third from events where event_type is not null),
            log as (select event_type as topic, event_id // third as part, row_number() over (partition by event_type order by event_id) - 1 as "offset", strlen(coalesce(props, '')) as byte_size from events, th where event_type is not null),
            firsts as (select topic, part, min("offset") as f, sum(ceil(n / {REQUEST})) over (partition by topic order by part) - ceil(n / {REQUEST}) as b from (select topic, part, "offset", count(*) over (partition by topic, part) as n from log) group by topic, part, n),
            asked as (select log.*, (b + ("offset" - f) // {REQUEST})::bigint as batch_id from log join firsts using (topic, part)),
            req as (select topic, batch_id, min("offset") as first_offset, sum(byte_size + 20)::bigint as n_bytes from asked group by 1, 2),
            rolled as (select topic, batch_id, first_offset as block, n_bytes as head_bytes from req where batch_id = 0
                union all select req.topic, req.batch_id, case when head_bytes > {MAX_BLOCK} then first_offset else block end, case when head_bytes > {MAX_BLOCK} then n_bytes else head_bytes + n_bytes end
                from rolled join req on req.topic = rolled.topic and req.batch_id = rolled.batch_id + 1)
            select asked.topic, count(*) as n, 0::bigint as wrong from asked join rolled using (topic, batch_id) where "offset" % {EVERY} = 0 and "offset" <> block group by 1""",
        "writer_rules": """select * from (values ('first writer', true), ('second writer', false), ('writer of a topic beside a writer of all', false), ('reader', true), ('write by the first', true), ('write by the reader', false),
            ('read by the reader', true), ('writer of a topic', true), ('writer of another topic', true), ('writer of both', false), ('write to the own topic', true), ('write to the other''s topic', false), ('write by the other', true),
            ('writer without a claim', true), ('writer that finds claims stale', true), ('write with a lost claim', false), ('writer after all have left', true)) as v(step, allowed)""",
        "frame_encode_crc32c": f"""with recursive t(i, c) as (select range, list_reduce(list_prepend(range, range(8)), lambda r, k: case when r & 1 = 1 then xor(r >> 1, 2197175160) else r >> 1 end) from range(256)),
            steps as (select list(c order by i) as steps from t), {_LOG},
            body as (select topic, "offset", {_hex_le("byte_size", 8)} || hex(encode(content)) || {_hex_le(chr(34) + "offset" + chr(34), 8)} as b from log),
            bytes as (select topic, "offset", b, [('0x' || b[2 * i + 1 : 2 * i + 2])::bigint for i in range(length(b) // 2)] as v from body),
            crc as (select topic, "offset", b, xor(list_reduce(list_prepend(4294967295, v), lambda r, x: xor(r >> 8, steps[(xor(r, x) & 255) + 1])), 4294967295) as crc from bytes, steps)
            select topic, "offset", {_hex_le("crc", 4)} || b as frame from crc""",
        "write_batches": f"with {_REQUESTS} select topic, batch_id, first_offset, wrote, n_bytes from req",
        "frame_sizes": f'with {_LOG} select topic, "offset", (byte_size + 20)::bigint as frame_bytes from log',
        "block_rollover": f"with recursive {_ROLLED} select topic, batch_id, block, head_bytes::bigint as head_bytes from rolled",
        "block_info": f"with recursive {_INFO} select * from info",
        "topic_status": f"with recursive {_INFO} select topic, max(last_offset) + 1 as next_offset, max(block) as head_block, arg_max(n_bytes, block) as head_block_bytes, count(*) as n_blocks from info group by 1",
        "byte_offsets": f"with recursive {_BYTES} select * from bo",
        "sparse_index": f"with recursive {_INDEX} select * from idx",
        "offset_to_block": f'with recursive {_BLOCKED} select topic, "offset" as target, block from blk union all select topic, max("offset") + 1, null from blk group by 1',
        "index_lookup": f"with recursive {_FOUND} select * from found",
        "scan_count": f"with recursive {_FOUND} select topic, block, target, target - case when index_offset = 0 then block else index_offset end as scanned from found",
        "index_head": f'with recursive {_INDEX} select topic, block, max("offset") as "offset", arg_max(byte_offset, "offset") as byte_offset from idx group by 1, 2',
        "unindexed_blocks": f"""with recursive {_BYTES}, sparse as (select distinct topic, block from bo where "offset" % 150 = 0 and "offset" <> block)
            select topic, block from info where (topic, block) not in (select (topic, block) from sparse) union select topic, max(block) from info group by 1""",
        "read_batches": f"""with recursive {_BLOCKED} select topic, block, ("offset" - greatest({START}, block)) // {BATCH} as read_batch, min("offset") as first_offset, max("offset") as last_offset, count(*) as n
            from blk where "offset" >= {START} group by 1, 2, 3""",
        "contiguity_gaps": f"""with recursive {_BLOCKED}, part as (select topic, block, "offset", lag("offset") over (partition by topic, block order by "offset") as previous from blk where "offset" % 50 <> 3)
            select * from part where "offset" - previous <> 1 or (previous is null and "offset" <> block)""",
        "contiguity_check": f"""with recursive {_BLOCKED}, part as (select topic, block, "offset", lag("offset") over (partition by topic, block order by "offset") as previous from blk)
            select * from part where "offset" - previous <> 1 or (previous is null and "offset" <> block)""",
        "render_lines": f"with {_LOG} select topic, concat(\"offset\", chr(9), content) as line from log",
        "render_index": f"with recursive {_INDEX} select topic, block, concat(\"offset\", ' -> ', byte_offset) as line from idx",
        "render_blocks": f"with recursive {_INFO} select topic, concat(row_number() over (partition by topic order by block) - 1, ' -> ', block) as line from info",
        "le_encode_offset": f'with {_LOG} select topic, "offset", {_hex_le(chr(34) + "offset" + chr(34), 8)} as le64, {_hex_le("byte_size", 4)} as le32 from log',
        "frame_roundtrip": f'with {_LOG} select topic, "offset", byte_size::bigint as byte_size, content from log',
        "text_lines_ingest": """with l as (select source, doc_id, unnest(range(0, len(string_split(text, chr(10))))) as no, unnest(string_split(text, chr(10))) as line from documents where source is not null),
            c as (select source, doc_id, no, regexp_replace(line, '\\r$', '') as line from l)
            select source as topic, row_number() over (partition by source order by doc_id, no) - 1 as "offset", strlen(line)::bigint as n_bytes, md5(line) as digest from c where line <> ''""",
        "write_status": "select count(*) as wrote from events where event_type is not null",
        "store_append": """select event_type as topic, row_number() over (partition by event_type order by event_id % 1000 >= 500, event_id) - 1 as "offset", coalesce(props, '') as content from events""",
        "stream_offsets": everything,
        "stream_offsets_stateful": everything,
        "stream_tail_replay": f"with {_LOG} select \"offset\", content from log where topic = 'view' and \"offset\" >= {START}",
    }
