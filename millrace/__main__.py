"""Command line: ``python -m millrace [--root DIR] COMMAND``.

``list``; ``write TOPIC [FILE]`` (lines of a file, or of standard input); ``read TOPIC [OFFSET] [BATCH]``; ``status``;
``bench TOPIC``; ``read-log FILE [BATCH]`` (with a line before each batch) and ``read-index FILE`` for binary segment files. Defaults
come from MILLRACE_ROOT, MILLRACE_MAX_BLOCK_MB and MILLRACE_READ_ONLY. A termination signal ends a command as an error does:
what was not published is not there, and the claim on the store is given up.
"""

from __future__ import annotations

import argparse
import os
import signal
import sys
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.functions.render import INDEX_TITLE, entry_line, index_line
from millrace.operators.log import as_entries
from millrace.sources import segments
from millrace.sources.store import LogStore
from millrace.sources.text import read_lines
from millrace.streaming.follow import follow
from millrace.tables import filesystem, shared_dir


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--root", default=os.environ.get("MILLRACE_ROOT"))
    p.add_argument("--max-block-mb", type=int, default=int(os.environ.get("MILLRACE_MAX_BLOCK_MB", "1000")))
    p.add_argument("--read-only", action="store_true", default=os.environ.get("MILLRACE_READ_ONLY", "").lower() == "true")
    c = p.add_subparsers(dest="command", required=True)
    c.add_parser("list")
    c.add_parser("status")
    w = c.add_parser("write")
    w.add_argument("topic")
    w.add_argument("file", nargs="?")
    r = c.add_parser("read")
    r.add_argument("topic")
    r.add_argument("offset", type=int, nargs="?", default=0)
    r.add_argument("batch", type=int, nargs="?", default=1000)
    r.add_argument("--follow", type=float, default=0, metavar="SECONDS", help="wait so long for more entries")
    b = c.add_parser("bench")
    b.add_argument("topic")
    b.add_argument("--bytes", type=int, default=100)
    b.add_argument("--entries", type=int, default=1000, help="entries of a request")
    b.add_argument("--requests", type=int, default=1000)
    b.add_argument("--batch", type=int, default=1000, help="entries of a batch that is read")
    b.add_argument("--concurrent", type=int, default=1, metavar="N", help="so many writers and readers, each of a topic of its own")
    for name in ("read-log", "read-index"):
        f = c.add_parser(name)
        f.add_argument("file")
        if name == "read-log":
            f.add_argument("batch", type=int, nargs="?")
    return p


def concurrent_bench(spark: SparkSession, root: str, args: argparse.Namespace) -> dict[str, float]:
    """Seconds, entries and bytes a second of writers and then readers side by side, each of the topic TOPIC-0, TOPIC-1, ..."""
    n = args.entries * args.requests
    rows = spark.range(n).select(F.lit(args.topic).alias("t"), F.encode(F.rpad(F.hex(F.xxhash64("id")), args.bytes, "æ"), "UTF-8").alias("c"), "id")

    def write(i: int) -> None:
        topic = f"{args.topic}-{i}"
        with LogStore(spark, root, args.max_block_mb << 20, args.entries, topics=[topic]) as store:
            store.write(as_entries(rows.withColumn("t", F.lit(topic)), "t", "c", "id"))

    def read(i: int) -> int:
        store = LogStore(spark, root, read_only=True)
        return sum(len(batch) for _, batch in follow(store, f"{args.topic}-{i}", 0, args.batch, stop_on_completion=True))

    out = {}
    for name, work in (("write", write), ("read", read)):
        began = time.perf_counter()
        with ThreadPoolExecutor(args.concurrent) as pool:
            list(pool.map(work, range(args.concurrent)))
        took = time.perf_counter() - began
        out |= {name: round(took, 3), f"{name}_entries_per_s": round(args.concurrent * n / took), f"{name}_mb_per_s": round(args.concurrent * n * args.bytes / took / 1e6, 1)}
    return out


def bench(store: LogStore, topic: str, size: int, entries: int) -> dict[str, float]:
    """Seconds to append ``entries`` of ``size`` characters, to read them all, and to read the last hundredth."""
    spark = store.spark
    rows = spark.range(entries).select(F.lit(topic).alias("t"), F.encode(F.rpad(F.hex(F.xxhash64("id")), size, "æ"), "UTF-8").alias("c"), "id")
    out = {}
    began = time.perf_counter()
    first = {r.topic: r.next_offset for r in store.status().collect()}.get(topic, 0)
    store.write(as_entries(rows, "t", "c", "id"))
    out["write"] = time.perf_counter() - began
    for name, offset in (("read_all", first), ("read_half", first + entries // 2), ("read_last", first + entries - entries // 100)):
        began = time.perf_counter()
        store.read(topic, offset).write.format("noop").mode("overwrite").save()
        out[name] = time.perf_counter() - began
    return {k: round(v, 3) for k, v in out.items()}


def _standard_input(spark: SparkSession) -> str:
    """Copy standard input, which is the driver's, into the folder that executors share."""
    path = f"{shared_dir(spark)}/millrace-stdin-{uuid.uuid4().hex}"
    fs, where = filesystem(spark, path)
    out = fs.create(where, False)
    while chunk := sys.stdin.buffer.read(1 << 20):
        out.write(bytearray(chunk))
    out.close()
    return path


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("millrace").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if args.command in ("read-log", "read-index"):
        segments.register(spark)
        if args.command == "read-log":
            rows = spark.read.format("segments").load(args.file).orderBy("offset").select(entry_line(F.col("offset"), F.col("content")).alias("line"))
            if args.batch is not None and args.batch < 1:
                sys.exit("a batch has one entry at least")
        else:
            print(INDEX_TITLE)
            rows = spark.read.format("segment_index").load(args.file).orderBy("offset").select(index_line(F.col("offset"), F.col("byte_offset")).alias("line"))
        size = getattr(args, "batch", None)
        for i, r in enumerate(rows.toLocalIterator()):
            if size and i % size == 0:
                print(f"batch {i // size}")
            print(r.line)
        return 0
    if not args.root:
        sys.exit("--root or MILLRACE_ROOT says where the log is")
    if threading.current_thread() is threading.main_thread():
        signal.signal(signal.SIGTERM, lambda *_: sys.exit(143))
    if args.command == "bench" and args.concurrent > 1:
        if args.read_only:
            sys.exit("the store was opened for reading")
        print(concurrent_bench(spark, args.root, args))
        return 0
    reads = args.read_only or args.command in ("list", "status", "read")
    with LogStore(spark, args.root, args.max_block_mb << 20, args.entries if args.command == "bench" else 1000, read_only=reads) as store:
        if args.command == "list":
            print(*store.list(), sep="\n")
        elif args.command == "status":
            store.status().orderBy("topic").show(truncate=False)
        elif args.command == "bench":
            print(bench(store, args.topic, args.bytes, args.entries * args.requests))
        elif args.command == "read":
            for _, batch in follow(store, args.topic, args.offset, args.batch, ttl=args.follow, stop_on_completion=not args.follow):
                for offset, content in batch:
                    print(f"{offset}\t{content.decode(errors='replace')}")
        else:
            path = args.file or _standard_input(spark)
            lines = read_lines(spark, path).withColumn("topic", F.lit(args.topic))
            began = time.perf_counter()
            print(f"wrote {store.write(as_entries(lines, 'topic', 'content', 'o0'))} entries in {time.perf_counter() - began:.1f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
