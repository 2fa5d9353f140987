"""The command line."""

import io
import os
import signal
import subprocess
import sys
import time

from millrace.__main__ import main
from millrace.sources import segments
from millrace.streaming.metrics import watch


def test_commands(spark, tmp_path, capsys, monkeypatch):
    root = ["--root", str(tmp_path / "s")]
    (tmp_path / "in.txt").write_text("one\n\ntwo\r\nthree\n")
    assert main([*root, "write", "t", str(tmp_path / "in.txt")], spark) == 0
    assert capsys.readouterr().out.startswith("wrote 3 entries")
    main([*root, "list"], spark)
    main([*root, "read", "t", "1", "1"], spark)
    assert capsys.readouterr().out == "t\n1\ttwo\n2\tthree\n"
    main([*root, "bench", "b", "--entries", "50", "--requests", "10"], spark)
    assert "read_last" in capsys.readouterr().out
    main([*root, "status"], spark)
    assert "|500" in capsys.readouterr().out
    main([*root, "bench", "c", "--entries", "50", "--requests", "4", "--concurrent", "2", "--batch", "30"], spark)
    assert "read_entries_per_s" in capsys.readouterr().out
    main([*root, "list"], spark)
    assert capsys.readouterr().out == "b\nc-0\nc-1\nt\n"
    monkeypatch.setattr("sys.stdin", type("In", (), {"buffer": io.BytesIO(b"four\nfive\n")}))
    main([*root, "write", "t"], spark)
    main([*root, "read", "t", "3"], spark)
    assert "wrote 2 entries" in (said := capsys.readouterr().out) and said.endswith("3\tfour\n4\tfive\n")
    (tmp_path / "0.log").write_bytes(segments.encode([b"a", "æ".encode()], 0))
    (tmp_path / "0.idx").write_bytes(segments.build_index(str(tmp_path / "0.log"), 1))
    main(["read-log", str(tmp_path / "0.log")], spark)
    main(["read-log", str(tmp_path / "0.log"), "1"], spark)
    assert capsys.readouterr().out == "0\ta\n1\tæ\nbatch 0\n0\ta\nbatch 1\n1\tæ\n"
    main(["read-index", str(tmp_path / "0.idx")], spark)
    assert capsys.readouterr().out == "log offset -> byte offset\n1 -> 21\n"


def test_signal_gives_up_the_claim(tmp_path):
    """A reader that follows, as a process, ends at a signal; a writer's claim goes with it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys, time, threading, os, signal
sys.path.insert(0, {root!r})
from millrace import __main__ as m
class Slow(m.LogStore):
    def write(self, *_):
        print("writing", flush=True)
        time.sleep(60)
m.LogStore = Slow
m.main(["--root", {str(tmp_path / "s")!r}, "write", "t", {str(tmp_path / "in.txt")!r}])
"""
    (tmp_path / "in.txt").write_text("one\n")
    p = subprocess.Popen([sys.executable, "-c", code], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, cwd=tmp_path, text=True)
    assert p.stdout.readline() == "writing\n" and os.path.exists(tmp_path / "s/leases/all")
    p.send_signal(signal.SIGTERM)
    assert p.wait(60) == 143 and not os.path.exists(tmp_path / "s/leases/all")


def test_stream_counts(spark, tmp_path):
    counts = watch(spark)
    try:
        spark.range(30).write.parquet(str(tmp_path / "in"))
        query = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.queryName("counted").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        for _ in range(50):
            if counts.rows["counted"]:
                break
            time.sleep(0.1)
        assert counts.rows["counted"] == 30 and not counts.failed
    finally:
        spark.streams.removeListener(counts)
