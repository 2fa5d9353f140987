"""Counts of what the streams of a session have done."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class StreamCounts(StreamingQueryListener):
    """Rows and micro-batches by query name (or id), and queries that ended with an error."""

    def __init__(self):
        self.rows: Counter = Counter()
        self.batches: Counter = Counter()
        self.failed: dict[str, str] = {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        name = event.progress.name or str(event.progress.id)
        self.rows[name] += event.progress.numInputRows
        self.batches[name] += 1

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.exception:
            self.failed[str(event.id)] = event.exception


def watch(spark: SparkSession) -> StreamCounts:
    counts = StreamCounts()
    spark.streams.addListener(counts)
    return counts
