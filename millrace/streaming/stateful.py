"""Offsets as a stateful operator, for streams that stay streams (no store between).

A topic's next offset is the state of its key. A micro-batch's rows of a topic are sorted by ``seq`` together, as the
chunks they come in have no order among each other; so a micro-batch, which the source's limits bound, should hold no more of one
topic than a task takes. Where it may, ``follow.ingest`` numbers rows without bringing a topic together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.workers import python_workers

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NextOffset(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "offset long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable", ignore_index=True)
        start = self.next.get()[0] if self.next.exists() else 0
        self.next.update((start + len(batch),))
        batch["offset"] = range(start, start + len(batch))
        yield batch[["topic", "offset", "content"]]

    def close(self) -> None:
        pass


def with_offsets(stream: DataFrame, topic: str, content: str, seq: str) -> DataFrame:
    """A stream of (topic, offset, content): offsets dense by topic, in micro-batches by ``seq``. Null topics are dropped, null
    contents empty."""
    python_workers(stream.sparkSession)
    stream.sparkSession.conf.set(_PROVIDER, _ROCKSDB)
    rows = stream.select(F.col(topic).alias("topic"), F.col(seq).cast("long").alias("seq"), F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("content")).where(F.col("topic").isNotNull())
    return rows.groupBy("topic").transformWithStateInPandas(NextOffset(), "topic string, offset long, content binary", "append", "none")
