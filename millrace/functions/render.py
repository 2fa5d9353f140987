"""Texts as the log's tools print them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entry_line(offset: Column, content: Column) -> Column:
    """Offset, tab, content as UTF-8."""
    return F.concat_ws("\t", offset.cast("string"), F.decode(content, "UTF-8"))


def index_line(offset: Column, byte_offset: Column) -> Column:
    return F.concat_ws(" -> ", offset.cast("string"), byte_offset.cast("string"))


#: What stands above the lines of an index.
INDEX_TITLE = "log offset -> byte offset"
