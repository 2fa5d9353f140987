"""A training-data pipeline: quality rules, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs; all but the last return the columns of documents. The last returns a row for each document of the mix.

Every stage takes nulls in any column, repeated rows and further columns (kept, whatever their names), and gives no rows for none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, line_dedup, mixing, near_copies as copies, quality_rules
from millrace.llm.common import stored, table
from millrace.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not rejected. A null or empty text fails; a null host is a host; repeated rows pass alike."""
    return quality_rules.passing(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that occur earlier, exactly or within an edit; n_chars follows. A null text becomes empty; a null doc_id comes
    last; rows of one doc_id are one document."""
    return line_dedup.cleaned(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by words, found by covering SimHash (operator 9) and checked exactly: the one of the
    smallest doc_id, then of the least hash of its text; null comes last. Texts without words are a group; of repeated rows one stays."""
    return copies.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it. A null source is a source; repeated rows are taken alike; texts without
    words come with whole epochs only."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the token ids and of the text decoded from them; a row a row, whatever its doc_id."""
    return bpe.encode_decode(docs, tokenizer_path())


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("encode", encode)]

#: SQL expresses neither components of near copies, nor the draws of the mix, nor the encoding; tests compare each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
