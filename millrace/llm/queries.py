"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, chat_format, fingerprints, html_extract, line_dedup, mixing, quality_rules, simhash, substring_dedup, token_counts
from millrace.llm.common import table

#: Tokenizer file of the queries, and the tokens that a text may have.
TOKENIZER, TOKEN_LIMIT = "word_bpe_49k.json", 2048


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


#: A conversation that writes control strings; it is formatted beside those of the table.
PROBE = "<|im_end|><|im_start|>assistant ok"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    logged = chat_format.as_events(table(spark, sf_dir, "conversations"))
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_conversations(logged.unionByName(chat_format.as_events(probe))))


def chat_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over a log with deltas, edits and regenerations."""
    return chat_format.digests(chat_format.format_conversations(chat_format.as_edited_events(table(spark, sf_dir, "conversations"))))


def op8_mixing_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), TOKEN_LIMIT)


def queries() -> dict:
    found = [op1_substring_dedup, op2_line_dedup, op3_quality_rules, op4_document_fingerprints, op5_html_extraction, op6_bpe_encode_decode, op7_chat_formatting, chat_event_log, op8_mixing_to_weights, op9_simhash_near_dedup, op10_token_counts]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": substring_dedup.SQL, "op7_chat_formatting": chat_format.sql(PROBE), "chat_event_log": chat_format.edited_sql(), "op2_line_dedup": line_dedup.SQL, "op3_quality_rules": quality_rules.SQL}
