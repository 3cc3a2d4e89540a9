"""The corpus pipeline: documents through quality, dedup, mixing and tokenizing stages.

Each stage works on all that the one before it kept. The first four return the columns of
``documents``, the last one the digests of each document's ids and decoded text. Heavy work
stays in all tasks; only the digests are exchanged, so that fewer tasks write them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import line_dedup, mixing, ngram_join, quality, sp_codec
from foliospark.llm.common import digests, forget, stored, stored_tables, table
from foliospark.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal or similar lines the first stays; documents without a byte left go."""
    return line_dedup.without_repeated_lines(docs)


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return ngram_join.one_of_each_group(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eighty of a hundred tokens, by the target weights; no document twice."""
    return mixing.mixed(docs, percent=80, max_epochs=1, as_documents=True)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoded and decoded texts, as digests."""
    return digests(sp_codec.encode_texts(docs, tokenizer_path(), keep_words=False, piece_chars=1 << 19))


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("ngram_join", join_stage), ("mixing", mixing_stage), ("sentencepiece", token_stage)]

#: The stages learn, hash with numpy and call a tokenizer: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one stage keeps is written and read again by the next.

    A stage's own tables, and the documents before it, are deleted once its result is written.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with stored_tables() as mine:
            docs, path = stored(stage(spark, docs, sf_dir), "stage")
            forget(spark, before + [p for p in mine if p != path])
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
