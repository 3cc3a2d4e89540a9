"""One query for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe_stream, line_dedup, merkle, mixing, ngram_join, quality, ranked, sharding, sp_codec, substring_dedup, suffix_dedup, tiff
from .common import table

SHARDS = 40
SEED = 20240607


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def word_vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards; the texts travel with their rows and are digested where they arrive."""
    sharded = sharding.shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS, SEED)
    text = F.coalesce("text", F.lit(""))
    return sharded.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_documents(table(spark, sf_dir, "documents")).drop("text_hash")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.encode_texts(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op10_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.store_texts(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), changed=merkle.lowered)


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.encode_texts(table(spark, sf_dir, "documents"), word_vocabulary_path())


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_sharding": op2_sharding,
    "op3_line_dedup": op3_line_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_ngram_join": op5_ngram_join,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_ann": op7_ann,
    "op8_quality": op8_quality,
    "op9_mixing": op9_mixing,
    "op10_media_tiff": op10_media_tiff,
    "op11_merkle": op11_merkle,
    "op12_ranked": op12_ranked,
    "op13_bpe_stream": op13_bpe_stream,
}
ORACLES: dict[str, str] = {
    "op4_suffix_dedup": suffix_dedup.oracle(),
    "op5_ngram_join": ngram_join.oracle(),
    "op9_mixing": mixing.oracle(),
    "op11_merkle": merkle.oracle(),
    "op12_ranked": ranked.oracle(),
}
