"""The registered queries of this subpackage and the SQL that some of them are checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelweave.llm import line_dedup, mixing
from pixelweave.llm.byte_bpe import encode_and_decode
from pixelweave.llm.conversations import repair_report
from pixelweave.llm.hard_negatives import mined
from pixelweave.llm.line_dedup import line_report
from pixelweave.llm.mixing import mix_sources
from pixelweave.llm.near_vectors import near_vectors
from pixelweave.llm.ngram_join import ngram_components
from pixelweave.llm.packing import pack
from pixelweave.llm.secret_scan import scan_secrets
from pixelweave.llm.spotsigs import fingerprints
from pixelweave.llm.substring import substring_dedup
from pixelweave.llm.token_store import store_and_read
from pixelweave.llm.tokens import vocabulary
from pixelweave.llm.toxicity import toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), 2048)


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).drop("source")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(documents(spark, sf_dir))


def op9_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_and_decode(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_near_vectors, op3_toxicity, op4_token_store, op5_source_mixing, op6_ngram_join, op7_substring_dedup,
    op8_line_dedup, op9_spot_signatures, op10_secret_scan, op11_hard_negatives, op12_byte_bpe, op13_conversation_repair,
)}
ORACLES = {"op5_source_mixing": mixing.ORACLE, "op8_line_dedup": line_dedup.ORACLE}
