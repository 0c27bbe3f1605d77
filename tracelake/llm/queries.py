"""The registered queries of this subpackage: each operator on its whole table, at production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .bilinear_lm import lm_scores
from .column_bwt import suffix_dedup
from .conversation_repair import conversation_repair
from .cross_polytope import near_vectors
from .language_crf import language_id
from .license_scan import license_labels
from .mixing import EQUAL, mix_rates
from .ngram_join import ngram_join
from .oracles import ORACLES  # noqa: F401
from .recompression import substring_dedup
from .sentencepiece_arrays import encode
from .sharding import shard
from .telephony import media_columns
from .whitening import embedding_whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op2_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "n_links")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_rates(table(spark, sf_dir, "documents"), EQUAL, "source")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening(table(spark, sf_dir, "embeddings"))


def op11_embedding_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whitening's exact columns, one row a vector, which SQL can express."""
    return embedding_whitening(table(spark, sf_dir, "embeddings")).where("component = 1").select("vec_id", "n", "deviation")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair(table(spark, sf_dir, "conversations"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir, "documents"))


def op13_license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan's base columns, which SQL can express."""
    return license_labels(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op2_ngram_jaccard_links": op2_ngram_jaccard_links,
    "op3_mixing": op3_mixing,
    "op4_media_columns": op4_media_columns,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_language_id": op8_language_id,
    "op9_sharding": op9_sharding,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op11_embedding_deviations": op11_embedding_deviations,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_license_scan": op13_license_scan,
    "op13_license_phrases": op13_license_phrases,
    "pipeline": corpus_pipeline.run,
}

