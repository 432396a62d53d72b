"""The operators' queries over whole tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from . import oracles
from .decontamination import leaks
from .hard_negatives import hard_negatives
from .html_extraction import extract
from .licenses import license_digest
from .line_dedup import drop_recurring_lines
from .near_duplicates import near_duplicates
from .packing import pack
from .passages import repeated_stretches
from .quality import quality
from .resampling import resample
from .sharding import hilbert_shards
from .simhash import simhash_duplicates
from .token_counts import token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(table(spark, sf_dir, "documents"), min_docs=10, min_tokens=1)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=75)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"), shards=16)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_stretches(table(spark, sf_dir, "documents"), min_words=50, percent=75)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), length=1024, end_id=0)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents"), k=3, radius=2)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, min_words=20, seed=7)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_token_counts": op4_token_counts,
    "op5_sharding": op5_sharding,
    "op6_license_scan": op6_license_scan,
    "op7_decontamination": op7_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_packing": op9_packing,
    "op10_html_extraction": op10_html_extraction,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": oracles.QUALITY,
    "op3_ngram_jaccard_join": oracles.NEAR_DUPLICATES,
    "op7_decontamination": oracles.LEAKS,
    "op12_importance_resampling": oracles.RESAMPLING,
    "op13_hard_negatives": oracles.HARD_NEGATIVES,
}
