"""From raw documents to packed training sequences: five stages, each by an operator of the llm subpackage.

Every stage reads what the one before it kept, written as Parquet.  Null ids
and null texts pass the filters that cannot judge them; rows of one id stay or
go together in the near-duplicate and benchmark stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from diffsignal.llm.decontamination import leaks
from diffsignal.llm.line_dedup import drop_recurring_lines
from diffsignal.llm.near_duplicates import near_duplicates
from diffsignal.llm.packing import pack
from diffsignal.llm.quality import keep_good
from diffsignal.llm.store import materialise, without


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the base rules nor come from a rejected host."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template recurs in ten or more of them; n_chars follows the text."""
    cleaned = drop_recurring_lines(docs, min_docs=10, min_tokens=1)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*[F.col(f"`{c}`") for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates."""
    return without(docs, near_duplicates(docs, percent=75).filter("doc_id <> component_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return without(docs, leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The boundary records of sequences of 1,024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), length=1024, end_id=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL has no tokenizer; the tests hold run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``: the packed sequences' boundary records."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
