"""A training corpus from ``documents``: five stages, each over all rows that the one before kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again before the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import rule_ensemble
from wayfare.llm.chunk_bpe import encode_documents
from wayfare.llm.common import documents, small_batches, table
from wayfare.llm.decontamination import decontaminate_rows
from wayfare.llm.line_dedup import dedup_lines
from wayfare.llm.ngram_join import one_of_each
from wayfare.session import materialise


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    model = rule_ensemble.learn_from(docs, table(spark, sf_dir, "labels"))
    return rule_ensemble.accepted(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; ``n_chars`` follows the text."""
    kept = dedup_lines(docs)
    changed = F.length("text").cast("long") if "n_chars" in docs.columns else None
    return kept if changed is None else kept.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    small_batches(spark)
    return one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate_rows(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, decoded`` of each document: what a training run reads."""
    small_batches(spark)
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: SQL cannot express training, MinHash components and BPE; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
