"""The queries of this package, under the names that the driver checks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import new_path
from .binary_records import record_digests, write_records
from .chunk_bpe import encoding_digests
from . import decision_lists, rule_ensemble
from .common import documents, table
from .conversation_repair import damaged, repair_digests
from .decontamination import contamination
from .line_dedup import line_report
from .ngram_join import ngram_components
from .periodic_runs import run_digests
from .pii_crf import find_personal_data, labelled_runs, train
from .secret_index import find_secrets
from .substring_dedup import repeat_digests
from .token_counts import count_tokens

WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"


def op1_rule_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return rule_ensemble.score_documents(docs, rule_ensemble.learn_from(docs, table(spark, folder, "labels")))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_report(documents(spark, folder))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(documents(spark, folder), public_tokenizers.path(PIECE_BPE))


def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_components(documents(spark, folder))


def op5_chunk_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encoding_digests(documents(spark, folder), public_tokenizers.path(WORD_BPE))


def op6_pii_crf(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal_data(documents(spark, folder), train(labelled_runs()))


def op7_secret_index(spark: SparkSession, folder: str) -> DataFrame:
    return find_secrets(documents(spark, folder))


def op8_decision_lists(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return decision_lists.apply_rules(docs, decision_lists.learn_from(docs, table(spark, folder, "labels")))


def op9_binary_records(spark: SparkSession, folder: str) -> DataFrame:
    place = new_path(spark, "token-records")
    write_records(documents(spark, folder), public_tokenizers.path(WORD_BPE), place, end_id=2)
    return record_digests(spark, place)


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(documents(spark, folder), table(spark, folder, "benchmark"))


def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeat_digests(documents(spark, folder))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return run_digests(documents(spark, folder))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair_digests(damaged(table(spark, folder, "conversations")))


QUERIES = {f.__name__: f for f in (
    op1_rule_ensemble, op2_line_dedup, op3_token_counts, op4_ngram_join, op5_chunk_bpe, op6_pii_crf, op7_secret_index, op8_decision_lists, op9_binary_records,
    op10_decontamination, op11_substring_dedup, op12_periodic_runs, op13_conversation_repair,
)}
ORACLES: dict[str, str] = {}
