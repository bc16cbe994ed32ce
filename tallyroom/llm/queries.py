"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.llm import bpe, decontaminate, fingerprint_index, neardup, packing, preference, prefix_trie, quality, resampling, secrets, suffixes, threshold, toxicity
from tallyroom.tables import table

BPE_FILE = "word_bpe_49k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.stripped(table(spark, sf_dir, "documents")).drop("kept")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_index.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.formatted(preference.paired_by_opening(table(spark, sf_dir, "conversations")))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.found(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.trained(docs, table(spark, sf_dir, "labels")))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE))


def op9_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold.top_k(threshold.quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.linked(table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_decontaminate, op3_suffixes, op4_fingerprints, op5_preference, op6_secrets, op7_quality, op8_bpe, op9_threshold, op10_neardup, op11_resampling, op12_prefix_trie, op13_packing)}
ORACLE_SQL = {"op5_preference": preference.ORACLE, "op6_secrets": secrets.ORACLE, "op9_threshold": threshold.ORACLE, "op11_resampling": resampling.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE}
