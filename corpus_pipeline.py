"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets, BPE.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. The first four return the
columns of documents; each one's output is written and read again before the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyroom.llm import bpe, decontaminate, neardup, secrets, toxicity
from tallyroom.tables import staged, table


#: Documents that go to a Python worker at once: with the default of 10,000 a batch of long texts takes tens of MB in the
#: JVM and again in each worker.
BATCH_ROWS = 250


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_ROWS; afterwards the session is as it was."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _whole(stage: Callable) -> Callable:
    """The stage, run under small batches: what it returns is written, so nothing of it runs later under others."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with _small_batches(spark):
            return staged(stage(spark, docs, sf_dir), stage.__name__)

    return run


@_whole
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on labelled documents of this input."""
    return toxicity.clean(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


@_whole
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    return neardup.clean(docs, shingle=5)


@_whole
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one with other parameters, go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@_whole
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; found secrets and linked parts of credentials are replaced in their texts."""
    return secrets.redacted(docs)


@_whole
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left."""
    return bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

#: SQL can't express the classifier and the encoder; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; each stage reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
