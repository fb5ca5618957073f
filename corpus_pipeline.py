"""The corpus pipeline: documents in, token ids out, each stage written and reread as Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import cohortgauge
from cohortgauge.llm import attention, mergequeue, qgrams, recompression, simhash_texts
from cohortgauge.llm.queries import word_tokenizer
from cohortgauge.llm.tables import stored, table, unused

# The package is not installed on the executors: ship its functions by value.
cloudpickle.register_pickle_by_value(cohortgauge)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention model scores as good; the others go."""
    return attention.keep_good(docs, attention.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near copies: five-word shingles, similarity of 0.8 or more."""
    return simhash_texts.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated 35-word windows; every document stays."""
    return recompression.cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    leaks = unused(docs, "_leaks")
    found = qgrams.with_leaks(docs, table(spark, sf_dir, "benchmark"), column=leaks)
    return found.where(F.size(leaks) == 0).drop(leaks)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the digests of both directions."""
    return mergequeue.encode_and_decode(docs, word_tokenizer(), ids=True).drop("decoded").withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: The fitted classifier, the alignment and the merge queue have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
