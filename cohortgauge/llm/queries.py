"""The contract queries over the driver's tables, one per operator, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortgauge.llm import attention, bitplanes, centroids, feistel, fences, lehmer, linkrank, mergequeue, oracle, qgrams, recompression, simhash, toxicspans, warczip
from cohortgauge.llm.tables import table


def op1_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after the words of repeated 35-word windows are taken out."""
    cut = recompression.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.selectExpr("id AS doc_id", "n_words", "n_removed", "kept_sha256")


def op2_warczip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a packaged archive and read back by range."""
    packages = warczip.write_packages(table(spark, sf_dir, "pages"))
    return warczip.read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs = table(spark, sf_dir, "documents")
    scored = attention.score_rows(docs, attention.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        F.col("id").alias("doc_id"), attention.held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= attention.THRESHOLD).cast("int").alias("predicted"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and class."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).selectExpr("id AS doc_id", "fingerprint", "component_id")


def op5_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under a keyed permutation of row numbers."""
    placed = feistel.assign_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, whether it fails the base rules, and whether it is kept."""
    judged = fences.apply_rules(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_linkrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's rule and verdict."""
    return linkrank.judge_pages(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_qgrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, with its edits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = qgrams.with_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", F.col("leak.item").alias("item_id"), F.col("leak.edits").alias("edits"), F.col("leak.stop").alias("stop_char"))


def word_tokenizer() -> str:
    """The path of the public word tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written as bit planes in the order of doc_id, and read back."""
    files = bitplanes.write_ids(table(spark, sf_dir, "documents"), word_tokenizer(), end_id=2)
    return bitplanes.read_ids(files).withColumnRenamed("id", "doc_id")


def op10_mergequeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return mergequeue.encode_and_decode(table(spark, sf_dir, "documents"), word_tokenizer()).withColumnRenamed("id", "doc_id")


def op11_chainfield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score and its offending spans."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicspans.score_rows(docs, toxicspans.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        F.col("id").alias("doc_id"), toxicspans.held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= toxicspans.THRESHOLD).cast("int").alias("predicted"), "spans",
    )


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector's cluster, its distance and the sums of distances."""
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_lehmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from every source, in all 120 orders."""
    return lehmer.audit(lehmer.mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_recompression": op1_recompression,
    "op2_warczip": op2_warczip,
    "op3_attention": op3_attention,
    "op4_simhash": op4_simhash,
    "op5_feistel": op5_feistel,
    "op6_fences": op6_fences,
    "op7_qgrams": op7_qgrams,
    "op8_bitplanes": op8_bitplanes,
    "op9_linkrank": op9_linkrank,
    "op10_mergequeue": op10_mergequeue,
    "op11_chainfield": op11_chainfield,
    "op12_centroids": op12_centroids,
    "op13_lehmer": op13_lehmer,
}

ORACLE: dict[str, str] = dict(oracle.STATEMENTS)
