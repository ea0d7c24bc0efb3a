"""A corpus pipeline: five stages, each over all that the one before it kept.

Language ID drops documents without a letter or in no learned language, line dedup deletes runs of lines that occur before,
near-dedup leaves one document of each group, decontamination drops documents that hold benchmark items, and the rest is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import bpe, decontamination, language, lines, near_copies, simhash
from loomwork.llm.batches import table
from loomwork.llm.queries import BYTE_BPE
from loomwork.llm.shared import small_batches

#: Words from which one or two lines that repeat are deleted too.
LONG_WORDS = 50

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4, which learns from the same documents as its query does."""
    small_batches(spark)
    samples = language.learn(docs.filter(~language.held_out("doc_id")))
    return language.in_learned_language(docs, samples)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9, and runs of fewer lines if they have LONG_WORDS words together; n_chars follows the text."""
    out = lines.remove_repeated_runs(docs, long_words=LONG_WORDS).drop("n_lines", "n_removed")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8's masks, over five-word shingles at a similarity of 0.8 or more; one document of each group stays."""
    small_batches(spark)
    return simhash.one_of_each(docs, found=near_copies.groups(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1."""
    small_batches(spark)
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: doc_id, n_tokens, ids, and whether decoding gives the text back."""
    small_batches(spark)
    out = bpe.encode(docs.select("doc_id", "text"), BYTE_BPE)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", benchmark_decontamination),
    ("bpe_encoding", encoding),
]
#: Cross-parsing, connected components and BPE can't be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
