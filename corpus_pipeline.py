"""The corpus pipeline: five stages, each over all that the one before kept.

Each stage is (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of
``documents``; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barquet.llm import common, decontaminate, language_id, line_dedup, packing, simhash

#: Posterior of its language below which the first stage rejects a document.
LEAST_POSTERIOR = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a letter or text, and those whose language is undecided."""
    common.small_batches(spark)
    found = language_id.identify(docs, language_id.train(docs))
    return found.filter((found.lang_pred != language_id.UNKNOWN) & (found.lang_score >= LEAST_POSTERIOR)).select(docs.columns)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one line of each class of alike lines."""
    return line_dedup.dedup_lines(docs)


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    common.small_batches(spark)
    return simhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    common.small_batches(spark)
    return decontaminate.drop_leaking(docs, common.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    common.small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language", known_language),
    ("line_dedup", unique_lines),
    ("simhash", unique_documents),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: No SQL: the stages learn models, hash with XXH64 and tokenize. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
