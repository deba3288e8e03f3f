"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the
last return the columns of docs, whatever others there are and whatever their names.
Rows with null texts count as empty ones, which the quality stage scores as such; null
ids are ids like others. Rows repeated in the table: quality and decontamination keep or
drop them together, near_duplicates keeps one. Of near duplicates the row with the least
id stays, then that with the least hash of its text. An empty table gives an empty one.
Texts are read whole at any length. Stages read no more of sf_dir than labels and
benchmark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fluxloom.llm import bpe, common, decontamination, jaccard_join, quality_classifier, suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the pairwise ranking scores below 0.3."""
    return quality_classifier.accepted(docs, quality_classifier.fit(docs, common.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by 80 % equal 5-word shingles, keep that with the smallest id."""
    return jaccard_join.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 200 bytes that also stand elsewhere from the texts."""
    return suffix_dedup.clean_documents(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten consecutive words of a benchmark item."""
    return decontamination.uncontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32) and the decoded text."""
    return bpe.encode(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontamination_stage),
    ("token_ids", token_ids),
]

#: SQL expresses neither the classifier nor the token ids; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
