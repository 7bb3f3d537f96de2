"""The corpus pipeline: language ID, exact dedup, near duplicates, pseudonyms, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet into the shared folder
and read again as the next one's docs. Nulls, ties, repeated rows, empty tables and extra columns have the
results that the operators' docstrings state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailward.llm.common import table, written
from mailward.llm.exact_dedup import drop_copies
from mailward.llm.langid import keep_identified
from mailward.llm.ngram_join import keep_one_each
from mailward.llm.packing import pack_texts
from mailward.llm.pii import pseudonymise_texts
from mailward.llm.wordbpe import vocabulary_path


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the calibrated model does not reject."""
    return keep_identified(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links at 0.8 on five-word shingles."""
    return keep_one_each(docs, width=5, percent=80)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data permuted inside their formats."""
    name = "__finds"
    while name in docs.columns:
        name += "_"
    return pseudonymise_texts(docs, spans_as=name).drop(name)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_length, batch_id, slot and padding of every document."""
    return pack_texts(docs, vocabulary=vocabulary_path())


STAGES = [("language_id", identify), ("exact_dedup", dedup), ("near_duplicates", near_dedup), ("pii", pseudonyms), ("packing", packed)]

#: A trained model, a keyed permutation and a dynamic programme are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
