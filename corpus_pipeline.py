"""Corpus pipeline: language ID, near-duplicates, decontamination, PII, mixing.

Each stage takes what its predecessor kept, as a Parquet table, and returns the columns of
documents; the last adds the columns of the mixture.

Defined cases: texts that are null, empty or without a letter go in the first stage; rows with a null
doc_id and a text stay throughout, as no other row can be named their copy; of repeated rows of a doc_id
one stays; a null source is mixed as the empty one; an empty table gives an empty result; extra columns
stay as they are. Ties are settled by the smallest doc_id (near duplicates) and a hash (mixture).
A stage's table is deleted once its successor's is written, and memory that the driver has freed is returned between
stages.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import decontaminate, lang_id, mixing, ngram_join, pii
from geoloom.llm.common import given_back, removed, shared, table


def _lean(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage begins with a driver that holds no memory which its predecessor has freed."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        given_back(spark)
        return stage(spark, docs, sf_dir)

    return run


@_lean
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return lang_id.keep_identified(docs)


@_lean
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return ngram_join.keep_one(docs, threshold=0.8)


@_lean
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@_lean
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in their texts; n_chars follows the text."""
    return pii.pseudonymise(docs, pii.session_key(spark), counts=False)


@_lean
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mixture."""
    return mixing.mix(docs)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("PII", personal_data), ("mixing to target weights", mixture)]

#: The stages train a model and draw random paths, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            removed(spark, f"{folder}/{k - 1}")
    return docs
