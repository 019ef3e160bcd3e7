"""A training corpus from ``documents``: quality rules, near duplicates, personal data, mixing and packing, in this order.

Every stage takes what the one before has kept and returns the columns of ``documents``; the last returns the pieces of packed
sequences with their token ids. ``run`` writes each stage's rows as Parquet to the shared folder and reads them back for the
next. Nulls, empty and repeated rows, clashing columns and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightgrid.llm import jaccard_join, mixing, packing, pii, quality
from sightgrid.llm.common import documents, stored
from sightgrid.llm.queries import END_ID, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their language's perplexity band reject go."""
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    return jaccard_join.first_of_each_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, plain or in disguise, is replaced by its kind."""
    return pii.redacted_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for, to the nearest whole copy."""
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), END_ID)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("personal data", personal_data),
          ("source mix", source_mix), ("packing", packed_sequences)]

ORACLE_SQL = None  # SQL has no tokenizer and no n-gram model; tests/llm/test_pipeline.py holds each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
