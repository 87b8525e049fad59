"""Cleaning of a corpus in five stages, each an operator of ``leasewell.llm`` over all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.  All but the last return the columns of ``documents``; the last
adds token ids.  Rows with a null id take no part in matching and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leasewell.llm import decontaminate, language_id, near_duplicates, repeats, sentencepiece_fst
from leasewell.llm.session import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in a known language."""
    return language_id.accepted(docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each group of near duplicates."""
    return near_duplicates.one_of_each_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document (or the same one before) has; documents with nothing left go."""
    return repeats.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no test item."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the piece ids of the texts."""
    return sentencepiece_fst.encode(docs)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicate),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", token_ids),
]

#: Not expressible in SQL: the language and token stages follow learned automata and transducers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``documents`` after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-").lower())
    return docs
