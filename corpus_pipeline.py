"""A training-data pipeline of five of the corpus operators.

Stages take the documents that their predecessor kept and return the columns of
documents; the last adds the shard and the place in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prismlake.llm.common import forget, table, written
from prismlake.llm.decontamination import without_contaminated
from prismlake.llm.mixing import mixed_documents
from prismlake.llm.near_texts import without_near_duplicates
from prismlake.llm.sharding import sharded_documents
from prismlake.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of 0.3 or more."""
    return without_toxic(docs, table(spark, sf_dir, "labels"), 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that shares 0.8 of its five-word shingles."""
    return without_near_duplicates(docs, 5, 0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes sources to their weights; documents that are taken twice are there twice."""
    return mixed_documents(spark, docs, sf_dir)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Assigns 40 shards of near-equal bytes along the Hilbert curve."""
    return sharded_documents(docs, 40, "bytes")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Learned scores and fingerprints: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written before the next.

    A stage's documents go when the next one's are written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
