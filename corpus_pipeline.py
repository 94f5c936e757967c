"""The corpus pipeline: four stages over ``documents``, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import stage
from quarry.llm.dedup_exact import drop_exact_duplicates
from quarry.llm.jaccard import drop_near_duplicates
from quarry.llm.packing import pack
from quarry.llm.quality import drop_outliers


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the base rules or the robust outlier test reject go."""
    return drop_outliers(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of equal texts one stays."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each class of near duplicates (five-word shingles, similarity 0.8) one stays."""
    return drop_near_duplicates(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: what is left, packed into sequences of 2048 tokens."""
    return pack(docs).drop("shard")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("packed", packed)]

#: Robust covariance estimates and tokenization are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs)
    return docs
