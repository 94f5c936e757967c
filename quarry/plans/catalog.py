"""All registered queries of the library's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import audits, claims, dialogue, extract, graph, more, questions, relational, repeats, rest, retrieval, scans, search, text, years  # noqa: F401
from quarry.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["op_x11_hybrid_rrf"](spark, sf_dir)
