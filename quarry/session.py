"""A session with the settings that the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int = 8, memory: str = "12g", partitions: int = 8) -> SparkSession:
    """For tests and the bench; on a cluster use its own session."""
    b = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
