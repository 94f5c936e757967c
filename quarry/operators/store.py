"""A keyed store of computed values (X05, W16): bucketed and sorted by key, so that requests meet it without moving it, and appended to.

The first level is the run itself: equal texts of a run are one key. The second is the store, a table in a shared folder that later sessions open again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.graph import staged

BUCKETS = 32


def open_store(spark: SparkSession, name: str, path: str, value: str, buckets: int = BUCKETS) -> str:
    """The table ``name`` over ``path`` (key string, value ``value``), made if it is not there; ``buckets`` must be what it was made with."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` (key STRING, value {value}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def key_of(text: str) -> F.Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def stored(requests: DataFrame, name: str, buckets: int = BUCKETS) -> DataFrame:
    """``requests`` (with key) with the store's value and ``hit``; the requests are dealt like the store, which is not shuffled.

    A key of many requests is no hot task: distinct keys are joined, not rows."""
    store = requests.sparkSession.table(name)
    keys = requests.select("key").distinct().repartition(buckets, "key")
    return keys.join(store.hint("merge"), "key", "left").withColumn("hit", F.col("value").isNotNull())


def computed(requests: DataFrame, name: str, compute: Callable[[DataFrame], DataFrame], text: str = "text", buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """Every row of ``requests`` with its ``value`` and whether that was in the store before (``hit``), and how many texts were computed.

    ``compute`` takes (key, text) and gives (key, value), no null values; it sees each distinct text that the store lacks once. What it gives is staged, then appended to the store, so a run that
    is lost between leaves the store as it was, and one that is repeated computes nothing again. A null text is empty. One run at a time may append to a store."""
    rows = requests.withColumn("key", key_of(text))
    known = staged(stored(rows, name, buckets).select("key", "value", "hit"))
    lacking = known.filter(~F.col("hit")).select("key")
    texts = rows.select("key", F.coalesce(F.col(text), F.lit("")).alias("text")).join(lacking, "key", "left_semi").dropDuplicates(["key"])
    new = staged(compute(texts).select("key", "value"))
    n = new.count()
    if n:
        new.repartition(buckets, "key").sortWithinPartitions("key").write.insertInto(name)
    values = known.filter("hit").unionByName(new.withColumn("hit", F.lit(False)))
    return rows.join(values, "key").drop("key"), n
