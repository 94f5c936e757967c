"""Ranks and percentiles in keys of any size: rows are dealt by ranges of the whole order, so that a key with a third of all rows is many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.graph import staged


def ranked(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank", total: str | None = None) -> DataFrame:
    """``df`` with the row number from 1 within ``keys`` in ``order`` (N02, N09, T04), and with the rows of the key as ``total``.

    Rows are dealt by ranges of keys and order and staged, as the ranges come from a sample; numbers within a range and the counts of the ranges before it add up to the rank.
    Null keys are one key; of rows alike in the whole order any may come first; an empty table gives none."""
    rows = staged(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()))
    inner = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)).cast("long"))
    key = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))])
    counts = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_q")).agg(F.count(F.lit(1)).alias("_n"))
    before = key.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[f"_k{i}" for i in range(len(keys))], "_q", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(key).alias("_total"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    out = inner.join(counts, [*same, F.col("_part") == F.col("_q")])
    return out.select(*df.columns, (F.col("_in") + F.col("_before")).alias(rank), *([F.col("_total").alias(total)] if total else []))


def interpolated_percentiles(df: DataFrame, keys: list[str], value: str, points: list[int]) -> DataFrame:
    """Percentiles between order statistics (A15); null values count for nothing."""
    rows = _values(df, keys, value)
    at = lambda p: F.lit(p) * (F.col("_n") - 1) / 100
    value_at = lambda i: F.max(F.when(F.col("_i") == i, F.col(value)))
    place = lambda p: F.max(at(p)) - F.floor(F.max(at(p)))
    low, high = (lambda p: value_at(F.floor(at(p)))), (lambda p: value_at(F.ceil(at(p))))
    return rows.groupBy(*keys).agg(*[((1 - place(p)) * low(p) + place(p) * high(p)).alias(f"p{p}") for p in points])


def discrete_percentiles(df: DataFrame, keys: list[str], value: str, points: list[int]) -> DataFrame:
    """sorted[min(floor(p/100*n), n-1)] (A16), by rank; null values count for nothing."""
    at = lambda p: F.least(F.floor(F.lit(p) * F.col("_n") / 100), F.col("_n") - 1)
    return _values(df, keys, value).groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == at(p), F.col(value))).alias(f"p{p}") for p in points])


def _values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values that are not null, with their place from 0 in the key and the key's number of them. A number of its own orders rows of equal values, so that a very frequent value is many ranges."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value, F.monotonically_increasing_id().alias("_tie"))
    return ranked(rows, keys, [F.col(value), F.col("_tie")], "_i", "_n").withColumn("_i", F.col("_i") - 1)
