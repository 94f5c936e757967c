"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its counted rows, at this many bytes each, stay below the bound.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 64
#: A key is a heavy hitter when it holds more than 1/HEAVY of all rows, so at most HEAVY keys are.
HEAVY = 1000
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where it is unset and all run on one machine (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quarry-"))
    return sc.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the quick path."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, ASCII_UPPER, ASCII_LOWER))


def small(df: DataFrame, rows: int, row_bytes: int = ROW_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if ``rows`` of ``row_bytes`` stay below the bound, else as it is (a shuffle join)."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner", n_groups: int | None = None, row_bytes: int = ROW_BYTES) -> DataFrame:
    """Join ``rows`` to one row per key of ``groups`` (with the key's count in ``size``) without a hot task.

    Groups are broadcast if ``n_groups`` of them (as many as rows, unless counted) stay below the bound. Else keys with more than total/HEAVY rows, of which there are at most HEAVY,
    are broadcast; what remains has no hot key and is joined by an ordinary shuffle.
    ``keys`` must not be null. ``how``: inner or left.
    """
    extra = [c for c in groups.columns if c not in keys]
    if (total if n_groups is None else n_groups) * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(groups), keys, how)
    hot = groups.filter(F.col(size) * HEAVY > total).select(*keys, F.struct(*extra).alias("_hot"))
    split = rows.join(F.broadcast(hot), keys, "left")
    first = split.filter(F.col("_hot").isNotNull()).select(*rows.columns, *[F.col("_hot")[c].alias(c) for c in extra])
    rest = split.filter(F.col("_hot").isNull()).select(*rows.columns).join(groups, keys, how)
    return first.unionByName(rest.select(*first.columns))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected ``edges``: component is the least node reachable. Null ends are ignored.

    Alternating large-star and small-star rounds, each a few grouped minima over a staged edge table:
    the number of rounds grows with the logarithm of a component's size, not with its diameter,
    and hubs are joined through ``join_groups``. Nodes without an edge to another node are absent.
    """
    spark = edges.sparkSession
    x, y = F.col(a), F.col(b)
    e = stage(edges.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    n = e.count()
    if not n:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(most_rounds):
        # Large star: hang every larger neighbour on the least of the neighbourhood.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("deg"))
        large = join_groups(both.filter("v > u"), least, ["u"], "deg", 2 * n).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large)
        edges_of_round = large.count()
        # Small star: hang every smaller neighbour, and the node itself, on the least one.
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg"))
        joined = join_groups(large, least, ["u"], "deg", edges_of_round)
        new = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = stage(new)
        m = new.count()
        same = m == n and new.join(e, ["u", "v"], "left_anti").isEmpty()
        discard(large, e)
        e, n = new, m
        if same:
            break
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only ``names``, by exact name, so that further columns cannot clash; a missing one is null text."""
    return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
