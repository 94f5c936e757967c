"""Sharding by a permutation-filled lookup table of prime size, in constant time a document."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import columns

#: A prime far above the number of shards keeps their shares even: within 1 % up to 655 shards.
TABLE_SIZE = 65_537


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of its shard. Each shard's preference order is a permutation of all slots, and shards
    take turns claiming the next slot of theirs that is free; losing a shard moves few slots of the others. The table's size is fixed."""
    if not shards:
        raise ValueError("no shards")
    place = [_number(s, "offset") % size for s in shards]
    step = [_number(s, "skip") % (size - 1) + 1 for s in shards]
    table, free = [-1] * size, size
    while True:
        for k in range(len(shards)):
            while table[place[k]] >= 0:
                place[k] = (place[k] + step[k]) % size
            table[place[k]] = k
            free -= 1
            if not free:
                return table


def slot(key: str, size: int = TABLE_SIZE):
    """The slot of a key: its MD5's first 60 bits, modulo the table's size. Null counts as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % size


def place(docs: DataFrame, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """One row per row of ``docs``: the key, n_bytes of the text (null: 0), slot and shard.

    The table, of ``size`` entries whatever the input, is broadcast. Equal keys go to one shard; further columns are ignored.
    """
    spark = docs.sparkSession
    table = lookup_table(shards, size)
    rows = spark.createDataFrame([(i, shards[k]) for i, k in enumerate(table)], "slot long, shard string")
    placed = columns(docs, key, "text").select(key, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), slot(key, size).alias("slot"))
    return placed.join(F.broadcast(rows), "slot").select(key, "n_bytes", "slot", "shard")


def write_shards(docs: DataFrame, path: str, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE, name: str = "in_shard") -> None:
    """Write ``docs`` as one folder a shard, ``name``=shard, with all their columns; ``docs`` must have no column of that name.

    Rows are spread over tasks by shard and slot, twice as many as there are shuffle partitions and 16 a shard at least, so no task holds a whole shard."""
    spark = docs.sparkSession
    each = max(16, -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // len(shards)))
    rows = spark.createDataFrame([(i, shards[k]) for i, k in enumerate(lookup_table(shards, size))], f"_placed_slot long, {name} string")
    out = docs.withColumn("_placed_slot", slot(key, size)).join(F.broadcast(rows), "_placed_slot")
    out.repartition(F.col(name), F.col("_placed_slot") % each).drop("_placed_slot").write.mode("overwrite").partitionBy(name).parquet(path)
