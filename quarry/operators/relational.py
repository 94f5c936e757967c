"""Joins, de-duplication, snapshots and audits that the plans compose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.dims import BRIDGE_EPOCHS, BRIDGE_YEARS


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order`` (A06, J07, N08): a ranked window, never a self-join on inequality."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int | Column, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def running_budget(df: DataFrame, keys: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """The longest prefix of each key's rows whose costs stay within ``budget``; the first row always stays."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spent = df.withColumn("spent", F.sum(cost).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    return spent.filter((F.col("spent") <= budget) | (F.col("_n") == 1)).drop("_n")


def overlapping_epochs(df: DataFrame, chronology: DataFrame, first: str, last: str) -> DataFrame:
    """Interval overlap join (J10): the distinct epochs that each row's closed interval meets, as a sorted array.

    The chronology is a fixed table of a few rows, so it is broadcast. Null bounds meet nothing."""
    met = df.join(F.broadcast(chronology), (F.col("start_year") <= F.col(last)) & (F.col("end_year") >= F.col(first)), "left")
    out = met.groupBy(*df.columns).agg(F.collect_set("epoch_id").alias("epochs"))
    bridge = (F.col(first) <= BRIDGE_YEARS[1]) & (F.col(last) >= BRIDGE_YEARS[0])
    return out.withColumn("epochs", F.array_sort(F.when(bridge, F.array_union("epochs", F.array(*map(F.lit, BRIDGE_EPOCHS)))).otherwise(F.col("epochs"))))


def epoch_of_year(df: DataFrame, chronology: DataFrame, year: str) -> DataFrame:
    """Point in interval with clamping (J11): earlier years take the first row, later ones the last."""
    bounded = F.greatest(F.lit(-2879), F.least(F.lit(2026), F.col(year)))
    return df.join(F.broadcast(chronology), bounded.between(F.col("start_year"), F.col("end_year")), "left")


def resolve_names(df: DataFrame, aliases: DataFrame, name: str, steps: list[Column]) -> DataFrame:
    """Alias resolution (J08): ``steps`` are ever coarser keys of ``name``; the first that ``aliases`` (key, canonical) knows wins."""
    out = df
    for k, step in enumerate(steps):
        out = out.withColumn(f"_k{k}", step).join(aliases.select(F.col("key").alias(f"_k{k}"), F.col("canonical").alias(f"_c{k}")), f"_k{k}", "left")
    found = F.coalesce(*[F.col(f"_c{k}") for k in range(len(steps))])
    return out.select(*df.columns, found.alias("canonical"))


def rekey(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Entity merge (J09, W11): ends mapped old to canonical, self-loops and collisions dropped; of colliding edges the one that had
    its canonical ends before stays, then the most confident."""
    m = mapping.select("old", "canonical")
    out = edges.join(m.withColumnsRenamed({"old": "src", "canonical": "_s"}), "src", "left").join(m.withColumnsRenamed({"old": "tgt", "canonical": "_t"}), "tgt", "left")
    out = out.withColumn("moved", F.col("_s").isNotNull() | F.col("_t").isNotNull()).withColumns({"src": F.coalesce("_s", "src"), "tgt": F.coalesce("_t", "tgt")}).drop("_s", "_t").filter("src <> tgt")
    return keep_first(out, ["src", "rel", "tgt"], [F.col("moved"), F.desc("confidence")])


# Snapshots: each takes the stored table and a batch and returns the table after the statement.
def upsert_replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch replace stored rows of the same key."""
    return old.join(new, keys, "left_anti").unionByName(new)


def upsert_columns(old: DataFrame, new: DataFrame, keys: list[str], replaced: list[str]) -> DataFrame:
    """Only ``replaced`` columns take the batch's values; the rest of a stored row stays."""
    o, n = old.alias("o"), new.alias("n")
    cond = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    pick = lambda c: F.coalesce(f"n.{c}", f"o.{c}") if c in replaced or c in keys else F.when(F.col(f"o.{keys[0]}").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return o.join(n, cond, "full").select(*[pick(c).alias(c) for c in old.columns])


def upsert_last(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last write of a key stays."""
    return keep_first(old.unionByName(new), keys, [F.desc(seq)])


def upsert_max(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The greatest value of a key stays."""
    return old.unionByName(new).groupBy(*keys).agg(F.max(value).alias(value))


def upsert_add(old: DataFrame, new: DataFrame, keys: list[str], count: str, sample: str, seq: str) -> DataFrame:
    """Counters add up, the latest sample stays."""
    return old.unionByName(new).groupBy(*keys).agg(F.sum(count).alias(count), F.max_by(sample, seq).alias(sample))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Only keys that are not stored yet come in."""
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"))


def upsert_union(old: DataFrame, new: DataFrame, keys: list[str], values: str) -> DataFrame:
    """Array columns take the sorted union."""
    return old.unionByName(new).groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(values)))).alias(values))


def replace_slice(old: DataFrame, new: DataFrame, slice_key: str) -> DataFrame:
    """Delete by slice, then insert."""
    return old.join(new.select(slice_key).distinct(), slice_key, "left_anti").unionByName(new)


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows where the predicate is true go; where it is null they stay."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that no node has."""
    ids = nodes.select("id")
    lost = lambda c: edges.join(ids, edges[c] == ids["id"], "left_anti")
    return lost("src").union(lost("tgt")).distinct()
