"""Operators over turns, scenes, caches and search results."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Items and characters of an embedding batch; words of a scene and of a tail that joins it.
BATCH_ITEMS, BATCH_CHARS, SCENE_WORDS, TAIL_WORDS = 16, 18_000, 52, 14


def embedding_batches(texts: DataFrame, key: str = "slice", order: str = "doc_id") -> DataFrame:
    """Batches of at most BATCH_ITEMS texts and BATCH_CHARS characters (X05), greedy in order within each slice. Slices are of bounded size and only lengths travel: key, doc_id, batch."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        batch, n, chars, out = 0, 0, 0, []
        for r in pdf.sort_values(order).itertuples():
            if n and (n == BATCH_ITEMS or chars + r.chars > BATCH_CHARS):
                batch, n, chars = batch + 1, 0, 0
            out.append(batch)
            n, chars = n + 1, chars + r.chars
        return pdf.sort_values(order)[[key, "doc_id"]].assign(batch=out)

    rows = texts.select(key, "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    return rows.groupBy(key).applyInPandas(run, f"{key} long, doc_id long, batch long")


def scenes(docs: DataFrame) -> DataFrame:
    """Sentences packed into scenes (O01): a scene closes once it has more than SCENE_WORDS words; a last one under TAIL_WORDS joins the one before. One document at a time, a narrow pass."""

    def run(batches):
        for pdf in batches:
            out = []
            for d in pdf.itertuples(index=False):
                packed: list[int] = []
                open_ = 0
                for s in re.split(r"(?<=[.!?])\s+", d.text or ""):
                    open_ += len(s.split())
                    if open_ > SCENE_WORDS:
                        packed.append(open_)
                        open_ = 0
                if open_:
                    if packed and open_ < TAIL_WORDS:
                        packed[-1] += open_
                    else:
                        packed.append(open_)
                out += [(d.doc_id, k, n) for k, n in enumerate(packed)]
            yield pd.DataFrame(out, columns=["doc_id", "scene", "words"]).astype({"doc_id": "Int64", "scene": "int64", "words": "int64"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, scene long, words long")


def truncate_at_boundary(c: Column, most: int) -> Column:
    """Cut to ``most`` characters at the last sentence end in the second 60 per cent, else at the last space in the second half, else hard (P25)."""
    head = c.substr(1, most)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    space = F.regexp_extract(head, r"(?s)^(.*)\s", 1)
    return F.when(F.length(c) <= most, c).when(F.length(sentence) >= int(0.4 * most), sentence).when(F.length(space) >= most // 2, space).otherwise(head)


def topic_shifts(turns: DataFrame, least: float = 0.1) -> DataFrame:
    """Whether a user turn leaves the topic of the one before (P33): under ``least`` of its words shared."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= 3))
    t = turns.filter("role = 'user'").withColumn("_w", words).withColumn("_p", F.lag("_w").over(w))
    shared = F.size(F.array_intersect("_w", "_p")) / F.greatest(F.lit(1), F.size("_w"))
    return t.select("conv_id", "turn", F.round(F.coalesce(shared, F.lit(1.0)), 6).alias("shared"), F.coalesce(shared < least, F.lit(False)).alias("shift"))


def dialogue_state(turns: DataFrame) -> DataFrame:
    """What of a conversation counts for its state (P42): all user turns, then the last two of the assistant."""
    w = Window.partitionBy("conv_id", "role").orderBy(F.desc("turn"))
    t = turns.withColumn("_n", F.row_number().over(w)).filter("role = 'user' or (role = 'assistant' and _n <= 2)")
    part = F.struct((F.col("role") == "assistant").cast("int").alias("late"), "turn", "text")
    return t.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts")).select("conv_id", F.size("parts").cast("long").alias("turns"), F.array_join("parts.text", "\n").alias("state"))


def breaker_trips(calls: DataFrame, key: str, failed: Column, threshold: int = 3) -> DataFrame:
    """Where a circuit breaker opens (R05): the calls with which ``threshold`` failures in a row are reached."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    c = calls.withColumn("_ok", F.sum((~failed).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_bad", failed)
    run = F.row_number().over(Window.partitionBy(key, "_ok").orderBy("ts", "event_id")) - F.when(F.col("_ok") > 0, 1).otherwise(0)
    return c.withColumn("run", run).filter("_bad").filter(F.col("run") == threshold).drop("_ok", "_bad", "run")


def missing_from_cache(requests: DataFrame, cache: DataFrame, text: str) -> DataFrame:
    """Distinct texts by SHA-256 that the keyed cache does not hold yet (W16, X05): what an expensive function still has to see."""
    return requests.select(F.sha2(F.col(text).cast("binary"), 256).alias("key"), text).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def ordered_search(results: DataFrame, key: str, url: str, order: list[Column], quota: int) -> DataFrame:
    """First occurrences of a URL in order, up to a quota a key."""
    first = results.withColumn("_n", F.row_number().over(Window.partitionBy(key, url).orderBy(*order))).filter("_n = 1").drop("_n")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("place") <= quota)
