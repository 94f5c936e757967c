"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import columns, stage
from quarry.llm.tokens import byte_ids

#: Lengths in one bucket of the two-level suffix sums.
BUCKET = 1024


def length_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = pa.array([len(byte_ids(t or "")) for t in batch.column("text").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), counts], [*batch.schema.names[:-1], "n_tokens"])


def token_lengths(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and n_tokens, the number of ids of the whole text (null: empty), for each row."""
    rows = columns(docs, *keep, "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "n_tokens long"])
    return rows.mapInArrow(length_rows, schema)


def length_histogram(docs: DataFrame, by: str = "lang") -> DataFrame:
    """For each value of ``by`` and each encoded length that occurs, as a context limit, what the limit means.

    Columns: ``by`` (null as empty), context_limit, n_docs (of this length), docs_over (longer), docs_total, tokens_total,
    truncated_total (sum of min(length, limit)), tokens_lost, share_within (documents not longer: the limit is this quantile of the lengths).
    Null and empty texts have length 0. Further columns are ignored; an empty table gives no rows.
    """
    lengths = token_lengths(docs, by).withColumn(by, F.coalesce(by, F.lit("")))
    hist = stage(lengths.groupBy(by, "n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))  # read twice below, texts encoded once
    hist = hist.withColumn("bucket", F.floor(F.col("n_tokens") / BUCKET))
    # Sums over longer documents: within a bucket, and over the buckets above it, of which there are few.
    inner = Window.partitionBy(by, "bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(by).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(by)
    zero = lambda c: F.coalesce(c, F.lit(0))
    tokens = F.col("n_docs") * F.col("n_tokens")
    totals = hist.groupBy(by, "bucket").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    totals = totals.select(by, "bucket", zero(F.sum("d").over(above)).alias("docs_above"), zero(F.sum("t").over(above)).alias("tokens_above"), F.sum("d").over(whole).alias("docs_total"), F.sum("t").over(whole).alias("tokens_total"))
    rows = hist.withColumn("docs_in", zero(F.sum("n_docs").over(inner))).withColumn("tokens_in", zero(F.sum(tokens).over(inner))).join(totals, [by, "bucket"])
    over, lost = F.col("docs_in") + F.col("docs_above"), F.col("tokens_in") + F.col("tokens_above")
    rows = rows.withColumn("docs_over", over).withColumn("tokens_lost", lost - over * F.col("n_tokens"))
    return rows.select(by, F.col("n_tokens").alias("context_limit"), "n_docs", "docs_over", "docs_total", "tokens_total", (F.col("tokens_total") - F.col("tokens_lost")).alias("truncated_total"), "tokens_lost", F.round(1 - F.col("docs_over") / F.col("docs_total"), 9).alias("share_within"))
