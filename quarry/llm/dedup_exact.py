"""Exact duplicates by two-pass Bloom filtering, in DataFrame functions only.

Pass one builds, from one 64-bit hash a row, a blocked Bloom filter in two layers: what was seen, and
what was seen again. A block is one 64-bit word with three bits a hash, so a filter of any size is a table
(word, again) and needs no driver. Pass two probes it where the rows are: the words that have bits seen again are counted and broadcast, in slices of bounded size.
Rows whose bits were not seen again are unique and
pass straight through; only the others shuffle to be grouped by the SHA-256 of their text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, columns, join_groups, small, stage, union_all

#: Rows for each 64-bit word of the filter: 16 bits a row.
ROWS_PER_WORD = 4
#: Bytes of filter words that are broadcast at once, and of one such word.
SLICE_BYTES, WORD_BYTES = 32 << 20, 64
#: Bytes of a group (a digest, a row's number and id, a count) in a broadcast table.
GROUP_BYTES = 200


def digest() -> Column:
    return F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256)


def digests(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_sha256 (A-Z lower-cased text, null as empty) and the row's place in a filter of ``words`` words."""
    rows = columns(docs, "doc_id", "text").select("doc_id", digest().alias("text_sha256"), F.monotonically_increasing_id().alias("_row"))
    bit = lambda k: F.expr(f"shiftleft(1L, cast((shiftright(_h, {6 * k}) & 63) as int))")
    return (
        rows.withColumn("_word", F.pmod(F.xxhash64("text_sha256"), F.lit(words)))
        .withColumn("_h", F.xxhash64(F.lit("bits"), "text_sha256"))
        .withColumn("_mask", bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)))
        .drop("_h")
    )


def seen_again(rows: DataFrame) -> DataFrame:
    """(_word, _again): for each filter word that has any, the bits of hashes that may have come twice."""
    masks = rows.groupBy("_word", "_mask").agg(F.count(F.lit(1)).alias("_c"))  # equal hashes meet before the shuffle
    folded = F.expr(
        """aggregate(array_sort(collect_list(struct(_mask, _c))), named_struct('seen', 0L, 'again', 0L), (s, x) -> named_struct(
             'seen', s.seen | x._mask,
             'again', if(x._c > 1 or (s.seen & x._mask) = x._mask, s.again | x._mask, s.again)), s -> s.again)"""
    )
    return masks.groupBy("_word").agg(folded.alias("_again")).filter("_again != 0")


def slices(again: DataFrame, words: int) -> list[tuple[int, int]]:
    """Ranges of filter words, of so many with bits seen again as a broadcast may hold, about: words are hashes, so they are spread evenly."""
    n = max(1, math.ceil(again.count() * WORD_BYTES / SLICE_BYTES))
    return [(k * words // n, (k + 1) * words // n) for k in range(n)]


def probe(rows: DataFrame, again: DataFrame, first: int, end: int) -> DataFrame:
    """The rows of a range of filter words with ``_maybe``: were all their bits seen again? They are joined where they are; in a staged table that is sorted by word only the range is read."""
    inside = (F.col("_word") >= first) & (F.col("_word") < end)
    marked = rows.filter(inside).join(F.broadcast(again.filter(inside)), "_word", "left")
    return marked.withColumn("_maybe", F.coalesce(F.col("_again").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False)))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and empty texts equal each other.
    Of equal texts the row with the largest doc_id stays (null ids are least); of fully repeated rows exactly one is kept.
    Further columns are ignored; an empty table gives no rows.
    """
    n = docs.count()
    words = 1 << max(0, math.ceil(math.log2(max(1, n) / ROWS_PER_WORD)))
    rows = stage(digests(docs, words).sortWithinPartitions("_word"))
    again = stage(seen_again(rows).sortWithinPartitions("_word"))
    parts = slices(again, words)
    # One slice after the other, so that there is one in memory at a time.
    probed = probe(rows, again, *parts[0]) if len(parts) == 1 else union_all([stage(probe(rows, again, *part)) for part in parts])
    maybe = probed.filter("_maybe").select("doc_id", "text_sha256", "_row")
    groups = stage(maybe.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "_row")).alias("_keep"), F.count(F.lit(1)).alias("group_size")))
    counted = groups.agg(F.count(F.lit(1)), F.sum("group_size")).first()
    grouped = join_groups(maybe, groups, ["text_sha256"], "group_size", counted[1] or 0, "inner", counted[0], GROUP_BYTES)
    grouped = grouped.select("doc_id", F.col("_keep.doc_id").alias("keep_id"), "group_size", (F.col("_keep._row") == F.col("_row")).alias("kept"), "text_sha256")
    alone = probed.filter("not _maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return grouped.unionByName(alone)


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, in its own columns. Only the dropped rows' ids and digests are joined to it."""
    verdict = exact_duplicates(docs).filter("group_size > 1")
    # What goes, and (only of fully repeated rows) that of which one row stays.
    odd = verdict.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("_stays"), F.count(F.lit(1)).alias("_n")).filter("not _stays or _n > 1")
    odd = stage(odd.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest"), "_stays"))
    n, twice = odd.agg(F.count(F.lit(1)), F.sum(F.col("_stays").cast("int"))).first()
    rows = docs.withColumn("_own_digest", digest())
    out = rows.join(small(odd, n, GROUP_BYTES), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own_digest") == F.col("_digest")), "left")
    once = out.filter("_stays is null").select(*docs.columns)
    return once.unionByName(out.filter("_stays").dropDuplicates(["doc_id", "_digest"]).select(*docs.columns)) if twice else once
