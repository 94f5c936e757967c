"""Quality rules: base statistics of whole texts, then robust multivariate outliers.

Each language and source gets a minimum-covariance-determinant estimate of its transformed statistics. All rows are added up by cells of
half a least deviation, with exact counts and moments, so that a group of any size is a table of bounded size; concentration steps over
its cells, from many starts, find the three quarters of its rows with the least determinant. Then each row is judged by its own distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import columns, join_groups, small, stage

#: Fixed values of the contract.
SPACE, SYMBOLS = " \t\n\r\x0b\x0c", "#*$%&|<>"
#: The share of a group that an estimate rests on, and the factor that makes its covariance consistent for normal data in four dimensions.
SHARE, CONSISTENT = 0.75, 1.488
#: A statistic's least standard deviation: below it a difference is no sign of anything. In the shortest text that passes the base rules,
#: half of 50 words in repeats are log1p(100 * 25 / 150) = 2.87: more than a floor times the cutoff's root, so each statistic can reject alone.
FLOORS = (0.08, 0.3, 0.4, 0.6)
#: The share of normal data that is no outlier.
QUANTILE = 0.999


def chi_square(share: float) -> float:
    """The quantile of the chi-square distribution with four degrees of freedom, whose tail is exp(-x / 2) (1 + x / 2)."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        low, high = (x, high) if math.exp(-x / 2) * (1 + x / 2) > 1 - share else (low, x)
    return low


#: Squared distance beyond which a document is an outlier: 18.47.
CUTOFF = chi_square(QUANTILE)
#: Smaller groups are judged by their language's estimate over all such groups.
LEAST_GROUP = 50
#: Concentration steps go on until the determinant's logarithm does not change; random starts; starts that go on after two steps.
MOST_STEPS, SETTLED, STARTS, BEST = 100, 1e-9, 40, 5
#: Statistics count in whole units of 1/UNIT.
UNIT = 100_000
#: A cell's length along each statistic, half of its least deviation, and how many there are: the last one is open; the last two statistics end at 4.62 and 3.93.
CELL, MOST_CELLS = tuple(round(f * UNIT / 2) for f in FLOORS), (250, 100, 24, 14)
DIMS = range(len(FLOORS))
STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a run of three words that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter([known.setdefault(w, len(known)) for w in words], np.int64, n)
    pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1][:-1].astype(np.int64)
    _, at, count = np.unique(pairs * len(known) + ids[2:], return_inverse=True, return_counts=True)
    if len(count) == n - 2:
        return 0
    again = count[at] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : k + n - 2] |= again
    return int(inside.sum())


def statistics_of(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def statistic_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = np.array([statistics_of(t) for t in batch.column("text").to_pylist()], np.int64).reshape(-1, 5)
        n, again = got[:, 0], got[:, 4]
        fields = [batch.column("doc_id"), batch.column("lang"), batch.column("source"), *(pa.array(got[:, k]) for k in range(5)), pa.array((n < 50) | (100 * again > 50 * n))]
        yield pa.RecordBatch.from_arrays(fields, ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])


def transformed() -> list[Column]:
    """The statistic vector, in whole units: log word length, and logs of smoothed rates a hundred words of symbols, repeated lines and repeated words."""
    rate = lambda c: F.log1p(100 * F.col(c) / (F.col("n_words") + 100))
    vector = [F.log(F.col("word_chars") / F.col("n_words")), rate("n_symbols"), rate("n_dup_lines"), rate("n_repeat_words")]
    return [F.round(v * UNIT).cast("long").alias(f"z{k}") for k, v in enumerate(vector)]


def cells(rows: DataFrame) -> DataFrame:
    """The rows of each group by cells of CELL along each statistic: how many there are, sums of what they are above the cell's corner, and of the products.

    Cells are at most the product of MOST_CELLS in number, however many rows there are, and sums of whole numbers do not depend on the order of tasks."""
    corner = [F.least(F.floor(F.col(f"z{i}") / CELL[i]), F.lit(MOST_CELLS[i] - 1)).alias(f"c{i}") for i in DIMS]
    rows = rows.select(*KEY, "size", *(f"z{i}" for i in DIMS), *corner)
    above = [F.col(f"z{i}") - F.col(f"c{i}") * CELL[i] for i in DIMS]
    sums = [F.sum(above[i]).alias(f"s{i}") for i in DIMS] + [F.sum(above[i] * above[j]).alias(f"p{i}{j}") for i in DIMS for j in DIMS if i <= j]
    return rows.groupBy(*KEY, "size", *(f"c{i}" for i in DIMS)).agg(F.count(F.lit(1)).alias("n"), *sums)


def estimate(n: float, first: np.ndarray, second: np.ndarray, factor: float) -> tuple[float, np.ndarray, np.ndarray]:
    """(log-determinant, centre, covariance) from sums of vectors and of their products."""
    centre = first / n
    cov = factor * (second / n - np.outer(centre, centre)) + np.diag(np.square(FLOORS))
    return float(np.linalg.slogdet(cov)[1]), centre, cov


def concentrate(n: np.ndarray, first: np.ndarray, second: np.ndarray, fit: tuple[float, np.ndarray, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
    """The estimate of the SHARE of rows that lie nearest by ``fit``; of the last cell so much as is needed."""
    gap = first / n[:, None] - fit[1]
    order = np.argsort(np.einsum("ij,jk,ik->i", gap, np.linalg.inv(fit[2]), gap), kind="stable")
    before = np.cumsum(n[order]) - n[order]
    h = math.ceil(SHARE * n.sum())
    part = np.clip((h - before) / n[order], 0.0, 1.0)
    return estimate(h, part @ first[order], np.einsum("i,ijk->jk", part, second[order]), CONSISTENT)


def least_determinant(n: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Concentration from several starts (all rows, the medians, and means of a few rows each), first some steps of each, then of the best until nothing changes."""
    mean = first / n[:, None]
    flat = np.diag(np.square(FLOORS))
    middle = []
    for i in DIMS:
        order = np.argsort(mean[:, i], kind="stable")
        middle.append(mean[order[np.searchsorted(np.cumsum(n[order]), n.sum() / 2)], i])
    few = np.random.default_rng(0).choice(len(n), (STARTS, len(FLOORS) + 1), p=n / n.sum())
    fits = [estimate(n.sum(), first.sum(0), second.sum(0), 1.0), (0.0, np.array(middle), flat), *((0.0, mean[k].mean(0), flat) for k in few)]
    for _ in range(2):
        fits = [concentrate(n, first, second, f) for f in fits]
    out = []
    for f in sorted(fits, key=lambda f: f[0])[:BEST]:
        for _ in range(MOST_STEPS):
            before, f = f, concentrate(n, first, second, f)
            if abs(f[0] - before[0]) < SETTLED:
                break
        out.append(f)
    return min(out, key=lambda f: f[0])


def fit_group(table: pd.DataFrame) -> pd.DataFrame:
    """The estimate of one group from its cells."""
    table = table.sort_values([f"c{i}" for i in DIMS])
    n = table["n"].to_numpy(np.float64)
    corner = np.column_stack([table[f"c{i}"] * CELL[i] for i in DIMS]) / UNIT
    s = np.column_stack([table[f"s{i}"] for i in DIMS]) / UNIT
    p = np.array([[table[f"p{min(i, j)}{max(i, j)}"] for j in DIMS] for i in DIMS]).transpose(2, 0, 1) / UNIT**2
    cross = corner[:, :, None] * s[:, None, :]
    second = n[:, None, None] * corner[:, :, None] * corner[:, None, :] + cross + cross.transpose(0, 2, 1) + p
    _, centre, cov = least_determinant(n, n[:, None] * corner + s, second)
    return pd.DataFrame({"lang": table["lang"].iloc[:1].to_numpy(), "grp": table["grp"].iloc[:1].to_numpy(), "_size": table["size"].iloc[:1].to_numpy(), "centre": [centre], "inverse": [np.linalg.inv(cov).ravel()]})


KEY = ["lang", "grp"]


def distance() -> Column:
    gap = [F.col(f"z{i}") / UNIT - F.col("centre")[i] for i in DIMS]
    p = len(FLOORS)
    return reduce(Column.__add__, (F.col("inverse")[i * p + j] * gap[i] * gap[j] for i in DIMS for j in DIMS))


def fit(rows: DataFrame) -> DataFrame:
    """One estimate per group: what concentration ends in with the least determinant."""
    return cells(rows).groupBy(*KEY).applyInPandas(fit_group, "lang string, grp string, _size long, centre array<double>, inverse array<double>")


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, outlyingness.

    Words are runs of anything but ASCII white space; a null text has none. A document fails the base rules with fewer than
    50 words or with more than half of them in repeated runs. Of the others those are dropped whose squared robust
    distance within their language and source exceeds the cutoff (null counts as an empty name); ``outlyingness`` is null for documents
    that failed before. Equal rows get equal verdicts, further columns are ignored, an empty table gives no rows.
    """
    slim = stage(columns(docs, "doc_id", "lang", "source", "text").mapInArrow(statistic_rows, STATS))
    total = slim.count()
    named = slim.withColumn("lang", F.coalesce("lang", F.lit(""))).withColumn("source", F.coalesce("source", F.lit("")))
    passed = named.filter("not base_failed")
    sizes = passed.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("_n"))
    judged = join_groups(passed, sizes, ["lang", "source"], "_n", total)
    # A pooled group has a name that no source has.
    judged = judged.withColumn("grp", F.when(F.col("_n") >= LEAST_GROUP, F.concat(F.lit("="), "source")).otherwise("*")).select(*slim.columns, "grp", *transformed())
    group_sizes = judged.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size"))
    judged = stage(join_groups(judged, group_sizes, KEY, "size", total))
    best = stage(fit(judged))
    scored = join_groups(judged, best, KEY, "_size", total).withColumn("outlyingness", distance())
    keep = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    failed = slim.filter("base_failed").select(*keep, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("outlyingness"))
    return scored.select(*keep, (F.col("outlyingness") <= CUTOFF).alias("kept"), "outlyingness").unionByName(failed)


def drop_outliers(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, in their own columns. Rows of one doc_id, null too, share one verdict: all stay if any does."""
    lost = stage(quality_verdicts(docs).groupBy(F.col("doc_id").alias("_id")).agg(F.max("kept").alias("_kept")).filter("not _kept").select("_id"))
    return docs.join(small(lost, lost.count()), docs["doc_id"].eqNullSafe(lost["_id"]), "left_anti")
