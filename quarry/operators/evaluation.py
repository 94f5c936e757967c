"""Metrics over ranked lists, labels and pairs, as grouped aggregations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, gold: DataFrame, k: int = 5, least_grade: int = 2) -> DataFrame:
    """Per query nDCG@k (gain 2^g - 1), MRR@k (grade from ``least_grade``), MAP@k, recall and precision@k.

    ``ranked``: query, chunk_id, rank; ``gold``: query, chunk_id, grade > 0. Queries are those of ``ranked``. Without gold nDCG, MAP and recall are 1, MRR and precision 0.
    """
    top = ranked.filter(F.col("rank") <= k).join(gold, ["query", "chunk_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    w = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    top = top.withColumn("hits", F.sum((F.col("grade") > 0).cast("int")).over(w))
    gain = lambda rank: (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col(rank) + 1.0)
    got = top.groupBy("query").agg(
        F.sum(gain("rank")).alias("dcg"), F.min(F.when(F.col("grade") >= least_grade, F.col("rank"))).alias("first"), F.sum(F.when(F.col("grade") > 0, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap"), F.sum((F.col("grade") > 0).cast("int")).alias("found"), F.count(F.lit(1)).alias("returned"),
    )
    ideal = gold.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "chunk_id")))
    ideal = ideal.groupBy("query").agg(F.sum(F.when(F.col("place") <= k, gain("place"))).alias("idcg"), F.count(F.lit(1)).alias("n_gold"))
    j = got.join(ideal, "query", "left")
    some = F.col("n_gold").isNotNull()
    r = lambda c: F.round(c, 6)
    return j.select(
        "query", r(F.when(some, F.col("dcg") / F.col("idcg")).otherwise(1.0)).alias("ndcg"), r(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), r(F.when(some, F.col("ap") / F.least("n_gold", F.lit(k))).otherwise(1.0)).alias("map"), r(F.when(some, F.col("found") / F.col("n_gold")).otherwise(1.0)).alias("recall"), r(F.when(some, F.col("found") / F.col("returned")).otherwise(0.0)).alias("precision"),
    )


def pair_accuracy(scored: DataFrame, key: str, score: str, grade: str) -> DataFrame:
    """Share of pairs of different grade that the score orders rightly (M04), per key; counted from ranks by window sums, without forming pairs: a tie in score counts as wrong."""
    levels = scored.groupBy(key, score, grade).agg(F.count(F.lit(1)).alias("n"))
    grades = levels.select(key, F.col(grade).alias("_g")).distinct()
    cells = levels.join(grades, key).withColumn("lower", F.col("_g") < F.col(grade))
    below = Window.partitionBy(key, "_g").orderBy(score).rangeBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col(grade) == F.col("_g"), F.col("n")).otherwise(0)
    right = cells.withColumn("under", F.coalesce(F.sum(own).over(Window.partitionBy(key, "_g").orderBy(score).rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)))
    same = cells.groupBy(key, score, "_g").agg(F.sum(own).alias("ties"))
    right = right.join(same, [key, score, "_g"]).withColumn("under", F.col("under") - F.col("ties"))
    total = cells.groupBy(key, "_g").agg(F.sum(own).alias("all"))
    out = right.filter("lower").join(total, [key, "_g"]).groupBy(key).agg(F.sum(F.col("n") * F.col("under")).alias("right"), F.sum(F.col("n") * F.col("all")).alias("pairs"))
    return out.withColumn("accuracy", F.round(F.col("right") / F.col("pairs"), 6))


def confusion(df: DataFrame, actual: str, predicted: str, classes: list) -> DataFrame:
    """Confusion matrix (A20): one row an actual class, one column a predicted one."""
    return df.groupBy(actual).pivot(predicted, classes).count().fillna(0)


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Per class precision, recall and F1."""
    cells = df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))
    side = lambda c, name: cells.groupBy(F.col(c).alias("cls")).agg(F.sum("n").alias(name))
    hit = cells.filter(F.col(actual) == F.col(predicted)).select(F.col(actual).alias("cls"), F.col("n").alias("tp"))
    j = side(actual, "support").join(side(predicted, "called"), "cls", "full").join(hit, "cls", "left").fillna(0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("called")), ratio(F.col("tp"), F.col("support"))
    return j.select("cls", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"))


def set_scores(predicted: DataFrame, gold: DataFrame, key: str, item: str) -> DataFrame:
    """Precision, recall and F1 of item sets per key."""
    p, g = predicted.select(key, item).distinct().withColumn("p", F.lit(1)), gold.select(key, item).distinct().withColumn("g", F.lit(1))
    c = p.join(g, [key, item], "full").groupBy(key).agg(F.count("p").alias("n_predicted"), F.count("g").alias("n_gold"), F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("n_both"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    pr, re = ratio(F.col("n_both"), F.col("n_predicted")), ratio(F.col("n_both"), F.col("n_gold"))
    return c.select(key, F.round(pr, 6).alias("precision"), F.round(re, 6).alias("recall"), F.round(ratio(2 * pr * re, pr + re), 6).alias("f1"))


def kendall(df: DataFrame, key: str, place: str, value: str) -> DataFrame:
    """Kendall's tau of the order of ``value`` along ``place`` (M13): (C - D) / sqrt(N * max(1, C + D)), as 0 to 100. Keys are scenes of bounded length."""
    a, b = df.select(key, F.col(place).alias("_i"), F.col(value).alias("_v")), df.select(key, F.col(place).alias("_j"), F.col(value).alias("_w"))
    p = a.join(b, key).filter("_i < _j").groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_v") < F.col("_w")).alias("c"), F.count_if(F.col("_v") > F.col("_w")).alias("d"))
    tau = (F.col("c") - F.col("d")) / F.sqrt(F.col("n") * F.greatest(F.lit(1), F.col("c") + F.col("d")))
    return p.select(key, F.round(50 * (tau + 1), 6).alias("flow"))


#: Coefficients of the normal distribution's polynomial, from the highest power of 1 / (1 + 0.2316419 |x|), its leading factor and the level of significance; fixed values.
NORMAL = [1.330274, -1.821256, 1.781478, -0.3565638, 0.3193815]
NORMAL_STEP, NORMAL_PEAK, LEVEL = 0.2316419, 0.3989423, 0.01


def upper_tail(x: Column) -> Column:
    """Probability that a standard normal variable exceeds ``x`` >= 0, by the polynomial."""
    t = 1 / (1 + NORMAL_STEP * x)
    poly = F.lit(0.0)
    for c in NORMAL:
        poly = (poly + c) * t
    return NORMAL_PEAK * F.exp(-x * x / 2) * poly


def paired_t(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Paired t test of b - a per key (M08): n, mean, t, two-sided p from the normal distribution, significant. Fewer than two pairs give t 0 and p 1; equal differences give p 0, or 1 if they are 0."""
    s = df.withColumn("_d", F.col(b) - F.col(a)).groupBy(key).agg(F.count("_d").alias("n"), F.avg("_d").alias("mean"), F.stddev_samp("_d").alias("_s"))
    few, same = F.col("n") < 2, F.col("_s") == 0
    flat = F.when(F.col("mean") == 0, 0.0).otherwise(F.signum("mean") * F.lit(float("inf")))
    t = F.when(few, 0.0).when(same, flat).otherwise(F.col("mean") / (F.col("_s") / F.sqrt("n")))
    p = F.when(few | (same & (F.col("mean") == 0)), 1.0).when(same, 0.0).otherwise(F.least(F.lit(1.0), 2 * upper_tail(F.abs(t))))
    return s.select(key, "n", F.round("mean", 6).alias("mean"), F.round(t, 4).alias("t"), F.round(p, 6).alias("p"), (p < LEVEL).alias("significant"))


def class_averages(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy, and precision, recall and F1 as the mean over classes and over all rows (A20, A21, M12): one row; zeros for an empty table.

    Classes are all that occur on either side; rows without a class on a side count there for none."""
    cells = df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col(actual) == F.col(predicted), F.col("n"))), F.lit(0)).alias("hits"), F.coalesce(F.sum(F.when(F.col(actual).isNotNull(), F.col("n"))), F.lit(0)).alias("_sup"), F.coalesce(F.sum(F.when(F.col(predicted).isNotNull(), F.col("n"))), F.lit(0)).alias("_called"))
    macro = class_report(df, actual, predicted).filter("cls is not null").agg(F.count(F.lit(1)).alias("classes"), *[F.coalesce(F.round(F.avg(c), 5), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("hits"), F.col("_called")), ratio(F.col("hits"), F.col("_sup"))
    micro = total.select("rows", F.round(ratio(F.col("hits"), F.col("rows")), 6).alias("accuracy"), F.round(p, 6).alias("micro_precision"), F.round(r, 6).alias("micro_recall"), F.round(ratio(2 * p * r, p + r), 6).alias("micro_f1"))
    return micro.crossJoin(macro)


#: Multiplier, increment and modulus of the generator that resamples; fixed values.
LCG = 1664525, 1013904223, 1 << 32
#: Rounds of a task's row.
ROUNDS = 100


def generator(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and addends that take a state k = 1..n steps on, modulo 2^32."""
    a, c = np.full(n, LCG[0], np.uint32), np.zeros(n, np.uint32)
    a = np.multiply.accumulate(a, dtype=np.uint32)
    c[0] = LCG[1]
    np.cumsum(np.concatenate([[1], a[:-1]]).astype(np.uint32), dtype=np.uint32, out=c)
    return a, c * np.uint32(LCG[1])


def advanced(state: int, steps: int) -> int:
    """The state after so many steps, by repeated squaring."""
    a, c = LCG[0], LCG[1]
    while steps:
        if steps & 1:
            state = (a * state + c) % LCG[2]
        a, c = a * a % LCG[2], (a * c + c) % LCG[2]
        steps >>= 1
    return state


def bootstrap(df: DataFrame, key: str, value: str, other: str | None = None, seed: int = 42, rounds: int = 10_000) -> DataFrame:
    """Confidence interval of the mean, or of the mean of ``other`` - ``value``, by resampling with a linear congruential generator (M07): floor-index 2.5 and 97.5 per cent.

    Keys are evaluation runs, with a value a query. Rounds are rows: each knows its place in the generator's sequence, so Spark deals them to tasks."""
    v = F.col(value) if other is None else F.col(other) - F.col(value)
    runs = df.select(key, v.alias("_v")).filter("_v is not null").groupBy(key).agg(F.sort_array(F.collect_list("_v")).alias("_x"))
    work = runs.withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1), F.lit(ROUNDS)))).repartition(key, "_first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            means = []
            for x, first in zip(pdf["_x"], pdf["_first"]):
                x, n = np.asarray(x), len(x)
                a, c = generator(n)
                some = []
                for k in range(first, min(first + ROUNDS, rounds)):
                    states = a * np.uint32(advanced(seed, k * n)) + c
                    some.append(float(x[(states * (n / LCG[2])).astype(np.int64)].mean()))
                means.append(some)
            yield pd.DataFrame({key: pdf[key], "n": pdf["_x"].map(len), "means": means})

    kind = dict(df.dtypes)[key]
    every = work.mapInPandas(run, f"{key} {kind}, n long, means array<double>").groupBy(key).agg(F.first("n").alias("n"), F.sort_array(F.flatten(F.collect_list("means"))).alias("m"))
    at = lambda p: F.round(F.element_at("m", math.floor(p * rounds) + 1), 6)
    return every.select(key, "n", at(0.025).alias("low"), at(0.975).alias("high"))


def triple_scores(predicted: DataFrame, gold: DataFrame, closure) -> DataFrame:
    """Triple scores against gold (M09): exact matches, matches of what follows from gold by ``closure``, pairs of ends in the wrong direction, and the rest, which count as hallucinated.

    One row: predicted, exact, implied, reversed, hallucinated, precision, recall, f1."""
    t = ["src", "rel", "tgt"]
    p, g = predicted.select(*t).distinct(), gold.select(*t).distinct()
    flag = lambda df, name: df.select(*t).distinct().withColumn(name, F.lit(True))
    turned = g.select(F.col("tgt").alias("src"), "rel", F.col("src").alias("tgt"))
    j = p.join(flag(g, "e"), t, "left").join(flag(closure(g), "i"), t, "left").join(flag(turned, "r"), t, "left")
    e, i, r = F.col("e").isNotNull(), F.col("i").isNotNull(), F.col("r").isNotNull()
    c = j.agg(F.count(F.lit(1)).alias("predicted"), F.count_if(e).alias("exact"), F.count_if(~e & i).alias("implied"), F.count_if(~e & ~i & r).alias("reversed"), F.count_if(~e & ~i & ~r).alias("hallucinated"))
    n = c.crossJoin(g.agg(F.count(F.lit(1)).alias("n_gold")))  # one row each
    pr, re = (F.col("exact") + F.col("implied")) / F.col("predicted"), F.col("exact") / F.col("n_gold")
    return n.select("predicted", "exact", "implied", "reversed", "hallucinated", F.round(pr, 6).alias("precision"), F.round(re, 6).alias("recall"), F.round(2 * pr * re / (pr + re), 6).alias("f1"))


def span_scores(predicted: DataFrame, gold: DataFrame, key: str, width: int) -> DataFrame:
    """Spans found in each ``key`` (M10): gold, predicted, exact and partial hits, precision, recall and F1 in per cent by exact hits, and recall of gold spans that no dictionary knows, by any hit.

    ``predicted`` (key, start, end, name), ``gold`` (key, id, start, end, name, known). A gold span is hit exactly by the same offsets or the same name (case and outer blanks do not count), partially by an overlap;
    names that only contain each other are no hit. Spans have at most ``width`` characters, so two that overlap share a cell of that width. Without gold or predicted spans a share is 100 if the other side is empty too, else 0."""
    name = F.lower(F.trim("name")).alias("name")
    p, g = predicted.select(key, "start", "end", name), gold.select(key, "id", "start", "end", name, "known")
    same = g.join(p.select(key, "start", "end").distinct(), [key, "start", "end"], "left_semi").select(key, "id").unionByName(g.join(p.select(key, "name").distinct(), [key, "name"], "left_semi").select(key, "id")).distinct()
    cells = lambda df: df.withColumn("_cell", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"greatest(start, end - 1) div {width}"))))
    o = cells(p).select(key, "_cell", F.col("start").alias("_s"), F.col("end").alias("_e"))
    touched = cells(g).join(o, [key, "_cell"]).filter(F.greatest("start", "_s") < F.least("end", "_e")).select(key, "id").distinct()
    j = g.join(same.withColumn("_x", F.lit(True)), [key, "id"], "left").join(touched.withColumn("_t", F.lit(True)), [key, "id"], "left")
    hit, oov = F.col("_x").isNotNull() | F.col("_t").isNotNull(), ~F.coalesce("known", F.lit(False))
    by = j.groupBy(key).agg(F.count(F.lit(1)).alias("gold"), F.count("_x").alias("exact"), F.count_if(F.col("_x").isNull() & F.col("_t").isNotNull()).alias("partial"), F.count_if(oov).alias("oov"), F.count_if(oov & hit).alias("oov_found"))
    c = by.join(p.groupBy(key).agg(F.count(F.lit(1)).alias("predicted")), key, "full").fillna(0)
    share = lambda a, n, other: F.when(F.col(n) > 0, 100 * F.col(a) / F.col(n)).when(F.col(other) == 0, 100.0).otherwise(0.0)
    c = c.withColumns({"_p": share("exact", "predicted", "gold"), "_r": share("exact", "gold", "predicted")})
    f1 = F.when(F.col("_p") + F.col("_r") > 0, 2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r"))).otherwise(0.0)
    return c.select(key, "gold", "predicted", "exact", "partial", F.round("_p", 2).alias("precision"), F.round("_r", 2).alias("recall"), F.round(f1, 2).alias("f1"), F.round(F.when(F.col("oov") > 0, 100 * F.col("oov_found") / F.col("oov")).otherwise(100.0), 2).alias("oov_recall"))
