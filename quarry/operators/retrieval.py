"""Ranked branches, fusion, re-ranking and context selection for many queries at once.

Every branch is a DataFrame (query, chunk_id, score, rank); what follows joins and groups those.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.graph import staged
from quarry.operators.relational import top_per

#: Fixed values of the fusion: constant of reciprocal ranks, over-fetch, boosts of the first tier and of child chunks.
RRF_K, OVERFETCH, TIER_BOOST, CHILD_BOOST = 60, 3, 1.35, 1.15
#: Distance in years up to which a factor holds, and the factor beyond.
HYBRID_YEARS, HYBRID_BEYOND = [(0, 1.25), (2, 1.10), (5, 1.0), (15, 0.75), (30, 0.40)], 0.15
RERANK_YEARS, RERANK_BEYOND = [(2, 1.10), (30, 1.00), (100, 0.85), (500, 0.70), (1000, 0.05)], 0.001
#: Vector and lexical weight by intent, and without one for exact years, concepts and the rest.
INTENT_WEIGHTS = {"FACTOID_LOOKUP": (0.20, 0.80), "GENEALOGY_RELATION": (0.40, 0.60), "BATTLE_TACTICS": (0.60, 0.40), "COMPARATIVE_SYNTHESIS": (0.50, 0.50)}
YEAR_WEIGHTS, CONCEPT_WEIGHTS, EVEN_WEIGHTS = (0.30, 0.70), (0.60, 0.40), (0.50, 0.50)
CONCEPTS = r"(?iu)(?:ý\s+nghĩa|ảnh\s+hưởng|nguyên\s+nhân|bối\s+cảnh|tổng\s+quan|đánh\s+giá|vai\s+trò)"
#: Least score, share of the top score, weights of tiers and of co-retrieval.
LEAST_SCORE, TOP_SHARE, TIER_WEIGHTS, CO_RETRIEVED = 0.15, 0.25, {"LEVEL_1": 1.0, "LEVEL_2": 0.5}, 0.05
CHARS_PER_TOKEN = 3.5
#: Vectors in a block of the exact search; blocks of queries are broadcast in slices of so many bytes.
VECTORS, QUERIES, SLICE_BYTES = 4096, 1024, 32 << 20
#: Queries whose similarities with a block of vectors are held at once.
AT_ONCE = 128


def cosine(a: str, b: str) -> Column:
    """Cosine similarity of two array columns (X02): 0 on different lengths or a zero vector, the plain dot product if both have norm 1 within 1e-4."""
    dot = F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, v) -> s + v)")
    norm = lambda c: F.sqrt(F.expr(f"aggregate({c}, 0D, (s, v) -> s + cast(v as double) * cast(v as double))"))
    unit = (F.abs(norm(a) - 1) < 1e-4) & (F.abs(norm(b) - 1) < 1e-4)
    return F.when(F.size(a) != F.size(b), 0.0).when((norm(a) == 0) | (norm(b) == 0), 0.0).when(unit, dot).otherwise(dot / (norm(a) * norm(b)))


def similarities(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All cosines of the rows of ``a`` and ``b`` under the rule of ``cosine``."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    dot, both = a @ b.T, np.outer(na, nb)
    unit = (np.abs(na - 1) < 1e-4)[:, None] & (np.abs(nb - 1) < 1e-4)[None, :]
    return np.where(both == 0, 0.0, np.where(unit, dot, dot / np.where(both == 0, 1.0, both)))


def best(q_ids: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, similarity) of the k largest of each row of ``s``, equal ones by id and what is no number last; only what reaches a row's k-th largest is sorted."""
    # Of the negative numbers, as what is no number comes last in a partition.
    least = -np.partition(-s, k - 1, axis=1)[:, k - 1] if k < s.shape[1] else np.full(len(s), np.nan)
    q, at = np.nonzero((s >= least[:, None]) | np.isnan(least)[:, None])
    value = s[q, at]
    order = np.lexsort((ids[at], -value, q))
    q, at, value = q[order], at[order], value[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q_ids[q[first]], ids[at[first]], value[first]


def packed(vectors: DataFrame, per_block: int) -> DataFrame:
    """(ids, data, dim): vectors in blocks of one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, per_block):
                part = batch.slice(k, per_block)
                m = np.array(part.column(1).to_pylist(), np.float64)
                if m.ndim != 2:
                    raise ValueError("vectors of different lengths")
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary()), pa.array([m.shape[1]], pa.int32())], ["ids", "data", "dim"])

    return vectors.filter(F.col(vectors.columns[1]).isNotNull()).mapInArrow(run, "ids array<long>, data binary, dim int")


def ranges(sizes: list[tuple[int, int]], most: int) -> Iterator[tuple[int, int]]:
    """(first, last) of the ascending numbers of (number, size), in runs of ``most`` together; a larger one is a run of its own."""
    first, last, total = None, None, 0
    for number, size in sizes:
        if first is not None and total + size > most:
            yield first, last
            first, total = None, 0
        first, last, total = number if first is None else first, number, total + size
    if first is not None:
        yield first, last


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact dense search (X01, T01): ``queries`` and ``vectors`` are (id, array) and the result (query, chunk_id, similarity, score, rank).

    Blocks of queries meet blocks of vectors, each pair is one matrix product that keeps the k best of every query; a ranked window over
    those keeps the k best of all. The staged queries are broadcast, in slices of SLICE_BYTES at most by their counted size (a block is one row, of QUERIES vectors);
    the vectors stay where they are. score = 1 / (1 + cosine distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q, dim, v_ids, v in zip(*batch.columns):
                # Neither the batch's vectors nor similarities of many queries are held a second time.
                q, v = (np.frombuffer(x.as_buffer()).reshape(-1, dim.as_py()) for x in (q, v))
                q_ids, v_ids = (x.values.to_numpy() for x in (q_ids, v_ids))
                for i in range(0, len(q), AT_ONCE):
                    s = np.round(similarities(q[i : i + AT_ONCE], v), 9)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in best(q_ids[i : i + AT_ONCE], v_ids, s, k)], ["query", "chunk_id", "similarity"])

    q = staged(packed(queries, QUERIES).select(F.col("ids").alias("q_ids"), F.col("data").alias("q"), "dim", F.monotonically_increasing_id().alias("block")))
    # Of a block only its number and size come to the driver; a slice is a range of numbers.
    sizes, found = q.select("block", F.length("q").alias("n")).orderBy("block").collect(), None
    v = packed(vectors, VECTORS).select(F.col("ids").alias("v_ids"), F.col("data").alias("v"))
    for first, last in ranges([(r["block"], r["n"]) for r in sizes], SLICE_BYTES):
        part = v.crossJoin(F.broadcast(q.filter(F.col("block").between(first, last)))).select("q_ids", "q", "dim", "v_ids", "v").mapInArrow(run, "query long, chunk_id long, similarity double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = queries.sparkSession.createDataFrame([], "query long, chunk_id long, similarity double")
    return top_per(found, ["query"], [F.desc("similarity"), F.col("chunk_id")], k).withColumn("score", 1 / (2 - F.col("similarity")))


#: Points of a term in a title; fixed value.
TITLE_POINTS = 2


def lexical_scores(query_terms: DataFrame, postings: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Term hits (X09): (query, term) against the inverted indexes (token, chunk_id) of contents and titles: one point a term that the content has, TITLE_POINTS more if the title has it.

    Hits are added up before they are shuffled by query and chunk."""
    index = postings.select(F.col("token").alias("term"), "chunk_id", F.lit(1).alias("points"))
    if titles is not None:
        index = index.unionByName(titles.select(F.col("token").alias("term"), "chunk_id", F.lit(TITLE_POINTS).alias("points")))
    return query_terms.distinct().join(index, "term").groupBy("query", "chunk_id").agg(F.sum("points").cast("double").alias("score"))


#: The ten stems and twelve branches of a sexagenary year.
STEMS = ["giáp", "ất", "bính", "đinh", "mậu", "kỷ", "canh", "tân", "nhâm", "quý"]
BRANCHES = ["tý", "sửu", "dần", "mão", "thìn", "tỵ", "ngọ", "mùi", "thân", "dậu", "tuất", "hợi"]
SEXAGENARY = rf"(^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(STEMS)})\s+(?:{'|'.join(BRANCHES)})([^\p{{L}}\p{{N}}_]|$)"


def weights(text: Column, intent: Column | None = None) -> Column:
    """Adaptive weights (X10) as a struct (dense, lexical): by intent, else 3-4 digit or sexagenary years, else concepts in a query without capitals."""
    pair = lambda w: F.struct(F.lit(w[0]).alias("dense"), F.lit(w[1]).alias("lexical"))
    year = text.rlike(r"(^|[^0-9A-Za-z_])\d{3,4}([^0-9A-Za-z_]|$)") | F.lower(text).rlike(SEXAGENARY)
    concept = text.rlike(CONCEPTS) & ~text.rlike(r"(^|[^0-9A-Za-z_])[A-ZÀ-Ỹ]")
    out = F.when(year, pair(YEAR_WEIGHTS)).when(concept, pair(CONCEPT_WEIGHTS)).otherwise(pair(EVEN_WEIGHTS))
    if intent is not None:
        for name, w in reversed(INTENT_WEIGHTS.items()):
            out = F.when(intent == name, pair(w)).otherwise(out)
    return out


def banded(distance: Column, bands: list[tuple[int, float]], beyond: float) -> Column:
    out = F.lit(beyond)
    for most, factor in reversed(bands):
        out = F.when(distance <= most, factor).otherwise(out)
    return out


def year_distance(year: Column, start: Column, end: Column) -> Column:
    """Years between a point and a closed interval; one known bound stands for both, null if none is known."""
    lo, hi = F.least(F.coalesce(start, end), F.coalesce(end, start)), F.greatest(F.coalesce(start, end), F.coalesce(end, start))
    return F.greatest(lo - year, year - hi, F.lit(0))


def fuse(branches: list[tuple[DataFrame, float | Column]], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion (A09, X15, X16): the sum of weight / (k + rank) over the branches."""
    parts = [b.select("query", "chunk_id", ((w if isinstance(w, Column) else F.lit(w)) / (k + F.col("rank"))).alias("part")) for b, w in branches]
    return reduce(DataFrame.unionByName, parts).groupBy("query", "chunk_id").agg(F.sum("part").alias("score"))


def hybrid(dense: DataFrame, lexical: DataFrame, chunk_rows: DataFrame, query_rows: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Hybrid search (X11): ranked branches (of 3k each) fused with the query's weights, boosted by tier and for children, then by distance in time.

    ``chunk_rows``: chunk_id, tier, parent_id, time_start, time_end; ``query_rows``: query, w (struct of weights), year (null: no adjustment). Result: query, chunk_id, score, rank."""
    w = query_rows.select("query", "w", "year")
    parts = [(b.join(w, "query"), F.col(f"w.{name}")) for b, name in ((dense, "dense"), (lexical, "lexical"))]
    scored = fuse(parts, rrf_k).join(chunk_rows.select("chunk_id", "tier", "parent_id", "time_start", "time_end"), "chunk_id").join(w, "query")
    boost = F.when(F.col("tier") == "LEVEL_1", TIER_BOOST).otherwise(1.0) * F.when(F.col("parent_id").isNotNull(), CHILD_BOOST).otherwise(1.0)
    gap = year_distance(F.col("year"), F.col("time_start"), F.col("time_end"))
    near = F.when(F.col("year").isNull() | F.coalesce("time_start", "time_end").isNull(), 1.0).otherwise(banded(gap, HYBRID_YEARS, HYBRID_BEYOND))
    scored = scored.select("query", "chunk_id", F.round(F.col("score") * boost * near, 9).alias("score"))
    return top_per(scored, ["query"], [F.desc("score"), F.col("chunk_id")], k)


def co_retrieved(candidates: DataFrame, graph: DataFrame, most: int = 10) -> DataFrame:
    """Graph boost (X17): candidates (query, chunk_id, score) that the graph branch (query, chunk_id, graph_score, hop, rank) found too gain
    0.05 x graph score and a flag; of the others its first ``most`` enter with 0.010 x graph score / hop."""
    both = candidates.alias("c").join(graph.alias("g"), ["query", "chunk_id"], "full")
    known = F.col("c.score").isNotNull()
    enter = 0.010 * F.coalesce("graph_score", F.lit(0.8)) / F.greatest(F.lit(1), F.coalesce("hop", F.lit(1)))
    gain = F.when(F.col("g.rank").isNotNull(), CO_RETRIEVED * F.coalesce("graph_score", F.lit(0.5))).otherwise(0.0)
    out = both.filter(known | (F.col("g.rank") <= most))
    return out.select("query", "chunk_id", F.round(F.when(known, F.col("c.score") + gain).otherwise(enter), 9).alias("score"), (known & F.col("g.rank").isNotNull()).alias("co_retrieved"))


def rerank_fallback(rank: str = "rank") -> Column:
    """The score of a candidate by its place where no re-ranking model is at hand."""
    return F.greatest(F.lit(0.40), 0.85 - 0.03 * (F.col(rank) - 1))


def temporal_multiplier(years: str, start: Column, end: Column) -> Column:
    """Factor by the least distance of the query's years to a chunk's bounds or middle, 0 within them (X20); 1 without years or bounds."""
    lo, hi = F.least(F.coalesce(start, end), F.coalesce(end, start)), F.greatest(F.coalesce(start, end), F.coalesce(end, start))
    gap = F.array_min(F.transform(years, lambda y: F.when(y.between(lo, hi), 0.0).otherwise(F.least(F.abs(y - lo), F.abs(y - hi), F.abs(y - (lo + hi) / 2)).cast("double"))))
    return F.when(F.size(F.coalesce(F.col(years), F.array())) == 0, 1.0).when(lo.isNull(), 1.0).otherwise(banded(gap, RERANK_YEARS, RERANK_BEYOND))


def bayesian(raw: Column, tier: Column, temporal: Column, co: Column) -> Column:
    """Final score (X19): clamped raw score x (1 + 0.2 x tier weight, from 0.15 up) x temporal factor + 0.05 if co-retrieved."""
    weight = F.when(tier == "LEVEL_1", 1.0).when(tier == "LEVEL_2", 0.5).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)) * F.when(raw >= LEAST_SCORE, 1 + 0.2 * weight).otherwise(1.0) * temporal + F.when(co, CO_RETRIEVED).otherwise(0.0)


def pool_size(intent: Column, top_k: int = 5, most: int = 20) -> Column:
    """How many candidates are re-ranked."""
    base = F.when(intent == "FACTOID_LOOKUP", 16).when(intent == "GENEALOGY_RELATION", 18).when(intent == "COMPARATIVE_SYNTHESIS", min(24, most)).otherwise(20)
    return F.greatest(F.lit(3 * top_k), F.least(F.lit(most), base))


def token_estimate(*texts: Column) -> Column:
    return F.ceil(reduce(Column.__add__, [F.coalesce(F.length(t), F.lit(0)) for t in texts]) / CHARS_PER_TOKEN)


SELECTED = "query long, chunk_id long, place int, spent long"


def select_context(candidates: DataFrame, top_k: int = 5, budget: int = 2500) -> DataFrame:
    """Context selection (X22): per query in rank order, drop what scores under 0.15 or, after the first, under a quarter of the top; at most max(4, ceil(top_k / 2)) a source
    (top_k if there are two sources or fewer; no cap for three candidates or fewer); stop at the budget or at ``top_k``. The first kept row always stays.

    ``candidates``: query, chunk_id, rank, score, source, tokens, of bounded number a query. A skipped row spends nothing and an overflow stops, so each row depends on the ones before: one pass per query.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        few, top = pdf["source"].nunique() <= 2, pdf["score"].iloc[0]
        most = top_k if few else max(4, -(-top_k // 2))
        seen: dict[str, int] = {}
        out, spent = [], 0
        for i, r in enumerate(pdf.itertuples()):
            if r.score < LEAST_SCORE or (i and r.score < max(LEAST_SCORE, TOP_SHARE * top)):
                continue
            if seen.get(r.source, 0) >= most and len(pdf) > 3:
                continue
            if out and spent + r.tokens > budget or len(out) >= top_k:
                break
            seen[r.source] = seen.get(r.source, 0) + 1
            spent += int(r.tokens)
            out.append((r.query, r.chunk_id, len(out) + 1, spent))
        return pd.DataFrame(out, columns=["query", "chunk_id", "place", "spent"])

    return candidates.groupBy("query").applyInPandas(run, SELECTED)


def stitch(children: DataFrame, least: int = 10, most: int = 60) -> DataFrame:
    """Sibling stitching (X23): runs of adjacent children (parent_id, idx, content) become one text; where a child starts with the last ``least`` to ``most`` words of the one before, they are written once."""

    def overlap(a: list[str], b: list[str]) -> int:
        return next((n for n in range(min(most, len(a), len(b)), least - 1, -1) if a[-n:] == b[:n]), 0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for r in pdf.sort_values("idx").itertuples():
            words = (r.content or "").split()
            if out and r.idx == out[-1][2] + 1:
                n = overlap(out[-1][3], words)
                out[-1][2], out[-1][3], out[-1][4] = r.idx, out[-1][3] + words[n:], out[-1][4] + n
            else:
                out.append([r.parent_id, r.idx, r.idx, words, 0])
        return pd.DataFrame([(p, a, b, " ".join(w), n) for p, a, b, w, n in out], columns=["parent_id", "first", "last", "content", "words_saved"])

    return children.groupBy("parent_id").applyInPandas(run, "parent_id long, first long, last long, content string, words_saved long")


def prune_triples(triples: DataFrame, bridges: DataFrame, keys: list[str], k: int = 15) -> DataFrame:
    """Triple pruning (X25): those that touch a bridge node first, then identities, then the rest; by confidence; ``k`` a key."""
    b = bridges.select(F.col("node").alias("_n"), *keys).distinct()
    touch = triples.join(b.withColumnRenamed("_n", "src").withColumn("_s", F.lit(True)), [*keys, "src"], "left").join(b.withColumnRenamed("_n", "tgt").withColumn("_t", F.lit(True)), [*keys, "tgt"], "left")
    priority = F.when(F.coalesce("_s", "_t").isNotNull(), 100).when(F.col("rel").isin("ALIAS_OF", "SAME_AS_LOCATION"), 50).otherwise(10)
    return top_per(touch.withColumn("priority", priority).drop("_s", "_t"), keys, [F.desc("priority"), F.desc("confidence"), F.col("src"), F.col("rel"), F.col("tgt")], k)
