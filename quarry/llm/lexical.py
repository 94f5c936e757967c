"""Ranked lexical search over a length-stratified index.

All documents of one normaliser m form a stratum. A row of the index is a chunk of a stratum: its documents, its terms, and for each term its
postings by term frequency, so the impact of a frequency is worked out once for all its documents. A search sums, for each item and chunk, the
weights by the terms' best impacts; chunks with the highest such bounds are visited first, and then those whose bound reaches the score that the
k-th best document has by then. No row of the index moves: only bounds and each task's best documents do.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import columns, join_groups, shared_dir, stage

#: A chunk holds about so many terms with repeats, a task of the build so many.
CHUNK, TASK = 200_000, 4_000_000
#: Items are searched in slices of about so many terms, which the driver holds with their weights.
SLICE = 100_000
#: Chunks that each item visits first.
FIRST = 8
#: Scores are worked out for so many pairs of item and document, or postings, at once.
CELLS = 1 << 21
#: A document without an id counts in the statistics and is ranked last among equals.
NO_ID = (1 << 63) - 1
#: What belongs to no term goes, A-Z become small; bytes of other characters than ASCII are parts of terms.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
VECTORS = "doc_id long, n long, spread long, terms array<binary>, tfs array<int>"
INDEX = "m long, chunk long, doc_ids array<long>, terms array<binary>, runs array<int>, run_tf array<int>, run_docs array<int>, docs array<int>"


class Index(NamedTuple):
    """Chunks of strata, the number of documents with a term, and of all terms with repeats."""

    chunks: DataFrame
    documents: int
    length: int


def counted(text: str | None) -> Counter[bytes]:
    """The terms of a whole text and how often each occurs."""
    return Counter((text or "").encode("utf-8", "surrogatepass").translate(TABLE).split())


def term_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spread = 0
    for batch in batches:
        first, ends, terms, tfs, n = 0, [0], [], [], []
        for i, text in enumerate(batch.column("text"), 1):
            found = counted(text.as_py())
            terms.extend(found)
            tfs.extend(found.values())
            n.append(found.total())
            ends.append(len(terms))
            # A batch may be thousands of texts; of their terms only so many are held as Python objects.
            if len(terms) >= CHUNK or i == batch.num_rows:
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (pa.array(terms, pa.binary()), pa.array(tfs, pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, i - first), pa.array(n, pa.int64()), pa.array(np.arange(spread, spread + len(n))), *lists], ["doc_id", "n", "spread", "terms", "tfs"])
                spread += len(n)
                first, ends, terms, tfs, n = i, [0], [], [], []


def chunk_row(m: int, chunk: int, table: pa.Table) -> pa.RecordBatch:
    """The documents of a chunk, and their postings by term and term frequency."""
    terms, tfs = (table.column(c).combine_chunks() for c in ("terms", "tfs"))
    doc = np.repeat(np.arange(table.num_rows), pc.list_value_length(terms).to_numpy())
    coded, tf = terms.flatten().dictionary_encode(), tfs.flatten().to_numpy()
    term = coded.indices.to_numpy()
    order = np.lexsort((doc, tf, term))
    term, tf, doc = term[order], tf[order], doc[order]
    new_term = np.r_[True, term[1:] != term[:-1]]
    run = np.flatnonzero(new_term | np.r_[True, tf[1:] != tf[:-1]])
    one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, t))
    fields = {
        "m": pa.array([m], pa.int64()),
        "chunk": pa.array([chunk], pa.int64()),
        "doc_ids": one(pc.fill_null(table.column("doc_id").combine_chunks(), NO_ID), pa.int64()),
        "terms": one(coded.dictionary.take(pa.array(term[new_term])), pa.binary()),
        "runs": one(np.diff(np.r_[np.flatnonzero(new_term[run]), len(run)]), pa.int32()),
        "run_tf": one(tf[run], pa.int32()),
        "run_docs": one(np.diff(np.r_[run, len(term)]), pa.int32()),
        "docs": one(doc, pa.int32()),
    }
    return pa.RecordBatch.from_pydict(fields)


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of m and chunk come in; each run of one key is a row of the index."""
    key, held = None, []
    for batch in batches:
        m, chunk = batch.column("m").to_numpy(), batch.column("chunk").to_numpy()
        begin = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (chunk[1:] != chunk[:-1])]) if len(m) else np.zeros(0, int)
        for i, j in zip(begin, np.r_[begin[1:], len(m)], strict=True):
            if key != (m[i], chunk[i]):
                if held:
                    yield chunk_row(*key, pa.Table.from_batches(held))
                key, held = (m[i], chunk[i]), []
            held.append(batch.slice(i, j - i))
    if held:
        yield chunk_row(*key, pa.Table.from_batches(held))


def build_index(docs: DataFrame) -> Index:
    """The index of every row of ``docs`` (doc_id, text) that has a term. Texts are read once; term counts are staged, dealt by stratum, and written as chunks.

    Strata larger than CHUNK are cut into chunks by dealing their rows in turns, so equal rows and common lengths make no large group; a longer text is a chunk of its own."""
    shared_dir(docs.sparkSession)
    vectors = stage(columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(term_vectors, VECTORS).filter("n > 0"))
    documents, length = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).head()
    if not documents:
        return Index(stage(docs.sparkSession.createDataFrame([], INDEX)), 0, 0)
    rows = vectors.withColumn("m", F.expr(f"50 + (50 * n * {documents}) div {length}"))
    strata = stage(rows.groupBy("m").agg(F.count(F.lit(1)).alias("_n"), F.expr(f"(sum(n) + {CHUNK} - 1) div {CHUNK}").alias("_chunks")))
    dealt = join_groups(rows, strata, ["m"], "_n", documents, n_groups=strata.count()).select("m", F.expr("pmod(xxhash64(spread), _chunks)").alias("chunk"), "doc_id", "terms", "tfs")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-length // TASK))
    return Index(stage(dealt.repartition(tasks, "m", "chunk").sortWithinPartitions("m", "chunk").mapInArrow(chunk_rows, INDEX)), documents, length)


class Slice(NamedTuple):
    """Some items: their ids, the terms they ask for, and a (term, item) pair for each, in the order of terms."""

    items: np.ndarray
    terms: pa.Array
    term: np.ndarray
    item: np.ndarray


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def asked(row: dict, part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's terms that items ask for: the place in the chunk, the place among the asked, ordered by the latter."""
    found = pc.index_in(row["terms"], value_set=part.terms)
    here = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
    which = found.take(pa.array(here)).to_numpy()
    order = np.argsort(which)
    return here[order], which[order]


def chunk_of(batch: pa.RecordBatch, k: int) -> dict:
    row = {c: batch.column(c)[k].values for c in batch.schema.names if c not in ("m", "chunk")}
    return {c: v if c == "terms" else v.to_numpy() for c, v in row.items()} | {"m": batch.column("m")[k].as_py(), "chunk": batch.column("chunk")[k].as_py()}


def document_counts(part: Slice) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many documents of a task's chunks hold each asked term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(part.terms), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                row = chunk_of(batch, k)
                here, which = asked(row, part)
                run_end = np.cumsum(row["runs"])
                docs = np.r_[0, np.cumsum(row["run_docs"], dtype=np.int64)]
                df[which] += docs[run_end[here]] - docs[run_end[here] - row["runs"][here]]
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    return run


class Chunk:
    """A chunk as one slice of items sees it: its asked terms, where their postings lie, and each item's bound."""

    def __init__(self, row: dict, part: Slice, weight: np.ndarray):
        self.row, self.part = row, part
        here, which = asked(row, part)
        run_end = np.cumsum(row["runs"])
        docs = np.r_[0, np.cumsum(row["run_docs"], dtype=np.int64)]
        self.impact = impacts(row["run_tf"].astype(np.int64), row["m"])
        # Pairs of asked term and item, for the terms of this chunk only.
        begin, end = np.searchsorted(part.term, which), np.searchsorted(part.term, which, "right")
        pair = spans(begin, end - begin)
        at = np.repeat(here, end - begin)
        self.item, self.weight = part.item[pair], weight[part.term[pair]]
        self.first, self.last = docs[run_end[at] - row["runs"][at]], docs[run_end[at]]
        # Runs of a term ascend by frequency, so the last has the best impact.
        self.bound = np.bincount(self.item, self.weight * self.impact[run_end[at] - 1], len(part.items)).astype(np.int64)

    def scores(self, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, doc_id, score) of the documents whose score reaches ``least`` of the item, for items whose bound does."""
        d = len(self.row["doc_ids"])
        wanted = np.flatnonzero(self.bound >= least)
        if not len(wanted):
            return
        posting_impact = np.repeat(self.impact, self.row["run_docs"])
        place = np.full(len(least), -1)
        place[wanted] = np.arange(len(wanted))
        order = np.argsort(self.item, kind="stable")
        order = order[place[self.item[order]] >= 0]
        owner, size = place[self.item[order]], (self.last - self.first)[order]
        work = np.bincount(owner, np.maximum(size, 1), len(wanted)) + d
        group = np.cumsum(work) // CELLS
        for g in np.unique(group):
            lo, hi = np.searchsorted(group, g), np.searchsorted(group, g, "right")
            some = order[np.searchsorted(owner, lo) : np.searchsorted(owner, hi)]
            count = self.last[some] - self.first[some]
            posting = spans(self.first[some], count)
            cell = np.repeat(place[self.item[some]] - lo, count) * d + self.row["docs"][posting]
            # Sums stay far below 2**53, so they are exact.
            total = np.bincount(cell, np.repeat(self.weight[some], count) * posting_impact[posting], (hi - lo) * d).astype(np.int64)
            hit = np.flatnonzero(total >= np.repeat(least[wanted[lo:hi]], d))
            yield wanted[lo + hit // d], self.row["doc_ids"][hit % d], total[hit]


def spans(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges that begin there and have so many."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + count, count)


class Best:
    """The k best documents of each item so far; ``least`` is the score that a further one must reach."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least, self.held, self.n = k, least.copy(), [], 0

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        self.held.append((item, doc, score))
        self.n += len(item)
        if self.n > 2 * self.k * len(self.least) + 1024:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return (np.zeros(0, np.int64),) * 3
        item, doc, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        begin = np.searchsorted(item, item)
        rank = np.arange(len(item)) - begin
        full = rank == self.k - 1
        self.least[item[full]] = np.maximum(self.least[item[full]], score[full])
        keep = rank < self.k
        self.held, self.n = [(item[keep], doc[keep], score[keep])], int(keep.sum())
        return self.held[0]


def leading(part: Slice, weight: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each item the FIRST chunks of a task with the highest bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, where = Best(FIRST, np.ones(len(part.items), np.int64)), []
        for batch in batches:
            for k in range(batch.num_rows):
                row = chunk_of(batch, k)
                bound = Chunk(row, part, weight).bound
                item = np.flatnonzero(bound >= best.least)
                best.add(item, np.full(len(item), len(where)), bound[item])
                where.append((row["m"], row["chunk"]))
        item, at, bound = best.settle()
        m, chunk = (np.array([w[i] for w in where], np.int64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(m[at]), pa.array(chunk[at]), pa.array(bound)], ["item", "m", "chunk", "bound"])

    return run


def visits(part: Slice, weight: np.ndarray, k: int, least: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each item the k best documents of a task's chunks, none below ``least``. The chunks of a batch are visited by falling bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, least)
        for batch in batches:
            order = np.argsort([-float(Chunk(chunk_of(batch, i), part, weight).bound.max(initial=0)) for i in range(batch.num_rows)], kind="stable")
            for i in order:
                for found in Chunk(chunk_of(batch, int(i)), part, weight).scores(best.least):
                    best.add(*found)
        item, doc, score = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc), pa.array(score)], ["item", "doc_id", "score"])

    return run


def top(rows: DataFrame, k: int, order: list) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = 50) -> DataFrame:
    """The k best documents of each item of ``items`` (item_id, text): item_id, rank int from 1, doc_id, score; equal scores by doc_id, null last.

    Rows of one item_id ask together, each term once. Items without a term that a document holds have no rows; rows of one doc_id are documents of their own.
    An item costs one entry for each of its terms on the driver, slice after slice of SLICE terms at most (a longer item is a slice of its own)."""
    spark = items.sparkSession
    pairs = columns(items, "item_id", "text").select(F.col("item_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(term_vectors, VECTORS)
    pairs = stage(pairs.select(F.col("doc_id").alias("item_id"), F.explode("terms").alias("term")).distinct())
    slices = -(-pairs.count() // SLICE)
    out = [spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")]
    rows = index.chunks
    for s in range(slices if index.documents else 0):
        got = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == s).toArrow()
        if not got.num_rows:
            continue
        ids = got.column("item_id").combine_chunks().dictionary_encode()
        named = got.column("term").combine_chunks().dictionary_encode()
        order = np.argsort(named.indices.to_numpy(), kind="stable")
        part = Slice(np.arange(len(ids.dictionary)), named.dictionary, named.indices.to_numpy()[order], ids.indices.to_numpy()[order])
        weight = np.zeros(len(part.terms), np.int64)
        for term, df in rows.select("m", "chunk", "terms", "runs", "run_docs").mapInArrow(document_counts(part), "term long, df long").groupBy("term").agg(F.sum("df")).collect():
            weight[term] = math.floor(1000 * math.log((2 * index.documents + 2) / (2 * df + 1)))
        # First the chunks with the highest bounds, which give each item a score to reach.
        bounds = rows.select("m", "chunk", "terms", "runs", "run_tf", "run_docs").mapInArrow(leading(part, weight), "item long, m long, chunk long, bound long")
        first = stage(top(bounds, FIRST, [F.desc("bound"), "m", "chunk"]).select("m", "chunk").distinct())
        least = np.ones(len(part.items), np.int64)
        scored = "item long, doc_id long, score long"
        seen = rows.join(F.broadcast(first), ["m", "chunk"], "left_semi").select(*rows.columns).mapInArrow(visits(part, weight, k, least), scored)
        for r in top(seen, k, [F.desc("score"), "doc_id"]).filter(F.col("rank") == k).collect():
            least[r["item"]] = r["score"]
        best = top(rows.mapInArrow(visits(part, weight, k, least), scored), k, [F.desc("score"), "doc_id"])
        names = spark.createDataFrame(pa.table({"item": part.items, "item_id": ids.dictionary}))
        doc = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
        out.append(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int"), doc.alias("doc_id"), "score"))
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole
