"""A positional inverted index and what is searched in it: points for terms, and cover density for terms and phrases.

A row of the index is a block of chunks with its tokens, for each token the chunks that hold it, and for each of those the positions, titles first.
It is staged once and read by every search. Queries come in slices that the driver holds; each task scores a block for all queries of the slice at
once and keeps the best, so that only those are shuffled, however many chunks share a word with a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import unaccent
from quarry.operators.graph import few_rows, staged
from quarry.operators.relational import keep_first, top_per

#: Chunks and tokens of a block; (query, clause) rows of a slice, and query-chunk cells or hits that are held at once.
BLOCK, BLOCK_TOKENS, SLICE, CELLS = 4096, 1 << 20, 1 << 19, 1 << 18
#: Chunks that a task of the index is handed at once.
CHUNKS_AT_ONCE = 256
#: Blocks that a task reads at a time: a row is some megabytes, and a reader's usual batch would be all rows of a file.
BLOCKS_AT_ONCE = 2
#: A hit costs about as much as so many cells of a matrix product.
CELLS_A_HIT = 512
#: Matrices of a block's frequent words are held for all queries if they have so many times CELLS numbers at most.
HELD = 8
#: If more than so many times the k best of a block reach what is asked, they are cut to the k best before they are held.
MANY = 4
#: Points of a term in the content and in the title; fixed values.
CONTENT_POINTS, TITLE_POINTS = 1, 2
#: Weight of a position without a label of its own; fixed value of cover density.
POSITION_WEIGHT = 0.1
#: Names that one entity adds to a query at most; fixed value.
MOST_NAMES = 4
#: Bytes of a row group of the index, and rows after which its size is looked at: a reader's batch ends with the row group, so it is a few rows whatever the session's settings are when it is read.
GROUP_BYTES, GROUP_ROWS = 2 << 20, 2
#: Tasks a core of a search for the best.
TASKS_A_CORE = 4
#: Pairs that a task hands over at once.
PAIRS_AT_ONCE = 1 << 16
#: Lower-cased runs of letters and digits.
WORD = r"[\p{L}\p{N}]+"
BLOCKS = "chunk_ids array<long>, boosts array<double>, title_words array<int>, tokens array<string>, plain array<string>, ends array<int>, docs array<short>, points array<byte>, pos_ends array<int>, pos array<int>"


POSITIONS = ["title_words", "pos_ends", "pos"]


def words(c: Column, least: int = 1) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= least)


def block_row(batch: pa.RecordBatch) -> pa.RecordBatch:
    listed, titles = batch.column("words"), batch.column("title_words").to_numpy()
    size = pc.list_value_length(listed).to_numpy()
    doc = np.repeat(np.arange(batch.num_rows, dtype=np.int32), size)
    place = np.arange(len(doc), dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size)
    coded = listed.flatten().dictionary_encode()
    token = coded.indices.to_numpy()
    # Words come in order of chunk and place, which a stable sort by token keeps.
    order = np.argsort(token.astype(np.uint16) if len(coded.dictionary) < 1 << 16 else token, kind="stable")
    token, doc, place = token[order], doc[order], place[order]
    in_title = place < titles[doc]
    run = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])]) if len(token) else np.zeros(0, int)
    points = CONTENT_POINTS * np.logical_or.reduceat(~in_title, run) + TITLE_POINTS * np.logical_or.reduceat(in_title, run) if len(run) else run
    distinct, count = np.unique(token[run], return_counts=True)
    known = coded.dictionary.take(pa.array(distinct))
    one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, t))
    fields = {
        "chunk_ids": one(batch.column("chunk_id"), pa.int64()), "boosts": one(batch.column("boost"), pa.float64()), "title_words": one(titles, pa.int32()), "tokens": one(known, pa.string()), "plain": one(PLAIN(known.to_pylist()), pa.string()),
        "ends": one(np.cumsum(count), pa.int32()), "docs": one(doc[run], pa.int16()), "points": one(points, pa.int8()), "pos_ends": one(np.r_[run[1:], len(token)] if len(run) else run, pa.int32()), "pos": one(place, pa.int32()),
    }
    return pa.RecordBatch.from_pydict(fields)


def PLAIN(tokens: list[str]) -> list[str]:
    """The tokens without their marks, as ``unaccent`` has it."""
    from quarry.functions.text import _FROM, _TO

    table = str.maketrans(_FROM, _TO)
    return [t.translate(table) for t in tokens]


def block_rows(batches: Iterator[pa.RecordBatch], chunks: int, most_words: int) -> Iterator[pa.RecordBatch]:
    """Blocks of up to so many chunks and words, or one chunk, from however small batches."""
    held, rows, words = [], 0, 0
    for batch in batches:
        tokens = np.cumsum(pc.list_value_length(batch.column("words")).to_numpy())
        i = 0
        while i < batch.num_rows:
            before = tokens[i - 1] if i else 0
            j = min(batch.num_rows, i + chunks - rows, int(np.searchsorted(tokens, before + most_words - words, "right")))
            j = max(j, i if held else i + 1)
            if j > i:
                held.append(batch.slice(i, j - i))
                rows, words, i = rows + j - i, words + tokens[j - 1] - before, j
            if i < batch.num_rows:
                yield block_row(pa.concat_batches(held))
                held, rows, words = [], 0, 0
    if held:
        yield block_row(pa.concat_batches(held))


def build_index(chunk_rows: DataFrame, least: int = 3, boost: Column | None = None, positions: bool = True) -> DataFrame:
    """The index of (chunk_id, title, content): tokens of ``least`` letters or more, titles first; null texts have none. ``boost`` is a factor that scores are multiplied by.
    Without ``positions``, which are most of it, it serves points only. A task's blocks are of chunks of like length, the longest first, so that short ones can be left out as a whole once enough points are reached."""
    title = words(F.col("title"), least)
    rows = chunk_rows.sortWithinPartitions(F.desc(F.octet_length("content"))).select("chunk_id", F.concat(title, words(F.col("content"), least)).alias("words"), F.size(title).alias("title_words"), (F.lit(1.0) if boost is None else boost.cast("double")).alias("boost"))
    most, most_words = BLOCK, BLOCK_TOKENS
    blocks = rows.filter(F.size("words") > 0).mapInArrow(lambda batches: block_rows(batches, most, most_words), BLOCKS)
    with few_rows(chunk_rows.sparkSession, CHUNKS_AT_ONCE):
        return staged(blocks if positions else blocks.drop(*POSITIONS), **{"parquet.block.size": str(GROUP_BYTES), "parquet.block.size.row.check.min": str(GROUP_ROWS), "parquet.page.size.row.check.min": str(GROUP_ROWS)})


class Slice(NamedTuple):
    """Some queries with all their clauses; a clause is one word or several in a row, of one of the query's groups."""

    queries: np.ndarray
    words: pa.Array
    #: For each (word, query) pair, in the order of queries: the word and the query.
    word: np.ndarray
    query: np.ndarray
    #: For each query: for each group its clauses as places in ``words``; none where only words count.
    groups: list[list[list[list[int]]]]


def slices(clauses: DataFrame, grouped: bool = True) -> Iterator[Slice]:
    """The (query, clause, group) rows in slices of about SLICE rows, whole queries each. A clause is its words with single spaces; only words count if not ``grouped``."""
    if not grouped:
        clauses = clauses.select("query", F.explode(F.split("clause", " ")).alias("clause"))
    held = staged(clauses.distinct())
    n = -(-held.count() // SLICE)
    for k in range(n):
        part = held.filter(F.pmod(F.xxhash64("query"), F.lit(n)) == k)
        if not grouped:
            got = part.toArrow()
            if got.num_rows:
                ids, known = (got.column(c).combine_chunks().dictionary_encode() for c in ("query", "clause"))
                query, word = ids.indices.to_numpy().astype(np.int64), known.indices.to_numpy().astype(np.int64)
                order = np.argsort(query, kind="stable")
                yield Slice(ids.dictionary.to_numpy(), known.dictionary, word[order], query[order], [])
            continue
        rows = part.orderBy("query", "group", "clause").collect()
        if not rows:
            continue
        ids: dict = {}
        known: dict[str, int] = {}
        groups: list[dict] = []
        pairs = set()
        for r in rows:
            q = ids.setdefault(r["query"], len(ids))
            if q == len(groups):
                groups.append({})
            clause = [known.setdefault(w, len(known)) for w in r["clause"].split(" ")]
            groups[q].setdefault(r["group"], []).append(clause)
            pairs |= {(q, w) for w in clause}
        query, word = (np.array(x, np.int64) for x in zip(*sorted(pairs), strict=True))
        yield Slice(np.array(list(ids)), pa.array(list(known), pa.string()), word, query, [list(g.values()) for g in groups])


def arrays(batch: pa.RecordBatch, k: int) -> dict:
    row = {c: batch.column(c)[k].values for c in batch.schema.names}
    return {c: v if c in ("tokens", "plain") else v.to_numpy(zero_copy_only=False) for c, v in row.items()}


def spans(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges that begin there and have so many."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + count, count)


def runs_of(row: dict, part: Slice, plain: bool) -> tuple[np.ndarray, np.ndarray]:
    """(word, run) for each run of the block whose token is a word of the slice, by word."""
    found = pc.fill_null(pc.index_in(row["plain" if plain else "tokens"], value_set=part.words), -1).to_numpy().astype(np.int64)
    here = np.flatnonzero(found >= 0)
    which = found[here]
    begin = np.r_[0, row["ends"]][here]
    count = row["ends"][here] - begin
    order = np.argsort(which, kind="stable")
    return np.repeat(which[order], count[order]), spans(begin[order], count[order])


def block_points(row: dict, part: Slice, plain: bool, least: np.ndarray, k: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, chunk, points) of all pairs that share a word and reach ``least`` of the query; with ``k`` without some that are not among the query's k best of the block.

    Words that many queries share with many chunks are a product of two matrices, the others are added hit by hit; neither holds more than about CELLS numbers at once, however often words occur.
    Sums of points stay far below 2**24, so they are exact. Queries whose words have too few points in the block, and chunks with too few points of the slice's words, are left out first."""
    word, run = runs_of(row, part, plain)
    if not len(word):
        return
    docs, points = row["docs"][run].astype(np.int64), row["points"][run].astype(np.int64)
    if plain:
        # Several tokens of one plain form in a chunk are one hit.
        key = word * len(row["chunk_ids"]) + docs
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(key[order]) > 0])
        points, word, docs = np.bitwise_or.reduceat(points[order], first), word[order][first], docs[order][first]
    # Points are whole, so a pair reaches what it must have if it reaches the next whole number, 1 at least.
    need = np.maximum(np.ceil(least), 1).astype(np.float32)
    most = np.zeros(len(part.words), np.int64)
    np.maximum.at(most, word, points)
    has = np.bincount(docs, points, len(row["chunk_ids"]))
    asks = np.flatnonzero((np.bincount(part.query, most[part.word], len(part.queries)) >= need) & (need <= has.max()))
    if not len(asks):
        return
    kept = np.flatnonzero(has >= need[asks].min())
    d, need = len(kept), need[asks]
    at_query, at_word = part.query, part.word
    if len(asks) < len(part.queries):
        place = np.full(len(part.queries), -1)
        place[asks] = np.arange(len(asks))
        at_query = place[part.query]
        at_query, at_word = at_query[at_query >= 0], part.word[at_query >= 0]
    if d < len(row["chunk_ids"]):
        place = np.full(len(row["chunk_ids"]), -1)
        place[kept] = np.arange(d)
        docs = place[docs]
        word, docs, points = word[docs >= 0], docs[docs >= 0], points[docs >= 0]
    found = np.bincount(word, minlength=len(part.words))
    start = np.cumsum(found) - found
    common = np.flatnonzero(found * np.bincount(at_word, minlength=len(part.words)) * CELLS_A_HIT >= len(asks) * d)
    common = common[found[common] > 0]
    place = np.full(len(part.words), -1)
    place[common] = np.arange(len(common))
    hits, column = found[at_word], place[at_word]
    rare, dense = np.flatnonzero((column < 0) & (hits > 0)), np.flatnonzero(column >= 0)
    rare_query, rare_start, count = at_query[rare], start[at_word[rare]], hits[rare]
    dense_query, column = at_query[dense], column[dense]
    # What the rare words can add to a query at most, and to a chunk.
    query_most, chunk_most = np.bincount(rare_query, most[at_word[rare]], len(asks)).astype(np.float32), np.bincount(docs, points * (place[word] < 0), d).astype(np.float32)
    points = points.astype(np.float64)
    step = max(1, CELLS // d)

    def panel(i: int) -> np.ndarray:
        words = common[i : i + step]
        at, b = spans(start[words], found[words]), np.zeros((len(words), d), np.float32)
        b[np.repeat(np.arange(len(words)), found[words]), docs[at]] = points[at]
        return b

    firsts = range(0, len(common), step)
    held = [panel(i) for i in firsts] if len(common) * d <= HELD * CELLS else None
    work = np.bincount(rare_query, count, len(asks)) + d
    group = (np.cumsum(work) // CELLS).astype(np.int64)
    for g in np.unique(group):
        lo, hi = np.searchsorted(group, g), np.searchsorted(group, g, "right")
        n, total, bound = hi - lo, np.zeros((hi - lo, d), np.float32), need[lo:hi]
        i, j = np.searchsorted(dense_query, lo), np.searchsorted(dense_query, hi)
        some_query, some_column = dense_query[i:j] - lo, column[i:j]
        for p, i in enumerate(firsts if len(some_query) else ()):
            b = held[p] if held else panel(i)
            here = (some_column >= i) & (some_column < i + step)
            for u in range(0, n, step_a := max(1, CELLS // len(b))):
                v = here & (some_query >= u) & (some_query < u + step_a)
                a = np.zeros((min(n, u + step_a) - u, len(b)), np.float32)
                a[some_query[v] - u, some_column[v] - i] = 1
                total[u : u + step_a] += a @ b
        i, j = np.searchsorted(rare_query, lo), np.searchsorted(rare_query, hi)
        some_query, some_start, some_count = rare_query[i:j] - lo, rare_start[i:j], count[i:j]
        if bound.max() > 1:
            # Queries that no chunk of the block can satisfy any more need no more hits.
            live = (total + np.minimum(query_most[lo:hi, None], chunk_most) >= bound[:, None]).any(1)
            good = np.flatnonzero(live[some_query])
            some_query, some_start, some_count = some_query[good], some_start[good], some_count[good]
        # The hits of one query may be more than CELLS too.
        run_of = np.cumsum(some_count) // CELLS
        for r in np.unique(run_of):
            i, j = np.searchsorted(run_of, r), np.searchsorted(run_of, r, "right")
            at = spans(some_start[i:j], some_count[i:j])
            cell = np.repeat(some_query[i:j] * d, some_count[i:j])
            cell += docs[at]
            total += np.bincount(cell, points[at], n * d).reshape(n, d)
        good = np.flatnonzero(total >= bound[:, None])
        if k is not None and k < d and len(good) > MANY * k * n:
            bound = np.maximum(bound, np.partition(total, d - k, axis=1)[:, d - k])
            good = np.flatnonzero(total >= bound[:, None])
        query, chunk = np.divmod(good, d)
        yield asks[lo + query], kept[chunk], total.ravel()[good]


def boosted_points(row: dict, part: Slice, plain: bool, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``block_points`` times the chunk's boost."""
    for query, chunk, points in block_points(row, part, plain, np.full(len(part.queries), -np.inf)):
        score = points * row["boosts"][chunk]
        good = score >= least[query]
        yield query[good], chunk[good], score[good]


def minimal(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct intervals that hold no other one, in ascending order of both ends."""
    if not len(begin):
        return begin, end
    # Both ends as one number: the latest begin first, of those the shortest.
    shift = int((end - begin).max()).bit_length()
    most = (1 << shift) - 1
    key = np.sort(begin << shift | most - (end - begin))[::-1]
    begin, end = key >> shift, (key >> shift) + most - (key & most)
    keep = end < np.r_[np.iinfo(np.int64).max, np.minimum.accumulate(end)[:-1]]
    return begin[keep][::-1], end[keep][::-1]


def covers(groups: list[tuple[np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The minimal intervals with an occurrence of every group, from each group's minimal occurrences; ends are chunk * width + position.

    For each place where an occurrence ends, each group's last occurrence up to there is found by binary search, and the cover begins where the first of them does."""
    if len(groups) == 1:
        return groups[0]
    ends = np.unique(np.concatenate([e for _, e in groups]))
    begin = np.full(len(ends), np.iinfo(np.int64).max)
    for b, e in groups:
        at = np.searchsorted(e, ends, "right") - 1
        begin = np.minimum(begin, np.where(at >= 0, b[np.maximum(at, 0)] if len(b) else -1, -1))
    whole = (begin >= 0) & (begin // width == ends // width)
    return minimal(begin[whole], ends[whole])


def block_covers(row: dict, part: Slice, plain: bool, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, chunk, cover density) of all pairs with a cover whose density reaches ``least`` of the query."""
    word, run = runs_of(row, part, plain)
    width = int(row["pos"].max(initial=0)) + 2
    first = np.r_[0, row["pos_ends"]][run]
    count = row["pos_ends"][run] - first
    place = np.repeat(row["docs"][run].astype(np.int64) * width, count) + row["pos"][spans(first, count)]
    owner = np.repeat(word, count)
    order = np.lexsort((place, owner))
    place, edges = place[order], np.searchsorted(owner[order], np.arange(len(part.words) + 1))
    of = [place[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    nowhere = np.zeros(0, np.int64)
    for q, groups in enumerate(part.groups):
        found, all_words = [], set()
        for clauses in groups:
            begins, ends = [], []
            for clause in clauses:
                all_words.update(clause)
                at = of[clause[0]]
                for k, w in enumerate(clause[1:], 1):
                    # -1 stands for no later occurrence.
                    at = at[np.append(of[w], -1)[np.searchsorted(of[w], at + k)] == at + k]
                if len(at):
                    begins.append(at)
                    ends.append(at + len(clause) - 1)
            found.append(minimal(np.concatenate(begins), np.concatenate(ends)) if begins else (nowhere, nowhere))
        begin, end = covers(found, width)
        if not len(begin):
            continue
        here = np.sort(np.concatenate([of[w] for w in all_words]))
        inside = np.searchsorted(here, end, "right") - np.searchsorted(here, begin)
        density = POSITION_WEIGHT / (1 + (end - begin) - (inside - 1))
        chunk = begin // width
        first = np.r_[True, chunk[1:] != chunk[:-1]]
        chunk, density = chunk[first], np.bincount(np.cumsum(first) - 1, density)
        density = np.round(density * row["boosts"][chunk], 9)
        good = density >= least[q]
        yield np.full(int(good.sum()), q), chunk[good], density[good]


Scorer = Callable[[dict, Slice, bool, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def best_of_task(part: Slice, k: int | None, plain: bool, scorer: Scorer, reach: np.ndarray | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each query the k best chunks of a task, all if k is None; none below ``reach`` of the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        score_block = partial(scorer, k=k) if scorer is block_points else scorer
        least = np.full(len(part.queries), -np.inf) if reach is None else reach.copy()

        def settle() -> None:
            query, chunk, score = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((chunk, -score, query))
            query, chunk, score = query[order], chunk[order], score[order]
            rank = np.arange(len(query)) - np.searchsorted(query, query)
            least[query[rank == k - 1]] = score[rank == k - 1]
            held[:] = [(query[rank < k], chunk[rank < k], score[rank < k])]

        def out(query: np.ndarray, chunk: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(query), PAIRS_AT_ONCE):
                q, c, s = (x[i : i + PAIRS_AT_ONCE] for x in (query, chunk, score))
                yield pa.RecordBatch.from_arrays([pa.array(part.queries[q]), pa.array(c), pa.array(s.astype(np.float64))], ["query", "chunk_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = arrays(batch, i)
                for query, at, score in score_block(row, part, plain, least):
                    if k is None:
                        yield from out(query, row["chunk_ids"][at], score)
                        continue
                    held.append((query, row["chunk_ids"][at], score))
                    if sum(len(h[0]) for h in held) > 2 * k * len(part.queries) + 4096:
                        settle()
        if held:
            settle()
            yield from out(*held[0])

    return run


def few_tasks(index: DataFrame) -> DataFrame:
    """The index in so many tasks that all cores are busy: each has k chunks a query to hand over, however few it has looked at."""
    return index.coalesce(TASKS_A_CORE * index.sparkSession.sparkContext.defaultParallelism)


def kth_best(index: DataFrame, part: Slice, k: int, plain: bool, scorer: Scorer) -> np.ndarray:
    """The k-th best score of each query of a slice; -inf if fewer chunks match."""
    out = np.full(len(part.queries), -np.inf)
    found = top_per(few_tasks(index).mapInArrow(best_of_task(part, k, plain, scorer), "query long, chunk_id long, score double"), ["query"], [F.desc("score"), F.col("chunk_id")], k)
    with few_rows(index.sparkSession, BLOCKS_AT_ONCE):
        got = found.filter(F.col("rank") == k).select("query", "score").toArrow()
    at = pc.index_in(got.column("query").combine_chunks(), value_set=pa.array(part.queries)).to_numpy(zero_copy_only=False)
    out[at] = got.column("score").to_numpy()
    return out


def search(index: DataFrame, clauses: DataFrame, k: int | None, scorer: Scorer, plain: bool = False, cut: tuple[int, Callable[[np.ndarray], np.ndarray]] | None = None) -> DataFrame:
    """(query, chunk_id, score, rank): for each query of ``clauses`` (query long, clause, group) the k best chunks by ``scorer``, equal scores by chunk_id; all matches, without a rank, if k is None.

    ``cut`` (n, f): only scores of f(the query's n-th best score) and more; n = 0 asks for no such score. Tasks drop what lies below, so it is never shuffled.
    ``plain``: clauses are unaccented and meet tokens without their marks. Chunk ids must not be null, and are distinct."""
    found = index.sparkSession.createDataFrame([], "query long, chunk_id long, score double")
    # Only what the scorer looks at is read, some blocks at a time where what is found is staged; all matches by points are too many for that.
    unread = ["title_words", "tokens" if plain else "plain", *([] if scorer is block_covers else POSITIONS)]
    index = index.drop(*unread)
    for part in slices(clauses, scorer is block_covers):
        reach = None
        if cut is not None:
            reach = cut[1](kth_best(index, part, cut[0], plain, scorer) if cut[0] else np.full(len(part.queries), -np.inf))
        here = (index if k is None else few_tasks(index)).mapInArrow(best_of_task(part, k, plain, scorer, reach), "query long, chunk_id long, score double")
        if k is not None or scorer is block_covers:
            with few_rows(index.sparkSession, BLOCKS_AT_ONCE):
                here = staged(here)
        found = found.unionByName(here)
    return found if k is None else top_per(found, ["query"], [F.desc("score"), F.col("chunk_id")], k)


def term_points(index: DataFrame, terms: DataFrame, k: int | None, plain: bool = False, cut: tuple[int, Callable[[np.ndarray], np.ndarray]] | None = None, boosted: bool = False) -> DataFrame:
    """Term hits (X09): (query, term) against the index, a point for each term that the content has and TITLE_POINTS more if the title has it, times the chunk's boost if ``boosted``; ``plain`` matches unaccented forms."""
    term = unaccent(F.col("term")) if plain else F.col("term")
    return search(index, terms.select("query", term.alias("clause"), F.lit(0).alias("group")), k, boosted_points if boosted else block_points, plain, cut)


def cover_density(index: DataFrame, clauses: DataFrame, k: int | None, plain: bool = False) -> DataFrame:
    """Cover density rank (X08): a cover is a minimal run of positions that satisfies the query, that is, holds a clause of each of its groups (so one group is a disjunction); it counts
    POSITION_WEIGHT over one more than the words in it that the query doesn't ask for; the sum over all covers is multiplied by the chunk's boost.

    ``clauses``: query, clause (words with single spaces: a phrase if several), group."""
    return search(index, clauses, k, block_covers, plain)


def enhanced_query(queries: DataFrame, mentions: DataFrame) -> DataFrame:
    """Clauses of a disjunctive query (X07): (query, text) and the names of the entities found in it (query, entity, place, name) to (query, clause).

    Each entity adds up to MOST_NAMES names of two words or more as phrases, plain and, if that differs, as written; the words of the names that were looked at ask no longer on their own.
    The text's words of two letters or more follow, as written and plain; those of names only if no phrase was added."""
    q = queries.select("query", F.array_distinct(F.concat(words(F.col("text"), 2), words(unaccent(F.col("text")), 2))).alias("w"))
    base = q.select("query", F.explode("w").alias("clause"))
    named = mentions.select("query", "entity", "place", F.lower(F.trim("name")).alias("name"))
    named = keep_first(named, ["query", "name"], [F.col("entity"), F.col("place")])
    clean = F.array_join(words(F.col("name")), " ")
    named = named.select("query", "entity", "place", clean.alias("clean"), F.array_join(words(unaccent(F.col("name"))), " ").alias("plain"))
    long = F.size(F.split("plain", " ")) >= 2
    before = F.count_if(long).over(Window.partitionBy("query", "entity").orderBy("place", "clean").rowsBetween(Window.unboundedPreceding, -1))
    looked = named.withColumn("before", before).filter(F.col("before") < MOST_NAMES)
    phrases = looked.filter(long).select("query", F.explode(F.array_distinct(F.array("plain", "clean"))).alias("clause"))
    parts = looked.select("query", F.explode(F.array_distinct(F.concat(F.split("clean", " "), F.split("plain", " ")))).alias("clause"))
    named_queries = phrases.select("query").distinct()
    kept = base.join(named_queries, "query", "left_semi").join(parts.distinct(), ["query", "clause"], "left_anti")
    return phrases.unionByName(kept).unionByName(base.join(named_queries, "query", "left_anti")).distinct()
