"""Lexical retrieval packing: windows filled with the documents that a sharded BM25 inverted index ranks next to a seed.

Documents are encoded once. How many documents hold each token is counted over all of them (a table of the vocabulary's size), and gives every shard's index the corpus' weights.
Documents are dealt to shards of bounded size by content: in order of the nearest of some centres, which are fitted on all documents, and then of three
weighted minima over the document's tokens, so that texts with much in common lie side by side. Each shard holds a complete inverted index of its
documents. A seed document queries it for unused neighbours and takes them, best first, until its window is full; the last one
is cut and its rest stays unused. So every window is full but the last of a shard, and no state is shared between shards.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import columns, discard, stage
from quarry.llm.tokens import SEPARATOR, byte_ids

WINDOW = 2048
#: Bytes of text in a shard of operator 10, about.
SHARD_BYTES = 4 << 20
#: Tokens in a shard, about. It bounds what one task holds at once, besides a single longer document.
SHARD_TOKENS = 1 << 20
#: BM25's usual constants.
K1, B = 1.2, 0.75
#: The vocabulary's size: ids fit 16 bits.
TERMS = 50_257
#: Centres of the documents' vectors; dimensions that tokens are hashed to; rounds of fitting; a component of 1 in whole numbers, which are cut at 127.
CENTRES, DIMENSIONS, ROUNDS, UNIT = 64, 512, 3, 254
#: Tokens and documents of an Arrow batch of encoded documents, about.
BATCH_TOKENS, BATCH_DOCS = 1 << 20, 2000
#: Encoded documents whose vectors are made at once.
SLICE_DOCS = 256
#: Neighbours of a seed that are sorted before the others.
FIRST = 32


def sharded(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and a shard by a hash of both and of the row's number: repeated rows and null ids are dealt apart."""
    rows = columns(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))
    return rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(shards)))


def document_ids(table: pa.Table) -> tuple[list, list[np.ndarray]]:
    """The shard's documents in order of (doc_id, text): their ids, and their token ids with the separator."""
    rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return [i for i, _ in rows], [np.array([*byte_ids(t), SEPARATOR], np.uint32) for _, t in rows]


def encoded(text: str | None) -> np.ndarray:
    ids = array("H", byte_ids(text or ""))
    ids.append(SEPARATOR)
    return np.frombuffer(ids, np.uint16)


def counted(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, ascending, and how often each occurs."""
    s = np.sort(tokens, kind="stable")  # a radix sort of 16-bit numbers
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
    return s[first], np.diff(np.append(first, len(s)))


def token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and the ids with the separator, 16 bits each; last a row that counts how many documents of the partition hold each token."""
    names, n = ["doc_id", "tokens", "frequencies"], np.zeros(TERMS, np.int32)
    for batch in batches:
        ids, out, size = batch.column("doc_id"), [], 0
        for k, text in enumerate(batch.column("text").to_pylist()):
            tokens = encoded(text)
            n[counted(tokens)[0]] += 1
            out.append(tokens.tobytes())
            size += len(tokens)
            if size >= BATCH_TOKENS or len(out) >= BATCH_DOCS or k + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays([ids.slice(k + 1 - len(out), len(out)), pa.array(out, pa.binary()), pa.nulls(len(out), pa.binary())], names)
                out, size = [], 0
    if n.any():
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([n.tobytes()], pa.binary())], names)


def frequency_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents each token is, over the counts of some partitions."""
    n = np.zeros(TERMS, np.int64)
    for batch in batches:
        for counts in batch.column("frequencies").to_pylist():
            n += np.frombuffer(counts, np.int32)
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["term", "n"])


def rarity(df: np.ndarray, n: int) -> np.ndarray:
    """BM25's weight of each token: one in half of the documents or more weighs nothing, and one of a single document finds no neighbour."""
    return np.where((df > 1) & (2 * df < n), np.log(np.maximum((n - df + 0.5) / (df + 0.5), 1e-9)), 0.0)


def scramble(x: np.ndarray, salt: int) -> np.ndarray:
    """Random-looking 64-bit numbers of token ids."""
    x = (x.astype(np.uint64) + np.uint64(salt * TERMS + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Content:
    """Where documents lie by content, with the corpus' weight of each token."""

    def __init__(self, idf: np.ndarray):
        every = np.arange(TERMS)
        self.idf = idf
        self.place, self.sign = (scramble(every, 0) % np.uint64(DIMENSIONS)).astype(np.int64), np.where(scramble(every, 1) & np.uint64(1), 1.0, -1.0)
        # A token's exponential variates: with a rate of its weight, the token of the least is the document's weighted minimum.
        self.rates = np.array([-np.log((scramble(every, 2 + k).astype(np.float64) + 1) / 2.0**64) for k in range(3)])
        self.centres = np.empty((0, DIMENSIONS), np.float32)

    def places(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the encoded documents that have a token of weight: their numbers, their vectors in whole numbers, and their three minima as one number."""
        pairs = [counted(t) for t in docs]
        terms, doc = np.concatenate([t for t, _ in pairs]), np.repeat(np.arange(len(docs)), [len(t) for t, _ in pairs])
        tf = np.concatenate([n for _, n in pairs])
        weight = self.idf[terms] * tf * (K1 + 1) / (tf + K1)
        use = np.flatnonzero(weight > 0)
        terms, doc, weight = terms[use].astype(np.int64), doc[use], weight[use]
        if not len(terms):
            return np.empty(0, np.int64), np.empty((0, DIMENSIONS), np.int8), np.empty(0, np.int64)
        some, first, count = np.unique(doc, return_index=True, return_counts=True)
        vectors = np.bincount(doc * DIMENSIONS + self.place[terms], weight * self.sign[terms], len(docs) * DIMENSIONS).reshape(-1, DIMENSIONS)[some]
        vectors *= UNIT / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        minima = np.zeros(len(some), np.int64)
        for rate in self.rates:
            value = rate[terms] / weight
            least = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, first), count))
            minima = minima << 16 | terms[least[np.searchsorted(least, first)]]
        return some, np.clip(np.rint(vectors), -127, 127).astype(np.int8), minima

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors.astype(np.float32) @ self.centres.T).argmax(1)

    def keys(self, docs: list[np.ndarray]) -> np.ndarray:
        """For each encoded document the nearest centre, then the minima, so that documents with much in common have near keys; 0 without a token of weight."""
        out = np.zeros(len(docs), np.int64)
        some, vectors, minima = self.places(docs)
        if len(some):
            out[some] = 1 + self.nearest(vectors) << 48 | minima
        return out

    def placed_keys(self, batch: pa.RecordBatch) -> np.ndarray:
        """The same from the minima and vectors of ``placed``."""
        key = batch.column("minima").to_numpy(zero_copy_only=False).copy()
        some = np.flatnonzero(batch.column("vector").is_valid().to_numpy(zero_copy_only=False))
        if len(some):
            key[some] |= 1 + self.nearest(matrix(batch.column("vector").drop_null())) << 48
        return key

    def part_of(self, keys: np.ndarray, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The part between ``bounds`` of each key; one that fills some parts alone is dealt to them by row."""
        first, last = np.searchsorted(bounds, keys.astype(np.float64), "left"), np.searchsorted(bounds, keys.astype(np.float64), "right")
        return first + (rows.astype(np.int64) % (last - first + 1))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE_DOCS):
            some = batch.slice(k, SLICE_DOCS)
            yield some, [np.frombuffer(t, np.uint16) for t in some.column("tokens").to_pylist()]


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, DIMENSIONS)


def placed(content: Content, tokens: DataFrame) -> DataFrame:
    """``tokens`` with minima and vector of each row, staged, so that neither is computed again."""
    names = [*tokens.columns, "minima", "vector"]

    def vector_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, docs in slices(batches):
            some, vectors, minima = content.places(docs)
            # A row without tokens of weight has no vector, but a place among the keys.
            all_minima, all_vectors = np.zeros(len(docs), np.int64), [None] * len(docs)
            all_minima[some] = minima
            for d, v in zip(some.tolist(), vectors):
                all_vectors[d] = v.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(all_minima), pa.array(all_vectors, pa.binary())], names)

    return stage(tokens.mapInArrow(vector_rows, ", ".join(f"{n} {t}" for n, t in [*tokens.dtypes, ("minima", "long"), ("vector", "binary")])))


def fitted(content: Content, tokens: DataFrame, parts: int) -> tuple[Content, np.ndarray]:
    """``content`` with centres, by spherical k-means over the vectors of all ``tokens`` (row, tokens; or as ``placed`` gives them), and the bounds of ``parts`` parts of about as many rows each.

    It starts from the vectors of some rows by hash. Vectors are of whole numbers, so their sums depend on no order. What the driver gets is as large as the centres and bounds."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(content.centres), DIMENSIONS), np.int64)
        for batch in batches:
            v = matrix(batch.column("vector"))
            near = content.nearest(v)
            order = np.argsort(near, kind="stable")
            some, first = np.unique(near[order], return_index=True)
            if len(some):
                total[some] += np.add.reduceat(v[order], first, axis=0, dtype=np.int64)
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([total[k].tobytes() for k in some], pa.binary())], ["centre", "sums"])

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(DIMENSIONS, np.int64)
        for s in table.column("sums").to_pylist():
            total += np.frombuffer(s, np.int64)
        return pa.table({"centre": table.column("centre")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(content.placed_keys(batch).astype(np.float64))], ["key"])

    rows = tokens if "vector" in tokens.columns else placed(content, tokens)
    vectors = rows.filter("vector is not null").select("row", "vector")
    start = [r.vector for r in vectors.orderBy(F.xxhash64("row"), "row").limit(CENTRES).collect()]
    if start:
        content.centres = unit(matrix(pa.array(start, pa.binary())))
        for _ in range(ROUNDS):
            got = vectors.select("vector").mapInArrow(sums, "centre int, sums binary").groupBy("centre").applyInArrow(added, "centre int, sums binary").collect()
            new = content.centres.copy()
            for r in got:
                new[r.centre] = unit(np.frombuffer(r.sums, np.int64)[None])[0]
            content.centres = new
        content.centres = content.centres[chain(content.centres)]
    keys = rows.select("minima", "vector").mapInArrow(key_rows, "key double")
    bounds = np.array(keys.approxQuantile("key", [k / parts for k in range(1, parts)], 1 / (8 * parts)) if parts > 1 else [])
    if rows is not tokens:
        discard(rows)
    return content, bounds


def unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def chain(centres: np.ndarray) -> list[int]:
    """An order in which each centre is followed by the nearest of those left, so that a part of some centres holds near ones."""
    alike, order, left = centres @ centres.T, [0], list(range(1, len(centres)))
    while left:
        order.append(max(left, key=lambda k: alike[order[-1], k]))
        left.remove(order[-1])
    return order


def dealt_rows(content: Content, bounds: np.ndarray):
    """The ``placed`` rows (doc_id, tokens, row, minima, vector) with their key and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = content.placed_keys(batch), batch.column("row")
            part = content.part_of(keys, rows.to_numpy(), bounds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tokens"), rows, pa.array(keys), pa.array(part, pa.int32())], ["doc_id", "tokens", "row", "key", "part"])

    return run


class Index:
    """An inverted index with BM25 weights over the token ids of a shard's documents; ``idf`` has the corpus' weights, else they are those of the documents."""

    def __init__(self, tokens: list[np.ndarray], idf: np.ndarray | None = None):
        n = len(tokens)
        lengths = np.array([len(t) for t in tokens], np.int64)
        flat, docs = np.concatenate(tokens), np.repeat(np.arange(n), lengths)
        order = np.argsort(flat.astype(np.uint16), kind="stable")  # by term, then by document
        flat, docs = flat[order], docs[order]
        first = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (docs[1:] != docs[:-1])]))
        terms, docs, tf = flat[first].astype(np.int64), docs[first], np.diff(np.append(first, len(flat)))
        df = np.bincount(terms, minlength=TERMS)
        idf = rarity(df, n) if idf is None else idf
        use = (idf[terms] > 0) & (df[terms] > 1)
        self.terms, self.docs, tf = terms, docs, tf = terms[use], docs[use], tf[use]
        self.n = n
        self.weight = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.docs] / lengths.mean()))
        self.at = self.starts()
        by = np.argsort(self.docs.astype(np.min_scalar_type(n)), kind="stable")
        self.own = np.split(terms[by], np.searchsorted(self.docs[by], np.arange(1, n)))

    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.bincount(self.terms, minlength=TERMS))])

    def keep(self, unused: np.ndarray) -> None:
        """Leave only the postings of unused documents; their scores stay the same."""
        use = np.flatnonzero(unused[self.docs])
        self.terms, self.docs, self.weight = self.terms[use], self.docs[use], self.weight[use]
        self.at = self.starts()

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every document of the shard for the seed's distinct terms."""
        own = self.own[seed]
        first, count = self.at[own], self.at[own + 1] - self.at[own]
        total = int(count.sum())
        if not total:
            return np.zeros(self.n)
        where = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total)
        return np.bincount(self.docs[where], self.weight[where], self.n)


def best_first(scores: np.ndarray) -> Iterator[int]:
    """The documents of positive score, highest first, equal ones in order; the FIRST best are sorted before the others, as a window seldom needs more."""
    found = np.flatnonzero(scores > 0)
    some = scores[found]
    if len(found) > 2 * FIRST:
        least = np.partition(some, len(some) - FIRST)[len(some) - FIRST]
        top = np.flatnonzero(some >= least)
        yield from found[top[np.argsort(-some[top], kind="stable")]].tolist()
        found, some = found[some < least], some[some < least]
    yield from found[np.argsort(-some, kind="stable")].tolist()


def fill(tokens: list[np.ndarray], window: int, idf: np.ndarray | None = None) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) pieces of one shard."""
    pieces, start, left, sequence = [], [], [], 0
    for d, t in enumerate(tokens):
        full = len(t) // window
        for k in range(full):
            pieces.append((d, k * window, window, sequence, 0))
            sequence += 1
        start.append(full * window)
        left.append(len(t) - full * window)
    unused = np.array([n > 0 for n in left])
    # Nothing before it is unused.
    lowest = 0
    index = Index(tokens, idf) if unused.any() else None
    # Documents that the index has, and those of them that are unused.
    held = n_unused = int(unused.sum())
    for seed in range(len(tokens)):
        if not unused[seed]:
            continue
        near, room, d = None, window, seed
        while True:
            n = min(left[d], room)
            pieces.append((d, start[d], n, sequence, window - room))
            start[d], left[d], room = start[d] + n, left[d] - n, room - n
            if not left[d]:
                unused[d], n_unused = False, n_unused - 1
            if not room:
                break
            if near is None:
                if 4 * n_unused < 3 * held:
                    index.keep(unused)
                    held = n_unused
                scores = np.where(unused, index.scores(seed), 0.0)
                near = best_first(scores)
            # The nearest first; then, as all that share a token are taken, the others in order.
            d = next((x for x in near if unused[x]), -1)
            if d < 0:
                while lowest < len(tokens) and not unused[lowest]:
                    lowest += 1
                if lowest == len(tokens):
                    break
                d = lowest
        sequence += 1
    return pieces


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, shard long"


def pack_rows(window: int, idf: np.ndarray):
    """Pieces of a partition's documents, which come in order of content, shard by shard."""

    def shard(ids: list, tokens: list[np.ndarray], sequence: int, number: int) -> tuple[pa.RecordBatch, int]:
        pieces = fill(tokens, window, idf)
        col = lambda k: [p[k] for p in pieces]
        fields = [
            pa.array([ids[d] for d in col(0)], pa.int64()),
            pa.array(col(1), pa.int64()),
            pa.array(col(2), pa.int64()),
            pa.array([tokens[d][s : s + n].astype(np.uint32).tobytes() for d, s, n, _, _ in pieces], pa.binary()),
            pa.array([len(tokens[d]) for d in col(0)], pa.int64()),
            pa.array([sequence + s for s in col(3)], pa.int64()),
            pa.array(col(4), pa.int64()),
            pa.array([number] * len(pieces), pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(fields, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "shard"]), sequence + 1 + max(col(3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tokens, size = [], [], 0
        sequence = number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("tokens").to_pylist()):
                if tokens and size + len(t) // 2 > 2 * SHARD_TOKENS:
                    out, sequence = shard(ids, tokens, sequence, number)
                    yield out
                    ids, tokens, size, number = [], [], 0, number + 1
                ids.append(i)
                tokens.append(np.frombuffer(t, np.uint16))
                size += len(tokens[-1])
        if tokens:
            yield shard(ids, tokens, sequence, number)[0]

    return run


def pack(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, shard.

    Every document, an empty or null text too, is its token ids and the separator; each id lies in exactly one piece. Repeated rows are packed
    as often as they occur, further columns are ignored, an empty table gives no rows.
    """
    rows = stage(columns(docs, "doc_id", "text").mapInArrow(token_rows, "doc_id long, tokens binary, frequencies binary"))
    tokens = rows.filter("tokens is not null").select("doc_id", "tokens", F.monotonically_increasing_id().alias("row"))  # so that repeated rows can be dealt apart
    n, size = tokens.agg(F.count(F.lit(1)), F.sum(F.octet_length("tokens"))).first()
    counts = rows.filter("frequencies is not null").select("frequencies").mapInArrow(frequency_rows, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = np.zeros(TERMS)
    for r in counts.collect():  # a row for each token of the vocabulary at most
        df[r.term] = r.n
    idf = rarity(df, n)
    # A partition is a shard, or some where many rows have one key: a task cuts what it gets.
    parts = max(1, math.ceil((size or 0) / 2 / SHARD_TOKENS))
    content = Content(idf)
    tokens = placed(content, tokens)
    discard(rows)
    content, bounds = fitted(content, tokens, parts)
    dealt = tokens.mapInArrow(dealt_rows(content, bounds), "doc_id long, tokens binary, row long, key long, part int").repartitionById(parts, "part").sortWithinPartitions("key", "row")
    return dealt.select("doc_id", "tokens").mapInArrow(pack_rows(window, idf), SCHEMA)
