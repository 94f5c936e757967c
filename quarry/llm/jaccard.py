"""Exact n-gram Jaccard join by T-occurrence search over inverted lists: linked classes and the number of links.

Two sets that reach the similarity share at least T shingles, so they share one of the |x|-T+1 shortest
inverted lists of either, in any one global order. The order is by how many texts have a shingle, counted over all texts: blocks of texts
ask for the frequencies of their distinct shingles, compressed and dealt by leading bits, and get them back as one byte each.
Documents of one short list tie if their sizes and 512 parity bits leave the similarity possible (sets that differ in d shingles differ in d bits at most), so
a shared passage ties no texts that are otherwise apart, and no linked pair lies across the groups that ties make. Each group gets its own inverted
index and runs the search: short lists are merged with a heap, the longest ones are left out as DivideSkip decides and
only probed, by binary search for the candidates that can still reach T.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import HEAVY, columns, connected_components, discard, join_groups, small, stage
from quarry.llm.textblock import M1, cut, mix, read_table, shingle_sets, squeeze, table_bytes, unsqueeze

#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20
#: Bytes of text whose shingles make one bucket of the frequency count, about.
BUCKET_BYTES = 8 << 20
#: A block is searched in parts of about so many documents and shingles; each pair of parts is one task's work.
PART_DOCS, PART_SHINGLES = 512, 400_000
#: DivideSkip's weight of a probe against a step of the merge: small, as a list is probed for all candidates at once.
MU = 0.005
#: A list of more documents, if it also has more than 1/HEAVY of all rows, ties all of them to one, each where it is, so that no task holds it.
LIST_DOCS = 4096
#: Parity bits of a set, by which pairs that are too far apart are told without their texts.
PARITY = 512


def node_of(s: np.ndarray) -> np.int64:
    """A set's number among blocks; sets that share one by chance only meet in a block."""
    return mix(s).sum(dtype=np.uint64).astype(np.int64)


def checks_of(s: np.ndarray) -> tuple[int, int]:
    """Two numbers of a set; with its size they tell equal sets from others."""
    return int(node_of(s)), int(mix(s + M1).sum(dtype=np.uint64).astype(np.int64))


def need(size: int, num: int, den: int) -> int:
    """The least overlap of a set of ``size`` with any set that reaches num/den."""
    return -(-num * size // den)


def linked(overlap: int, a: int, b: int, num: int, den: int) -> bool:
    return den * overlap >= num * (a + b - overlap)


def block_rows(batches: Iterator[pa.RecordBatch], width: int, bits: int, most: int) -> Iterator[pa.RecordBatch]:
    """For each block of texts: the texts, what to know of each, and the shingles whose frequency the block asks for.

    A request holds one bucket's shingles, by their leading bits, as ascending 32-bit numbers, and in how many of the block's texts each is."""
    for block, table in cut(batches, most):
        sets = list(shingle_sets(table.column("text"), width))
        known = np.array([(len(s), *checks_of(s)) for s in sets], np.int64).reshape(-1, 3)
        keys, counts = np.unique(keys_of(np.concatenate(sets), bits), return_counts=True)
        edges = np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
        asked = []
        for b, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            if j > i:
                asked.append({"bucket": b, "n": j - i, "keys": squeeze(planes(keys[i:j])), "counts": squeeze(np.minimum(counts[i:j], 255).astype(np.uint8).tobytes())})
        fields = [table.column("doc_id").to_pylist(), *known.T.tolist()]
        rows = [dict(zip(("doc_id", "n_shingles", "node", "check"), r)) for r in zip(*fields)]
        yield pa.RecordBatch.from_pylist([{"block": block, "texts": table_bytes(table), "sets": rows, "asked": asked}], BLOCK_TYPE)


BLOCK_TYPE = pa.schema(
    [
        ("block", pa.int64()),
        ("texts", pa.binary()),
        ("sets", pa.list_(pa.struct([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("check", pa.int64())]))),
        ("asked", pa.list_(pa.struct([("bucket", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))),
    ]
)
BLOCKS = "block long, texts binary, sets array<struct<doc_id:long,n_shingles:long,node:long,check:long>>, asked array<struct<bucket:int,n:long,keys:binary,counts:binary>>"


def keys_of(shingles: np.ndarray, bits: int) -> np.ndarray:
    """A shingle's bucket and 32 bits more: enough to order by, shared by chance now and then."""
    return shingles >> np.uint64(32 - bits)


def planes(keys: np.ndarray) -> bytes:
    """Steps between ascending keys, byte by byte, so that they compress."""
    steps = np.diff(keys.astype(np.uint32), prepend=np.uint32(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes, n: int) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, n).T).view(np.uint32).reshape(-1)
    return np.cumsum(steps, dtype=np.uint32)


def answer_bucket(key, table):
    """How frequent each shingle of a bucket is over all blocks, on a scale of logarithms: 0 if one text has it."""
    sizes = table.column("n").to_pylist()
    keys = np.concatenate([from_planes(unsqueeze(k, 4 * n), n) for k, n in zip(table.column("keys").to_pylist(), sizes)])
    counts = np.concatenate([np.frombuffer(unsqueeze(c, n), np.uint8) for c, n in zip(table.column("counts").to_pylist(), sizes)])
    distinct, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, counts, len(distinct))
    ranks = np.minimum(np.floor(8 * np.log2(total)), 255).astype(np.uint8)[at]
    parts = np.split(ranks, np.cumsum(sizes)[:-1])
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "n": table.column("n"), "ranks": pa.array([squeeze(p.tobytes()) for p in parts], pa.binary())})


def parity(s: np.ndarray) -> bytes:
    """For each of PARITY buckets of shingles whether the set has an odd number of them."""
    return np.packbits(np.bincount((mix(s) >> np.uint64(55)).astype(np.int64), minlength=PARITY) & 1).tobytes()


def short_lists(width: int, num: int, den: int, bits: int):
    """(shingle, node, n_shingles, parity): of the |x|-T+1 rarest shingles of each distinct set of a block those that another text has too."""

    def run(blocks, answers):
        ranks = np.concatenate([np.empty(0, np.uint8), *(np.frombuffer(unsqueeze(r["ranks"], r["n"]), np.uint8) for r in sorted(answers.to_pylist(), key=lambda r: r["bucket"]))])
        shingles, nodes, sizes, parities, seen = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [], set()
        for blob in blocks.column("texts").to_pylist():
            sets = list(shingle_sets(read_table(blob).column("text"), width))
            keys, at = np.unique(keys_of(np.concatenate(sets), bits), return_inverse=True)
            if len(keys) != len(ranks):
                raise ValueError("a block's shingles are not those that it asked for")
            rank, first = ranks[at], 0
            for s in sets:
                own = rank[first : first + len(s)]
                first += len(s)
                if not len(s) or not own.any() or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                by = np.argsort(own, kind="stable")[: len(s) - need(len(s), num, den) + 1]
                by = by[own[by] > 0]
                shingles.append(s[by])
                nodes.append(np.full(len(by), node))
                sizes.append(np.full(len(by), len(s)))
                parities += [parity(s)] * len(by)
        return pa.table({"shingle": np.concatenate(shingles).view(np.int64), "node": np.concatenate(nodes), "n_shingles": np.concatenate(sizes), "parity": pa.array(parities, pa.binary())})

    return run


def possible(sizes: np.ndarray, bits: np.ndarray, size: int, own: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which sets, of these sizes and parities, may reach the similarity with one of ``size`` and ``own``."""
    both = sizes + size
    apart = both - 2 * -(-num * both // (num + den))
    return (np.minimum(sizes, size) * den >= np.maximum(sizes, size) * num) & (np.bitwise_count(bits ^ own).sum(axis=-1) <= apart)


def ties(sizes: np.ndarray, bits: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of a list's documents that hold together all that may be linked: a walk from each one to those not reached before."""
    left, out = np.arange(len(sizes)), []
    while len(left) > 1:
        at, left = [left[0]], left[1:]
        while at and len(left):
            k = at.pop()
            near = possible(sizes[left], bits[left], sizes[k], bits[k], num, den)
            out += [(int(k), int(x)) for x in left[near]]
            at += left[near].tolist()
            left = left[~near]
    return out


def list_ties(num: int, den: int):
    """(a, b) of rows that are in order of shingle and node."""

    def of(table: pa.Table) -> pa.RecordBatch:
        shingle, node, size = (table.column(k).to_numpy() for k in ("shingle", "node", "n_shingles"))
        bits = np.frombuffer(b"".join(table.column("parity").to_pylist()), np.uint64).reshape(-1, PARITY // 64)
        first = np.flatnonzero(np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])])) if len(shingle) else np.empty(0, np.int64)
        shingle, node, size, bits = shingle[first], node[first], size[first], bits[first]
        edges = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1], [True]])) if len(shingle) else np.zeros(1, np.int64)
        length = np.diff(edges)
        two = edges[:-1][length == 2]
        two = two[possible(size[two], bits[two], size[two + 1], bits[two + 1], num, den)] if len(two) else two
        a, b = [node[two]], [node[two + 1]]
        for i, n in zip(edges[:-1][length > 2].tolist(), length[length > 2].tolist()):
            for x, y in ties(size[i : i + n], bits[i : i + n], num, den):
                a.append(node[i + x : i + x + 1])
                b.append(node[i + y : i + y + 1])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column(0).to_numpy()
            if rest and last[-1] == rest[0].column(0)[-1].as_py():
                rest.append(batch)  # one list goes on over the whole batch
                continue
            others = np.flatnonzero(last != last[-1])
            cut_at = int(others[-1]) + 1 if len(others) else 0
            yield of(pa.Table.from_batches([*rest, batch.slice(0, cut_at)]))
            rest = [batch.slice(cut_at)]
        if rest:
            yield of(pa.Table.from_batches(rest))

    return run


def tied(blocks: DataFrame, width: int, num: int, den: int, bits: int) -> DataFrame:
    """(node, component): sets that share a short list with another that is near enough, and what they hang together with."""
    asked = blocks.select("block", F.inline("asked"))
    answers = asked.groupBy("bucket").applyInArrow(answer_bucket, "block long, bucket int, n long, ranks binary")
    texts = blocks.select("block", "texts")
    lists = stage(texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(short_lists(width, num, den, bits), "shingle long, node long, n_shingles long, parity binary"))
    total = lists.count()
    heads = lists.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("head"))
    hot = F.broadcast(stage(heads.filter((F.col("n") > LIST_DOCS) & (F.col("n") * HEAVY > total)).select("shingle", "head")))  # HEAVY rows at most
    cold = lists.join(hot, "shingle", "left_anti").repartition("shingle").sortWithinPartitions("shingle", "node")
    pairs = cold.mapInArrow(list_ties(num, den), "a long, b long").unionByName(lists.join(hot, "shingle").select(F.col("node").alias("a"), F.col("head").alias("b")).filter("a != b"))
    out = connected_components(pairs)
    discard(lists)
    return out


def long_lists(longest: int, t: int) -> int:
    """How many of the longest lists DivideSkip leaves to probing: none but fewer than t may be left out of the merge."""
    return min(t - 1, int(t / (MU * math.log2(longest + 1) + 1)))


def merge(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The documents of ascending lists, in ascending order, and how many lists hold each, by a heap over the lists' heads."""
    merged = np.fromiter(heapq.merge(*(x.tolist() for x in lists)), np.int64)
    first = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]])) if len(merged) else merged
    return merged[first], np.diff(np.append(first, len(merged)))


def find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def inverted(docs: list[int], indexed: list[int], sets: list[np.ndarray]) -> tuple[dict[int, np.ndarray], list[np.ndarray]]:
    """The shingles of each document that another one of ``docs`` has too, by number, and each number's ascending list of ``indexed`` documents."""
    every, at = np.unique(np.concatenate([sets[d] for d in docs]), return_inverse=True)
    shared = (np.bincount(at, minlength=len(every)) > 1)[at]
    ends = np.cumsum([len(sets[d]) for d in docs])
    own = {d: part[keep] for d, part, keep in zip(docs, np.split(at, ends[:-1]), np.split(shared, ends[:-1]))}
    order = sorted(indexed)
    numbers = np.concatenate([np.empty(0, np.int64), *(own[d] for d in order)])
    holders = np.repeat(np.array(order, np.int64), [len(own[d]) for d in order])[np.argsort(numbers, kind="stable")]
    return own, np.split(holders, np.cumsum(np.bincount(numbers, minlength=len(every)))[:-1])


def search(queries: list[int], indexed: list[int], sets: list[np.ndarray], num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each of ``queries`` that has any, the documents of ``indexed`` (positions in ``sets``) that it is linked with. Where both are the same, each pair comes once."""
    docs = sorted({*queries, *indexed})
    if len(docs) < 2:
        return
    own, index = inverted(docs, indexed, sets)
    every = np.array([len(s) for s in sets], np.int64)
    once = queries == indexed
    for q in queries:
        size = len(sets[q])
        t = need(size, num, den)
        lists = sorted((index[s] for s in own[q].tolist() if len(index[s])), key=len)
        if len(lists) < t:
            continue
        skip = long_lists(len(lists[-1]), t)
        found, n = merge(lists[: len(lists) - skip])
        keep = (n >= t - skip) & (found > q if once else True) & (size * num <= every[found] * den) & (every[found] * num <= size * den)
        found, n = found[keep], n[keep]
        for k, long in enumerate(lists[len(lists) - skip :]):
            # Binary probes of a long list, for the candidates that can still reach T with the lists that are left.
            n = n + (long[np.minimum(np.searchsorted(long, found), len(long) - 1)] == found)
            keep = n >= t - (skip - k - 1)
            found, n = found[keep], n[keep]
        found = found[den * n >= num * (size + every[found] - n)]
        if len(found):
            yield q, found


LINKS = "doc_id long, node long, check long, links long, to long"


def search_part(width: int, num: int, den: int):
    """For one pair of a group's parts: for each document that has links there how many, weighted by the copies of the other, and a document that all of its own hang on."""

    def run(key, table):
        rows, known = [], set()
        fields = zip(*(table.column(k).to_pylist() for k in ("doc_id", "node", "check", "size", "part")))
        sets = list(shingle_sets(table.column("text"), width))
        for k, (row, s) in enumerate(zip(fields, sets)):
            # A doc_id may have several texts: only the one whose set is meant counts, once.
            if row[1:3] == checks_of(s) and row[:3] not in known:
                known.add(row[:3])
                rows.append((row, k))
        rows.sort()
        sets, rows = [sets[k] for _, k in rows], [r for r, _ in rows]
        i, j = key[1].as_py(), key[2].as_py()
        a, b = ([k for k, r in enumerate(rows) if r[4] == side] for side in (i, j))
        weight = np.array([r[3] for r in rows], np.int64)
        links, parent = np.zeros(len(rows), np.int64), list(range(len(rows)))
        for q, found in search(a, b, sets, num, den):
            links[q] += weight[found].sum()
            links[found] += weight[q]
            for d in found.tolist():
                x, y = sorted((find(parent, q), find(parent, d)))
                parent[y] = x
        some = np.flatnonzero(links).tolist()
        out = {name: pa.array([rows[k][c] for k in some], pa.int64()) for c, name in enumerate(("doc_id", "node", "check"))}
        return pa.table(out | {"links": links[some], "to": pa.array([rows[find(parent, k)][0] for k in some], pa.int64())})

    return run


def jaccard_classes(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, the smallest doc_id that links reach, and n_links, how many other rows it is linked with.

    Words are runs of anything but ASCII white space, A-Z lower-cased; the set holds the distinct shingles of ``width``
    words, the whole sequence where there are fewer, and nothing for null, empty or blank texts, which link with nothing. Two documents link when
    den * intersection >= num * union. Rows with a null doc_id link with nothing. Repeated rows and equal texts are linked. Rows of one doc_id with different texts have
    links of their own, and one component: the doc_id's. Further columns are ignored, an empty table gives no rows.
    """
    docs = columns(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    most = BLOCK_BYTES
    bits = max(0, min(30, math.ceil(math.log2(max(1, size) / BUCKET_BYTES))))
    blocks = stage(docs.mapInArrow(lambda it: block_rows(it, width, bits, most), BLOCKS))
    rows = stage(blocks.select(F.inline("sets")))
    total = rows.count()
    key = ["node", "check", "n_shingles"]
    full = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = stage(full.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")))

    # Sets that tie hang together; no linked pair lies across such groups. One text of each set goes on.
    groups = stage(tied(blocks, width, num, den, bits))
    discard(blocks)
    inside = stage(classes.join(small(groups, groups.count()), "node").select(F.col("rep").alias("doc_id"), *key, "size", F.col("component").alias("block")))
    n_inside = inside.count()
    texts = docs.join(small(inside, n_inside, 100), "doc_id").withColumn("_text", F.md5(F.col("text").cast("binary"))).dropDuplicates(["doc_id", "node", "check", "_text"]).drop("_text")

    # Groups are dealt in parts, and each pair of a group's parts is searched for itself.
    sizes = inside.groupBy("block").agg(F.greatest(F.ceil(F.count(F.lit(1)) / PART_DOCS), F.ceil(F.sum("n_shingles") / PART_SHINGLES)).alias("parts"), F.count(F.lit(1)).alias("members"))
    dealt = join_groups(texts, stage(sizes), ["block"], "members", n_inside).withColumn("part", F.pmod(F.xxhash64("doc_id", "node"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    sent = ["doc_id", "node", "check", "size", "text", "block", "part"]
    work = dealt.select(*sent, other).select(*sent, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    # A row costs far more to search than to move: as many tasks as the session shuffles to, not as few as its bytes would make.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = stage(work.repartition(tasks, "block", "i", "j").groupBy("block", "i", "j").applyInArrow(search_part(width, num, den), LINKS))

    # A doc_id with several texts hangs its classes together.
    ids = full.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("x"), F.max(F.struct(*key)).alias("y")).filter("x != y").select("doc_id")
    ids = stage(ids)
    bridges = full.join(small(ids, ids.count()), "doc_id").join(classes, key).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    joined = connected_components(links.select(F.col("doc_id").alias("a"), F.col("to").alias("b")).unionByName(bridges))
    partners = links.groupBy(F.col("doc_id").alias("rep"), "node", "check").agg(F.sum("links").alias("links"))
    named = classes.join(partners, ["rep", "node", "check"], "left").join(joined.withColumnRenamed("node", "_rep"), F.col("rep") == F.col("_rep"), "left")
    named = stage(named.select(*key, F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "size"))
    out = join_groups(full, named, key, "size", total).select("doc_id", "n_shingles", "component_id", "n_links")
    bare = rows.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(bare)


def drop_near_duplicates(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest doc_id, in its own columns. Documents without words stay."""
    lost = stage(jaccard_classes(docs, width, num, den).filter("component_id < doc_id").select("doc_id").distinct())
    return docs.join(small(lost, lost.count()), "doc_id", "left_anti").select(*docs.columns)
