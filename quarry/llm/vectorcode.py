"""Vector codes: product quantization by a dual-tree Lloyd iteration in whole numbers.

Each block of vectors keeps, for every part position, its points in the order of a balanced tree, with the box and the sums of each node. The trees
are built once. A round walks a block's tree against a tree over the codebook's entries: bounds of node pairs prune combinations, a node with one
entry left is assigned as a whole by its sums, and the leaves that stay uncertain compare points with the entries left. All numbers are integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import columns, join_groups, shared_dir, stage

#: Whole units of a component, vectors of a block, points of a leaf.
SCALE, BLOCK, LEAF = 1024, 4096, 16
BLOCKS = "vec_ids array<long>, labels array<string>, points array<binary>, orders array<binary>, lows array<binary>, highs array<binary>, sums array<binary>"


def cuts(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin, in the order of the tree, and ``n``: halves of halves."""
    return (np.arange((1 << level) + 1) * n) >> level


def depth(n: int, leaf: int) -> int:
    """The level whose nodes hold at most ``leaf`` points, and one at least."""
    d = 0
    while (n >> d) > leaf and (n >> (d + 1)) >= 1:
        d += 1
    return d


def tree_order(points: np.ndarray, levels: int) -> np.ndarray:
    """The order of the points in a balanced tree: each node is halved along the dimension in which its box is longest."""
    order = np.arange(len(points))
    for level in range(levels):
        at, below = cuts(len(points), level), cuts(len(points), level + 1)
        for k in range(1 << level):
            some = order[at[k] : at[k + 1]]
            axis = int(np.argmax(points[some].max(0) - points[some].min(0)))
            order[at[k] : at[k + 1]] = some[np.argpartition(points[some, axis], min(len(some) - 1, below[2 * k + 1] - at[k]))]
    return order


class Tree:
    """Boxes and sums of all nodes, level after level; node k of a level holds the points between its cuts."""

    def __init__(self, points: np.ndarray, levels: int, low: np.ndarray | None = None, high: np.ndarray | None = None, sums: np.ndarray | None = None):
        self.points, self.levels = points, levels
        if low is None:
            at = [cuts(len(points), level)[:-1] for level in range(levels + 1)]
            low = np.concatenate([np.minimum.reduceat(points, a) for a in at])
            high = np.concatenate([np.maximum.reduceat(points, a) for a in at])
            sums = np.concatenate([np.add.reduceat(points, a) for a in at])
        self.low, self.high, self.sums = low, high, sums

    def row(self, level: int) -> int:
        return (1 << level) - 1


def assign(tree: Tree, entries: Tree, names: np.ndarray, whole: Callable[[int, int, int, int, np.ndarray], None], single: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> None:
    """Tell ``whole`` of each node whose points all have one nearest entry (begin, end, row, entry), and ``single`` of all other points (places, entries, squared distances).

    ``names`` are the entries in the order of their tree. A pair of nodes goes only if its least distance is more than what another entry is sure to have,
    so entries at equal distance stay until the points themselves are compared, where the lower index wins."""
    n, level, below = len(tree.points), 0, 0
    node, entry = np.zeros(1, np.int64), np.zeros(1, np.int64)
    places, chosen, apart = [], [], []
    while len(node):
        p, e = node + tree.row(level), entry + entries.row(below)
        gap = np.maximum(0, np.maximum(tree.low[p] - entries.high[e], entries.low[e] - tree.high[p]))
        reach = np.maximum(tree.high[p] - entries.low[e], entries.high[e] - tree.low[p])
        least, most = (gap * gap).sum(1), (reach * reach).sum(1)
        begin = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        group = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(node)]))
        stays = least <= np.minimum.reduceat(most, begin)[group]
        node, entry, at = node[stays], entry[stays], cuts(n, level)
        if below == entries.levels:
            begin = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            count = np.diff(np.r_[begin, len(node)])
            for k in begin[count == 1]:
                whole(int(at[node[k]]), int(at[node[k] + 1]), tree.row(level) + int(node[k]), int(names[entry[k]]), tree.sums)
            rest = np.repeat(count > 1, count)
            if level == tree.levels:
                for k, c in zip(begin[count > 1], count[count > 1], strict=True):
                    left = names[entry[k : k + c]]
                    by_name = np.argsort(left)
                    left, c_points = left[by_name], entries.points[entry[k : k + c]][by_name]
                    some = tree.points[at[node[k]] : at[node[k] + 1]]
                    squares = (some * some).sum(1)[:, None] - 2 * (some @ c_points.T) + (c_points * c_points).sum(1)
                    best = squares.argmin(1)
                    places.append(np.arange(at[node[k]], at[node[k] + 1]))
                    chosen.append(left[best])
                    apart.append(squares[np.arange(len(some)), best])
                break
            node, entry = node[rest], entry[rest]
        # The entries' tree goes down twice as fast, so that single entries meet nodes that are still large.
        for _ in range(2):
            if below < entries.levels:
                node, entry, below = np.repeat(node, 2), (2 * np.repeat(entry, 2).reshape(-1, 2) + np.arange(2)).ravel(), below + 1
        if level < tree.levels:
            node, entry, level = np.concatenate([2 * node, 2 * node + 1]), np.concatenate([entry, entry]), level + 1
            order = np.lexsort((entry, node))
            node, entry = node[order], entry[order]
    if places:
        single(np.concatenate(places), np.concatenate(chosen), np.concatenate(apart))


def entry_trees(book: np.ndarray) -> list[tuple[Tree, np.ndarray]]:
    """A tree down to single entries for each part of the codebook, and the entries' indexes in its order."""
    out = []
    for part in book:
        levels = 0
        while (1 << levels) < len(part):
            levels += 1
        # Entries are repeated up to a power of two; a repeated one loses against the first by its index.
        index = np.resize(np.arange(len(part)), 1 << levels)
        order = tree_order(part[index], levels)
        out.append((Tree(part[index][order], levels), index[order]))
    return out


def blocks(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of at most BLOCK vectors, each with its trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(first, BLOCK)
                flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
                cut = np.split(np.floor(SCALE * flat).astype(np.int64).reshape(batch.num_rows, -1), parts, axis=1)
                found: list[list[bytes]] = [[], [], [], [], []]
                for points in cut:
                    levels = depth(len(points), LEAF)
                    order = tree_order(points, levels)
                    tree = Tree(points[order], levels)
                    for out, x in zip(found, (tree.points, order, tree.low, tree.high, tree.sums), strict=True):
                        out.append(np.ascontiguousarray(x, np.int64).tobytes())
                fields = [pa.array([batch.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([batch.column("label").to_pylist()], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(fields + [pa.array([x], pa.list_(pa.binary())) for x in found], ["vec_ids", "labels", "points", "orders", "lows", "highs", "sums"])

    return run


def trees_of(batch: pa.RecordBatch, row: int, part: int, width: int) -> tuple[Tree, np.ndarray]:
    x = {c: np.frombuffer(batch.column(c)[row][part].as_py(), np.int64) for c in ("points", "orders", "lows", "highs", "sums")}
    points = x["points"].reshape(-1, width)
    return Tree(points, depth(len(points), LEAF), x["lows"].reshape(-1, width), x["highs"].reshape(-1, width), x["sums"].reshape(-1, width)), x["orders"]


def sums_of(book: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each part and entry the number of its points and their sums, over all blocks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, total, count = entry_trees(book), np.zeros_like(book), np.zeros(book.shape[:2], np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                for part, (tree_e, names) in enumerate(entries):
                    tree, _ = trees_of(batch, row, part, book.shape[2])

                    def whole(begin: int, end: int, at: int, entry: int, sums: np.ndarray, part: int = part) -> None:
                        total[part, entry] += sums[at]
                        count[part, entry] += end - begin

                    def single(places: np.ndarray, chosen: np.ndarray, _: np.ndarray, part: int = part, tree: Tree = tree) -> None:
                        order = np.argsort(chosen, kind="stable")
                        begin = np.flatnonzero(np.r_[True, np.diff(chosen[order]) > 0])
                        which = chosen[order][begin]
                        total[part, which] += np.add.reduceat(tree.points[places[order]], begin)
                        count[part, which] += np.diff(np.r_[begin, len(order)])

                    assign(tree, tree_e, names, whole, single)
        part, entry = np.nonzero(count)
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def codes_of(book: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each vector's nearest entries and the squared distance to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = entry_trees(book)
        for batch in batches:
            for row in range(batch.num_rows):
                n = len(batch.column("vec_ids")[row])
                code, error = np.zeros((n, len(book)), np.int64), np.zeros(n, np.int64)
                for part, (tree_e, names) in enumerate(entries):
                    tree, order = trees_of(batch, row, part, book.shape[2])

                    def whole(begin: int, end: int, at: int, entry: int, _: np.ndarray, part: int = part, tree: Tree = tree, order: np.ndarray = order) -> None:
                        code[order[begin:end], part] = entry
                        error[order[begin:end]] += np.square(tree.points[begin:end] - book[part, entry]).sum(1)

                    def single(places: np.ndarray, chosen: np.ndarray, apart: np.ndarray, part: int = part, order: np.ndarray = order) -> None:
                        code[order[places], part] = chosen
                        error[order[places]] += apart

                    assign(tree, tree_e, names, whole, single)
                yield pa.RecordBatch.from_arrays([batch.column("vec_ids")[row].values, batch.column("labels")[row].values, pa.array(list(code), pa.list_(pa.int64())), pa.array(error)], ["vec_id", "label", "codes", "error"])

    return run


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """One row per vector of ``vectors`` (vec_id, embedding, label) that is kept: vec_id, label (as string), codes array<long>, error long, label_error long, codebooks string (all entries' components).

    A vector is dropped if it is null, empty, holds a null or non-finite component or one of more than sqrt(2**60 / length) units (its error could leave 64 bits), or has another length than the first kept one.
    Codebooks start from the smallest vec_ids (null last; of rows with one vec_id the smaller vector first); of fewer rows than ``entries`` all are taken, repeated rows too. An empty table gives no rows.
    Rounds cost one pass over the staged blocks and a sum of at most parts * entries rows for each task; the driver holds the codebooks only, whose size does not depend on the input.
    """
    spark = vectors.sparkSession
    shared_dir(spark)
    result = "vec_id long, label string, codes array<long>, error long, label_error long, codebooks string"
    rows = columns(vectors, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    size = F.size("embedding")
    rows = rows.filter(F.col("embedding").isNotNull() & (size > 0) & (size % parts == 0))
    # 0 * x is 0 for finite components alone.
    bound = F.sqrt(F.lit(float(1 << 60)) / size) / SCALE
    rows = rows.filter(F.coalesce(F.forall("embedding", lambda x: F.coalesce(0 * x == 0, F.lit(False)) & (F.abs(x) < bound)), F.lit(False)))
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding").asc()]
    first = rows.orderBy(*order).select(size.alias("n")).head()
    if first is None:
        return spark.createDataFrame([], result)
    rows = rows.filter(size == first["n"])
    width = first["n"] // parts
    start = np.floor(SCALE * np.array([r["embedding"] for r in rows.orderBy(*order).limit(entries).collect()])).astype(np.int64)
    book = np.stack(np.split(start, parts, axis=1))
    held = stage(rows.mapInArrow(blocks(parts), BLOCKS))
    for _ in range(rounds):
        sums = held.mapInArrow(sums_of(book), "part long, entry long, n long, sums array<long>")
        got = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums")).collect()
        book = book.copy()
        for r in got:
            book[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    coded = stage(held.mapInArrow(codes_of(book), "vec_id long, label string, codes array<long>, error long").withColumn("_label", F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))))
    groups = stage(coded.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")))
    text = ",".join(map(str, book.ravel().tolist()))
    return join_groups(coded, groups, ["_label"], "_n", coded.count(), n_groups=groups.count()).select("vec_id", "label", "codes", "error", "label_error", F.lit(text).alias("codebooks"))


def digest(coded: DataFrame) -> DataFrame:
    """The contract's columns: codes as two hex digits each, the codebooks as a hash."""
    one = lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))
    return coded.select("vec_id", F.array_join(F.transform("codes", one), "").alias("code"), "error", "label_error", F.sha2(F.col("codebooks").cast("binary"), 256).alias("codebooks_sha256"))

