"""Token-id output: documents packed best-fit-decreasing into fixed rows, written as binary id matrices.

Each shard of documents is packed for itself. Documents longer than a row are split losslessly into full rows and a rest. A
segment tree over remaining capacities finds the fullest row that still has room.
"""

from __future__ import annotations

import uuid
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import shared_dir
from quarry.llm.packing import WINDOW, document_ids, sharded

#: The id that fills rows up: the vocabulary's end of text.
PADDING = 50_256
SCHEMA = "shard long, row long, n_tokens long, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<long>"


class Capacities:
    """Rows by remaining capacity, in a segment tree over the capacities 0..most."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[deque[int]] = [deque() for _ in range(most + 1)]

    def _add(self, capacity: int, n: int) -> None:
        k = capacity + self.size
        while k:
            self.count[k] += n
            k >>= 1

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, row) of the least sufficient capacity, taken out; the oldest row of that capacity."""
        k = least + self.size
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k ^ 1]):
                k >>= 1
            if k <= 1:
                return None
            k ^= 1
            while k < self.size:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        capacity = k - self.size
        row = self.rows[capacity].popleft()
        self._add(capacity, -1)
        return capacity, row


def best_fit(lengths: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Rows of (document, start, length)."""
    rows: list[list[tuple[int, int, int]]] = []
    rest = []
    for d, n in enumerate(lengths):
        full = n // window
        rows += [[(d, k * window, window)] for k in range(full)]
        if n % window:
            rest.append((n % window, d, full * window))
    free = Capacities(window)
    for n, d, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        got = free.take(n)
        if got is None:
            rows.append([(d, start, n)])
            free.put(window - n, len(rows) - 1)
        else:
            rows[got[1]].append((d, start, n))
            free.put(got[0] - n, got[1])
    return rows


def pack_rows(window: int):
    def run(key, table):
        ids, tokens = document_ids(table)
        rows = best_fit([len(t) for t in tokens], window)
        out = {k: [] for k in ("n_tokens", "ids", "cu_seqlens", "position_ids", "doc_ids", "starts")}
        for row in rows:
            matrix, positions, ends = np.full(window, PADDING, np.uint32), np.zeros(window, np.uint16), [0]
            for d, start, n in row:
                at = ends[-1]
                matrix[at : at + n] = tokens[d][start : start + n]
                positions[at : at + n] = np.arange(n)
                ends.append(at + n)
            out["n_tokens"].append(ends[-1])
            out["ids"].append(matrix.tobytes())
            out["cu_seqlens"].append(ends)
            out["position_ids"].append(positions.tobytes())
            out["doc_ids"].append([ids[d] for d, _, _ in row])
            out["starts"].append([s for _, s, _ in row])
        kinds = {"n_tokens": pa.int64(), "ids": pa.binary(), "cu_seqlens": pa.list_(pa.int32()), "position_ids": pa.binary(), "doc_ids": pa.list_(pa.int64()), "starts": pa.list_(pa.int64())}
        return pa.table({"shard": pa.array([key[0].as_py()] * len(rows), pa.int64()), "row": pa.array(range(len(rows)), pa.int64())} | {k: pa.array(v, kinds[k]) for k, v in out.items()})

    return run


def write_packed(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pack ``docs`` and write one record a row of the id matrix to ``path`` (a Parquet folder); returns it as read back.

    ids: ``window`` little-endian unsigned 32-bit ids, filled up with PADDING; n_tokens of them count. cu_seqlens: where
    segments begin and end. position_ids: 16-bit positions that start again at 0 with each segment. doc_ids, starts: each segment's document and place in it.
    A document is its ids and the separator; a null text is empty. Repeated rows are packed as often as they occur, further columns are ignored; an empty table gives no rows.
    """
    path = path or f"{shared_dir(docs.sparkSession)}/packed-{uuid.uuid4().hex}"
    sharded(docs).groupBy("shard").applyInArrow(pack_rows(window), SCHEMA).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(SCHEMA).parquet(path)


def packed_digest(rows: DataFrame) -> DataFrame:
    """One row per matrix row: what it holds, as read back."""
    return rows.select("shard", "row", "n_tokens", F.size("doc_ids").cast("long").alias("n_segments"), "cu_seqlens", "doc_ids", "starts", F.crc32("ids").alias("ids_crc32"), F.crc32("position_ids").alias("position_crc32"))
