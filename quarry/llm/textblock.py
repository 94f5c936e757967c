"""Runs of words of many texts at once, as 64-bit hashes, and blocks of texts that travel compressed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext

#: Texts are handled in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: A partition's documents travel in blocks of so many bytes of text.
BLOCK_BYTES = 16 << 20
R = np.uint64(0x9E3779B97F4A7C15)
M1, M2 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M1
    return (x ^ (x >> np.uint64(29))) * M2


def slices(texts: pa.Array | pa.ChunkedArray) -> Iterator[pa.Array]:
    """The texts of an Arrow string column in order, null as empty, in slices of bounded size."""
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        ends, i = np.cumsum(pc.fill_null(pc.binary_length(chunk), 0).to_numpy(zero_copy_only=False)), 0
        while i < len(chunk):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE_BYTES, "right")))
            yield chunk.slice(i, j - i).fill_null("")
            i = j


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of 128 bits for each word of all texts in order, A-Z lower-cased, and where each text's words begin (one more entry than texts).

    Each distinct word is hashed once over its bytes."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    begin = np.concatenate([[0], np.cumsum(full)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    known = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.cast(pa.binary()).to_pylist())), np.uint64).reshape(-1, 2)
    return known[coded.indices.to_numpy()], begin


def chained(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` of the words. Between two words all bits are mixed, so no two runs meet but by chance."""
    n = len(words) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = mix((h + words[k : n + k, 0]) * R ^ words[k : n + k, 1])
    return h


def runs(texts: pa.Array | pa.ChunkedArray, width: int) -> Iterator[np.ndarray]:
    """For each text the hashes of its runs of ``width`` words, in order; fewer words are one run, none are none."""
    for some in slices(texts):
        words, begin = word_hashes(some)
        every = chained(words, width) if len(words) >= width else words[:0, 0]
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            yield every[a : b - width + 1] if b - a >= width else chained(words[a:b], b - a) if b > a else words[:0, 0]


def shingle_sets(texts: pa.Array | pa.ChunkedArray, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``width`` words, A-Z lower-cased."""
    for run in runs(texts, width):
        s = np.sort(run)
        yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s


def cut(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Table]]:
    """(block, rows): a partition's rows in blocks that end once they hold ``most`` bytes."""
    block, some, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        text = batch.column("text")
        ends, first = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False)), 0
        while first < batch.num_rows:
            k = int(np.searchsorted(ends, most - size + (ends[first - 1] if first else 0), "left")) + 1
            part = batch.slice(first, k - first)
            some.append(part)
            size += part.column("text").nbytes
            first += part.num_rows
            if size >= most:
                yield block, pa.Table.from_batches(some)
                block, some, size = block + 1, [], 0
    if some:
        yield block, pa.Table.from_batches(some)


def table_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def read_table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def squeeze(data: bytes) -> bytes:
    return pa.Codec("zstd", 5).compress(data, asbytes=True)


def unsqueeze(data: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(data, size, asbytes=True)
