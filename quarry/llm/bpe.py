"""BPE encoding and decoding through a distinct-word table.

The vocabulary never joins characters across white space, so a text's ids are those of its words in order. Texts travel in
blocks of bounded size. Each block asks for its distinct words; the requests meet by word in one table for the whole corpus, each distinct word is encoded
once, and the answers are joined back to their blocks, where every word's position takes its ids. So the shuffles hold
compressed texts and distinct words, not one row per word occurrence, and a frequent word is no hot key.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import columns
from quarry.llm.textblock import cut, read_table, squeeze, table_bytes, unsqueeze
from quarry.llm.tokens import tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side

VOCABULARY = "word_bpe_49k.json"
#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Bytes of text for each bucket of the distinct-word table, about: a bucket's requests are some of all blocks' words, so its size does not grow with the input.
BUCKET_BYTES = 8 << 20


def text_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Each block's documents, compressed."""
    for block, table in cut(batches, most):
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([table_bytes(table)], pa.binary())], ["block", "texts"])


def request_rows(batches: Iterator[pa.RecordBatch], most: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Each block's distinct words, dealt to buckets by their hash; a bucket without words gets no row."""
    for block, table in cut(batches, most):
        words: set[bytes] = set()
        for chunk in table.column("text").chunks:
            for text in chunk.cast(pa.binary()).to_pylist():
                words.update(text.split())
        dealt: dict[int, list[bytes]] = {}
        for w in sorted(words):
            dealt.setdefault(zlib.crc32(w) % buckets, []).append(w)
        some = [(b, b"\n".join(ws)) for b, ws in sorted(dealt.items())]
        fields = [pa.array([block] * len(some), pa.int64()), pa.array([b for b, _ in some], pa.int32()), pa.array([len(w) for _, w in some], pa.int64()), pa.array([squeeze(w) for _, w in some], pa.binary())]
        yield pa.RecordBatch.from_arrays(fields, ["block", "bucket", "size", "words"])


def encode_words(words: list[bytes], file: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after the other, where each word's begin)."""
    t, ids, ends = tokenizer(file), [], [0]
    it = iter(words)
    while some := list(islice(it, 20_000)):
        for e in t.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False):
            got = e.ids
            ids.extend(got)
            ends.append(ends[-1] + len(got))
    return np.array(ids, np.uint32), np.array(ends, np.int64)


def gather(values: np.ndarray, begin: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[begin[k]:begin[k + 1]] for each k of ``which``, one after the other, and their lengths."""
    first, count = begin[which], begin[which + 1] - begin[which]
    total = int(count.sum())
    return values[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(total)], count


def answer_bucket(file: str):
    """For one bucket of words: each distinct word encoded once, and for each block that asked the ids of its words."""

    def run(key, table):
        asked = [unsqueeze(w, n).split(b"\n") for w, n in zip(table.column("words").to_pylist(), table.column("size").to_pylist())]
        distinct = sorted(set().union(*asked))
        at = {w: k for k, w in enumerate(distinct)}
        ids, begin = encode_words(distinct, file)
        answers = []
        for ws in asked:
            got, count = gather(ids, begin, np.fromiter(map(at.__getitem__, ws), np.int64, len(ws)))
            answers.append((count.astype(np.uint32).tobytes(), got.tobytes()))
        return pa.table({"block": table.column("block"), "size": table.column("size"), "words": table.column("words"), "counts": pa.array([squeeze(c) for c, _ in answers], pa.binary()), "n_ids": pa.array([len(i) // 4 for _, i in answers], pa.int64()), "ids": pa.array([squeeze(i) for _, i in answers], pa.binary())})

    return run


def assemble(file: str):
    """A block's documents with their ids: every word's position takes the ids of its word."""

    def run(texts, answers):
        at: dict[bytes, int] = {}
        ids, counts = [np.empty(0, np.uint32)], [np.zeros(1, np.int64)]
        for r in answers.to_pylist():
            ws = unsqueeze(r["words"], r["size"]).split(b"\n")
            at.update(zip(ws, range(len(at), len(at) + len(ws))))
            counts.append(np.frombuffer(unsqueeze(r["counts"], 4 * len(ws)), np.uint32).astype(np.int64))
            ids.append(np.frombuffer(unsqueeze(r["ids"], 4 * r["n_ids"]), np.uint32))
        values, begin = np.concatenate(ids), np.cumsum(np.concatenate(counts))
        out = []
        for blob in texts.column("texts").to_pylist():
            for batch in read_table(blob).to_batches(max_chunksize=500):
                words = [t.split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
                flat = [w for ws in words for w in ws]
                lost = sorted({w for w in flat if w not in at})
                if lost:  # only if a lost executor's rows came back in another order
                    more, ends = encode_words(lost, file)
                    at.update(zip(lost, range(len(at), len(at) + len(lost))))
                    values, begin = np.concatenate([values, more]), np.concatenate([begin, begin[-1] + ends[1:]])
                got, count = gather(values, begin, np.fromiter(map(at.__getitem__, flat), np.int64, len(flat)))
                ends = np.concatenate([[0], np.cumsum(count)])[np.cumsum([0, *map(len, words)])]
                out.append(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(got.astype(np.int32)))], ["doc_id", "ids"]))
        kind = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        return pa.Table.from_batches([b.cast(kind) for b in out], kind)

    return run


def encode(docs: DataFrame, file: str = VOCABULARY) -> DataFrame:
    """One row per row of ``docs``: doc_id and ids, the token ids of the whole text (null: empty, no ids).

    As the tokenizers library encodes without special tokens, truncation and padding. Repeated rows and null ids keep their rows, further columns are ignored, an empty table gives no rows.
    """
    rows = columns(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size, most = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, BLOCK_BYTES
    buckets = max(16, size // BUCKET_BYTES)
    texts = rows.mapInArrow(lambda it: text_rows(it, most), "block long, texts binary")
    requests = rows.mapInArrow(lambda it: request_rows(it, most, buckets), "block long, bucket int, size long, words binary")
    answers = requests.groupBy("bucket").applyInArrow(answer_bucket(file), "block long, size long, words binary, counts binary, n_ids long, ids binary")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(assemble(file), "doc_id long, ids array<int>")


def decoded_rows(batches: Iterator[pa.RecordBatch], file: str) -> Iterator[pa.RecordBatch]:
    t = tokenizer(file)
    pieces = pa.array([t.id_to_token(k) or "" for k in range(t.get_vocab_size())], pa.large_string())
    for batch in batches:
        for part in range(0, batch.num_rows, 500):
            b = batch.slice(part, 500)
            lists = b.column("ids")
            lists = pa.LargeListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]).cast(pa.int64()), pieces.take(lists.flatten()))
            text = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns)), text], [*b.schema.names, "decoded"])


def decode(encoded: DataFrame, file: str = VOCABULARY) -> DataFrame:
    """``encoded`` (with ``ids``) and ``decoded``: each id joined to its piece, the pieces put together with one space,
    as the library decodes for a vocabulary without a decoder, special tokens kept. The table of pieces has the vocabulary's fixed size. Null ids are taken as none."""
    rows = encoded.withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(lambda it: decoded_rows(it, file), f"{schema}, decoded string")
