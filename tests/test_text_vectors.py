"""Vectors of texts, hashed for many texts at once, against the same rules text by text, to the last bit."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import text as T

TEXTS = ["The  quick\nbrown fox.", "", "   ", None, "a", "ab", "Über größe đường 漢字 漢 😀😀 x", "w" * 250 + " " + "é" * 101 + " z", "to be or not to be to be", "x" * 100 + " y"] + [f"word{k} again word{k % 7} Ab{k}" for k in range(600)]


def plain_hashed(text, dim=64):
    h, v, clean = T.djb2, np.zeros(dim), (text or "").lower().strip()
    words = clean.split()
    for w in words:
        v[h(w) % dim] += 1.5
        v[(h(w) * 31 + 17) % dim] += 0.8
    for a, b in zip(words, words[1:]):
        v[h(f"{a} {b}") % dim] += 2.0
    for i in range(len(clean) - 2):
        v[h(clean[i : i + 3]) % dim] += 0.3
    return v / (math.sqrt(float(v @ v)) or 1.0)


def plain_small(text, dim=64):
    def h(t, factor):
        n = 0
        for c in t:
            n = (n * factor + ord(c)) & 0xFFFFFFFF
        return n

    v, words = np.zeros(dim), re.findall(r"\w+", (text or "").lower())
    for w in words:
        v[h(w, 31) % dim] += 1.0
    for a, b in zip(words, words[1:]):
        v[h(f"{a} {b}", 33) % dim] += 1.5
    return v / (math.sqrt(float(v @ v)) or 1.0)


def test_vectors_of_many_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    for many, plain in ((T.hashed_vectors, plain_hashed), (T.small_vectors, plain_small)):
        got = {r.doc_id: r.embedding for r in many(docs).collect()}
        assert len(got) == len(TEXTS)
        for i, t in enumerate(TEXTS):
            assert got[i] == plain(t).tolist(), (plain.__name__, i)


def test_few_documents_are_held_at_once(spark):
    """A batch of 600 documents goes through in slices: a row of the plan's Python node knows no more of them."""
    seen = []
    rows = spark.createDataFrame([(i, "x") for i in range(600)], "doc_id long, text string").toArrow().to_batches(max_chunksize=10_000)
    seen = [b.num_rows for b in T.slices(iter(rows))]
    assert max(seen) <= T.SLICE_DOCS and sum(seen) == 600


class Batches:
    """In place of a DataFrame: what a pass makes of one batch of 600 documents."""

    def __init__(self, table):
        self.table, self.schema = table, None

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return [b.num_rows for b in run(iter(self.table.to_batches()))]


def test_passes_over_texts_hold_few_documents(spark):
    import pyarrow as pa

    from quarry.operators.syllables import heal

    texts = Batches(pa.table({"doc_id": range(600), "text": ["in the\nrain"] * 599 + [None]}))
    for sizes in (T.unwrap_lines(texts), T.heal_syllables(texts, ["inthe"]), T.composed(texts), heal(texts)):
        assert sizes == [256, 256, 88]
    # One parent and one child each.
    whole = Batches(pa.table({"doc_id": range(600), "source": ["s"] * 600, "text": ["some words"] * 600}))
    assert T.chunk_documents(whole) == [512, 512, 176]
