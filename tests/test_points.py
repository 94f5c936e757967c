"""Points of terms: bounded work at once, scores cut in the tasks, and what the registered queries take from them, against plain versions."""

import random

import numpy as np
import pyarrow as pa

from quarry.operators import grounding as V
from quarry.operators import index as I

WORDS = [f"word{i}" for i in range(40)]


def block(n, each=12, seed=1):
    rng = random.Random(seed)
    docs = [[rng.choice(WORDS) for _ in range(each)] for _ in range(n)]
    batch = pa.RecordBatch.from_pydict({"chunk_id": pa.array(range(n), pa.int64()), "words": docs, "title_words": pa.array([2] * n, pa.int32()), "boost": pa.array([1.0] * n)})
    return docs, I.arrays(I.block_row(batch), 0)


def part(n, each=25, seed=2):
    rng = random.Random(seed)
    asked = [rng.sample(range(len(WORDS)), each) for _ in range(n)]
    return asked, I.Slice(np.arange(n), pa.array(WORDS), np.concatenate(asked), np.repeat(np.arange(n), each), [])


def test_points_of_frequent_words_are_worked_out_in_bounded_parts(monkeypatch):
    docs, row = block(300)
    asked, some = part(200)
    want = {}
    for q, words in enumerate(asked):
        for d, doc in enumerate(docs):
            n = sum((WORDS[w] in doc[2:]) + 2 * (WORDS[w] in doc[:2]) for w in words)
            if n >= 4:
                want[q, d] = n
    monkeypatch.setattr(I, "CELLS", 2000)
    largest = []
    spans = I.spans
    monkeypatch.setattr(I, "spans", lambda begin, count: (largest.append(int(np.sum(count))), spans(begin, count))[1])
    for cost in (128, 0):
        # With cost 0 no word counts as frequent, so all hits are added one by one.
        monkeypatch.setattr(I, "CELLS_A_HIT", cost)
        largest.clear()
        got = {(int(q), int(d)): int(s) for a in I.block_points(row, some, False, np.full(200, 4.0)) for q, d, s in zip(*a)}
        assert got == want
        # The block's own postings come first; then no part is much above CELLS, where all hits are more than 100,000.
        assert max(largest[1:]) <= 2000 + 300


def test_scores_are_cut_by_the_nth_best(spark):
    rows = [(i, "", " ".join(WORDS[:n])) for i, n in enumerate([10, 9, 9, 5, 3, 1])]
    index = I.build_index(spark.createDataFrame(rows, "chunk_id long, title string, content string"), positions=False)
    terms = spark.createDataFrame([(q, w) for q, n in ((1, 10), (2, 3)) for w in WORDS[:n]], "query long, term string")
    found = lambda cut: {(r.query, r.chunk_id) for r in I.term_points(index, terms, None, cut=cut).collect()}
    assert found((1, lambda top: top - 1)) == {(1, 0), (1, 1), (1, 2), *((2, i) for i in range(5))}
    assert found((4, lambda best: best)) == {(1, 0), (1, 1), (1, 2), (1, 3), *((2, i) for i in range(5))}
    assert found((9, lambda best: best)) == found(None)
    assert found((0, lambda s: np.full(len(s), 9.0))) == {(1, 0), (1, 1), (1, 2)}


def test_chapters_by_the_index_are_those_of_the_join(spark):
    rng = random.Random(3)
    rows = [(i, "", " ".join(rng.sample(WORDS, rng.randint(1, 40)))) for i in range(300)]
    chunks = spark.createDataFrame(rows, "chunk_id long, title string, content string")
    words = spark.createDataFrame([(i, w) for i, _, t in rows for w in t.split()], "chunk_id long, token string")
    asked = spark.createDataFrame([(c, w) for c in range(8) for w in rng.sample(WORDS, 30)], "chapter long, token string")
    years = spark.createDataFrame([(i, y) for i in range(0, 300, 2) for y in rng.sample(range(900, 1400), 2)], "chunk_id long, year int")
    chapters = spark.createDataFrame([(c, 900 + 50 * c, 980 + 50 * c) for c in range(8)], "chapter long, start_year int, end_year int")
    want = sorted(map(tuple, V.route_to_chapters(words, asked, years, chapters).collect()))
    assert sorted(map(tuple, V.route_by_index(I.build_index(chunks, positions=False), asked, years, chapters).collect())) == want and len(want) == 40
