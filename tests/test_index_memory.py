"""What bounds the memory of a search: row groups of the index, pairs handed over at once; and what points leave out early."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from quarry.operators import index as I
from quarry.operators.retrieval import best

WORDS = [f"word{i}" for i in range(300)]


def texts(n, seed=1):
    rng = random.Random(seed)
    return [(k, rng.choice(WORDS), " ".join(rng.choices(WORDS, k=rng.choice([3, 30, 300])))) for k in range(n)]


def test_a_reader_gets_few_blocks_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 5)
    monkeypatch.setattr(I, "GROUP_BYTES", 1000)
    index = I.build_index(spark.createDataFrame(texts(400), "chunk_id long, title string, content string").coalesce(1), positions=False)
    groups = [m.row_group(g).num_rows for f in index.inputFiles() for m in [pq.read_metadata(f.removeprefix("file://"))] for g in range(m.num_row_groups)]
    assert sum(groups) == 80 and max(groups) <= I.GROUP_ROWS


def test_pairs_are_handed_over_in_parts(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"chunk_id": pa.array(range(300), pa.int64()), "words": [["word1"]] * 300, "title_words": pa.array([0] * 300, pa.int32()), "boost": pa.array([1.0] * 300)})
    part = I.Slice(np.arange(50), pa.array(["word1"]), np.zeros(50, np.int64), np.arange(50), [])
    monkeypatch.setattr(I, "PAIRS_AT_ONCE", 1000)
    for k, n in ((None, 300), (200, 200)):
        sizes = [b.num_rows for b in I.best_of_task(part, k, False, I.block_points)(iter([I.block_row(batch)]))]
        assert sum(sizes) == 50 * n and max(sizes) <= 1000


def test_points_with_what_is_left_out_early(spark, monkeypatch):
    rows = texts(500)
    monkeypatch.setattr(I, "BLOCK", 40)
    index = I.build_index(spark.createDataFrame(rows, "chunk_id long, title string, content string"), positions=False)
    asked = {q: set(random.Random(q).sample(WORDS, n)) for q, n in enumerate([2, 10, 60, 200])}
    terms = spark.createDataFrame([(q, w) for q, ws in asked.items() for w in ws], "query long, term string")
    want = {q: sorted((-(len(ws & set(c.split())) + 2 * (t in ws)), k) for k, t, c in rows if ws & {t, *c.split()}) for q, ws in asked.items()}
    got = {q: [] for q in asked}
    for r in I.term_points(index, terms, 7).orderBy("query", "rank").collect():
        got[r.query].append((-int(r.score), r.chunk_id))
    assert got == {q: w[:7] for q, w in want.items()}
    cut = {(r.query, r.chunk_id) for r in I.term_points(index, terms, None, cut=(0, lambda s: np.full(len(s), 39.5))).collect()}
    assert cut == {(q, k) for q, w in want.items() for s, k in w if -s >= 39.5} and cut
    # The same in tasks of one's own, with other bounds of what is held at once.
    part, blocks = next(I.slices(terms.select("query", terms["term"].alias("clause")), False)), index.drop("plain").toArrow().to_batches()
    for cells, cost in ((1 << 18, 512), (100, 512), (100, 0), (1 << 18, 1 << 20)):
        monkeypatch.setattr(I, "CELLS", cells)
        monkeypatch.setattr(I, "CELLS_A_HIT", cost)
        for k in (3, None):
            least = np.full(4, 9.5)
            found = [r for b in I.best_of_task(part, k, False, I.block_points, least)(iter(blocks)) for r in zip(*(c.to_pylist() for c in b.columns))]
            assert sorted(found) == sorted((q, i, -s) for q, w in want.items() for s, i in [x for x in w if -x[0] >= 9.5][:k])


def test_only_the_best_of_a_block_are_held(monkeypatch):
    docs = [WORDS[: k % 50 + 1] for k in range(400)]
    row = I.arrays(I.block_row(pa.RecordBatch.from_pydict({"chunk_id": pa.array(range(400), pa.int64()), "words": docs, "title_words": pa.array([0] * 400, pa.int32()), "boost": pa.array([1.0] * 400)})), 0)
    part = I.Slice(np.arange(3), pa.array(WORDS), np.tile(np.arange(50), 3), np.repeat(np.arange(3), 50), [])
    found = [len(q) for q, _, _ in I.block_points(row, part, False, np.full(3, -np.inf), 2)]
    assert sum(found) == 3 * 8  # the longest eight are equal


def test_blocks_are_put_together_from_small_batches():
    sizes = [1, 2, 3, 9, 1, 1, 1, 1, 1, 4]
    rows = pa.RecordBatch.from_pydict({"chunk_id": pa.array(range(10), pa.int64()), "words": [WORDS[:n] for n in sizes], "title_words": pa.array([0] * 10, pa.int32()), "boost": pa.array([1.0] * 10)})
    for n in (1, 3, 10):
        blocks = I.block_rows((rows.slice(i, n) for i in range(0, 10, n)), 4, 6)
        assert [b.column("chunk_ids")[0].as_py() for b in blocks] == [[0, 1, 2], [3], [4, 5, 6, 7], [8, 9]]


def test_best_similarities():
    rng = np.random.default_rng(0)
    s = np.round(rng.normal(size=(40, 300)), 1)
    s[3, 7], s[4] = np.nan, np.nan
    q, ids = np.arange(40) + 5, rng.permutation(300)
    for k in (1, 30, 300, 400):
        order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
        want = (np.repeat(q, order.shape[1]), ids[order].ravel(), np.take_along_axis(s, order, 1).ravel())
        for a, b in zip(best(q, ids, s, k), want, strict=True):
            np.testing.assert_array_equal(a, b)


def test_the_best_come_from_few_tasks(spark, monkeypatch):
    rows = texts(200)
    index = I.build_index(spark.createDataFrame(rows, "chunk_id long, title string, content string").repartition(40), positions=False)
    with monkeypatch.context() as m:
        m.setattr(I, "TASKS_A_CORE", 1)
        assert I.few_tasks(index.repartition(40)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    terms = spark.createDataFrame([(1, w) for w in WORDS[:100]], "query long, term string")
    got = [r.chunk_id for r in I.term_points(index, terms, 5).orderBy("rank").collect()]
    assert got == [k for _, k in sorted((-(len(set(WORDS[:100]) & set(c.split())) + 2 * (t in WORDS[:100])), k) for k, t, c in rows)[:5]]
