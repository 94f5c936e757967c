"""The positional index, cover density and dense search against plain versions of themselves."""

import collections
import itertools
import random
import re

import numpy as np
import pytest

import __spark_entry__ as entry
from quarry.operators import index as I
from quarry.operators import retrieval as X

SF = "/root/testdata/sf0.001"


def tokens(text, least=1):
    return [w for w in re.split(r"[^\w]|_", (text or "").lower()) if len(w) >= least]


def density(words, groups):
    """Every interval is tried; minimal ones that hold a clause of each group count."""
    asked = {w for clauses in groups for c in clauses for w in c.split(" ")}

    def holds(a, b):
        some = words[a : b + 1]
        return all(any(some[i : i + len(c.split(" "))] == c.split(" ") for c in clauses for i in range(len(some))) for clauses in groups)

    good = [(a, b) for a in range(len(words)) for b in range(a, len(words)) if holds(a, b)]
    least = [(a, b) for a, b in good if not any(a <= c and d <= b and (a, b) != (c, d) for c, d in good)]
    return sum(0.1 / (1 + (b - a) - (sum(w in asked for w in words[a : b + 1]) - 1)) for a, b in least)


@pytest.mark.parametrize("block", [1024, 3])
def test_cover_density_against_all_intervals(spark, monkeypatch, block):
    monkeypatch.setattr(I, "BLOCK", block)
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices("abcdef", k=rng.randrange(3))), " ".join(rng.choices("abcdefgh", k=rng.randrange(14))), 1.0 + k % 3) for k in range(40)] + [(90, None, None, 1.0), (91, "", "a b", 2.0), (92, "a", "b", 1.0)]
    queries = {1: [["a"]], 2: [["a", "b c"]], 3: [["a"], ["b"]], 4: [["a b"], ["c", "d e"]], 5: [["a"], ["b"], ["c d", "h"]], 6: [["zz"]], 7: [["a"], ["zz"]], 8: [["a b c", "b", "a b"]]}
    frame = spark.createDataFrame(rows, "chunk_id long, title string, content string, boost double").repartition(3)
    clauses = spark.createDataFrame([(q, c, g) for q, groups in queries.items() for g, clauses in enumerate(groups) for c in clauses], "query long, clause string, group int")
    index = I.build_index(frame, 1, frame["boost"])
    want = {(q, i): round(density(tokens(t) + tokens(c), groups) * b, 9) for q, groups in queries.items() for i, t, c, b in rows}
    got = {(r.query, r.chunk_id): r.score for r in I.cover_density(index, clauses, None).collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if v}, abs=2e-9)
    top = collections.defaultdict(list)
    for r in I.cover_density(index, clauses, 4).orderBy("query", "rank").collect():
        top[r.query].append(r.chunk_id)
    assert dict(top) == {q: [i for s, i in sorted((-s, i) for (p, i), s in got.items() if p == q)[:4]] for q in {q for q, _ in got}}


def test_term_points(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 2)
    monkeypatch.setattr(I, "CELLS", 3)
    monkeypatch.setattr(I, "SLICE", 2)
    rows = [(1, "Été", "ete ÉTÉ autre"), (2, "autre", "rien"), (3, None, "été"), (4, "ete", None), (5, "", "")]
    terms = spark.createDataFrame([(1, "été"), (1, "autre"), (2, "ete"), (3, "rien"), (3, "rien")], "query long, term string")
    index = I.build_index(spark.createDataFrame(rows, "chunk_id long, title string, content string"))
    assert {(r.query, r.chunk_id, r.score) for r in I.term_points(index, terms, None).collect()} == {(1, 1, 4.0), (1, 2, 2.0), (1, 3, 1.0), (2, 1, 1.0), (2, 4, 2.0), (3, 2, 1.0)}
    assert {(r.query, r.chunk_id, r.score) for r in I.term_points(index, terms, None, plain=True).collect()} == {(1, 1, 4.0), (1, 2, 2.0), (1, 3, 1.0), (1, 4, 2.0), (2, 1, 3.0), (2, 3, 1.0), (2, 4, 2.0), (3, 2, 1.0)}
    nothing = I.build_index(spark.createDataFrame([], "chunk_id long, title string, content string"))
    assert I.term_points(nothing, terms, 5).count() == 0 and I.term_points(index, terms.limit(0), 5).count() == 0


def test_enhanced_query(spark):
    q = spark.createDataFrame([(1, "Trận Bạch Đằng năm 938"), (2, "sông Hồng"), (3, None)], "query long, text string")
    names = [(1, "bd", 0, "Bạch Đằng"), (1, "bd", 1, "bach dang"), (1, "bd", 2, "sông Bạch Đằng"), (1, "x", 0, "Ngô"), *[(1, "y", k, f"tên {k}") for k in range(6)]]
    got = collections.defaultdict(set)
    for r in I.enhanced_query(q, spark.createDataFrame(names, "query long, entity string, place int, name string")).collect():
        got[r.query].add(r.clause)
    assert got[1] == {"bạch đằng", "bach dang", "sông bạch đằng", "song bach dang", *[f"{w} {k}" for w in ("tên", "ten") for k in range(4)], "trận", "tran", "năm", "nam", "938"}
    assert got[2] == {"sông", "hồng", "song", "hong"} and 3 not in got


def test_dense_search_broadcasts_queries_only(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    q = v.filter("vec_id % 10 = 0")
    want = {i: [j for _, j in sorted((-round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9), j) for j, b in rows)[:5]] for i, a in rows if i % 10 == 0}
    for most, per in ((32 << 20, 1024), (500, 3)):
        monkeypatch.setattr(X, "SLICE_BYTES", most)
        monkeypatch.setattr(X, "QUERIES", per)
        found = X.dense_top_k(q, v, 5)
        plan = found._jdf.queryExecution().executedPlan().toString()
        joins = re.findall(r"BroadcastNestedLoopJoin (Build\w+)", plan)
        assert joins and set(joins) == {"BuildRight"} and "CartesianProduct" not in plan
        # The side that is broadcast is the staged queries.
        for side in plan.split("BroadcastExchange")[1:]:
            assert "q_ids" in side.split("FileScan")[1].split("\n")[0]
        got = collections.defaultdict(list)
        for r in found.orderBy("query", "rank").collect():
            got[r.query].append(r.chunk_id)
        assert got == want
    assert list(X.ranges([(1, 5), (2, 5), (4, 20), (9, 1), (11, 9)], 10)) == [(1, 2), (4, 4), (9, 11)] and list(X.ranges([], 3)) == []


def test_blocks_are_read_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 1)
    index = I.build_index(spark.createDataFrame([(k, "", "a b") for k in range(40)], "chunk_id long, title string, content string").coalesce(1), 1)

    def probe(*_):
        def run(batches):
            for batch in batches:
                yield I.pa.RecordBatch.from_pydict({"query": I.pa.array([1]), "chunk_id": I.pa.array([batch.column("chunk_ids")[0][0].as_py()]), "score": I.pa.array([float(batch.num_rows)])})

        return run

    monkeypatch.setattr(I, "best_of_task", probe)
    sizes = [r.score for r in I.cover_density(index.coalesce(1), spark.createDataFrame([(1, "a b", 0)], "query long, clause string, group int"), None).collect()]
    assert sum(sizes) == 40 and max(sizes) <= I.BLOCKS_AT_ONCE
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


@pytest.mark.parametrize("name", ["op_f07_phrase_match", "op_x08_cover_density", "op_x07_enhanced_query", "op_x09_unaccented_top_k"])
def test_queries_find_something(spark, name):
    rows = entry.queries()[name](spark, SF).collect()
    assert len(rows) > 20
    if name == "op_x07_enhanced_query":
        assert len({" " in r.clause for r in rows}) == 2
