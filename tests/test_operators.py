"""Operators on hand-made rows with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from quarry import dims
from quarry.functions import text as T
from quarry.operators import evaluation as E
from quarry.operators import graph as G
from quarry.operators import ranks as K
from quarry.operators import relational as R
from quarry.operators import retrieval as X
from quarry.operators import text as O
from quarry.schemas import conform
from quarry.sources import documents as S


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def value(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr).first()[0]


# -- relational
def test_upserts(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 1), ("c", 5)], "k string, v int")
    assert rows(R.upsert_replace(old, new, ["k"])) == [("a", 1), ("b", 1), ("c", 5)]
    assert rows(R.upsert_max(old, new, ["k"], "v")) == [("a", 1), ("b", 2), ("c", 5)]
    assert rows(R.insert_ignore(old, new, ["k"])) == [("a", 1), ("b", 2), ("c", 5)]
    assert rows(R.replace_slice(old, new, "k")) == [("a", 1), ("b", 1), ("c", 5)]
    arrays = lambda df: df.select("k", F.array("v").alias("v"))
    assert rows(R.upsert_union(arrays(old), arrays(new), ["k"], "v")) == [("a", [1]), ("b", [1, 2]), ("c", [5])]


def test_delete_keeps_unknown(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "v int")
    assert {r[0] for r in R.delete_where(df, F.col("v") > 2).collect()} == {1, None}


def test_percentiles(spark):
    for n in (1, 2, 20):
        df = spark.createDataFrame([("k", float(i)) for i in range(n)], "k string, v double")
        assert K.discrete_percentiles(df, ["k"], "v", [50, 95]).first()[1:] == (float(min(n // 2, n - 1)), float(min(95 * n // 100, n - 1)))
        assert K.interpolated_percentiles(df, ["k"], "v", [50]).first()[1] == (n - 1) / 2


def test_ranks_of_hot_and_null_keys(spark):
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 7}", (i * 7919) % 100, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(5)
    got = {r["i"]: (r["at"], r["n"]) for r in K.ranked(df, ["k"], [F.desc("v"), F.col("i")], "at", "n").collect()}
    want = {}
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        want |= {r[2]: (at, len(group)) for at, r in enumerate(group, 1)}
    assert got == want
    assert K.ranked(df.limit(0), ["k"], [F.col("v")]).collect() == []


def test_epochs(spark):
    years = [(-258, -258), (-257, -257), (938, 938), (939, 939), (1771, 1777), (2027, 2027), (-3000, -3000)]
    df = spark.createDataFrame(years, "a int, b int")
    got = {r[0]: r[2] for r in R.overlapping_epochs(df, dims.chronology(spark), "a", "b").collect()}
    assert got == {-258: ["EPOCH_01"], -257: ["EPOCH_01"], 938: ["EPOCH_02"], 939: ["EPOCH_03"], 1771: ["EPOCH_09", "EPOCH_10"], 2027: [], -3000: []}
    point = {r["a"]: r["dynasty_id"] for r in R.epoch_of_year(df, dims.chronology(spark), "a").collect()}
    assert point[-258] == "dynasty_van_lang" and point[-257] == "dynasty_au_lac" and point[2027] == "epoch_hien_dai" and point[-3000] == "dynasty_van_lang"


def test_running_budget_keeps_first(spark):
    df = spark.createDataFrame([(1, 1, 900), (1, 2, 10), (2, 1, 5), (2, 2, 5), (2, 3, 100)], "k int, i int, c int")
    assert rows(R.running_budget(df, ["k"], [F.col("i")], "c", 50).select("k", "i")) == [(1, 1), (2, 1), (2, 2)]


def test_rekey(spark):
    e = spark.createDataFrame([("a", "r", "x", 0.5), ("b", "r", "x", 0.9), ("a", "r", "b", 0.7)], "src string, rel string, tgt string, confidence double")
    m = spark.createDataFrame([("b", "a")], "old string, canonical string")
    assert rows(R.rekey(e, m).select("src", "rel", "tgt", "confidence")) == [("a", "r", "x", 0.5)]


def test_conform(spark):
    df = spark.createDataFrame([("a", "b", 1.5)], "source_entity_id string, target_entity_id string, confidence double")
    r = conform(df, "quarantine_triples").first()
    assert r["status"] == "PENDING" and r["violations"] == ["confidence out of range"]


# -- graph
EDGES = [("a", "LED_BY", "b", 0.9), ("b", "PART_OF", "c", 0.5), ("c", "PART_OF", "a", 0.8), ("d", "LED_BY", "b", 0.7), ("a", "MENTIONED_IN", "z", 0.9), ("a", "HAPPENED_AT", "e", 0.49), ("c", "HAPPENED_AT", "f", 0.6)]
EDGE = "src string, rel string, tgt string, confidence double"


def test_bfs(spark):
    e = G.walkable(spark.createDataFrame(EDGES, EDGE))
    seeds = spark.createDataFrame([(1, "a")], "query long, node string")
    seen, kept = G.bounded_bfs(e, seeds, 2, None)
    assert {(r.node, r.hop) for r in seen.collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("f", 2)}
    seen, kept = G.bounded_bfs(e, seeds, 2, 4)
    # Two places are left after the seed's hop; forwards comes before backwards.
    assert {r.node for r in seen.collect()} == {"a", "b", "c", "f"}
    assert ("b", "PART_OF", "c") in {(r.src, r.rel, r.tgt) for r in kept.collect()} and all(r.src != "d" for r in kept.collect())


def test_bfs_lies_in_closure_free_reach(spark):
    e = spark.createDataFrame(EDGES, EDGE)
    closure = {(r.src, r.rel, r.tgt) for r in G.transitive_closure(e).collect()}
    assert {t[:3] for t in EDGES} <= closure and ("a", "HAPPENED_AT", "c") in closure


def test_quarantine_order(spark):
    e = spark.createDataFrame([("a", "r", "a", 0.1), ("a", "r", "b", 0.1), ("a", "r", "q", 0.9), ("a", "r", "b", 0.9)], EDGE)
    n = spark.createDataFrame([("a",), ("b",)], "id string")
    assert sorted(r.route for r in G.quarantine(e, n).collect()) == ["DANGLING", "LOW_CONFIDENCE", "PRODUCTION", "SELF_LOOP"]


# -- retrieval
def test_rrf_by_hand(spark):
    dense = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query long, chunk_id long, rank int")
    lexical = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query long, chunk_id long, rank int")
    c = spark.createDataFrame([(10, "LEVEL_1", None, None, None), (11, "LEVEL_2", 1, None, None), (12, "LEVEL_3", None, 1300, 1300)], "chunk_id long, tier string, parent_id long, time_start int, time_end int")
    q = spark.createDataFrame([(1, 1288)], "query long, year int").withColumn("w", F.struct(F.lit(0.5).alias("dense"), F.lit(0.5).alias("lexical")))
    got = {r.chunk_id: r.score for r in X.hybrid(dense, lexical, c, q, 5).collect()}
    assert got == pytest.approx({10: 0.5 / 61 * 1.35, 11: (0.5 / 62 + 0.5 / 61) * 1.15, 12: 0.5 / 62 * 0.75}, abs=1e-8)


def test_temporal_bands(spark):
    df = spark.createDataFrame([(g,) for g in (0, 2, 5, 15, 30, 31)], "g int")
    assert [r[0] for r in df.orderBy("g").select(X.banded(F.col("g"), X.HYBRID_YEARS, X.HYBRID_BEYOND)).collect()] == [1.25, 1.10, 1.0, 0.75, 0.40, 0.15]


def test_fusion_does_not_depend_on_branch_order(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query long, chunk_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1)], "query long, chunk_id long, rank int")
    one, two = X.fuse([(a, 0.3), (b, 0.7)]), X.fuse([(b, 0.7), (a, 0.3)])
    assert rows(one.select("query", "chunk_id", F.round("score", 9))) == rows(two.select("query", "chunk_id", F.round("score", 9)))


def test_dense_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(50, 8))
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, e array<double>")
    got = {(r.query, r["rank"]): r.chunk_id for r in X.dense_top_k(df.filter("id < 5"), df, 3).collect()}
    for q in range(5):
        n = np.linalg.norm(v, axis=1) * np.linalg.norm(v[q])
        s = np.where(n == 0, 0, np.round(v @ v[q] / np.where(n == 0, 1, n), 9))
        assert [got[q, k] for k in (1, 2, 3)] == sorted(range(50), key=lambda i: (-s[i], i))[:3]


def test_select_context(spark):
    c = [(1, 1, 1, 0.9, "s", 100), (1, 2, 2, 0.8, "s", 3000), (1, 3, 3, 0.7, "t", 10), (2, 4, 1, 0.1, "s", 1), (2, 5, 2, 0.5, "s", 9000)]
    df = spark.createDataFrame(c, "query long, chunk_id long, rank int, score double, source string, tokens long")
    # An overflow stops; a first row beyond the budget stays.
    assert rows(X.select_context(df)) == [(1, 1, 1, 100), (2, 5, 1, 9000)]


def test_stitch(spark):
    w = [f"w{i}" for i in range(60)]
    c = [(1, 1, " ".join(w[:30])), (1, 2, " ".join(w[18:40])), (1, 4, " ".join(w[31:50]))]
    got = rows(X.stitch(spark.createDataFrame(c, "parent_id long, idx long, content string")))
    assert got == [(1, 1, 2, " ".join(w[:40]), 12), (1, 4, 4, " ".join(w[31:50]), 0)]
    nine = [(1, 1, " ".join(w[:30])), (1, 2, " ".join(w[21:40]))]
    assert X.stitch(spark.createDataFrame(nine, "parent_id long, idx long, content string")).first().words_saved == 0


# -- text and sources
def test_string_functions(spark):
    t = F.col("t")
    assert value(spark, T.unaccent(t), "Trần Hưng Đạo") == "Tran Hung Dao"
    assert value(spark, T.slug(t), "Trần  Hưng-Đạo!") == "tran_hung_dao"
    assert value(spark, T.strip_banner(t), "[a] [b]\nrest") == "rest"
    assert value(spark, T.clean_wiki(t), "[[A|b]] '''c''' {{d}}<ref>e</ref>") == "b c "
    assert value(spark, T.query_normal(t), "Ai???  đó") == "ai? đó"
    assert value(spark, T.sanitize_terms(t, ["the"]), "The & cat") == ["cat"]
    assert value(spark, T.sanitize_terms(t, ["the"]), "the") == ["the"]
    assert value(spark, O.extract_years(t), "In 1288 and 40, 938-939; 12345 and 1288") == [1288, 938, 939]


def test_front_matter(spark):
    m = value(spark, S.front_matter(F.col("t")), "---\nTitle: 'A: b'\nx: 1\n...\nBody\n---\n")
    assert m["metadata"] == {"title": "A: b", "x": "1"} and m["body"] == "Body\n---\n"
    assert value(spark, S.front_matter(F.col("t")), "no head")["body"] == "no head"


def test_scrape(spark):
    html = "<title>T</title><nav>n</nav><main><p>a <b>b</b></p><div class='ad x'>no</div><script>s</script></main><footer>f</footer>"
    df = spark.createDataFrame([(1, html), (2, "<h1>H</h1><body>x"), (3, None)], "page_id long, html string")
    assert rows(S.scrape(df)) == [(1, "T", "a b"), (2, "H", "x"), (3, "", "")]


def test_files(spark, tmp_path):
    (tmp_path / "pdf").mkdir()
    for name in ("a.md", "b.txt", "c.csv", "pdf/d.txt"):
        (tmp_path / name).write_text(name)
    assert sorted(r.raw for r in S.read_files(spark, str(tmp_path)).collect()) == ["a.md", "b.txt"]


def test_chunk_bounds():
    for n in (1, 299, 300, 500, 501, 799, 800, 801, 1700, 5000):
        words = [f"w{i}" + ("." if i % 13 == 0 else "") for i in range(n)]
        spans = O.child_spans(words[:2500])
        covered = set()
        for a, b in spans:
            assert b > a and b - a <= 500
            covered |= set(range(a, b))
        assert covered == set(range(min(n, 2500)))
        chunks = list(O.chunk_document(1, "t", " ".join(words)))
        assert sum(c[5] for c in chunks if c[2] is None) == n
    assert list(O.chunk_document(1, "t", "")) == []


def test_gazetteer_takes_the_longest(spark):
    df = spark.createDataFrame([(1, "The of the cat"), (2, None)], "doc_id long, text string")
    assert rows(O.gazetteer_spans(df, ["of", "of the"])) == [(1, 4, 10, "of the")]


# -- metrics
def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 9, 1), (3, 1, 1)], "query long, chunk_id long, rank int")
    gold = spark.createDataFrame([(1, 2, 3), (1, 3, 1), (3, 1, 1)], "query long, chunk_id long, grade int")
    got = {r["query"]: r for r in E.ranking_metrics(ranked, gold).collect()}
    import math

    assert got[1].ndcg == pytest.approx((7 / math.log2(3)) / (7 + 1 / math.log2(3)), abs=1e-6) and got[1].mrr == 0.5 and got[1].map == 0.25 and got[1].recall == 0.5 and got[1].precision == 0.5
    assert (got[2].ndcg, got[2].mrr, got[2].map, got[2].recall, got[2].precision) == (1, 0, 1, 1, 0)
    assert (got[3].ndcg, got[3].mrr, got[3].map) == (1, 0, 1)


def test_pair_accuracy_with_ties(spark):
    df = spark.createDataFrame([("k", 1, 0), ("k", 2, 0), ("k", 2, 1), ("k", 3, 1)], "k string, s int, g int")
    assert E.pair_accuracy(df, "k", "s", "g").first()[1:] == (3, 4, 0.75)


def test_bootstrap_is_fixed(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 1.0)], "k string, v double")
    r = E.bootstrap(df, "k", "v", rounds=200).first()
    assert 0 <= r.low <= r.high <= 1 and rows(E.bootstrap(df, "k", "v", rounds=200)) == [tuple(r)]
