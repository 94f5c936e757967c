"""More operators on hand-made rows."""

import zlib

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import dialogue as D
from quarry.operators import evaluation as E
from quarry.operators import grounding as V
from quarry.operators import retrieval as X
from quarry.operators import text as O
from quarry.sources.pdf import pdf_text, read_pdfs
from quarry.streaming import state as R


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def value(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr).first()[0]


def test_pdf(spark, tmp_path):
    page = b"BT /F1 12 Tf (Hello \\(w\\051) Tj 0 -14 Td <48 69> Tj ET"
    raw = b"%PDF\n1 0 obj\nstream\n" + zlib.compress(page) + b"\nendstream\n2 0 obj\nstream\n\x00\x01\nendstream"
    assert pdf_text(raw) == "Hello (w)\nHi" and pdf_text(b"") == ""
    (tmp_path / "a.pdf").write_bytes(raw)
    assert read_pdfs(spark, str(tmp_path)).first().text == "Hello (w)\nHi"


def test_repairs(spark):
    t = F.col("t")
    assert value(spark, T.repair_inner_case(t), "a heLlo McD X USA") == "a hello Mcd X USA"
    assert value(spark, T.unwrap_tables(t), "| a | b |\n|---|---|\ntext") == "a b\ntext"
    assert value(spark, T.repair_json(t), 'x ```json\n{"a": [1,],}\n```') == '{"a": [1]}' and value(spark, T.repair_json(t), "none") is None
    assert value(spark, T.valid_span(t, ["thing"]), "Thing") is False and value(spark, T.valid_span(t, []), "A b") is True and value(spark, T.valid_span(t, []), "1 b") is False
    df = spark.createDataFrame([(1, "a line that is long enough to be wrapped\nand goes on\n- item"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in O.unwrap_lines(df).collect()} == {1: "a line that is long enough to be wrapped and goes on\n- item", 2: None}
    df = spark.createDataFrame([(1, "ng uyen van a n"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in O.heal_syllables(df, ["nguyen", "an", "van"]).collect()} == {1: "nguyen van an", 2: None}


def test_rules(spark):
    docs = spark.createDataFrame([(1, "Ann led the war. Bob war"), (2, "Ann war")], "doc_id long, text string")
    spans = O.gazetteer_spans(docs, ["ann", "bob", "war"]).withColumn("kind", F.when(F.col("name") == "war", "e").otherwise("p"))
    got = rows(O.rule_triples(spans, docs, [("p", "e", "LED_BY", "led", 80), ("p", "e", "NEAR", ".*", 80)]).select("doc_id", "src", "rel", "tgt"))
    assert got == [(1, "ann", "LED_BY", "war"), (1, "bob", "NEAR", "war"), (2, "ann", "NEAR", "war")]


def test_entailment(spark):
    df = spark.createDataFrame([("a cat sat", "a cat sat down"), ("born 1288", "born 1289"), ("", "x"), ("xx yy", "zz")], "claim string, evidence string")
    assert [r.verdict for r in V.entailment(df, ["a"]).collect()] == ["ENTAILED", "NOT_SUPPORTED", "NEUTRAL", "NOT_SUPPORTED"]


def test_licences(spark):
    names = ["CC_BY_SA_3_0", "cc by-nc 4.0", "Public Domain", "", None, "ALL RIGHTS RESERVED", "CC0"]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    assert [r[0] for r in df.select(V.license_allowed(F.col("t"))).collect()] == [True, False, True, False, False, False, True]
    assert [r[0] for r in df.select(V.license_type(F.col("t"))).collect()][:1] == ["CC_BY_SA_4_0"]


def test_merge_and_rules(spark):
    e = lambda *x: spark.createDataFrame(list(x), "src string, rel string, tgt string")
    got = V.residual_merge([e(("a", "r", "b")), e(("a", "r", "b"), ("b", "q", "a")), e(("a", "z", "b"), ("a", "z", "c"))], [False, False, True])
    assert rows(got) == [("a", "r", "b", 0), ("a", "z", "c", 2), ("b", "q", "a", 1)]
    got = V.canonicalize(e(("person_1", "LED_BY", "event_1"), ("event_1", "LED_BY", "person_1"), ("x", "BAD", "y")), [("LED_BY", "person_", "event_", "LED_BY", True), ("BAD", "", "", "", False)])
    assert rows(got.select("src", "rel", "tgt")) == [("event_1", "LED_BY", "person_1")] * 2


def test_batches_and_scenes(spark):
    df = spark.createDataFrame([(i, 0, "x" * 2000) for i in range(20)] + [(30, 1, None)], "doc_id long, slice long, text string")
    got = {r.doc_id: r.batch for r in D.embedding_batches(df).collect()}
    assert got[8] == 0 and got[9] == 1 and got[18] == 2 and got[30] == 0
    s = spark.createDataFrame([(1, " ".join(["w"] * 60) + ". " + "v " * 5 + "."), (2, None), (3, "one.")], "doc_id long, text string")
    assert rows(D.scenes(s)) == [(1, 0, 66), (3, 0, 1)]


def test_breaker(spark):
    rows_ = [("k", i, i, x) for i, x in enumerate("bbbgbbgbbbb")]
    df = spark.createDataFrame(rows_, "k string, ts int, event_id int, t string")
    assert [r.event_id for r in D.breaker_trips(df, "k", F.col("t") == "b", 3).orderBy("event_id").collect()] == [2, 9]


def test_loops_alike_in_stream_and_batch(spark, tmp_path):
    long = "a line of more than twenty-five characters"
    data = [("s", i, x) for i, x in enumerate([long, long, "b", long, long, long, long])] + [("t", i, "short") for i in range(5)] + [("u", 0, None)]
    df = spark.createDataFrame(data, R.LOOPS)
    df.write.parquet(str(tmp_path / "in"))
    want = [("s", 5, long)]
    assert rows(R.loops_in_batch(df).select("stream", "seq", "line")) == want
    stream = spark.readStream.schema(R.LOOPS).parquet(str(tmp_path / "in"))
    assert rows(R.run_once(R.detect_loops(stream), str(tmp_path / "out"), str(tmp_path / "cp"))) == want


def test_window_of_most_hits(spark):
    text = "x" * 250 + "cat cat" + "y" * 400
    assert value(spark, V.best_window(F.col("t"), F.array(F.lit("cat")), 100), text) == 200


def test_bootstrap_against_one_sequential_generator(spark):
    import math

    values = [(q % 7) / 10 for q in range(23)]
    df = spark.createDataFrame([("r", v, v / 2) for v in values] + [("r", None, 1.0)], "run string, a double, b double").repartition(3)
    for other, x in ((None, sorted(values)), ("b", sorted(v / 2 - v for v in values))):
        state, means = 42, []
        for _ in range(300):
            total = 0.0
            for _ in range(len(x)):
                state = (state * 1664525 + 1013904223) % 4294967296
                total += x[math.floor(state / 4294967296 * len(x))]
            means.append(total / len(x))
        means.sort()
        r = E.bootstrap(df, "run", "a", other, rounds=300).first()
        assert (r.run, r.n) == ("r", 23) and abs(r.low - means[7]) < 2e-6 and abs(r.high - means[292]) < 2e-6


def test_title_hits_count_twice_more(spark):
    terms = spark.createDataFrame([(1, "war"), (1, "war"), (1, "north")], "query long, term string")
    body = spark.createDataFrame([("war", 5), ("north", 5), ("war", 6), ("other", 7)], "token string, chunk_id long")
    heads = spark.createDataFrame([("war", 6), ("north", 8)], "token string, chunk_id long")
    assert rows(X.lexical_scores(terms, body, heads)) == [(1, 5, 2.0), (1, 6, 3.0), (1, 8, 2.0)]


def test_rows_without_an_id_keep_their_chunks(spark):
    from quarry.operators import text as TX

    docs = spark.createDataFrame([(None, "s", "A first line. A second one."), (1, "s", "One more line here.")], "doc_id long, source string, text string")
    assert {r.doc_id for r in TX.chunk_documents(docs).collect()} == {None, 1}
    assert {r.doc_id for r in D.scenes(docs).collect()} == {None, 1}


def test_chapters_in_blocks_have_the_latest_start_before_them(spark, monkeypatch):
    monkeypatch.setattr(V, "CHAPTERS", 2)
    chapters = spark.createDataFrame([(k, y, y + 10) for k, y in enumerate((1000, 900, 1200, 1100, 1300))], "chapter long, start_year int, end_year int")
    chunk_words = spark.createDataFrame([(c, "w") for c in range(3)], "chunk_id long, token string")
    chapter_words = spark.createDataFrame([(k, "w") for k in range(5)], "chapter long, token string")
    years = spark.createDataFrame([(0, 950), (1, 1150), (2, 1305)], "chunk_id long, year int")
    got = {(r.chapter, r.chunk_id): r.score for r in V.route_to_chapters(chunk_words, chapter_words, years, chapters).collect()}
    floors = [None, 1000, 1000, 1200, 1200]
    for k, start in enumerate((1000, 900, 1200, 1100, 1300)):
        low = start - 15 if floors[k] is None else max(start - 15, floors[k])
        for c, y in ((0, 950), (1, 1150), (2, 1305)):
            inside, outside = low <= y <= start + 25, y < start - 35 or y > start + 45
            assert got[k, c] == 10 + 30 * inside - (20 * outside if not inside else 0) - (50 if floors[k] is not None and y < floors[k] else 0)
