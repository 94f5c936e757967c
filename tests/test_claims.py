"""Ordered claim checks, years, mentions, repeated passages and anchors on hand-made rows."""

import math
import re
import statistics

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import claims as C
from quarry.operators import evaluation as E
from quarry.operators import retrieval as X
from quarry.operators import text as O

NAMES = [("ngo_quyen", "ngô quyền"), ("hoang_thao", "hoằng tháo")]

CLAIMS = [
    ("", "x", "NOT_SUPPORTED", "EMPTY"),
    (None, "x", "NOT_SUPPORTED", "EMPTY"),
    ("là", "x", "ENTAILED", "NO_CONTENT_WORDS"),
    ("mưa lớn phương bắc", "hoa nở vườn nhà", "NOT_SUPPORTED", "NO_TOPICAL_OVERLAP"),
    ("Ngô Quyền đánh bại Hoằng Tháo", "Hoằng Tháo đánh bại Ngô Quyền", "CONTRADICTED", "AGENT_TARGET_INVERSION"),
    ("Ngô Quyền đánh bại Hoằng Tháo", "Hoằng Tháo bị quân đánh bại bởi Ngô Quyền", "ENTAILED", None),
    ("quân Nam chiến thắng", "quân Nam thất bại", "CONTRADICTED", "CLAIM_VICTORY_EVIDENCE_DEFEAT"),
    ("quân Nam thất bại", "quân Nam thắng lợi", "CONTRADICTED", "CLAIM_DEFEAT_EVIDENCE_VICTORY"),
    ("quân Nam không phải chiến thắng", "quân Nam chiến thắng", "CONTRADICTED", "EXPLICIT_NEGATION"),
    ("Trãi là con của Khanh", "Trãi là cha của Khanh", "CONTRADICTED", "KINSHIP_CONFLICT"),
    ("Trãi là con của Lợi", "Trãi là con của Khanh", "CONTRADICTED", "KINSHIP_TARGET_CONFLICT"),
    ("trận sông lớn năm 938", "trận sông lớn năm 1288", "NOT_SUPPORTED", "TEMPORAL_MISMATCH"),
    ("trận sông lớn năm 938", "trận sông lớn vào năm 938", "ENTAILED", None),
    ("một hai ba bốn năm sáu", "một x ba y năm z", "NEUTRAL", None),
    ("một hai ba bốn năm", "một", "NOT_SUPPORTED", None),
]


def test_ordered_entailment(spark):
    df = spark.createDataFrame([(i, c, e) for i, (c, e, *_) in enumerate(CLAIMS)], "i int, claim string, evidence string")
    df = df.withColumns({f"{s}_spans": C.name_spans(F.col(s), NAMES) for s in ("claim", "evidence")})
    got = {r["i"]: (r["verdict"], r["reason"]) for r in C.checked_entailment(df, ["là"]).collect()}
    assert got == {i: tuple(x[2:]) for i, x in enumerate(CLAIMS)}


def test_scores_with_and_without_entities(spark):
    df = spark.createDataFrame([("ngô quyền thắng lớn", "ngô quyền thắng"), ("một hai ba", "một hai")], "claim string, evidence string")
    df = df.withColumns({f"{s}_spans": C.name_spans(F.col(s), NAMES) for s in ("claim", "evidence")})
    got = [r["score"] for r in C.checked_entailment(df, []).collect()]
    assert got == [round(0.35 * 3 / 4 + 0.35 * 2 / 3 + 0.3, 3), round(0.55 * 2 / 3 + 0.45 / 2, 3)]


def test_years(spark):
    texts = ["năm 938 và 1288, 99, 2051, x1234, 938", "từ 1941 đến 1954", "3000 - 40 rồi 1500", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r[0], r[1]["start_year"], r[1]["end_year"]) for r in df.select(C.routing_years(F.col("t")), C.time_range(F.col("t"))).collect()]
    assert got == [([938, 1288], 938, 1288), ([1941, 1954], 1941, 1954), ([1500], 1500, 1500), ([], None, None), (None, None, None)]


def test_time_bounds(spark):
    texts = ["năm 40 TCN", "năm 938 quân", "thời 12 và 257 TCN", "1288 thuyền, 1789", "năm 12345", "208 trước công nguyên", None]
    got = [r[0] and sorted(r[0]) or r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(C.time_bounds(F.col("t"))).collect()]
    assert got == [[-40], [], [-257, 12], [1789], [], [-208], None]


def test_mentions(spark):
    c = [(1, "person_a", "Lê Lợi", "PERSON"), (1, "unknown_b", "Lê Lợi vua nước", "UNKNOWN"), (1, "event_c", "Chi Lăng", "EVENT_BATTLE"), (2, "loc_d", "sông", "LOCATION"), (None, "x", "y", "z")]
    m = [(1, " PERSON_A "), (1, "lê lợi"), (1, "thời Lê Lợi vua nước Nam"), (1, "chien_dich lon"), (1, "khác"), (1, None), (1, ""), (2, "dòng sông dài"), (3, "sông"), (None, "y"), (1, "khác")]
    got = C.snap_mentions(spark.createDataFrame(m, "k int, mention string"), spark.createDataFrame(c, "k int, id string, text string, type string"), "k")
    got = {(r["k"], r["mention"]): (r["id"], r["step"]) for r in got.collect()}
    none = (None, None)
    assert got == {(1, " PERSON_A "): ("person_a", 1), (1, "lê lợi"): ("person_a", 2), (1, "thời Lê Lợi vua nước Nam"): ("person_a", 3), (1, "chien_dich lon"): ("event_c", 4), (1, "khác"): none,
                   (1, None): none, (1, ""): none, (2, "dòng sông dài"): ("loc_d", 3), (3, "sông"): none, (None, "y"): none}


def brute_dedup(text):
    """The rule of P30 for one text, in a loop."""
    if text is None or not text.strip():
        return text
    norm = lambda s: re.sub(r"[.,!?:;\s]+", " ", s.lower())
    paragraphs, sentences, out = set(), set(), []
    for par in filter(None, (p.strip() for p in re.split(r"\n{2,}", text))):
        if len(par) >= 35 and norm(par) in paragraphs:
            continue
        paragraphs.add(norm(par))
        kept = []
        for s in filter(None, (s.strip() for s in re.split(r"(?<=[.?!])\s+", par))):
            if len(s) >= 25:
                if norm(s) in sentences:
                    continue
                sentences.add(norm(s))
            kept.append(s)
        if kept:
            out.append(" ".join(kept))
    return "\n\n".join(out)


def test_passages(spark):
    long = "This is a sentence of many words. "
    texts = [long + "Short. Short. " + long, "\n\n".join([long * 2, long.upper() + long, "ab", "ab", long + "New words come at the very end!"]), "x" * 40 + "\n\n\n" + "x" * 40 + "\n\n", "", "  ", None, " a.  b \n\n\n c", long * 3000]
    rows = [(i // 2 if i != 3 else None, t) for i, t in enumerate(texts)]
    got = C.dedup_text(spark.createDataFrame(rows, "doc_id int, text string").repartition(3)).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(tuple, got), key=key) == sorted(((i, brute_dedup(t)) for i, t in rows), key=key)


def test_anchors(spark):
    rules = [C.Anchor("A", entities=("p1",), pattern=r"\blê hoàn\b", years=(981,), words=("bạch đằng",)), C.Anchor("B", years=(938, 981, 1288), least=2), C.Anchor("C", words=("sông",))]
    q = [(1, "Lê Hoàn", None, None), (2, "trận Bạch Đằng", ["p2", "p2", "p9"], [981]), (3, "938 và 1288 trên sông", ["p1"], []), (4, None, ["p3"], None)]
    e = [("p1", "Một", "Lý", -5, 40), ("p2", "Hai", None, 981, None), ("p3", "Ba", None, None, None)]
    got = C.chronology_anchors(spark.createDataFrame(q, "query int, text string, ids array<string>, years array<int>"), spark.createDataFrame(e, "id string, name string, dynasty string, first_year int, last_year int"), rules)
    got = {r["query"]: (r["anchors"], r["bullets"]) for r in got.collect()}
    assert got == {1: (["A"], []), 2: (["A"], ["- Hai: Niên đại: 981"]), 3: (["A", "B", "C"], ["- Một: Triều đại: Lý | Niên đại: 5 TCN - 40"]), 4: ([], [])}


def test_paired_t(spark):
    rows = [("a", 1.0, 2.0), ("b", 1.0, 2.0), ("b", 2.0, 3.0), ("c", 1.0, 1.0), ("c", 2.0, 2.0), *[("d", float(i), i + (i % 3)) for i in range(30)], ("e", None, 1.0)]
    got = {r["k"]: (r["n"], r["t"], r["p"], r["significant"]) for r in E.paired_t(spark.createDataFrame([(k, a, None if b is None else float(b)) for k, a, b in rows], "k string, a double, b double"), "k", "a", "b").collect()}
    diffs = [i % 3 for i in range(30)]
    t = statistics.mean(diffs) / (statistics.stdev(diffs) / 30**0.5)
    assert got["a"] == (1, 0.0, 1.0, False) and got["b"] == (2, math.inf, 0.0, True) and got["c"] == (2, 0.0, 1.0, False) and got["e"] == (0, 0.0, 1.0, False)
    assert got["d"][:2] == (30, round(t, 4)) and abs(got["d"][2] - math.erfc(t / 2**0.5)) < 1e-5
    assert abs(spark.range(1).select(E.upper_tail(F.lit(1.96))).first()[0] - 0.025) < 1e-5


def test_class_averages(spark):
    df = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), (None, "z")], "a string, b string")
    r = E.class_averages(df, "a", "b").first()
    assert (r["rows"], r["accuracy"], r["micro_precision"], r["micro_recall"]) == (4, 0.5, 0.5, round(2 / 3, 6))
    assert (r["classes"], r["macro_precision"], r["macro_recall"], r["macro_f1"]) == (3, 0.5, 0.5, 0.44444)
    assert E.class_averages(df.limit(0), "a", "b").first()["rows"] == 0


def test_number_words(spark):
    want = {0: "không", 5: "năm", 10: "mười", 15: "mười lăm", 21: "hai mươi mốt", 24: "hai mươi tư", 105: "một trăm lẻ năm", 111: "một trăm mười một", 1000: "một nghìn", 1005: "một nghìn không trăm lẻ năm", 1284: "một nghìn hai trăm tám mươi tư",
            -40: "âm bốn mươi", 2_000_015: "hai triệu không trăm mười lăm", 10**9: "một tỷ", 999_999_999_999_999: None, 10**15: None, None: None}
    got = dict(map(tuple, spark.createDataFrame([(n,) for n in want], "n long").select("n", T.number_words(F.col("n"))).collect()))
    nine = "chín trăm chín mươi chín"
    want[999_999_999_999_999] = f"{nine} nghìn tỷ {nine} tỷ {nine} triệu {nine} nghìn {nine}"
    assert got == want


def test_weights(spark):
    rows = ["năm Canh Thìn", "canh thìnx", "trận 938", "nguyên nhân", "Nguyên nhân", "x"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(X.weights(F.col("t"))["dense"]).collect()]
    assert got == [0.3, 0.5, 0.3, 0.6, 0.5, 0.5]


def test_span_scores(spark):
    p = [("a", 0, 5, "Huế"), ("a", 10, 14, "x"), ("a", 30, 35, " sông "), ("c", 0, 2, "y")]
    g = [("a", 1, 0, 5, "?", True), ("a", 2, 12, 20, "??", False), ("a", 3, 50, 55, "Sông", False), ("a", 4, 70, 75, "z", False), ("b", 5, 0, 3, "q", None)]
    got = E.span_scores(spark.createDataFrame(p, "k string, start int, end int, name string"), spark.createDataFrame(g, "k string, id int, start int, end int, name string, known boolean"), "k", 10)
    assert {r["k"]: tuple(r)[1:] for r in got.collect()} == {"a": (4, 3, 2, 1, 66.67, 50.0, 57.14, 66.67), "b": (1, 0, 0, 0, 0.0, 0.0, 0.0, 0.0), "c": (0, 1, 0, 0, 0.0, 0.0, 0.0, 100.0)}


def test_longest_names(spark):
    rows = [(1, "The of the end; of The"), (2, None), (None, "of of the the"), (3, "")]
    got = O.gazetteer_spans(spark.createDataFrame(rows, "doc_id long, text string"), ["the", "of the", "The", "", "of the end now"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, 3, "the"), (1, 4, 10, "of the"), (1, 16, 22, "of the"), (None, 3, 9, "of the"), (None, 10, 13, "the")], key=str)
