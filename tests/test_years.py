"""Years of questions and texts against plain walks over the text; branches of questions on hand-made rows."""

import random
import re

from pyspark.sql import functions as F

from quarry import dims
from quarry.operators import names as N
from quarry.operators import years as Y

REIGNS = [("Hồng Đức", 1470, 1497), ("Cảnh Hưng", 1740, 1786), ("Thái Bình", 970, 980)]
ERA = r"(?:tcn|trước\s+công\s+nguyên|trước\s+cn)"
NOT_IN = r"(?![^\W])"


def brute(text):
    """One pass a rule, with every number looked at in the whole text."""
    low, out, span = (text or "").lower(), [], None
    for m in re.finditer(r"\b(\d{3,4})\s*[-–—]\s*(\d{3,4})\b", low, re.A):
        a, b = int(m[1]), int(m[2])
        if 100 <= a <= 2100 and 100 <= b <= 2100:
            out += [a, b]
            span = (min(a, b), max(a, b))
    out += [-int(m[1]) for m in re.finditer(rf"(\d{{1,4}})\s*{ERA}{NOT_IN}", low) if int(m[1])]
    roman = {r: k + 1 for k, r in enumerate(Y.ROMAN)}
    for m in re.finditer(rf"(?:thế\s+kỷ|thế\s+kỉ|tk)\s*(?:thứ\s+)?([ivxlcdm]+|\d{{1,2}}){NOT_IN}", low):
        n = int(m[1]) if m[1].isdigit() else roman.get(m[1], 0)
        if 1 <= n <= 21:
            out.append(n * 100 - 50)
            span = span or (n * 100 - 99, n * 100)
    for name, a, b in REIGNS:
        if re.search(rf"(?<!\w){name.lower()}(?!\w)", low):
            out.append((a + b + 1) // 2)
            span = span or (a, b)
    out += [int(m[1]) for m in re.finditer(r"năm\s+(\d{1,2})(?![A-Za-z0-9_])(?!\s*(?:tcn|trước))", low) if int(m[1])]
    for m in re.finditer(r"(?<![A-Za-z0-9_])\d{3,4}(?![A-Za-z0-9_])", low):
        y, after, before = int(m[0]), low[m.end() :].strip(), low[: m.start()].strip()
        unit = re.match(rf"(?:{Y.COUNTED}){NOT_IN}", after)
        spent = re.match(rf"năm{NOT_IN}", after) and before not in Y.OPENING.split("|")
        counted = re.search(rf"(?:{Y.COUNTING})$", before) and y <= 500
        if 100 <= y <= 2100 and not unit and not spent and not counted and not re.match(rf"{ERA}{NOT_IN}", after):
            out.append(y)
    return list(dict.fromkeys(out)), span


def test_question_years_as_the_walk(spark):
    rng = random.Random(3)
    parts = ["năm", "938", "40", "1288", "1407-1427", "1945 – 1954", "257 TCN", "thế kỷ XIII", "thế kỉ thứ 10", "tk 30", "thế kỷ iiii", "vạn", "quân", "quân đội", "top", "thứ", "hơn", "từ", "trong", "năm,", "thời Hồng Đức", "thái bình", "Thái Bìnhx",
             "trước công nguyên", "trước cn", ".", "2101", "0", "99", "12345", "150", "500", "501", "m", "một", "giờ", "chữ", "555-5433", "\n", "1000 năm", "trong 1000 năm", "niên hiệu Cảnh Hưng"]
    texts = [" ".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(1500)] + ["", None, "trong 938 năm", "từ 938 năm", "năm 938 trong 150 năm", "1407-1427-1500", "năm 40 TCN", "năm 40", "thế kỷ Vị", "257tcn"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", Y.question_years(F.col("text"), REIGNS).alias("y")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.i])
        assert (r.y.years, r.y.range and tuple(r.y.range)) == want, texts[r.i]


def test_question_years_by_hand(spark):
    cases = {
        "So sánh năm 938 và 1288": [938, 1288], "Có 500 quân và 300 người": [], "hơn 500 và hơn 501": [501], "kéo dài 150 năm": [], "Năm 257 TCN": [-257], "thế kỷ XV": [1450], "đời Hồng Đức": [1484], "năm 40": [40],
    }
    got = spark.createDataFrame([(k,) for k in cases], "text string").select("text", Y.question_years(F.col("text"), REIGNS)["years"].alias("y")).collect()
    assert {r.text: r.y for r in got} == cases
    none = spark.createDataFrame([("đời Hồng Đức",)], "text string").select(Y.question_years(F.col("text")).alias("y")).head().y
    assert none.years == [] and none.range is None


def test_text_bounds_and_realm(spark):
    cases = [
        ("Năm 1010 và năm 1225.", 1010, 1225, None), ("khoảng 257 TCN đến 40", -257, -257, None), ("thế kỷ XV", 1401, 1500, None), ("thế kỷ Vị", None, None, None), ("938TCN", -938, -938, None), ("năm 12345", None, None, None),
        ("799 và 2027", None, None, None), ("năm 799", 799, 799, None), ("Nhà Trần và nhà Lý", None, None, "Nhà Trần"), ("nhà Trầns", None, None, None), ("năm 43, hai bà Trưng", 43, 43, "Trưng Nữ Vương"), ("", None, None, None), (None, None, None, None),
        ("thế kỷ 2 trước công nguyên", -2, -2, None), ("3001 TCN", None, None, None),
    ]
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(cases)], "i int, text string")
    for r in df.select("i", Y.text_bounds(F.col("text")).alias("b"), Y.realm_of(F.col("text")).alias("realm")).collect():
        assert (r.b.time_start, r.b.time_end, r.realm) == cases[r.i][1:], cases[r.i]


def test_enriched(spark):
    names = spark.createDataFrame([(2, "p1", "Ngô Quyền", "Ngô Quyền", N.PERSON), (1, "p2", "Lý Thái Tổ", "Lý Thái Tổ", N.PERSON), (3, "l1", "Thăng Long", "Thăng Long", N.PLACE), (0, "l2", "Cổ Loa", "Cổ Loa", N.PLACE), (9, "e", "Bạch Đằng", "Bạch Đằng", N.EVENT)], "ord long, id string, canonical string, name string, type string")
    docs = spark.createDataFrame([(1, "Ngô Quyền năm 938 và ly thai to ở Thăng Long, Cổ Loa. Ngô Quyền!", "x"), (2, "Bạch Đằng", "x"), (3, None, None), (None, "Thăng Long năm 1010", None), (2, "Thăng Long", "y")], "doc_id long, text string, figures string")
    got = Y.enriched(docs, names, dims.chronology(spark))
    assert got.columns == ["doc_id", "time_start", "time_end", "realm", "dynasty_id", "figures", "location"]
    rows = sorted(map(tuple, got.collect()), key=repr)
    want = [
        (1, 938, 938, "Nhà Lý", "epoch_bac_thuoc", ["Lý Thái Tổ", "Ngô Quyền"], "Cổ Loa"), (2, None, None, None, None, [], "Thăng Long"), (2, None, None, None, None, [], "Thăng Long"),
        (3, None, None, None, None, [], None), (None, 1010, 1010, None, "dynasty_ly", [], None),
    ]
    want[0] = (*want[0][:3], "Nhà Ngô", *want[0][4:])  # the unmarked name is no phrase of a realm
    assert rows == sorted(want, key=repr)
    assert Y.enriched(docs.limit(0), names, dims.chronology(spark)).count() == 0


def test_branches(spark):
    queries = spark.createDataFrame(
        [(1, "So sánh 938 và 1288, 981 với 1075 và 1945.", None), (2, "Trận nào lớn? Ngô Quyền và Thăng Long.", True), (3, "Ngô Quyền và Thăng Long", False), (4, None, True), (5, "Năm 938", True)], "query long, text string, comparative boolean")
    mentions = spark.createDataFrame(
        [(1, 0, "person_nq", "Ngô Quyền", N.PERSON, 897, 944), (1, 1, "event_1288", "Bạch Đằng", N.EVENT, None, None), (2, 1, "person_nq", "Ngô Quyền", N.PERSON, 897, 944), (2, 0, "loc_tl", "Thăng Long", N.PLACE, 1010, None), (2, 2, "p2", "Lý Bí", N.PERSON, 503, 548), (3, 0, "loc_tl", "Thăng Long", N.PLACE, None, None), (3, 1, "person_nq", "Ngô Quyền", N.PERSON, 897, 944)],
        "query long, ord int, id string, name string, type string, first int, last int")
    got = {(r.query, r.branch): (r.text, r.target_year, r.entities) for r in Y.branches(queries, mentions).collect()}
    assert got == {
        (1, 0): ("So sánh 938 và , với và . Ngô Quyền năm 938", 938, ["person_nq"]),
        (1, 1): ("So sánh và , 981 với và . năm 981", 981, ["person_nq", "event_1288"]),
        (1, 2): ("So sánh và , với 1075 và . năm 1075", 1075, ["person_nq", "event_1288"]),
        (1, 3): ("So sánh và 1288, với và . Bạch Đằng năm 1288", 1288, ["event_1288"]),
        (2, 0): ("Ngô Quyền và Thăng Long. Ngô Quyền", 897, ["person_nq"]),
        (2, 1): ("Ngô Quyền và Thăng Long. Thăng Long", 1010, ["loc_tl"]),
        (2, 2): ("Trận nào lớn? Ngô Quyền và Thăng Long. Lý Bí", 503, ["p2"]),
        (3, 0): ("Ngô Quyền và Thăng Long", None, ["loc_tl", "person_nq"]),
        (4, 0): ("", None, []),
        (5, 0): ("Năm 938", 938, []),
    }


def test_effective_bounds(spark):
    chronology = [("E1", "Nhà Lý", 1010, 1225), ("E2", "Nhà Trần", 1226, 1399)]
    rows = [
        ("Trận 1288", 1, 2, None, None, (1288, 1288)), ("Trận 899", 1, None, None, None, (1, None)), (None, None, None, ["E2", "E1"], None, (1010, 1225)), (None, None, None, [], "TRẦN ", (1226, 1399)),
        (None, None, None, ["E9"], "Trần", (None, None)), ("", None, None, None, "", (None, None)), ("a1288", None, None, None, None, (None, None)),
    ]
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(rows)], "i int, title string, s int, e int, ep array<string>, d string")
    for r in df.select("i", Y.effective_bounds(F.col("title"), F.col("s"), F.col("e"), F.col("ep"), F.col("d"), chronology).alias("b")).collect():
        assert tuple(r.b) == rows[r.i][5], rows[r.i]


def test_premise_conflicts(spark):
    people = [("Ngô Quyền", 897, 944), ("Võ Nguyên Giáp", 1911, 2013), ("Vô danh", None, None)]
    cases = [
        ("Sơn Tinh ký hiệp định Giơ-ne-vơ", [], (Y.MYTH, "sơn tinh", "hiệp định")), ("son tinh va hiep dinh", [], (Y.MYTH, "sơn tinh", "hiệp định")), ("sơn tinhx hiệp định", [], None),
        ("Ngô Quyền dùng xe tăng", [0], (Y.ANACHRONISM, "xe tăng", "Ngô Quyền")), ("Võ Nguyên Giáp dùng xe tăng", [1], None), ("xe tăng ở Bạch Đằng", [], (Y.ANACHRONISM, "xe tăng", "bạch đằng")), ("xe tăng ở Bạch Đằng năm 1288", [], (Y.ANACHRONISM, "xe tăng", "bạch đằng")),
        ("xe tăng ở Bạch Đằng năm 1972", [], None), ("Ngô Quyền năm 1288", [0], (Y.MISMATCH, "Ngô Quyền", "1288")), ("Ngô Quyền năm 1044", [0], None), ("Ngô Quyền năm 1045", [0], (Y.MISMATCH, "Ngô Quyền", "1045")), ("So sánh Ngô Quyền năm 1288", [0], None),
        ("Vô danh năm 1288", [2], None), ("Vô danh và Ngô Quyền năm 257 TCN", [2, 0], None), ("Võ Nguyên Giáp, Ngô Quyền, 1950 và 1288", [1, 0], (Y.MISMATCH, "Võ Nguyên Giáp", "1288")), ("", [], None), (None, [0], None),
    ]
    queries = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "query long, text string")
    named = spark.createDataFrame([(i, k, *people[p]) for i, c in enumerate(cases) for k, p in enumerate(c[1])], "query long, ord int, name string, first int, last int")
    got = {r.query: (r.kind, r.subject, r.object) for r in Y.premise_conflicts(queries, named, ["thần", "sơn tinh"], ["hiệp định"], ["máy bay", "xe tăng"], ["chi lăng", "bạch đằng"]).collect()}
    assert {cases[i][0]: v for i, v in got.items()} == {t: v or (None, None, None) for t, _, v in cases} and len(got) == len(cases)
    assert Y.premise_conflicts(queries, named, [], [], [], []).filter("kind = 'CHRONOLOGY_MISMATCH'").count() == 3
