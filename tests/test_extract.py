"""Pairs of names against all pairs of spans; relations on hand-made texts."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import extract as E
from quarry.operators import names as N

PEOPLE = [("p1", "Ngô Quyền", N.PERSON), ("p2", "Trần Hưng Đạo", N.PERSON), ("p3", "Quang Trung", N.PERSON), ("p4", "Nguyễn Huệ", N.PERSON), ("l1", "Thăng Long", N.PLACE), ("l2", "Hà Nội", N.PLACE), ("e1", "Trận Đống Đa", N.EVENT), ("d1", "Nhà Trần", N.ERA), ("w1", "Hịch Tướng Sĩ", N.WORK)]


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame([(k, i, n, n, t) for k, (i, n, t) in enumerate(PEOPLE)], "ord long, id string, canonical string, name string, type string")


def test_near_names_are_all_near_pairs(spark, dictionary):
    rng = random.Random(4)
    words = [n for _, n, _ in PEOPLE] + ["và", "của", "một", "dài hơn nhiều", ".", "\n", "(", ")"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(200)] + [(None, "Ngô Quyền và Hà Nội"), (None, None), (7, "Ngô Quyền ở Hà Nội")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((tuple(r) for r in N.near_names(docs, dictionary, (), 30, 5).select("doc_id", "a_start", "b_start", "a_id", "b_id", "gap", "after").collect()), key=repr)
    want = []
    for i, text in texts:
        spans = []
        for k, n, _ in PEOPLE:
            at = -1
            while (at := (text or "").find(n, at + 1)) >= 0:
                spans.append((at, at + len(n), k))
        want += [(i, a, b, x, y, text[ae:b], text[be : be + 5]) for a, ae, x in spans for b, be, y in spans if ae <= b <= ae + 30]
    assert got == sorted(want, key=repr) and len(got) > 500
    plan = N.near_names(docs, dictionary, (), 30)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


CASES = [
    ("Trận Đống Đa do Quang Trung chỉ huy", {("e1", "LED_BY", "p3", 0.98)}),
    ("Quang Trung đại phá trong Trận Đống Đa", {("e1", "LED_BY", "p3", 0.98)}),
    ("Trận Đống Đa, Quang Trung chỉ huy", {("e1", "LED_BY", "p3", 0.98)}),  # the word behind the leader
    ("Trận Đống Đa. Do Quang Trung", set()),
    ("Trận Đống Đa diễn ra tại Thăng Long", {("e1", "HAPPENED_AT", "l1", 0.98)}),
    ("Trận Đống Đa, Thăng Long", {("e1", "HAPPENED_AT", "l1", 0.98)}),
    ("Quang Trung tức Nguyễn Huệ", {("p3", "ALIAS_OF", "p4", 1.0)}),
    ("Quang Trung (Nguyễn Huệ)", {("p3", "ALIAS_OF", "p4", 1.0)}),
    ("Quang Trung (Nguyễn Huệ và)", set()),
    ("Thăng Long nay là Hà Nội", {("l1", "SAME_AS_LOCATION", "l2", 1.0)}),
    ("Thăng Long nay là thuộc Hà Nội", set()),
    ("Trần Hưng Đạo phò tá Nhà Trần", {("p2", "PART_OF", "d1", 0.98)}),
    ("Trần Hưng Đạo phò tá rồi chống lại Nhà Trần", set()),
    ("Trần Hưng Đạo viết Hịch Tướng Sĩ", {("p2", "MENTIONED_IN", "w1", 0.98)}),
    ("Ngô Quyền " + "x" * 130 + " ở Thăng Long", set()),
    ("Ngô Quyền ở Thăng Long. Ngô Quyền ở Thăng Long", {("p1", "HAPPENED_AT", "l1", 0.98)}),
    ("[Triều Đại: Nhà Hồ] Hịch Tướng Sĩ", {("w1", "HAPPENED_IN", "dynasty_nha_ho", 0.95)}),
    ("[Kỷ: ] Hịch Tướng Sĩ", set()), ("", set()), (None, set()),
]


def test_extracted_triples(spark, dictionary):
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(CASES)], "doc_id long, text string, src string")
    got = {i: set() for i in range(len(CASES))}
    rows = E.extracted_triples(docs, dictionary, name_rules=()).collect()
    for r in rows:
        got[r.doc_id].add((r.src, r.rel, r.tgt, r.confidence))
    # Whatever is not asked for in these short texts does not come up either.
    assert {CASES[i][0]: v for i, v in got.items()} == dict(CASES) and len(rows) == sum(len(v) for _, v in CASES)
    assert E.extracted_triples(docs.limit(0), dictionary, name_rules=()).count() == 0


def test_first_rule_of_a_relation_holds(spark, dictionary):
    rules = (E.Relation("R", (N.PERSON,), (N.PLACE,), 50, "ở", 0.5), E.Relation("R", (N.PLACE,), (N.PERSON,), 50, "ở", 0.9), E.Relation("S", (N.PLACE,), (N.PERSON,), 50, "và", 0.7, bare=True))
    docs = spark.createDataFrame([(1, "Ngô Quyền ở Hà Nội"), (2, "Hà Nội Ngô Quyền")], "doc_id long, text string")
    got = sorted(tuple(r) for r in E.relations(N.near_names(docs, dictionary, ()), rules).collect())
    assert got == [(1, "p1", "R", "l2", 0.5), (2, "l2", "S", "p1", 0.7)]


def test_unknown_names_get_made_ids(spark, dictionary):
    docs = spark.createDataFrame([(1, "ông Lê Văn Tám ở Hà Nội")], "doc_id long, text string")
    assert {r.src for r in E.extracted_triples(docs, dictionary).filter(F.col("rel") == "HAPPENED_AT").collect()} == {"person_le_van_tam"}
