"""Layered names against a plain search, and the layers on hand-made sentences."""

import collections
import random
import re

import pytest

from quarry.operators import names as N

NAMES = [(0, "person_tqt", "Trần Quốc Tuấn", "Trần Quốc Tuấn", N.PERSON), (1, "person_tqt", "Trần Quốc Tuấn", "Trần Hưng Đạo", N.PERSON), (2, "loc_bd", "Bạch Đằng", "Bạch Đằng", N.PLACE), (3, "dynasty_ngo", "Ngô", "Ngô", N.ERA), (4, "loc_ha_noi", "Hà Nội", "Hà Nội", N.PLACE)]


def table(spark, rows=NAMES):
    return spark.createDataFrame(rows, "ord int, id string, canonical string, name string, type string")


def found(spark, texts, names=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = N.layered_names(docs, names or table(spark)).orderBy("doc_id", "start", "end").collect()
    out = collections.defaultdict(list)
    for r in rows:
        assert texts[r.doc_id][r.start : r.end] == r.name
        out[r.doc_id].append((r.name, r.type, r.layer, r.entity_id, r.enclosed))
    return [out[k] for k in range(len(texts))]


def test_layers(spark):
    got = found(spark, [
        "Vua Trần Nhân Tông gặp trần hưng đạo ở sông Hồng.",
        "Trận Bạch Đằng năm 938, quân Ngo và ngô.",
        "Tại Lam Sơn có Nguyễn Trãi. Bài thơ Nam Quốc được viết ở tỉnh Thanh Hóa.",
        None, "", "Năm Tân Dậu và Mùa Xuân",
    ])
    assert got[0] == [("Trần Nhân Tông", N.PERSON, "RULE_PREFIX", "person_tran_nhan_tong", False), ("trần hưng đạo", N.PERSON, "GAZETTEER", "person_tqt", False), ("sông Hồng", N.PLACE, "RULE_PREFIX", "loc_song_hong", False)]
    # A place may lie in an event; a single-word era needs its capital, and is known without its marks.
    assert got[1] == [("Trận Bạch Đằng", N.EVENT, "RULE_PREFIX", "event_tran_bach_dang", False), ("Bạch Đằng", N.PLACE, "GAZETTEER", "loc_bd", True), ("Ngo", N.ERA, "GAZETTEER", "dynasty_ngo", False)]
    assert got[2] == [("Lam Sơn", N.UNKNOWN, "PROPER_NOUN_REGEX", "unknown_lam_son", False), ("Nguyễn Trãi", N.PERSON, "PROPER_NOUN_REGEX", "person_nguyen_trai", False), ("Nam Quốc", N.WORK, "RULE_PREFIX", "doc_nam_quoc", False), ("Thanh Hóa", N.PLACE, "RULE_PREFIX", "loc_thanh_hoa", False)]
    assert got[3:] == [[], [], []]


def test_overlaps():
    s = lambda a, b, t=N.PERSON, layer="GAZETTEER": N.Span(a, b, t, layer, None)
    assert N.resolved([s(0, 5), s(0, 5, N.PLACE, "RULE_PREFIX")]) == [s(0, 5)]
    assert N.resolved([s(0, 5), s(3, 9, N.PLACE)]) == [s(0, 5)]
    assert N.resolved([s(2, 4, N.PLACE), s(0, 9, N.GROUP, "RULE_PREFIX")]) == [s(0, 9, N.GROUP, "RULE_PREFIX"), s(2, 4, N.PLACE)._replace(enclosed=True)]
    assert N.resolved([s(0, 4, N.PLACE, "RULE_PREFIX"), s(0, 9, N.PLACE)]) == [s(0, 9, N.PLACE)]


def plain_search(texts, names):
    """Every run of words is looked up; of each beginning the longest counts."""
    for k, text in enumerate(texts):
        at = [m.span() for m in re.finditer(r"\S+", text)]
        best = {}
        for i, (start, _) in enumerate(at):
            for _, end in at[i:]:
                if text[start:end] in names:
                    best[start] = end
        yield k, sorted(best.items())


def test_large_dictionary_against_a_plain_search(spark):
    """300,000 names in one pass."""
    rng = random.Random(4)
    syllables = [a + b for a in "bcdghklmnprstvx" for b in ("a", "ang", "e", "i", "inh", "o", "ong", "u", "uy")]
    names = sorted({" ".join(rng.choices(syllables, k=rng.choice((2, 3, 4)))) for _ in range(450_000)})
    assert len(names) > 300_000
    rows = [(k, f"loc_{k}", n, n, N.PLACE) for k, n in enumerate(names)]
    # Half of the words come from names, so that many are found and overlap.
    texts = [" ".join(rng.choice(names) if rng.random() < 0.5 else rng.choice(syllables) for _ in range(40)) for _ in range(60)]
    dictionary = N.Dictionary([(n, i, t, False) for _, i, _, n, t in rows])
    got = {k: sorted((s.start, s.end) for s in dictionary.spans(t, t)) for k, t in enumerate(texts)}
    assert got == dict(plain_search(texts, set(names))) and sum(map(len, got.values())) > 1000
    total = found(spark, texts, table(spark, rows))
    flat = [s for spans in total for s in spans]
    assert flat and all(layer == "GAZETTEER" and i == f"loc_{names.index(n)}" for n, _, layer, i, _ in flat[:50])


def test_dictionary_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(N, "DICTIONARY_BYTES", 10)
    with pytest.raises(ValueError, match="bytes"):
        N.layered_names(spark.createDataFrame([(1, "x")], "doc_id long, text string"), table(spark))
