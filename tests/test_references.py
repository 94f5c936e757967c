"""Rewritten turns on hand-made dialogues and against a plain fold; premises on hand-made questions."""

import random

from quarry.operators import references as R

T = "conv_id long, turn long, role string, text string"
M = "conv_id long, turn long, start int, name string, kind string"


def test_dialogues(spark):
    turns = [
        (1, 0, "user", "Trần Hưng Đạo là ai?"), (1, 1, "assistant", "Trần Hưng Đạo đánh bại Thoát Hoan."), (1, 2, "user", "Vậy thì ông ấy sinh năm nào?"), (1, 3, "user", "Khi nào mất?"),
        (1, 4, "user", "Còn Nguyễn Trãi?"), (1, 5, "user", "Hai người này có gặp nhau không?"), (1, 6, "user", "Hắn thua ở đâu?"), (1, 7, "user", "So với Lê Lợi thì sao?"), (1, 8, "user", "Cuộc khởi nghĩa đó và ông ra sao?"),
        (2, 0, "user", "Khi nào mất?"), (2, 1, "user", None), (2, 2, "assistant", "Hà Nội $1 \\"), (2, 3, "user", "Ở đâu?"),
    ]
    mentions = [(1, 0, 0, "Trần Hưng Đạo", R.PERSON), (1, 1, 0, "Trần Hưng Đạo", R.PERSON), (1, 1, 23, "Thoát Hoan", R.ADVERSARY), (1, 4, 4, "Nguyễn Trãi", R.PERSON), (1, 7, 7, "Lê Lợi", R.PERSON), (2, 2, 0, "Hà Nội $1 \\", R.PLACE)]
    got = {(r.conv_id, r.turn): r for r in R.rewritten(spark.createDataFrame(turns, T), spark.createDataFrame(mentions, M)).collect()}
    text = {k: r.rewritten for k, r in got.items()}
    assert text[1, 0] == "Trần Hưng Đạo là ai?" and text[1, 2] == "Trần Hưng Đạo sinh năm nào?" and text[1, 3] == "Trần Hưng Đạo: Khi nào mất?"
    assert text[1, 4] == "Còn Nguyễn Trãi?" and got[1, 4].shifts and not got[1, 2].shifts
    assert text[1, 5] == "Trần Hưng Đạo và Nguyễn Trãi có gặp nhau không?" and text[1, 6] == "Thoát Hoan thua ở đâu?"
    assert text[1, 7] == "So sánh giữa Trần Hưng Đạo và Lê Lợi thì sao?" and text[1, 8] == "Cuộc khởi nghĩa đó Trần Hưng Đạo và Trần Hưng Đạo ra sao?"
    assert text[2, 0] == "Khi nào mất?" and text[2, 1] == "" and text[2, 3] == "Hà Nội $1 \\: Ở đâu?"


def test_salience_against_a_fold(spark):
    rng = random.Random(9)
    kinds = [R.PERSON, R.ADVERSARY, R.WORK, R.PLACE]
    turns = [(c, t, rng.choice(["user", "assistant", "system"]), "x") for c in range(25) for t in range(rng.randrange(1, 14))]
    mentions = [(c, t, k, f"n{rng.randrange(5)}", rng.choice(kinds)) for c, t, _, _ in turns for k in range(rng.choice([0, 0, 1, 3]))]
    want = {}
    for c in range(25):
        user, late = [], []
        for _, t, role, _ in sorted(x for x in turns if x[0] == c):
            mine = [(m[3], m[4]) for m in sorted(mentions) if m[:2] == (c, t)]
            if role == "user":
                seen = user + [m for ms in late[-2:] for m in ms]
                of = lambda kind: list(dict.fromkeys(n for n, k in seen if k == kind))  # noqa: B023, E731
                people = of(R.PERSON)
                firsts = [next(iter(of(k)), None) for k in kinds]
                want[c, t] = (firsts[0], people[1] if len(people) > 1 else None, *firsts[1:], next((f for f in firsts if f), None), bool(mine))
                user += mine
            elif role == "assistant":
                late.append(mine)
    got = {(r.conv_id, r.turn): (r.person, r.second, r.foe, r.work, r.place, r.subject, r.named) for r in R.salient(spark.createDataFrame(turns, T), spark.createDataFrame(mentions, M)).collect()}
    assert got == want


def test_premises(spark):
    texts = {
        1: "Quang Trung và Nguyễn Huệ có quan hệ gì?", 2: "Quang Trung và Nguyễn Huệ cùng chỉ huy trận nào?", 3: "Nguyễn Huệ và Nguyễn Nhạc là anh em?", 4: "Nguyễn Huệ và Lê Lợi là anh em?", 5: "Nguyễn Huệ và Nguyễn Nhạc không phải anh em?",
        6: "Lê Lợi thuộc nhà Trần?", 7: "Lê Lợi thuộc nhà Lê?", 8: "Lý Bí và Ngô Quyền là cha con?", 9: "Tôi là hậu duệ của tôi, gia phả nhà tôi ghi", 10: "Vua dùng máy bay năm 1288?", 11: "Vua dùng súng thần cơ và máy bay?", 12: "Máy bay năm 1972?", 13: "Nỏ thần có thật?", 14: None, 15: "Quang Trung, Nguyễn Huệ là ai?",
    }
    p = {"Quang Trung": "person_nh", "Nguyễn Huệ": "person_nh", "Nguyễn Nhạc": "person_nn", "Lê Lợi": "person_ll", "Lý Bí": None, "Ngô Quyền": None}
    eras = {"nhà Trần": "dynasty_tran", "nhà Lê": "dynasty_le"}
    mentions = [(q, t.index(n), n, i, kind) for q, t in texts.items() if t for d, kind in ((p, R.PERSON), (eras, R.ERA)) for n, i in d.items() if n in t]
    edges = [("person_nh", "SIBLING_OF", "person_nn"), ("person_ll", "PART_OF", "dynasty_le"), ("person_ll", "LED_BY", "person_nh")]
    got = R.premises(spark.createDataFrame(list(texts.items()), "question_id long, text string"), spark.createDataFrame(mentions, "question_id long, start int, name string, entity_id string, type string"), spark.createDataFrame(edges, "src string, rel string, tgt string"))
    assert {r.question_id: (r.kind, r.verdict) for r in got.collect()} == {
        1: ("SAME_PERSON_KINSHIP", "CORRECT_IT"), 2: ("SAME_PERSON_DEED", "CORRECT_IT"), 3: ("KINSHIP", "SUPPORTED"), 4: ("KINSHIP", "CONTRADICTED"), 5: ("KINSHIP", "CONTRADICTED"), 6: ("REALM", "CONTRADICTED"), 7: ("REALM", "SUPPORTED"), 8: ("KINSHIP", "UNKNOWN"),
        9: ("FLATTERY", "CORRECT_IT"), 10: ("ANACHRONISM", "CORRECT_IT"), 11: ("NONE", "NONE"), 12: ("NONE", "NONE"), 13: ("LEGEND", "CORRECT_IT"), 14: ("NONE", "NONE"), 15: ("SAME_PERSON_IDENTITY", "CORRECT_IT"),
    }
