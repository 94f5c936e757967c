"""Chunks with headings: what holds for all texts, and sections on a hand-made one."""

import collections
import random

from quarry.operators import chunker as C


def text(rng, blocks):
    sentence = lambda: " ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(3, 30))) + rng.choice(".!?")
    out = []
    for _ in range(blocks):
        if rng.random() < 0.2:
            out.append(rng.choice(["# One", "## Two", "== Three ==", "### " + "long " * 20]))
        out.append(rng.choice(["\n", " "]).join(sentence() for _ in range(rng.choice([1, 5, 20, 90]))))
    return "\n\n".join(out)


def test_all_words_in_order(spark):
    rng = random.Random(3)
    docs = [(k, f"t{k}", "r", text(rng, k * 3)) for k in range(1, 12)] + [(20, None, None, "word " * 700), (21, "x", "y", None), (22, "x", "y", " \n\n "), (23, "x", "y", "one"), (None, "n", "y", "two words")]
    rows = C.chunk_sections(spark.createDataFrame(docs, "doc_id long, title string, realm string, text string").repartition(3)).collect()
    parents, children = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        (parents[r.doc_id] if r.parent_chunk_id is None else children[r.parent_chunk_id]).append(r)
    assert set(parents) == {*range(1, 12), 20, 23, None}
    for doc_id, *_, body in docs:
        assert [w for p in parents[doc_id] for w in p.content.split()] == (body or "").split()
        for p in parents[doc_id][:-1]:
            assert C.PARENT_LEAST <= p.n_words <= C.PARENT_MOST + C.PARAGRAPH
        for p in parents[doc_id]:
            words, at = p.content.split(), 0
            for k, c in enumerate(children[p.chunk_id]):
                assert c.content.split("\n\n", 1)[1].split() == words[c.first_word : c.first_word + c.n_words]
                # Nothing is left out, and only the last child repeats words.
                assert c.first_word == at or c.first_word == at - C.OVERLAP and k == len(children[p.chunk_id]) - 1
                at = c.first_word + c.n_words
                assert c.n_words <= C.CHILD_MOST and (c.n_words >= C.CHILD_LEAST or len(words) < C.CHILD_LEAST or len(children[p.chunk_id]) == 1), (c.n_words, len(words))
            assert at == p.n_words


def test_sections():
    body = "\n\n".join(["# A. ", "x " * 1500, "## Trần era", "y " * 700, "== C ==", "z " * 2500, "# D: d", "end"])
    rows = [r for r in C.chunks_of(1, "T", "base", body, {"trần": "dynasty_tran"})]
    got = [(r[4], r[5], r[6], r[8]) for r in rows if r[2] is None]
    # 2 + 1500 + 3 + 700 + 3 words, then 2500 + 3 + 1; a parent's section is that of the last heading before it is closed.
    assert got == [("C", ["A", "C"], "base", 2208), ("D: d", ["D: d"], "base", 2504)]
    below = list(C.chunks_of(1, "T", "base", "# A\n\n## Trần era\n\n### Deep\n\nend", {"trần": "dynasty_tran"}))
    assert below[0][4:7] == ("Deep", ["A", "Trần era", "Deep"], "dynasty_tran")
    assert rows[1][-1].startswith("[Sử Liệu: T] [Kỷ/Triều Đại: ")


def test_overlap_and_snapping():
    words = [f"w{k}" for k in range(700)]
    assert list(C.child_spans(words)) == [(0, 400), (360, 700)]
    words[379] = "end."
    assert list(C.child_spans(words)) == [(0, 380), (340, 700)]
    assert list(C.child_spans(words[:500])) == [(0, 500)] and list(C.child_spans(words[:20])) == [(0, 20)]
    assert list(C.child_spans(["x"] * 1250)) == [(0, 400), (400, 800), (760, 1250)]
