"""Page structure on hand-made pages; torn syllables against a search over all ways to join."""

import itertools
import random
import re
import unicodedata

from quarry.operators import pages as P
from quarry.operators import syllables as S


def test_pages(spark):
    book = [(1, k, f"Sử ký toàn thư {k}\nQUYỂN MỘT\nChương {k} mở đầu\nnội dung {k}\ncuối trang\n{k}") for k in range(1, 7)]
    book += [(1, 7, "Trang 7\nkhông có gì"), (1, 8, None), (1, 9, " \n"), (2, 1, "Sử ký toàn thư 1\nx"), (2, 2, "y\n12")]
    got = {(r.doc, r.page): r for r in P.structured_pages(spark.createDataFrame(book, "doc long, page long, content string")).collect()}
    assert got[1, 3].header == ["Sử ký toàn thư 3", "QUYỂN MỘT"] and got[1, 3].footer == ["cuối trang", "3"] and got[1, 3].headings == ["Chương 3 mở đầu"] and got[1, 3].content == "Chương 3 mở đầu\nnội dung 3"
    assert got[1, 7].header == ["Trang 7"] and got[1, 7].content == "không có gì" and got[1, 8].content == got[1, 9].content == ""
    assert got[2, 1].header == [] and got[2, 1].content == "Sử ký toàn thư 1\nx" and got[2, 2].footer == ["12"] and len(got) == len(book)


def test_lexicon():
    assert len(S.toneless()) > 5000
    assert all(map(S.syllable, "nguyễn trần nghiêng đường ngoài khuya hoà hòa yêu ăn thuở giang quang".split()))
    assert not any(map(S.syllable, ["kan", "ce", "gi2", "ngi", "quư", "bb", "tràán", "str", "", "hello", "ng"]))
    # Every tone on every nucleus, at least on one of its vowels.
    for n, tone in itertools.product(S.NUCLEI, S.TONES):
        assert any(S.syllable(unicodedata.normalize("NFC", "b" + n[: k + 1] + tone + n[k + 1 :])) for k in range(len(n))), (n, tone)


def by_rules(words):
    """The same by recursion over the words of a line with single spaces."""
    if not words:
        return []
    for n in (3, 2):
        some = [unicodedata.normalize("NFC", w.lower()) for w in words[:n]]
        if len(some) < n or any(re.search(r"[\d\[\](){}<>,.;:!?]", w) for w in words[:n]) or any(len(w) > (4 if n == 3 else 5) for w in words[:n]):
            continue
        whole = "".join(some)
        if S.syllable(whole) and (not any(w in S.SINGLE for w in some) or n == 3 and any(w in S.PIECES for w in some)):
            return [whole.capitalize() if words[0][0].isupper() else whole, *by_rules(words[n:])]
    return [words[0], *by_rules(words[1:])]


def test_healing(spark):
    assert S.healed("Ng uyễn tr ần và th ời  Lê ở đ ây") == "Nguyễn trần và thời  Lê ở đây"
    assert S.healed("# Ng uyễn") == "# Ng uyễn" and S.healed("a b, c 1 n") == "a b, c 1 n" and S.healed("ngh iê ng") == "nghiêng" and S.healed("") == ""
    rng = random.Random(8)
    syllables = [s for s in sorted(S.toneless()) if 2 <= len(s) <= 6]
    lines = []
    for _ in range(300):
        words = []
        for _ in range(12):
            s = rng.choice(syllables)
            cut = sorted(rng.sample(range(1, len(s)), min(len(s) - 1, rng.choice([0, 1, 1, 2]))))
            parts = [s[a:b] for a, b in zip([0, *cut], [*cut, len(s)], strict=True)]
            words += [parts[0].capitalize() if rng.random() < 0.2 else parts[0], *parts[1:], *rng.choices(["12", "x,", "y", "a", "zz"], k=rng.choice([0, 0, 1]))]
        lines.append(" ".join(words))
    assert [S.healed(x) for x in lines] == [" ".join(by_rules(x.split(" "))) for x in lines]
    df = spark.createDataFrame([(1, "\n".join(lines), 5), (2, None, 6)], "doc_id long, text string, n int")
    got = {r.doc_id: (r.text, r.n) for r in S.heal(df).collect()}
    assert got == {1: ("\n".join(map(S.healed, lines)), 5), 2: (None, 6)}
