"""Syllables torn apart by scanning put together (P06), against a lexicon that is generated from onsets, rimes and tones."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import DataFrame

from quarry.operators.text import mapped_texts

#: Onsets, nuclei without tones, codas; the marks of the tones; which onsets go before which nuclei.
ONSETS = ["", "b", "c", "ch", "d", "đ", "g", "gh", "gi", "h", "k", "kh", "l", "m", "n", "ng", "ngh", "nh", "p", "ph", "qu", "r", "s", "t", "th", "tr", "v", "x"]
NUCLEI = ["a", "ă", "â", "e", "ê", "i", "o", "ô", "ơ", "u", "ư", "y", "ia", "iê", "ua", "uô", "ưa", "ươ", "oa", "oă", "oe", "uâ", "uê", "uy", "uơ", "uyê", "uya", "iêu", "yêu", "oai", "oay", "uay", "ươi", "ươu"]
CODAS = ["", "c", "ch", "m", "n", "ng", "nh", "p", "t", "i", "u", "y", "o"]
TONES = "̣̀́̃̉"
BEFORE = {"k": "ieêy", "gh": "ieê", "ngh": "ieê"}
NOT_BEFORE = {"c": "ieêy", "g": "ieê", "ng": "ieê", "qu": "uư"}
#: Words of one letter, and pieces that are no words.
SINGLE = frozenset("aảeyôơởýuê")
PIECES = frozenset("ng v ươ i n t c tr ch nh kh ph th qu gi gh ngh đ d b m l r s x h k p ư ơ ê â ă uô iê g q y ên iên uông ương oan oang uy uyên uyêt uyệt ung ưng ang ăng âng ong ông anh ênh inh êch ach ich ôm ơm iêm uôm ươm oam oăm uyp uynh".split())
#: Characters of a token that is looked at, in threes and in pairs.
MOST_OF_THREE, MOST_OF_TWO = 4, 5
BLOCKED = re.compile(r"[\d\[\](){}<>,.;:!?]")
#: Lines that are left alone: headings, tables, rules.
KEPT = ("#", "|", "---")


@cache
def toneless() -> frozenset[str]:
    """All syllables without their tone: an onset, a nucleus that may follow it, a coda."""
    fits = lambda o, n: n[0] in BEFORE.get(o, n[0]) and n[0] not in NOT_BEFORE.get(o, "")
    return frozenset(o + n + c for o in ONSETS for n in NUCLEI if fits(o, n) for c in CODAS)


def syllable(token: str) -> bool:
    """Whether a token is a syllable with one tone at most, whose mark is on a vowel."""
    parts = unicodedata.normalize("NFD", token.strip().lower())
    marks = [i for i, c in enumerate(parts) if c in TONES]
    if len(marks) > 1 or marks and not re.search(r"[aeiouy][̛̂̆]?$", parts[: marks[0]].replace("̣", "")):
        return False
    bare = "".join(c for c in parts if c not in TONES)
    return unicodedata.normalize("NFC", bare) in toneless()


def joint(tokens: list[str]) -> str | None:
    """The syllable that two or three tokens make, with the first one's capital; None if they make none or may be words of their own."""
    if any(not t or BLOCKED.search(t) for t in tokens):
        return None
    low = [unicodedata.normalize("NFC", t.lower()) for t in tokens]
    whole = unicodedata.normalize("NFC", "".join(low))
    single = any(t in SINGLE for t in low)
    if max(map(len, tokens)) > (MOST_OF_THREE if len(tokens) == 3 else MOST_OF_TWO) or not syllable(whole):
        return None
    if single and not (len(tokens) == 3 and any(t in PIECES for t in low)):
        return None
    return whole[0].upper() + whole[1:] if tokens[0][0].isupper() else whole


def healed(line: str) -> str:
    """Greedily from the left: three tokens, else two, else one; the white space between the others stays."""
    if line.startswith(KEPT):
        return line
    tokens, out, i = re.split(r"(\s+)", line), [], 0
    while i < len(tokens):
        for n in (3, 2):
            words = tokens[i : i + 2 * n - 1 : 2]
            if tokens[i].strip() and len(words) == n and (whole := joint(words)) is not None:
                out.append(whole)
                i += 2 * n - 1
                break
        else:
            out.append(tokens[i])
            i += 1
    return "".join(out)


def heal(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with the syllables of ``column`` put together line by line; null stays null. A narrow pass; the lexicon is generated in each worker."""

    return mapped_texts(docs, lambda t: None if t is None else "\n".join(map(healed, t.split("\n"))), column)
