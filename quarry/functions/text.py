"""String functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base letters and their marked forms.
MARKED = {
    "a": "àáảãạăằắẳẵặâầấẩẫậäå", "e": "èéẻẽẹêềếểễệë", "i": "ìíỉĩịîï", "o": "òóỏõọôồốổỗộơờớởỡợö", "u": "ùúủũụưừứửữựûü", "y": "ỳýỷỹỵÿ", "c": "ç", "n": "ñ", "d": "đ",
}
_FROM = "".join(v + v.upper() for v in MARKED.values())
_TO = "".join(k * len(v) + k.upper() * len(v) for k, v in MARKED.items())


def unaccent(c: Column) -> Column:
    """Letters without their marks (P22); composed letters only, đ becomes d."""
    return F.translate(c, _FROM, _TO)


def slug(c: Column, sep: str = "_") -> Column:
    """Lower-case unaccented words joined by ``sep`` (P21); an empty slug is the text's MD5."""
    s = F.trim(F.regexp_replace(F.lower(unaccent(c)), "[^a-z0-9]+", sep), F.lit(sep))
    return F.when(s == "", F.md5(c.cast("binary"))).otherwise(s)


def normal_space(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_banner(c: Column) -> Column:
    """Without leading bracketed banners."""
    return F.regexp_replace(c, r"^(\[[^\]]*\]\s*)+", "")


def split_glued(c: Column) -> Column:
    """A space between a lower-case letter and a capital or digit glued to it, and between a digit and a letter."""
    return F.regexp_replace(F.regexp_replace(c, r"(\p{Ll})(\p{Lu}|\d)", "$1 $2"), r"(\d)(\p{L})", "$1 $2")


def space_punctuation(c: Column) -> Column:
    """No space before marks, one after."""
    return F.regexp_replace(F.regexp_replace(c, r"\s+([,.;:!?])", "$1"), r"([,;:!?])(\p{L})", "$1 $2")


def clean_wiki(c: Column) -> Column:
    """Links keep their label, templates, references and emphasis go."""
    out = F.regexp_replace(c, r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1")
    out = F.regexp_replace(out, r"\{\{[^{}]*\}\}", "")
    return F.regexp_replace(F.regexp_replace(out, r"(?s)<ref[^>]*>.*?</ref>|<ref[^>]*/>", ""), r"'{2,}", "")


def clean_marks(c: Column) -> Column:
    """Page watermarks, footnote numbers and runs of decoration go."""
    out = F.regexp_replace(c, r"[#%$*&]{3,}", "")
    return F.regexp_replace(out, r"\[\d{1,3}\]", "")


def unhyphenate(c: Column) -> Column:
    """Words broken at a line end are joined."""
    return F.regexp_replace(c, r"(\p{Ll})-\n(\p{Ll})", "$1$2")


def quality_score(c: Column) -> Column:
    """100 less half a point for each pipe and marker and one for each odd glyph, between 0 and 100."""
    n = lambda p: F.regexp_count(c, F.lit(p))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - 0.5 * n(r"\|") - 0.5 * n(r"[#%$*&]{3}") - 1.0 * n("�")))


def token_count(c: Column) -> Column:
    """ceil(length / 3.5)."""
    return F.ceil(F.length(c) / 3.5)


def query_normal(c: Column) -> Column:
    """Repeated marks collapsed, lower-cased, white space normal."""
    return normal_space(F.lower(F.regexp_replace(c, r"([!?.,])(?:[!?.,])+", "$1")))


def break_lists(c: Column) -> Column:
    """A line break before list items that follow a mark on the same line."""
    return F.regexp_replace(c, r"([.:;]) +([-*•]|\d+\.) ", "$1\n$2 ")


def sanitize_terms(c: Column, stopwords: list[str]) -> Column:
    """Lower-cased query terms without operators and stopwords, in order; all of them if none is left."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), r"[&|!():*<>'\"\\]", " "), r"\s+"), lambda w: w != "")
    kept = F.filter(words, lambda w: ~w.isin(stopwords))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def classify(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first pattern that the text has."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(F.lower(c).rlike(pattern), name).otherwise(out)
    return out


def repair_inner_case(c: Column) -> Column:
    """A capital inside a lower-cased word is lowered (P03): its letters after the first, where a lower-case one comes before it."""
    words = F.split(c, " ")
    odd = lambda w: w.rlike(r"^\p{L}*\p{Ll}\p{Lu}\p{L}*$")
    return F.array_join(F.transform(words, lambda w: F.when(odd(w), F.concat(F.substring(w, 1, 1), F.lower(w.substr(F.lit(2), F.length(w))))).otherwise(w)), " ")


def unwrap_tables(c: Column) -> Column:
    """Table rows become lines of their cells, rulers go."""
    lines = F.filter(F.split(c, "\n"), lambda x: ~x.rlike(r"^\s*\|?[\s:|+-]*[-=]{3,}[\s:|+=-]*$"))
    return F.array_join(F.transform(lines, lambda x: F.when(x.rlike(r"^\s*\|.*\|\s*$"), F.trim(F.regexp_replace(F.trim(x), r"\s*\|\s*", " "))).otherwise(x)), "\n")


def repair_json(c: Column) -> Column:
    """The first JSON object of a text, without code fences and trailing commas (P37); null if there is none."""
    body = F.regexp_extract(F.regexp_replace(c, r"```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    return F.when(body != "", F.regexp_replace(body, r",\s*([}\]])", "$1"))


def valid_span(c: Column, generic: list[str]) -> Column:
    """Whether a candidate name can be an entity (F14): 2 to 80 characters, 8 words at most, no digit first, no brackets, not a generic word."""
    return F.length(c).between(2, 80) & (F.size(F.split(c, r"\s+")) <= 8) & ~c.rlike(r"^\d") & ~c.rlike(r"[\[\](){}<>]") & ~F.lower(c).isin(generic)


#: Spoken digits, and the units of groups of three digits from the lowest.
DIGITS = ["không", "một", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín"]
GROUPS = ["", "nghìn", "triệu", "tỷ", "nghìn tỷ"]


def number_words(c: Column) -> Column:
    """A whole number below 10^15 in words of the source language (P36); null for null and for numbers beyond."""
    n = F.abs(c.cast("long"))
    words = F.array(*map(F.lit, DIGITS))
    word = lambda d: F.get(words, d.cast("int"))
    parts = []
    for k in reversed(range(len(GROUPS))):
        g, leads = F.floor(n / F.lit(1000**k)) % 1000, n < 1000 ** (k + 1)
        h, t, u = F.floor(g / 100), F.floor(g / 10) % 10, g % 10
        full = (h > 0) | ~leads
        ones = F.when(u == 5, "lăm").otherwise(word(u))
        after_tens = F.when(u == 1, "mốt").when(u == 4, "tư").otherwise(ones)
        pieces = [
            F.when(full, F.concat_ws(" ", word(h), F.lit("trăm"))),
            F.when(t > 1, F.concat_ws(" ", word(t), F.lit("mươi"))).when(t == 1, F.lit("mười")).when(full & (u > 0), F.lit("lẻ")),
            F.when(u > 0, F.when(t > 1, after_tens).when(t == 1, ones).otherwise(word(u))),
            *([F.lit(GROUPS[k])] if k else []),
        ]
        spoken = F.concat_ws(" ", *pieces)
        parts.append(F.when(g > 0, spoken))
    return F.when(n < 10**15, F.when(n == 0, DIGITS[0]).otherwise(F.concat_ws(" ", F.when(c < 0, F.lit("âm")), *parts)))
