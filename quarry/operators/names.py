"""Layered names in texts: a dictionary table, prefix rules, proper nouns and honorifics, with overlaps resolved by layer.

The dictionary becomes one automaton that finds all of its names in a single pass over a text, whatever their number. It is built once in each Python
worker from the broadcast names, whose bytes are counted first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import unaccent
from quarry.operators.relational import keep_first

#: Names are broadcast up to so many bytes of text: about a million of them.
DICTIONARY_BYTES = 32 << 20
PERSON, PLACE, EVENT, ERA, GROUP, THING, WORK, UNKNOWN = "HISTORICAL_PERSON", "LOCATION", "EVENT_BATTLE", "DYNASTY_ERA", "ORGANIZATION", "ARTIFACT", "DOCUMENT_CULTURE", "UNKNOWN"
#: Id prefixes of the types.
ID_PREFIX = {PERSON: "person_", PLACE: "loc_", EVENT: "event_", ERA: "dynasty_", GROUP: "org_", THING: "artifact_", WORK: "doc_", UNKNOWN: "unknown_"}
#: Which types may lie inside which.
INSIDE = {EVENT: {PERSON, PLACE, THING}, GROUP: {PERSON, PLACE}, WORK: {PERSON}}
#: Layers with their priority and confidence.
LAYERS = {"GAZETTEER": (30, 0.99), "RULE_PREFIX": (20, 0.92), "PROPER_NOUN_REGEX": (10, 0.85)}


class Rule(NamedTuple):
    """Words before a name that tell its type. ``kept``: they are part of the span; ``most``: further words of the name; ``inner``: small words that may stand before each of its words."""

    type: str
    kept: bool
    most: int
    prefixes: tuple[str, ...]
    inner: tuple[str, ...] = ()


#: Prefixes by type, in the order in which they are tried.
RULES = (
    Rule(EVENT, True, 4, ("trận đánh", "trận", "chiến dịch", "chiến thắng", "đại thắng", "cuộc khởi nghĩa", "khởi nghĩa", "cuộc chiến đấu", "cuộc chiến tranh", "chiến đấu", "chiến tranh", "hội nghị", "đại hội", "phong trào", "khoa thi", "kỳ thi", "hội thi", "khoa mục"), ("phòng tuyến", "bán đảo", "trên không", "sông", "núi", "thành", "cửa", "đèo", "ải", "biên giới")),
    Rule(WORK, True, 6, ("chiếu", "hịch", "tuyên ngôn", "hiệp định", "bộ luật", "hình luật", "luật lệ", "luật", "đại cáo", "bài thơ", "tác phẩm", "sách", "bản đồ")),
    Rule(THING, True, 4, ("trống đồng", "nỏ thần", "nỏ", "xe tăng", "thông bảo")),
    Rule(PERSON, False, 4, ("tổng bí thư", "thủ tướng", "vua", "hoàng đế", "thái thượng hoàng", "chúa", "đại vương", "vương", "thái sư", "thái úy", "tiết chế", "quốc công", "đại tướng", "tướng", "đô đốc", "nữ tướng", "trạng trình", "trạng nguyên", "bảng nhãn", "danh sĩ", "sử thần", "sử gia", "sử quan", "chủ tịch", "bác")),
    Rule(PLACE, True, 4, ("thành", "lũy", "chiến lũy", "căn cứ", "ải", "núi", "sông", "bán đảo", "quần đảo", "địa đạo", "đường mòn", "đường", "đền", "chùa", "văn miếu", "quảng trường", "dinh", "ấp", "đầm")),
    Rule(ERA, True, 3, ("triều đình", "vương triều", "nhà", "triều", "thời kỳ", "thời", "kỷ nguyên")),
    Rule(PLACE, False, 4, ("sở chỉ huy", "doanh trại", "đồn lũy", "thành phố", "tỉnh", "huyện", "xứ", "đất", "vùng", "phủ", "lộ", "châu")),
)
#: Prefixes that are not part of a work's name; prepositions that begin a clause; family names; honorifics.
WORK_PREFIXES = ("bài thơ", "bộ luật", "tác phẩm", "sách")
PREPOSITIONS = ("tại", "ở", "từ", "về", "đến", "trên", "dưới", "trong", "ngoài", "cùng", "với", "theo", "qua", "sau", "trước")
SURNAMES = ("nguyễn", "trần", "lê", "phạm", "hoàng", "huỳnh", "phan", "vũ", "võ", "đặng", "bùi", "đỗ", "hồ", "ngô", "dương", "lý", "đinh", "đoàn", "lâm", "trịnh", "mai", "đào", "cao", "hà", "lưu", "lương", "thái", "châu", "tạ", "phùng", "tô", "vương", "quách", "nhâm", "tôn", "trương", "khuất")
HONORIFICS = ("thái thượng hoàng", "hoàng đế", "đại tướng", "trung tướng", "thiếu tướng", "tiết chế", "thái sư", "thái úy", "quốc công", "đô đốc", "nữ tướng", "tổng bí thư", "thủ tướng", "chủ tịch", "đại vương", "thiền sư", "quốc sư", "trạng nguyên", "sử gia", "sử thần", "sử quan", "tướng", "chúa", "vua", "bà", "ông", "bác")
#: Words and phrases that are no names, and those that begin a time.
GENERIC = frozenset("năm tháng ngày giờ vào thời khi sau trước trong giữa cuối đầu sang từ đến lúc người những các một được có tại ở về đã sẽ cũng thì là sự việc đây đó ông bà cha mẹ con cháu vua tướng sông núi thành huyện tỉnh châu lộ phủ quận trận cuộc".split()) | {"thời kỳ", "thời đại", "giai đoạn", "kết quả", "ý nghĩa", "nguyên nhân", "bối cảnh", "diễn biến", "tổng quan", "lịch sử"}
TIME = regex.compile(r"(?i)(?:năm|mùa|tháng|ngày|thời kỳ|niên hiệu)\s")
NAME_WORD = r"\p{Lu}\p{Ll}*"
PROPER = regex.compile(rf"(?<![\p{{L}}\p{{N}}])({NAME_WORD}(?:[\s\-–—]+{NAME_WORD}){{1,6}})(?![\p{{L}}\p{{N}}])")
PREPOSITION = regex.compile(rf"(?i)(?:{'|'.join(PREPOSITIONS)})\s+")
PERSON_NAME = regex.compile(r"\p{Lu}\p{Ll}+(?:\s+\p{Lu}\p{Ll}+)+")
LETTER = regex.compile(r"[\p{L}\p{N}]")
SPANS = "doc_id long, start int, end int, name string, type string, layer string, confidence double, known_id string, enclosed boolean"


class Span(NamedTuple):
    start: int
    end: int
    type: str
    layer: str
    known_id: str | None
    enclosed: bool = False


def small(text: str) -> str:
    """Small letters, one for each character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def pattern(rule: Rule) -> regex.Pattern:
    """The rule's prefixes, the first letter in either case, and the name after them as a group."""
    first = lambda p: f"[{p[0]}{p[0].upper()}]" + r"\s+".join(regex.escape(w) for w in p[1:].split(" "))
    word = rf"(?:(?:{'|'.join(rule.inner)})\s+)?(?:\p{{Lu}}[\p{{Ll}}\p{{Lu}}\d]*|\d+)" if rule.inner else NAME_WORD
    return regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(map(first, rule.prefixes))})\s+({word}(?:[\s\-–—]+{word}){{0,{rule.most}}})(?![\p{{L}}\p{{N}}])")


def valid(name: str) -> bool:
    """Whether a candidate can be a name."""
    clean = name.strip(" \t\n,.;:!?-–—\"'()[]{}")
    low = clean.lower()
    return 2 <= len(clean) <= 80 and not clean[0].isdigit() and not regex.search(r"[\[\]()=/\\<>|#*]", clean) and low not in GENERIC and not TIME.match(low + " ") and len(clean.split()) <= 8


class Dictionary:
    """The automaton over small letters, and what each name stands for: (id, type, one word only)."""

    def __init__(self, rows: list[tuple[str, str, str, bool]]):
        self.known = {name: (i, t, one) for name, i, t, one in rows}
        self.automaton = ahocorasick.Automaton()
        for name in self.known:
            self.automaton.add_word(name, name)
        if self.known:
            self.automaton.make_automaton()

    def spans(self, text: str, low: str) -> Iterator[Span]:
        """The longest name from each place where a word begins; names of one word that are persons or eras need a capital."""
        longest: dict[int, int] = {}
        for last, name in self.automaton.iter(low) if self.known else ():
            start, end = last + 1 - len(name), last + 1
            if (start and LETTER.match(low[start - 1])) or (end < len(low) and LETTER.match(low[end])):
                continue
            _, kind, one = self.known[name]
            if one and kind in (ERA, PERSON) and not text[start].isupper():
                continue
            longest[start] = max(end, longest.get(start, 0))
        for start, end in sorted(longest.items()):
            i, kind, _ = self.known[low[start:end]]
            yield Span(start, end, kind, "GAZETTEER", i)


def type_of(name: str, rules: tuple[Rule, ...]) -> str:
    """A proper noun's type by the words in it, else by a family name."""
    low = f" {name.lower()} "
    for rule in rules:
        if any(f" {p} " in low for p in rule.prefixes):
            return rule.type
    parts = low.split()
    return PERSON if 2 <= len(parts) <= 6 and parts[0] in SURNAMES else UNKNOWN


def ruled(text: str, rules: tuple[Rule, ...], patterns: list[regex.Pattern], known: dict) -> Iterator[Span]:
    for rule, p in zip(rules, patterns, strict=True):
        for m in p.finditer(text):
            start = m.start() if rule.kept else m.start(1)
            if rule.type == WORK and any(small(m[0]).startswith(w + " ") for w in WORK_PREFIXES) or rule.type == EVENT and small(m[0]).startswith("cuộc "):
                start = m.start(1) if rule.type == WORK else m.start() + 5
            yield Span(start, m.end(), rule.type, "RULE_PREFIX", known.get(small(text[start : m.end()]), (None,))[0])


def proper(text: str, higher: list[Span], rules: tuple[Rule, ...], known: dict) -> Iterator[Span]:
    """Runs of capitalised words that no span of a higher layer overlaps, without a preposition that begins the clause. Both are in the order of the text."""
    ends, at, reach = sorted(higher), 0, 0
    for m in PROPER.finditer(text):
        lead = PREPOSITION.match(m[0])
        start = m.start() + (lead.end() if lead else 0)
        while at < len(ends) and ends[at].start < m.end():
            reach, at = max(reach, ends[at].end), at + 1
        if reach > start:
            continue
        i, kind, _ = known.get(small(text[start : m.end()]), (None, None, None))
        yield Span(start, m.end(), kind or type_of(text[start : m.end()], rules), "PROPER_NOUN_REGEX", i)


def without_honorific(span: Span, text: str, known: dict) -> Span:
    """A person without the title before the name, if what is left is a known person or an unknown name of several words."""
    if span.type not in (PERSON, UNKNOWN):
        return span
    low = small(text[span.start : span.end])
    for h in HONORIFICS:
        if low.startswith(h + " ") and len(low) > len(h) + 2:
            start = span.start + len(h) + 1
            found = known.get(small(text[start : span.end]))
            if found and found[1] == PERSON or not found and PERSON_NAME.fullmatch(text[start : span.end]):
                return span._replace(start=start, type=PERSON, known_id=found[0] if found else None)
    return span


def resolved(spans: list[Span]) -> list[Span]:
    """No two spans overlap but where a type may lie inside another. In the order of start, priority and length, a span that meets an earlier one stays only if it is an allowed part of it,
    if the earlier one is an allowed part of it, or if it holds the whole of one of no higher priority, which then goes."""
    rank = lambda s: LAYERS[s.layer][0]
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s.start, -rank(s), s.start - s.end)):
        # Spans come by start, so what still reaches past this start is near the end.
        at = next((k for k, o in enumerate(out) if o.start < s.end and s.start < o.end), None)
        if at is None:
            out.append(s)
            continue
        o = out[at]
        if o.start <= s.start and s.end <= o.end:
            if (o.start, o.end) != (s.start, s.end) and s.type in INSIDE.get(o.type, ()):
                out.append(s._replace(enclosed=True))
        elif s.start <= o.start and o.end <= s.end:
            if o.type in INSIDE.get(s.type, ()):
                out[at] = o._replace(enclosed=True)
                out.append(s)
            elif rank(o) <= rank(s):
                out[at] = s
    return sorted(out, key=lambda s: (s.start, s.end))


def names_in(text: str, dictionary: Dictionary, rules: tuple[Rule, ...], patterns: list[regex.Pattern]) -> list[Span]:
    known, fits = dictionary.known, lambda spans: [s for s in spans if valid(text[s.start : s.end])]
    higher = fits(dictionary.spans(text, small(text))) + fits(ruled(text, rules, patterns, known))
    spans = higher + fits(proper(text, higher, rules, known))
    # Only spans that overlap are compared: runs of them are resolved one by one.
    out, run, reach = [], [], -1
    for s in sorted(without_honorific(s, text, known) for s in spans):
        if run and s.start >= reach:
            out += resolved(run)
            run = []
        run.append(s)
        reach = max(reach if len(run) > 1 else -1, s.end)
    return fits(out + resolved(run))


_DICTIONARIES: dict[str, Dictionary] = {}


def dictionary_entities(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, entity_id) of the dictionary's entities that a text names (J14), whatever else overlaps them."""
    return layered_names(docs, names, ()).select("doc_id", "entity_id").distinct()


def _in_texts(docs: DataFrame, names: DataFrame, rules: tuple[Rule, ...], rows_of: Callable[[int | None, str, list[Span]], Iterator[tuple]], schema: str, types: list[pa.DataType]) -> DataFrame:
    """Rows made of the names in each text, in one pass; the dictionary is held to its bound."""
    spark = docs.sparkSession
    plain = unaccent(F.col("name"))
    forms = names.select("ord", "id", "type", (~F.contains(F.trim("canonical"), F.lit(" "))).alias("one"), F.explode(F.when(F.length(plain) >= 3, F.array("name", plain)).otherwise(F.array("name"))).alias("name"))
    forms = forms.withColumn("name", F.trim(F.lower("name"))).filter("name <> ''")
    size = forms.agg(F.coalesce(F.sum(F.octet_length("name") + F.octet_length("id")), F.lit(0))).head()[0]
    if size > DICTIONARY_BYTES:
        raise ValueError(f"a dictionary of {size} bytes; {DICTIONARY_BYTES} are broadcast at most")
    rows = [tuple(r) for r in keep_first(forms, ["name"], [F.desc("ord"), F.col("id")]).select("name", "id", "type", "one").collect()]
    held, key = spark.sparkContext.broadcast(rows), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _DICTIONARIES:
            _DICTIONARIES.clear()
            _DICTIONARIES[key] = Dictionary(held.value)
        patterns = [pattern(r) for r in rules]
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                out += rows_of(doc_id, text, names_in(text, _DICTIONARIES[key], rules, patterns) if rules else _DICTIONARIES[key].spans(text, small(text)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], [f.split()[0] for f in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def entity_id(known: Column, kind: Column, name: Column) -> Column:
    """The dictionary's id, else one made from the type and the name."""
    from quarry.functions.text import slug

    return F.coalesce(known, F.concat(F.create_map(*[F.lit(x) for pair in ID_PREFIX.items() for x in pair])[kind], slug(name)))


def layered_names(docs: DataFrame, names: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Names in the whole texts of ``docs`` (doc_id, text): doc_id, start, end (code points), name, type, layer, confidence, known_id, enclosed, entity_id.

    ``names``: ord, id, canonical, name, type; each name also counts without its marks, if that has three letters or more; of equal ones the last by ord holds. ``entity_id`` is the dictionary's, else made from the type and the name.
    Without ``rules`` only the dictionary's spans are given, overlapping ones too. A null text has no names. Raises ValueError for a dictionary of more than DICTIONARY_BYTES, which would have to be cut."""

    def rows(doc_id: int | None, text: str, spans: list[Span]) -> Iterator[tuple]:
        return ((doc_id, s.start, s.end, text[s.start : s.end], s.type, s.layer, LAYERS[s.layer][1], s.known_id, s.enclosed) for s in spans)

    types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.bool_()]
    found = _in_texts(docs, names, rules, rows, SPANS, types)
    return found.withColumn("entity_id", entity_id(F.col("known_id"), F.col("type"), F.col("name")))


PAIRS = "doc_id long, a_start int, a_end int, a string, a_type string, a_known string, b_start int, b_end int, b string, b_type string, b_known string, gap string, after string"


def near_names(docs: DataFrame, names: DataFrame, rules: tuple[Rule, ...] = RULES, most: int = 120, after: int = 35) -> DataFrame:
    """Pairs of names at most ``most`` characters apart in one text (J15): doc_id, of the first a_start, a_end, a, a_type, a_id, of the second b_start to b_id, the text between as ``gap`` and ``after`` characters behind the second.

    Found in the pass that finds the names: nothing is joined or shuffled, and rows without a doc_id keep their pairs. Pairs of a text are at most its names times those within ``most`` characters. Names that overlap are no pair; `layered_names` says what names are."""

    def rows(doc_id: int | None, text: str, spans: list[Span]) -> Iterator[tuple]:
        spans = sorted(spans, key=lambda s: (s.start, s.end, s.type))
        for i, x in enumerate(spans):
            for j in range(i + 1, len(spans)):
                y = spans[j]
                if y.start - x.end > most:
                    break
                if y.start >= x.end:
                    side = lambda s: (s.start, s.end, text[s.start : s.end], s.type, s.known_id)
                    yield (doc_id, *side(x), *side(y), text[x.end : y.start], text[y.end : y.end + after])

    side = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    found = _in_texts(docs, names, rules, rows, PAIRS, [pa.int64(), *side, *side, pa.string(), pa.string()])
    return found.withColumns({f"{x}_id": entity_id(F.col(f"{x}_known"), F.col(f"{x}_type"), F.col(x)) for x in "ab"}).drop("a_known", "b_known")
