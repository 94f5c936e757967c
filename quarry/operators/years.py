"""Years in texts and questions, the realm and names of a text, and questions split by year or by entity. All but the dictionary pass is column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import unaccent
from quarry.operators.names import PERSON, PLACE, dictionary_entities
from quarry.operators.relational import epoch_of_year

# Centuries in Roman numerals, marks of years before the era, words around numbers that are no years.
ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx", "xxi"]
BEFORE_ERA = r"tcn|trước\s+công\s+nguyên|trước\s+cn"
COUNTED = "vạn|người|quân|lính|chiến thuyền|thuyền|km|mét|m|ha|đồng|trang|câu|chữ|bài|phút|giờ|lần"
COUNTING = "top|thứ|hạng|hơn|khoảng|gần|hàng"
OPENING = "từ|đến|trong|vào"
FIRST_YEAR, LAST_YEAR, LAST_DATED, OLDEST_PLAIN, COUNT_BELOW = 100, 2100, 2026, 800, 500
# Words of a realm, in order of priority.
REALMS = [
    ("Nhà Tây Sơn", ["nhà tây sơn", "triều tây sơn", "thời tây sơn", "quân tây sơn", "quang trung", "nguyễn huệ"]),
    ("Nhà Nguyễn", ["nhà nguyễn", "triều nguyễn", "thời nguyễn", "vua gia long", "vua minh mạng", "vua tự đức"]),
    ("Nhà Lê Sơ", ["nhà lê sơ", "triều lê sơ", "thời lê sơ", "vua lê thái tổ", "vua lê thánh tông"]),
    ("Lê Trung Hưng", ["lê trung hưng", "chúa trịnh", "chúa nguyễn", "đàng trong", "đàng ngoài"]),
    ("Nhà Mạc", ["nhà mạc", "triều mạc", "thời mạc", "mạc đăng dung"]),
    ("Nhà Hồ", ["nhà hồ", "triều hồ", "thời hồ", "hồ quý ly", "hồ hán thương"]),
    ("Nhà Trần", ["nhà trần", "triều trần", "thời trần", "vua trần thái tông", "trần hưng đạo", "trần nhân tông"]),
    ("Nhà Lý", ["nhà lý", "triều lý", "thời lý", "lý thái tổ", "lý thường kiệt"]),
    ("Nhà Tiền Lê", ["tiền lê", "nhà tiền lê", "triều tiền lê", "lê hoàn", "lê đại hành"]),
    ("Nhà Đinh", ["nhà đinh", "triều đinh", "đinh tiên hoàng", "đinh bộ lĩnh"]),
    ("Nhà Ngô", ["nhà ngô", "triều ngô", "ngô quyền", "tiền ngô vương"]),
    ("Nhà Tiền Lý", ["tiền lý", "nhà tiền lý", "lý bí", "lý nam đế", "vạn xuân"]),
    ("Trưng Nữ Vương", ["trưng nữ vương", "hai bà trưng", "trưng trắc", "trưng nhị"]),
    ("Âu Lạc", ["âu lạc", "an dương vương", "thục phán"]),
    ("Văn Lang", ["văn lang", "hùng vương", "hồng bàng"]),
    ("Thời kỳ Pháp thuộc", ["pháp thuộc", "thực dân pháp", "bảo hộ"]),
    ("Thời kỳ Bắc thuộc", ["bắc thuộc", "đô hộ"]),
    ("Thời kỳ Hiện đại", ["kháng chiến chống pháp", "kháng chiến chống mỹ", "việt nam dân chủ cộng hòa"]),
]

_ALONE = r"(?<![A-Za-z0-9_])"
_ENDS = r"(?![A-Za-z0-9_])"
_WORD = r"(?<![\p{L}\p{N}])"
_WORD_ENDS = r"(?![\p{L}\p{N}_])"
_NUMBER = _ALONE + r"\d{3,4}" + _ENDS
_SPAN = _ALONE + r"(\d{3,4})\s*[-–—]\s*(\d{3,4})" + _ENDS


def _century(c: Column) -> Column:
    """A century's number from Roman or Arabic digits; 0 for anything else."""
    return F.when(c.rlike(r"^\d+$"), c.cast("int")).otherwise(F.array_position(F.array(*map(F.lit, ROMAN)), c).cast("int"))


def _span(a: Column, b: Column) -> Column:
    return F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def question_years(c: Column, reigns: list[tuple[str, int, int]] = ()) -> Column:
    """Years that a question names (P16), as (years, range).

    ``years``, distinct, in this order: both ends of each range; years before the era, negative; the 50th year of a century; the middle of each of ``reigns`` (name, first, last) whose name stands in the text as whole words;
    years of one or two digits after the word for year; numbers of three or four digits from 100 to 2100 that no unit, no word for a span of years and no era mark follows and, up to 500, no counting word precedes.
    ``range``: the last range, else the first century, else the first reign, else null. Numbers end at other characters than ASCII letters, digits and _, words at other characters than letters, digits and _. Without text there are no years."""
    rows = [F.struct(F.lit(f" {name.lower()} ").alias("name"), F.lit((a + b + 1) // 2).alias("middle"), _span(F.lit(a), F.lit(b)).alias("span")) for name, a, b in reigns]
    known = lambda y: y.between(FIRST_YEAR, LAST_YEAR)

    def found(low: Column) -> Column:
        """What each rule finds in the text in lower case."""
        every = lambda p, g=1: F.regexp_extract_all(low, F.lit(p), F.lit(g))
        numbers = lambda p: F.transform(every(p), lambda y: y.cast("int"))
        spans = F.filter(F.zip_with(every(_SPAN, 1), every(_SPAN, 2), _span), lambda s: known(s["start"]) & known(s["end"]))
        before_era = F.transform(F.filter(numbers(rf"(\d{{1,4}})\s*(?:{BEFORE_ERA}){_WORD_ENDS}"), lambda y: y > 0), lambda y: -y)
        centuries = F.filter(F.transform(every(rf"(?:thế\s+kỷ|thế\s+kỉ|tk)\s*(?:thứ\s+)?([ivxlcdm]+|\d{{1,2}}){_WORD_ENDS}"), _century), lambda n: n.between(1, len(ROMAN)))
        short = F.filter(numbers(rf"năm\s+(\d{{1,2}}){_ENDS}(?!\s*(?:tcn|trước))"), lambda y: y > 0)
        # What stands before and after each number: the pieces between numbers.
        around = _with(F.split(low, _NUMBER), lambda pieces: F.zip_with(F.zip_with(every(_NUMBER, 0), pieces, lambda y, b: F.struct(y.cast("int").alias("y"), b.alias("before"))), F.slice(pieces, F.lit(2), F.size(pieces)), lambda s, a: F.struct(s["y"].alias("y"), s["before"].alias("before"), a.alias("after"))))
        plain = F.transform(F.filter(F.filter(around, lambda s: s["y"].isNotNull()), year), lambda s: s["y"])
        words = F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
        named = [_with(words, lambda w: F.filter(F.array(*rows), lambda r: F.contains(w, r["name"]))).alias("named")] if rows else []
        return F.struct(spans.alias("spans"), before_era.alias("before_era"), centuries.alias("centuries"), short.alias("short"), plain.alias("plain"), *named)

    def year(s: Column, i: Column) -> Column:
        follows = lambda p: s["after"].rlike(rf"^\s*(?:{p}){_WORD_ENDS}")
        spent = follows("năm") & ~((i == 0) & s["before"].rlike(rf"^\s*(?:{OPENING})\s*$"))
        counted = s["before"].rlike(rf"(?:{COUNTING})\s*$") & (s["y"] <= COUNT_BELOW)
        return known(s["y"]) & ~follows(COUNTED) & ~spent & ~follows(BEFORE_ERA) & ~counted

    def told(f: Column) -> Column:
        parts = [F.flatten(F.transform(f["spans"], lambda s: F.array(s["start"], s["end"]))), f["before_era"], F.transform(f["centuries"], lambda n: n * 100 - 50)]
        parts += [*([F.transform(f["named"], lambda r: r["middle"])] if rows else []), f["short"], f["plain"]]
        last, first = F.get(f["spans"], F.size(f["spans"]) - 1), F.get(f["centuries"], F.lit(0))
        ranges = [F.when(last.isNotNull(), _span(F.least(last["start"], last["end"]), F.greatest(last["start"], last["end"]))), F.when(first.isNotNull(), _span(first * 100 - 99, first * 100))]
        ranges += [F.get(f["named"], F.lit(0))["span"]] if rows else []
        return F.struct(F.array_distinct(F.concat(*parts)).alias("years"), F.coalesce(*ranges).alias("range"))

    return _with(F.coalesce(F.lower(c), F.lit("")), lambda low: _with(found(low), told))


def text_bounds(c: Column) -> Column:
    """(time_start, time_end) of a text (P15): the first and last of its years, nulls if it has none.

    Years are numbers after a word for year, time or century (to 2026; negative before an era mark), both ends of a century in Roman numerals there, any number of 1 to 3000 before an era mark, and numbers of 800 to 2026 alone."""
    marked = rf"(?iu)(?:năm|thời gian|thế kỷ|thế kỉ|tk)\s+(\d{{1,4}}|[ivxlcdm]+)(?:\s*({BEFORE_ERA}))?{_WORD_ENDS}"
    general = rf"(?iu){_ALONE}(\d{{1,4}})(?:\s*({BEFORE_ERA}){_WORD_ENDS}|{_ENDS})"
    every = lambda p, g: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), F.lit(g))
    pairs = lambda p: F.zip_with(every(p, 1), every(p, 2), lambda y, e: F.struct(F.lower(y).alias("y"), (e != "").alias("bc")))

    def told(s: Column) -> Column:
        y, n = F.when(s["y"].rlike(r"^\d"), s["y"]).cast("int"), F.when(~s["y"].rlike(r"^\d"), _century(s["y"]))
        return F.when(y.between(1, LAST_DATED), F.array(F.when(s["bc"], -y).otherwise(y))).when(n > 0, F.array(n * 100 - 99, n * 100)).otherwise(F.array().cast("array<int>"))

    def plain(s: Column) -> Column:
        y = s["y"].cast("int")
        return F.when(s["bc"] & y.between(1, 3000), -y).when(y.between(OLDEST_PLAIN, LAST_DATED), y)

    years = F.concat(F.flatten(F.transform(pairs(marked), told)), F.array_compact(F.transform(pairs(general), plain)))
    return F.struct(F.array_min(years).alias("time_start"), F.array_max(years).alias("time_end"))


def realm_of(c: Column, realms: list[tuple[str, list[str]]] = REALMS) -> Column:
    """The first of ``realms`` (name, phrases in lower case) of which a phrase stands in the text as whole words (P15); null if none does."""
    low = F.lower(c)
    return F.coalesce(*[F.when(low.rlike(rf"{_WORD}(?:{'|'.join(terms)})(?![\p{{L}}\p{{N}}])"), name) for name, terms in realms], F.lit(None).cast("string"))


def enriched(docs: DataFrame, names: DataFrame, chronology: DataFrame, realms: list[tuple[str, list[str]]] = REALMS) -> DataFrame:
    """Texts with what they tell of time, people and place (P15): doc_id, time_start, time_end, realm (by its words), dynasty_id (by the first year), figures, location.

    ``docs``: doc_id, text; ``names``: as of `names.layered_names`. ``figures`` are the canonical names of the people that a text names, by ord, ``location`` the first place by ord, as whole words, with or without marks. Rows with one doc_id share their names;
    a row without a doc_id has none. Names are few a text, the dictionary is bounded, and texts are not shuffled: only (doc_id, name) rows and the columns beside them are."""
    told = names.select(F.col("id").alias("entity_id"), "ord", "canonical", "type").filter(F.col("type").isin(PERSON, PLACE)).groupBy("entity_id").agg(F.min(F.struct("ord", "canonical", "type")).alias("e")).select("entity_id", "e.*")
    found = dictionary_entities(docs, names).join(F.broadcast(told), "entity_id")
    of = lambda kind: F.when(F.col("type") == kind, F.struct("ord", "canonical"))
    found = found.groupBy("doc_id").agg(F.array_sort(F.collect_set(of(PERSON))).alias("p"), F.min(of(PLACE)).alias("l"))
    found = found.select("doc_id", F.array_distinct(F.transform("p", lambda s: s["canonical"])).alias("figures"), F.col("l.canonical").alias("location"))
    rows = docs.select("doc_id", text_bounds(F.col("text")).alias("t"), realm_of(F.col("text"), realms).alias("realm")).select("doc_id", "t.*", "realm")
    columns = ["doc_id", "time_start", "time_end", "realm", "dynasty_id"]
    dated = epoch_of_year(rows.filter("time_start is not null"), chronology, "time_start").select(*columns)
    every = dated.unionByName(rows.filter("time_start is null").withColumn("dynasty_id", F.lit(None).cast("string")).select(*columns))
    return every.join(found, "doc_id", "left").withColumn("figures", F.coalesce("figures", F.array().cast("array<string>")))


# -- questions split into branches
def branches(queries: DataFrame, mentions: DataFrame, reigns: list[tuple[str, int, int]] = ()) -> DataFrame:
    """A question's parts for searches of their own (X13, X14): query, branch (from 0), text, target_year, entities.

    ``queries``: query, text, comparative; ``mentions``: query, ord, id, name, type, first, last, the entities that a question names, in order. A question with two years after the era or more has a branch for each of its first four (ascending):
    without the other years, with the names, not in it yet, of the entities whose time holds the year within 15 years (or whose id ends in it), and the year; its entities are those, or all if none does.
    Another, if ``comparative`` and of two entities or more, has a branch for each of five: those in its last sentence first, then people, eras and battles, then by ord; its text is the first sentence that has the name, else the question, and the name.
    Any other has one branch, itself with all its entities. A question without text has an empty one."""
    m = mentions.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "name", "type", "first", "last"))).alias("m"))
    q = queries.select("query", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("comparative", F.lit(False)).alias("comparative")).join(m, "query", "left")
    q = q.withColumn("m", F.coalesce("m", F.array().cast(dict(m.dtypes)["m"])))
    q = q.withColumn("years", F.array_sort(F.filter(question_years(F.col("text"), reigns)["years"], lambda y: y.between(1, LAST_YEAR))))
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    ids = lambda a: F.transform(a, lambda e: e["id"])

    y = F.col("target_year")
    a = q.filter("size(years) >= 2").select("*", F.posexplode(F.slice("years", 1, 4)).alias("branch", "target_year"))
    others = F.concat(F.lit(_ALONE + "("), F.array_join(F.filter("years", lambda o: o != y).cast("array<string>"), "|"), F.lit(")" + _ENDS))
    near = lambda e: F.coalesce(y.between(e["first"] - 15, F.coalesce(e["last"], e["first"]) + 15), F.lit(False)) | F.contains(e["id"], F.concat(F.lit("_"), y.cast("string")))
    a = a.withColumn("bound", F.filter("m", near)).withColumn("text", tidy(F.regexp_replace("text", others, F.lit(""))))
    told = F.transform(F.filter("bound", lambda e: ~F.contains(F.lower("text"), F.lower(e["name"]))), lambda e: e["name"])
    by_year = a.select("query", "branch", tidy(F.concat_ws(" ", "text", F.array_join(told, " "), F.lit("năm"), y.cast("string"))).alias("text"), "target_year", F.when(F.size("bound") > 0, ids(F.col("bound"))).otherwise(ids(F.col("m"))).alias("entities"))

    apart = F.col("comparative") & (F.size("m") >= 2)
    s = q.filter(F.size("years") < 2).withColumn("s", F.split("text", r"(?<=[.?!])\s+"))
    last = F.lower(F.get("s", F.size("s") - 1))
    weight = lambda e: F.when(e["type"].isin("HISTORICAL_PERSON", "DYNASTY_ERA", "EVENT_BATTLE"), 0).otherwise(1)
    placed = F.array_sort(F.transform("m", lambda e: F.struct((~F.contains(last, F.lower(e["name"]))).cast("int").alias("a"), weight(e).alias("b"), e.alias("e"))))
    one = s.filter(apart).select("query", "s", "text", F.posexplode(F.slice(placed, 1, 5)).alias("branch", "p")).select("query", "s", "text", "branch", "p.e.*")
    base = F.coalesce(F.get(F.filter("s", lambda x: F.contains(F.lower(x), F.lower("name"))), F.lit(0)), F.col("text"))
    by_entity = one.select("query", "branch", tidy(F.concat_ws(" ", base, "name")).alias("text"), F.col("first").alias("target_year"), F.array("id").alias("entities"))
    whole = s.filter(~apart).select("query", F.lit(0).alias("branch"), "text", F.get("years", F.lit(0)).alias("target_year"), ids(F.col("m")).alias("entities"))
    return by_year.unionByName(by_entity).unionByName(whole)


# Kinds of conflicts, words of a comparison, and the bounds of what is anachronistic.
MYTH, ANACHRONISM, MISMATCH = "MYTHOLOGY_HISTORICAL_INCOMPATIBILITY", "ANACHRONISTIC_WEAPONRY_TECH", "CHRONOLOGY_MISMATCH"
COMPARING = ["so sánh", "khác nhau", "đối chiếu", "cả hai", "so với", "tương đồng", "khác biệt"]
MODERN_SINCE, LIFE_MARGIN, FAR_OFF = 1850, 60, 100


def premise_conflicts(queries: DataFrame, people: DataFrame, myths: list[str], treaties: list[str], inventions: list[str], battles: list[str], reigns: list[tuple[str, int, int]] = ()) -> DataFrame:
    """What makes a question's premise impossible (P35), the first that holds: query, kind, subject, object; nulls if nothing does.

    ``queries``: query, text; ``people``: query, ord, name, first, last, the people that a question names, in order; the lists are phrases in order of priority, found as whole words, with or without marks. In this order: a myth and a treaty; an invention with the first person who died before 1850,
    else with one of ``battles`` unless the question has a year of 1850 or later; unless it compares, the first person and year after the era that lies more than 60 years outside the person's life and more than 100 from both ends."""
    m = people.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "first", "last"))).alias("m"))
    q = queries.select("query", F.coalesce("text", F.lit("")).alias("text")).join(m, "query", "left")
    plain = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    q = q.select("query", F.coalesce("m", F.array().cast(dict(m.dtypes)["m"])).alias("m"), question_years(F.col("text"), reigns)["years"].alias("years"), plain(F.col("text")).alias("w"), plain(unaccent(F.col("text"))).alias("u"))

    def first_of(phrases: list[str]) -> Column:
        held = lambda p: F.contains("w", plain(p)) | F.contains("u", plain(unaccent(p)))
        return F.get(F.filter(F.array(*map(F.lit, phrases)).cast("array<string>"), held), F.lit(0))

    q = q.withColumns({"myth": first_of(myths), "treaty": first_of(treaties), "invention": first_of(inventions), "battle": first_of(battles), "comparing": first_of(COMPARING).isNotNull()})
    old = F.get(F.filter("m", lambda p: p["last"] < MODERN_SINCE), F.lit(0))["name"]
    late = F.exists("years", lambda y: y >= MODERN_SINCE)

    def outside(p: Column, y: Column) -> Column:
        return (y > 0) & ((y < p["first"] - LIFE_MARGIN) | (y > p["last"] + LIFE_MARGIN)) & (F.abs(y - p["first"]) > FAR_OFF) & (F.abs(y - p["last"]) > FAR_OFF)

    off = F.flatten(F.transform("m", lambda p: F.transform(F.filter("years", lambda y: outside(p, y)), lambda y: F.struct(p["name"].alias("name"), y.alias("y")))))
    first_off = F.when(~F.col("comparing"), F.get(off, F.lit(0)))
    found = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("subject"), b.alias("object"))
    verdict = F.when(F.col("myth").isNotNull() & F.col("treaty").isNotNull(), found(MYTH, F.col("myth"), F.col("treaty")))
    verdict = verdict.when(F.col("invention").isNotNull() & old.isNotNull(), found(ANACHRONISM, F.col("invention"), old)).when(F.col("invention").isNotNull() & F.col("battle").isNotNull() & ~late, found(ANACHRONISM, F.col("invention"), F.col("battle")))
    verdict = verdict.when(first_off.isNotNull(), found(MISMATCH, first_off["name"], first_off["y"].cast("string")))
    return q.select("query", verdict.alias("v")).select("query", "v.kind", "v.subject", "v.object")


def effective_bounds(title: Column, start: Column, end: Column, epochs: Column, dynasty: Column, chronology: list[tuple[str, str, int, int]]) -> Column:
    """(start, end) by which a chunk is dated (X20): the first year in its title (900 to 2099); else its own; without either bound the first period of ``chronology`` (epoch, name, first, last) of its epochs, or, if it has none, of a name that holds its dynasty's; else nulls."""
    year = F.nullif(F.regexp_extract(F.coalesce(title, F.lit("")), _ALONE + r"(1\d{3}|20\d{2}|9\d{2})" + _ENDS, 1), F.lit("")).cast("int")
    rows = F.array(*[F.struct(F.lit(e).alias("epoch"), F.lit(n.lower()).alias("name"), _span(F.lit(a), F.lit(b)).alias("span")) for e, n, a, b in chronology])
    by_epoch = F.get(F.filter(rows, lambda r: F.array_contains(epochs, r["epoch"])), F.lit(0))["span"]
    by_name = F.get(F.filter(rows, lambda r: F.contains(r["name"], F.lower(F.trim(dynasty)))), F.lit(0))["span"]
    looked = F.when(F.size(F.coalesce(epochs, F.array().cast("array<string>"))) > 0, by_epoch).when(F.trim(dynasty) != "", by_name)
    return F.when(year.isNotNull(), _span(year, year)).when(F.coalesce(start, end).isNotNull(), _span(start, end)).otherwise(F.coalesce(looked, _span(F.lit(None), F.lit(None))))
