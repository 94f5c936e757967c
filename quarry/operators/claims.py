"""Ordered checks of claims, mentions and years, and repeated passages, as column expressions, joins and windows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.graph import staged
from quarry.operators.grounding import content_words, pairs_of, share_in

# Words of the source language that decide polarity, roles and kinship.
VICTORY = ["thắng", "đại thắng", "thắng lợi", "đánh tan", "quét sạch", "tiêu diệt", "bảo vệ", "giải phóng", "đập tan", "khởi nghĩa thành công", "chém chết", "bắt sống", "chiến thắng", "đại phá"]
DEFEAT = ["thất bại", "đầu hàng", "tháo chạy", "tử trận", "chết vô số", "thua trận", "bị diệt", "bị bắt", "tuẫn tiết", "thất thủ", "bị chém", "vỡ trận"]
ACTIONS = ["đại phá", "đánh tan", "tiêu diệt", "đập tan", "quét sạch", "đánh bại", "chém chết", "bắt sống", "bắt được", "tiêu hao", "đè bẹp", "bẻ gãy"]
KINSHIP = ["cha của", "mẹ của", "anh của", "em của", "chị của", "chồng của", "vợ của", "con của", "ông của", "cháu của"]
PASSIVE = "bị"
DENIAL = r"(?:không\s+phải|không\s+hề|chưa\s+bao\s+giờ|chẳng\s+phải)\s+(?:là\s+)?(?:chiến\s+thắng|thắng\s+lợi|đại\s+thắng|thắng\s+trận)|hoàn\s+toàn\s+sai|sai\s+lệch|hư\s+cấu|không\s+có\s+thật"
RELATIVE = r"\s+([\p{L}0-9_\s]{2,30}?)(?=[,.;!?:(]|\s+(?:và|đã|đang|ông|bà|người|theo|giúp|thì|nhưng|mà|với|trong|tại)|$)"
# Units after which a number is no year.
SPANS = "năm|tháng|ngày|vạn|nghìn|triệu|quân|lính"
UNITS = SPANS + "|thuyền|chiến thuyền|người|chiến sĩ|tàu|chiếc|khẩu|mét|km|dặm|tấn|kg|con|đoàn|trận"
# Scores of the verdicts that end the checks, and the bounds of the final score.
SCORE_EMPTY, SCORE_NO_WORDS, SCORE_OFF_TOPIC, SCORE_CONFLICT, SCORE_WRONG_TIME = 0.0, 0.8, 0.10, 0.05, 0.15
RELEVANT, ENTAILED, UNSUPPORTED, ENTAILED_WITH_NUMBERS = 0.15, 0.30, 0.20, 0.50

_ALONE = r"(?<![A-Za-z0-9_])"
_ENDS = r"(?![A-Za-z0-9_])"


@dataclass(frozen=True)
class Terms:
    """Word lists of the checks, in lower case; each list is a parameter."""

    victory: list[str] = field(default_factory=lambda: VICTORY)
    defeat: list[str] = field(default_factory=lambda: DEFEAT)
    actions: list[str] = field(default_factory=lambda: ACTIONS)
    kinship: list[str] = field(default_factory=lambda: KINSHIP)
    passive: str = PASSIVE
    denial: str = DENIAL


def routing_years(c: Column) -> Column:
    """Distinct years 100 to 2050 of three or four digits, ascending (P17, chapters); null for null."""
    found = F.transform(F.regexp_extract_all(c, F.lit(_ALONE + r"(\d{3,4})" + _ENDS), F.lit(1)), lambda y: y.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda y: y.between(100, 2050))))


def time_range(c: Column) -> Column:
    """(start_year, end_year) of a chapter's text (P17): its first span "a - b" if both are years, else the first and last of its years; nulls if it has none."""
    span = r"(?iu)(\d{3,4})\s*(?:-|–|—|đến|tới)\s*(\d{3,4})"
    a, b = (F.nullif(F.regexp_extract(c, span, g), F.lit("")).cast("int") for g in (1, 2))
    years, ok = routing_years(c), a.between(100, 2050) & b.between(100, 2050)
    return F.struct(F.when(ok, F.least(a, b)).otherwise(F.array_min(years)).alias("start_year"), F.when(ok, F.greatest(a, b)).otherwise(F.array_max(years)).alias("end_year"))


def time_bounds(c: Column) -> Column:
    """Distinct years of a claim (P17, judge): after a calendar word, before an era mark (negative), or 1000 to 2099 alone; numbers before a unit are none. Null for null."""
    after = rf"(?iu)(?:năm|thời|niên hiệu)\s+\d{{1,4}}(?:\s*(?:SCN|sau công nguyên))?(?:\s*(?:TCN|trước công nguyên))?(?!\s*(?:{UNITS})){_ENDS}"
    before_era = rf"(?iu){_ALONE}(\d{{1,4}})\s*(?:TCN|trước công nguyên){_ENDS}(?!\s*(?:{SPANS}))"
    alone = rf"(?iu){_ALONE}(1\d{{3}}|20\d{{2}}){_ENDS}(?!\s*(?:{UNITS}))"
    year = lambda m: F.regexp_extract(m, r"\d{1,4}", 0).cast("int")
    marked = F.transform(F.regexp_extract_all(c, F.lit(after), F.lit(0)), lambda m: F.when(m.rlike(r"(?iu)(?:TCN|trước công nguyên)$"), -year(m)).otherwise(year(m)))
    era = F.transform(F.regexp_extract_all(c, F.lit(before_era), F.lit(1)), lambda m: -m.cast("int"))
    plain = F.transform(F.regexp_extract_all(c, F.lit(alone), F.lit(1)), lambda m: m.cast("int"))
    return F.array_distinct(F.concat(F.filter(marked, lambda y: y.between(-3000, 2100)), F.filter(era, lambda y: y >= -3000), plain))


def name_spans(c: Column, names: list[tuple[str, str]]) -> Column:
    """First places of the named entities (id, lower-case name) in a text, in order of place, as array of (at, id)."""
    places = F.array(*[F.struct(F.instr(F.lower(c), name).alias("at"), F.lit(i).alias("id")) for i, name in names])
    return F.array_sort(F.filter(places, lambda s: s["at"] > 0))


def _any(c: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | c.contains(t)
    return out


def _first(c: Column, terms: list[str]) -> Column:
    return F.coalesce(*[F.when(c.contains(t), F.lit(t)) for t in terms], F.lit(None).cast("string"))


def _place(spans: Column, entity: Column) -> Column:
    return F.array_min(F.transform(F.filter(spans, lambda s: s["id"] == entity), lambda s: s["at"]))


def _is_agent(text: Column, verb: str, a: Column, b: Column, passive: str) -> Column:
    """Does the first of two entities act on the second around ``verb``? A passive word before the verb turns the roles."""
    at = F.instr(text, verb)
    turned = F.substring(text, F.lit(1), at - 1).contains(passive)
    return ((a < at) & (b > at) & ~turned) | ((b < at) & (a > at) & turned)


def checked_entailment(pairs: DataFrame, stopwords: list[str], terms: Terms = Terms()) -> DataFrame:
    """Is ``claim`` entailed by ``evidence`` (V02)? Ordered checks, the first that fires decides: topical relevance, turned roles, polarity, denial, kinship, time; then
    .35 words + .35 word pairs + .30 entities (.55 and .45 without entities) against .30 and .20.

    ``claim_spans`` and ``evidence_spans`` are arrays of (at, id) as of ``name_spans``. Words and pairs match as whole tokens, each counted once.
    Adds score, verdict and reason. A null or empty claim or evidence is NOT_SUPPORTED with score 0, a claim of stopwords only ENTAILED with 0.8."""
    c, e = F.lower("claim"), F.lower("evidence")
    rows = pairs.withColumns({"_cw": content_words(F.col("claim"), stopwords), "_ew": content_words(F.col("evidence"), stopwords), "_cy": time_bounds(F.col("claim")), "_ey": time_bounds(F.col("evidence")), "_ct": time_range(F.col("claim"))})
    ids = lambda spans: F.array_distinct(F.transform(spans, lambda s: s["id"]))
    rows = rows.withColumns({"_shared": F.array_intersect(ids(F.col("evidence_spans")), ids(F.col("claim_spans"))), "_words": share_in(F.col("_cw"), F.col("_ew")), "_numbers": F.filter("_cw", lambda w: w.rlike(r"^\d+$"))})
    won, lost, ewon, elost = _any(c, terms.victory), _any(c, terms.defeat), _any(e, terms.victory), _any(e, terms.defeat)
    relevant = (F.col("_words") >= RELEVANT) | (F.size(F.array_intersect("_numbers", "_ew")) > 0) | (F.size("_shared") > 0)

    a, b = F.get("_shared", F.lit(0)), F.get("_shared", F.lit(1))
    turned = F.lit(False)
    for verb in terms.actions:
        roles = [_is_agent(t, verb, _place(F.col(s), a), _place(F.col(s), b), terms.passive) for t, s in ((c, "claim_spans"), (e, "evidence_spans"))]
        turned = turned | (c.contains(verb) & e.contains(verb) & (roles[0] != roles[1]))
    turned = (F.size("_shared") >= 2) & turned

    kin, ekin = _first(c, terms.kinship), _first(e, terms.kinship)
    relative = F.lit(False)
    for t in terms.kinship:
        x, y = (F.trim(F.regexp_extract(s, t + RELATIVE, 1)) for s in (c, e))
        relative = relative | ((kin == t) & (ekin == t) & (x != "") & (y != "") & ~y.contains(x) & ~x.contains(y))

    digits = F.transform("_cy", lambda y: F.abs(y).cast("string"))
    same_year = (F.size(F.array_intersect("_cy", "_ey")) > 0) | (F.size(F.array_intersect(digits, "_ew")) > 0)
    in_range = F.exists("_ey", lambda y: y.between(F.col("_ct.start_year"), F.col("_ct.end_year")))
    wrong_time = (F.size("_cy") > 0) & ~same_year & ~F.coalesce(in_range, F.lit(False))

    pair_share = F.when(F.size("_cw") > 1, share_in(pairs_of(F.col("_cw")), pairs_of(F.col("_ew")))).otherwise(F.col("_words"))
    n = F.size(ids(F.col("claim_spans")))
    score = F.round(F.when(n > 0, 0.35 * F.col("_words") + 0.35 * pair_share + 0.30 * F.size("_shared") / n).otherwise(0.55 * F.col("_words") + 0.45 * pair_share), 3)

    checks = [
        (F.coalesce(c, F.lit("")).isin("") | F.coalesce(e, F.lit("")).isin(""), "NOT_SUPPORTED", SCORE_EMPTY, "EMPTY"),
        (F.size("_cw") == 0, "ENTAILED", SCORE_NO_WORDS, "NO_CONTENT_WORDS"),
        (~relevant, "NOT_SUPPORTED", SCORE_OFF_TOPIC, "NO_TOPICAL_OVERLAP"),
        (turned, "CONTRADICTED", SCORE_CONFLICT, "AGENT_TARGET_INVERSION"),
        (won & ~lost & elost & ~ewon, "CONTRADICTED", SCORE_CONFLICT, "CLAIM_VICTORY_EVIDENCE_DEFEAT"),
        (lost & ~won & ewon & ~elost, "CONTRADICTED", SCORE_CONFLICT, "CLAIM_DEFEAT_EVIDENCE_VICTORY"),
        (c.rlike("(?iu)" + terms.denial) & ewon, "CONTRADICTED", SCORE_CONFLICT, "EXPLICIT_NEGATION"),
        (kin.isNotNull() & ekin.isNotNull() & (kin != ekin), "CONTRADICTED", SCORE_CONFLICT, "KINSHIP_CONFLICT"),
        (relative, "CONTRADICTED", SCORE_CONFLICT, "KINSHIP_TARGET_CONFLICT"),
        (wrong_time, "NOT_SUPPORTED", SCORE_WRONG_TIME, "TEMPORAL_MISMATCH"),
    ]
    decided = F.coalesce(*[F.when(when, F.struct(F.lit(v).alias("verdict"), F.lit(s).alias("score"), F.lit(r).alias("reason"))) for when, v, s, r in checks])
    rows = rows.withColumns({"_decided": decided, "_score": score})
    held = (F.col("_score") >= ENTAILED) | ((F.col("_words") >= ENTAILED_WITH_NUMBERS) & (F.size("_numbers") > 0))
    final = F.when(held, "ENTAILED").when(F.col("_score") < UNSUPPORTED, "NOT_SUPPORTED").otherwise("NEUTRAL")
    return rows.select(*pairs.columns, F.coalesce("_decided.score", "_score").alias("score"), F.coalesce("_decided.verdict", final).alias("verdict"), F.col("_decided.reason").alias("reason"))


#: Words of a mention that stand for the one event among a document's candidates; fixed values.
EVENT_MENTIONS = ["cong_trinh", "xay_dung", "khoi_cong", "dai_cong_trinh", "chien_dich", "khoi_nghia", "tran_danh"]


def snap_mentions(mentions: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Mentions (``key``, ``mention``) snapped to the candidate spans of their document (``key``, id, text, type) (P40): by id, by text, by the longest candidate that the mention contains
    with known types first, or, for a mention of an event, to the document's only event; else rejected.

    Case does not count and mentions are trimmed. Result: ``key``, mention, id, text, type, step; nulls where rejected. Repeated mentions of a document are one row; a null or blank mention is rejected.
    One join on ``key``: candidates are the spans of one document. Of candidates alike the lowest id wins."""
    low = lambda c: F.lower(F.trim(c))
    m, c = mentions.select(key, "mention").distinct(), candidates.select(key, "id", "text", "type").distinct()
    events = c.filter((F.col("type") == "EVENT_BATTLE") | F.col("id").startswith("event_")).groupBy(key).agg(F.count(F.lit(1)).alias("_events"))
    pool = c.join(events, key, "left").select(F.col(key).alias("_key"), "id", "text", "type", "_events")
    is_event = ((F.col("type") == "EVENT_BATTLE") | F.col("id").startswith("event_")) & (F.col("_events") == 1) & _any(low("mention"), EVENT_MENTIONS)
    step = F.when(low("mention") == F.lower("id"), 1).when(low("mention") == low("text"), 2).when((low("text") != "") & low("mention").contains(low("text")), 3).when(is_event, 4)
    pairs = m.filter(F.trim("mention") != "").join(pool, F.col(key) == F.col("_key")).withColumn("step", step).filter("step is not null")
    known = (F.col("type") != "UNKNOWN") & ~F.coalesce(F.col("id").startswith("unknown_"), F.lit(False))
    inside = F.col("step") == 3
    order = F.struct("step", F.when(inside & ~F.coalesce(known, F.lit(False)), 1).otherwise(0), F.when(inside, -F.length("text")).otherwise(0), "id", "text", "type")
    best = pairs.groupBy(F.col(key).alias("_key"), F.col("mention").alias("_mention")).agg(F.min_by(F.struct("id", "text", "type", "step"), order).alias("b"))
    return m.join(best, F.col(key).eqNullSafe(F.col("_key")) & F.col("mention").eqNullSafe(F.col("_mention")), "left").select(key, "mention", "b.id", "b.text", "b.type", "b.step")


def dedup_text(docs: DataFrame, least_paragraph: int = 35, least_sentence: int = 25) -> DataFrame:
    """Repeated paragraphs, then repeated sentences of the paragraphs that stay, leave a text (P30); case, marks and blanks do not count, and short ones stay.

    Result: doc_id, text; kept paragraphs are joined by an empty line, their sentences by a blank. A null or blank text stays as it is; rows of one doc_id are apart from each other.
    Rows are numbered and staged, then one shuffle by row; a text's own paragraphs and sentences meet in one group."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    norm = lambda c: F.regexp_replace(F.lower(c), r"[.,!?:;\s]+", " ")
    # Numbers are given once: what reads them twice must not count anew.
    rows = staged(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row")))
    par = rows.select("_row", F.posexplode(F.split("text", r"\n{2,}")).alias("p", "par")).withColumn("par", strip("par")).filter("par <> ''").repartition("_row")
    seen = lambda by, order: F.row_number().over(Window.partitionBy("_row", by).orderBy(*order)) > 1
    par = par.withColumn("norm", norm("par")).withColumn("again", seen("norm", ["p"])).filter(~F.col("again") | (F.length("par") < least_paragraph)).select("_row", "p", "par")
    sent = par.select("_row", "p", F.posexplode(F.split("par", r"(?<=[.?!])\s+")).alias("s", "sent")).withColumn("sent", strip("sent")).filter("sent <> ''")
    long = F.length("sent") >= least_sentence
    sent = sent.withColumn("norm", F.when(long, norm("sent")).otherwise(F.concat_ws("/", F.lit("\u0000"), "p", "s"))).withColumn("again", seen("norm", ["p", "s"])).filter(~F.col("again"))
    lines = sent.groupBy("_row", "p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "sent"))), lambda x: x["sent"]), " ").alias("line"))
    kept = lines.groupBy("_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda x: x["line"]), "\n\n").alias("_kept"))
    return rows.join(kept, "_row", "left").select("doc_id", F.coalesce("_kept", "text").alias("text"))


@dataclass(frozen=True)
class Anchor:
    """A rule that gives a question its fixed facts: an entity, a pattern, or ``least`` of ``years`` together with one of ``words`` (any, if there are none)."""

    content: str
    entities: tuple[str, ...] = ()
    pattern: str | None = None
    years: tuple[int, ...] = ()
    words: tuple[str, ...] = ()
    least: int = 1


def chronology_anchors(questions: DataFrame, entities: DataFrame, rules: list[Anchor]) -> DataFrame:
    """The facts that go before each question (O11): contents of the rules that match, in their order, then a line for each entity with dynasty and years.

    ``questions`` (query, text, ids array<string>, years array<int>), ``entities`` (id, name, dynasty, first_year, last_year). Result: query, anchors (array), bullets (array); negative years are BCE.
    Entities join by id; an id without an entity, or an entity without dynasty and years, has no line."""
    text = F.lower(F.coalesce("text", F.lit("")))
    ids, years = F.coalesce("ids", F.array().cast("array<string>")), F.coalesce("years", F.array().cast("array<int>"))
    matched = []
    for r in rules:
        n = sum((F.when(F.array_contains(years, y) | text.rlike(f"{_ALONE}{y}{_ENDS}"), 1).otherwise(0) for y in r.years), F.lit(0))
        hit = (n >= r.least) & (_any(text, list(r.words)) if r.words else F.lit(True)) if r.years else _any(text, list(r.words))
        if r.entities:
            hit = hit | F.arrays_overlap(ids, F.array(*map(F.lit, r.entities)))
        if r.pattern:
            hit = hit | text.rlike("(?iu)" + r.pattern)
        matched.append(F.when(hit, F.lit(r.content)))
    anchors = F.filter(F.array(*matched), lambda x: x.isNotNull()) if matched else F.array().cast("array<string>")
    year = lambda c: F.when(F.col(c) < 0, F.concat(F.abs(F.col(c)).cast("string"), F.lit(" TCN"))).otherwise(F.col(c).cast("string"))
    span = F.when(F.col("first_year").isNotNull(), F.concat(F.lit("Niên đại: "), F.concat_ws(" - ", year("first_year"), year("last_year"))))
    parts = F.concat_ws(" | ", F.when(F.col("dynasty").isNotNull(), F.concat(F.lit("Triều đại: "), "dynasty")), span)
    lines = entities.select("id", F.when(parts != "", F.concat(F.lit("- "), F.coalesce("name", "id"), F.lit(": "), parts)).alias("line")).filter("line is not null")
    asked = questions.select("query", F.posexplode(F.array_distinct(ids)).alias("pos", "id"))
    bullets = asked.join(lines, "id").groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("bullets"))
    return questions.select("query", anchors.alias("anchors")).join(bullets, "query", "left").withColumn("bullets", F.coalesce("bullets", F.array().cast("array<string>")))
