"""Relations between names that stand near each other (P38, J15), names in brackets (P39) and a text's banner, by a table of rules over pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import slug
from quarry.operators.names import ERA, EVENT, GROUP, PERSON, PLACE, RULES, THING, WORK, Rule, layered_names, near_names

ALL_TYPES = (PERSON, PLACE, EVENT, ERA, GROUP, THING, WORK)


@dataclass(frozen=True)
class Relation:
    """``source`` -[name]-> ``target`` for two names at most ``most`` characters apart whose gap has one of the ``words`` (alternatives of a pattern, whole words) or is blank if ``bare``, and none of ``but``.

    ``either``: the source may also come second, where the words may stand behind it too if ``behind``; the first rule of a pair and relation gives the confidence. ``across``: a full stop or line end may lie between."""

    name: str
    source: tuple[str, ...]
    target: tuple[str, ...]
    most: int
    words: str
    confidence: float = 0.98
    bare: bool = False
    but: str = ""
    either: bool = True
    behind: bool = False
    across: bool = False


# Words between two names that tell a relation, and such that forbid it.
LEADING = r"lãnh\s+đạo|chỉ\s+huy|thống\s+lĩnh|chủ\s+trì|khởi\s+xướng|đại\s+phá|đánh\s+tan|tiến\s+đánh|chỉ\s+đạo|do"
LOCATED = r"tại|ở|trên|diễn\s+ra"
RESIDING = r"tại|ở|về|đến|từ|quê|sinh|mất|hy\s+sinh|đóng\s+đô|dời\s+đô|định\s+đô|lên\s+ngôi|khởi\s+nghĩa|căn\s+cứ"
PERIOD = r"thời|nhà|triều|thời\s+kỳ|thuộc"
WRITTEN = r"soạn|viết|ban|của|ghi|chép|kể|nhắc|ký|ban\s+hành|trong"
SERVING = r"vua|hoàng\s+đế|chúa|lập\s+nên|lập\s+ra|sáng\s+lập|thành\s+lập|phò\s+tá|phụng\s+sự|gia\s+nhập|tham\s+gia|thuộc|lên\s+ngôi|trị\s+vì|giúp"
OPPOSING = r"truất\s+ngôi|phế\s+truất|lật\s+đổ|đánh\s+đổ|tiêu\s+diệt|chống\s+lại|chống\s+nhà"
DISCUSSING = r"luận\s+bàn|bàn\s+về|khảo\s+cứu|viết\s+về|chép\s+lại|nhắc\s+đến|đánh\s+giá"
SAME_PERSON = r"tức|tức\s+là|còn\s+gọi\s+là|tên\s+thật\s+là|hiệu\s+là|tự\s+là|nguyên\s+danh\s+là"
SAME_PLACE = r"nay\s+là|vốn\s+là|chính\s+là|tương\s+ứng\s+với|được\s+gọi\s+là"
RELATIONS = (
    Relation("LED_BY", (EVENT,), (PERSON,), 75, LEADING, behind=True),
    Relation("LED_BY", (GROUP,), (PERSON,), 80, LEADING + r"|đứng\s+đầu"),
    Relation("HAPPENED_AT", (EVENT,), (PLACE,), 90, LOCATED, bare=True),
    Relation("HAPPENED_AT", (PERSON, GROUP), (PLACE,), 120, RESIDING, but=DISCUSSING),
    Relation("HAPPENED_AT", (THING, WORK), (PLACE,), 120, LOCATED + "|" + RESIDING),
    Relation("HAPPENED_IN", (EVENT,), (ERA,), 90, PERIOD, bare=True),
    Relation("HAPPENED_IN", (WORK, THING), (ERA,), 100, PERIOD, bare=True, but=DISCUSSING),
    Relation("MENTIONED_IN", (PERSON, GROUP, EVENT, ERA, THING), (WORK,), 120, WRITTEN, bare=True, across=True),
    Relation("PART_OF", (PERSON,), (ERA, GROUP), 120, SERVING, but=OPPOSING + "|" + DISCUSSING),
    Relation("ALIAS_OF", (PERSON,), (PERSON,), 85, SAME_PERSON, 1.0, either=False),
    Relation("SAME_AS_LOCATION", (PLACE,), (PLACE,), 85, SAME_PLACE, 1.0, but="thuộc", either=False),
)
#: Labels of a banner that names a text's realm, and the confidence of what follows from it, by type.
BANNER = r"(?i)\[(?:Kỷ/Triều\s*Đại|Triều\s*Đại|Kỷ):\s*([^\]]+)\]"
OF_BANNER = {THING: 0.95, WORK: 0.95, EVENT: 0.94}
TRIPLES = ["doc_id", "src", "rel", "tgt"]


def _word(c: Column, words: str) -> Column:
    return F.lower(c).rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])")


def _fits(r: Relation, source: str, target: str) -> Column:
    gap = F.col("gap")
    told = _word(gap, r.words) | (F.lit(r.bare) & gap.rlike(r"^\s*,?\s*$"))
    if r.behind and source == "a":
        told = told | _word(F.col("after"), r.words)
    out = F.col(f"{source}_type").isin(*r.source) & F.col(f"{target}_type").isin(*r.target) & (F.length(gap) <= r.most) & told & (F.col("a_id") != F.col("b_id"))
    if not r.across:
        out = out & ~gap.rlike(r"[.\n]")
    return out & ~_word(gap, r.but) if r.but else out


def relations(pairs: DataFrame, rules: tuple[Relation, ...] = RELATIONS) -> DataFrame:
    """Triples of the pairs of `names.near_names` (P38): doc_id, src, rel, tgt, confidence, each once a doc_id with its greatest confidence. A pair can have several relations, of one relation the first rule that fits."""
    found = []
    for name in dict.fromkeys(r.name for r in rules):
        hit = F.lit(None).cast("struct<src:string,rel:string,tgt:string,confidence:double>")
        for r in reversed([r for r in rules if r.name == name]):
            row = lambda s, t, c: F.struct(F.col(f"{s}_id").alias("src"), F.lit(name).alias("rel"), F.col(f"{t}_id").alias("tgt"), F.lit(c).alias("confidence"))  # noqa: B023, E731
            if r.either:
                hit = F.when(_fits(r, "b", "a"), row("b", "a", r.confidence)).otherwise(hit)
            hit = F.when(_fits(r, "a", "b"), row("a", "b", r.confidence)).otherwise(hit)
        found.append(hit)
    one = pairs.select("doc_id", F.explode(F.array_compact(F.array(*found))).alias("t")).select("doc_id", "t.*")
    return one.groupBy(*TRIPLES).agg(F.max("confidence").alias("confidence"))


def bracketed(pairs: DataFrame) -> DataFrame:
    """Triples of names with another of their type in brackets behind them (P39): people are aliases, places the same; doc_id, src, rel, tgt, confidence."""
    rel = F.when((F.col("a_type") == PERSON) & (F.col("b_type") == PERSON), "ALIAS_OF").when((F.col("a_type") == PLACE) & (F.col("b_type") == PLACE), "SAME_AS_LOCATION")
    p = pairs.filter(F.col("gap").rlike(r"^\s?\($") & F.col("after").startswith(")") & (F.col("a_id") != F.col("b_id"))).withColumn("rel", rel).filter("rel is not null")
    return p.select("doc_id", F.col("a_id").alias("src"), "rel", F.col("b_id").alias("tgt"), F.lit(1.0).alias("confidence")).distinct()


def of_banner(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Triples that follow from a text's banner (P38): its works, things and events belong to the realm the banner names; doc_id, src, rel, tgt, confidence. ``spans``: of `names.layered_names`. A text's first banner counts; rows of one doc_id share theirs, the least."""
    named = docs.select("doc_id", F.nullif(F.trim(F.regexp_extract("text", BANNER, 1)), F.lit("")).alias("realm")).filter("realm is not null")
    named = named.groupBy("doc_id").agg(F.concat(F.lit("dynasty_"), slug(F.min("realm"))).alias("tgt"))
    of = F.create_map(*[F.lit(x) for pair in OF_BANNER.items() for x in pair])
    items = spans.filter(F.col("type").isin(*OF_BANNER)).select("doc_id", F.col("entity_id").alias("src"), of[F.col("type")].alias("confidence"))
    out = items.join(named, "doc_id").select("doc_id", "src", F.lit("HAPPENED_IN").alias("rel"), "tgt", "confidence")
    return out.groupBy(*TRIPLES).agg(F.max("confidence").alias("confidence"))


def extracted_triples(docs: DataFrame, names: DataFrame, rules: tuple[Relation, ...] = RELATIONS, name_rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All triples of whole texts (P38, P39): doc_id, src, rel, tgt, confidence; of one triple of a doc_id the greatest confidence. Texts are not shuffled; a null text has no triples."""
    pairs = near_names(docs, names, name_rules, max(r.most for r in rules))
    every = relations(pairs, rules).unionByName(bracketed(pairs)).unionByName(of_banner(docs, layered_names(docs, names, name_rules)))
    return every.groupBy(*TRIPLES).agg(F.max("confidence").alias("confidence"))
