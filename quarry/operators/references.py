"""References across turns and rewritten questions (P33), and the premises of questions held against the graph.

What is salient before a turn is found by ordered windows over a conversation's mentions: each turn costs the same however long the conversation is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERSON, ADVERSARY, WORK, PLACE, ERA = "HISTORICAL_PERSON", "ADVERSARY", "DOCUMENT_CULTURE", "LOCATION", "DYNASTY_ERA"
#: Assistant turns that are looked at, besides all user turns; the order in which kinds give the main subject.
LATE_TURNS, SUBJECTS = 2, [PERSON, ADVERSARY, WORK, PLACE]
#: Fixed patterns: connectives that open a follow-up, questions without a subject, comparisons, words that point back, names.
CONNECTIVE = r"(?iu)^(?:vậy\s+thì|thế\s+thì|thế\s+nhưng|nhân\s+tiện|tiện\s+thể|(?:vậy|thế|còn)(?!\s*(?:kỷ|trận|lực|thần|tử|nào|gì|sao)))[\s,;:!?-]+"
OPEN_QUESTION = r"(?iu)^(?:sau\s*đó|khi\s*nào|ở\s*đâu|vì\s*sao|tại\s*sao|như\s*thế\s*nào|kết\s*quả\s*thế\s*nào|ai\s*là|ai\s*đã|vị\s*vua\s*nào|người\s*nào|tướng\s*nào)"
COMPARED = r"(?iu)^(?:nếu\s+)?(?:hãy\s+)?(?:so\s+với|so\s+sánh\s+với|đối\s+chiếu\s+với)\s+"
BOTH = r"(?iu)(?<!\p{L})(?:(?:cả\s+)?(?:hai|2)\s+(?:vị\s+tướng|vị\s+vua|nhân\s+vật|người|vị)(?:\s+(?:này|đó|ấy))?|họ|hai\s+ông|hai\s+bà)(?!\p{L})"
FOE = r"(?iu)(?<!\p{L})(?:hắn\s*ta|hắn|(?:tên\s*tướng|tướng\s*giặc|quân\s*giặc)\s+(?:này|đó|ấy))(?!\p{L})"
EVENT = r"(?iu)(?<!\p{L})((?:cuộc\s*khởi\s*nghĩa|trận\s*đánh|chiến\s*dịch|triều\s*đại)(?:\s*(?:này|đó|ấy))?)(?!\s+(?-i:\p{Lu}))(?!\p{L})"
ONE = r"(?iu)(?<!\p{L})(?:ông\s*ấy|bà\s*ấy|ông\s*ta|bà\s*ta|(?:vị\s*(?:tướng\s*)?|nhân\s*vật\s*)(?:này|đó|ấy)|ông|bà|ngài)(?!\p{L})"
NAME = r"(?<!\p{L})\p{Lu}\p{Ll}+(?:\s+\p{Lu}\p{Ll}+){1,3}(?!\p{L})"


def salient(turns: DataFrame, mentions: DataFrame) -> DataFrame:
    """What each user turn can refer to: conv_id, turn, person, second, foe, work, place, subject, named (the turn itself names something).

    ``turns``: conv_id, turn, role, text; ``mentions``: conv_id, turn, start, name, kind. Of each kind the first that an earlier user turn named, else the first of the last
    LATE_TURNS assistant turns before; ``second`` is the first other person in the same order. Conversations are windows in order of turn; a turn's mentions are one row before that."""
    kinds = {"p": PERSON, "a": ADVERSARY, "w": WORK, "l": PLACE}
    part = F.struct("start", "name")
    per = mentions.groupBy("conv_id", "turn").agg(*[F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, part))), lambda x: x["name"])).alias(c) for c, k in kinds.items()])
    t = turns.select("conv_id", "turn", "role").join(per, ["conv_id", "turn"], "left")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    user = F.col("role") == "user"
    have = lambda c: F.when(F.size(F.coalesce(c, F.array())) > 0, c)
    # An assistant turn carries its own names and those of the assistant turns just before it.
    own = Window.partitionBy("conv_id", "role").orderBy("turn")
    late = lambda c: F.flatten(F.array(*[F.coalesce(F.lag(c, k).over(own) if k else F.col(c), F.array()) for k in reversed(range(LATE_TURNS))]))
    t = t.withColumns({f"_{c}": F.when(F.col("role") == "assistant", late(c)) for c in kinds})
    first = {c: F.first(F.when(user, have(F.col(c))), ignorenulls=True) for c in kinds}
    t = t.withColumns({f"u{c}": first[c].over(before)[0] for c in kinds} | {f"v{c}": F.last(F.when(F.col("role") == "assistant", F.col(f"_{c}")), ignorenulls=True).over(before) for c in kinds})
    # The conversation's first person holds for all turns after it, so the first other one is a running first too.
    t = t.withColumn("_p1", first["p"].over(whole)[0])
    others = F.filter(F.coalesce(F.col("p"), F.array()), lambda x: ~x.eqNullSafe(F.col("_p1")))
    t = t.withColumn("u2", F.first(F.when(user, have(others)), ignorenulls=True).over(before)[0])
    pick = {name: F.coalesce(f"u{c}", F.get(F.col(f"v{c}"), F.lit(0))) for c, name in (("p", "person"), ("a", "foe"), ("w", "work"), ("l", "place"))}
    t = t.withColumns(pick)
    # A person of the assistant's comes second if no second user one is there.
    second = F.coalesce(F.when(F.col("up").isNotNull(), F.col("u2")), F.get(F.filter(F.coalesce(F.col("vp"), F.array()), lambda x: x != F.col("person")), F.lit(0)))
    named = F.size(F.concat(*[F.coalesce(F.col(c), F.array()) for c in kinds])) > 0
    out = t.filter(user).withColumns({"second": second, "subject": F.coalesce("person", "foe", "work", "place"), "named": named})
    return out.select("conv_id", "turn", "person", "second", "foe", "work", "place", "subject", "named")


def refers_back(text: Column, named: Column) -> Column:
    """Whether a question goes on from what was said: a comparison, a word that points back, or an open question without a subject of its own."""
    bare = F.regexp_replace(F.trim(text), CONNECTIVE, "")
    points = bare.rlike(ONE) | bare.rlike(BOTH) | bare.rlike(FOE)
    return bare.rlike(COMPARED) | points | (bare.rlike(OPEN_QUESTION) & ~(named | bare.rlike(NAME)))


def rewritten(turns: DataFrame, mentions: DataFrame) -> DataFrame:
    """User turns as questions that stand alone (P33): conv_id, turn, text, rewritten, refers_back, shifts (a new subject without pointing back).

    Words for two persons, a foe, an event and one person are replaced by what is salient; an open question without a name is put after the subject; a comparison names both sides.
    Without a subject before, or without a reference, a text stays as it is, trimmed; null texts are empty."""
    t = turns.select("conv_id", "turn", F.trim(F.coalesce("text", F.lit(""))).alias("text"), "role")
    s = t.filter("role = 'user'").drop("role").join(salient(turns, mentions), ["conv_id", "turn"])
    back = refers_back(F.col("text"), F.col("named"))
    literal = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    swap = lambda x, pattern, by: F.when(by.isNotNull(), F.regexp_replace(x, F.lit(pattern), literal(by))).otherwise(x)
    x = F.regexp_replace("text", CONNECTIVE, "")
    x = swap(x, BOTH, F.concat("person", F.lit(" và "), "second"))
    x = swap(x, FOE, F.col("foe"))
    anchor = F.coalesce("person", "subject")
    x = F.when(anchor.isNotNull(), F.regexp_replace(x, F.lit(EVENT), F.concat(F.lit("$1 "), literal(anchor)))).otherwise(x)
    x = swap(x, ONE, F.col("person"))
    x = F.when(x.rlike(OPEN_QUESTION) & ~x.rlike(NAME), F.concat("subject", F.lit(": "), x)).otherwise(x)
    compared = x.rlike(COMPARED) & ~F.contains(F.lower(x), F.lower("subject"))
    x = F.when(compared, F.concat(F.lit("So sánh giữa "), "subject", F.lit(" và "), F.regexp_replace(x, COMPARED, ""))).otherwise(x)
    out = F.when(back & F.col("subject").isNotNull(), x).otherwise(F.col("text"))
    return s.select("conv_id", "turn", "text", out.alias("rewritten"), back.alias("refers_back"), (F.col("named") & ~back & F.col("subject").isNotNull()).alias("shifts"))


# -- premises
#: Fixed patterns of premises: what is asked about two persons, what is done together, membership of a realm, denial, flattery, what is modern, what is old, legends.
KIN = r"(?iu)(?:anh\s+em|chị\s+em|cha\s+con|mẹ\s+con|vợ\s+chồng|ông\s+cháu|họ\s+hàng|thân\s+tộc|huyết\s+thống|con\s+trai|con\s+gái|quan\s+hệ)"
DEED = r"(?iu)(?:chiến\s+dịch|trận|đánh|khởi\s+nghĩa|chỉ\s+huy|lãnh\s+đạo|phối\s+hợp|phân\s+công|hội\s+nghị|sáng\s+lập|định\s+đô|dời\s+đô)"
REALM = r"(?iu)(?:triều|nhà|thời|vua|thuộc)"
DENIED = r"(?iu)(?:không\s+phải|chưa\s+từng|chẳng\s+phải|không\s+hề)"
FLATTERY = r"(?iu)(?:gia\s+phả|dòng\s+dõi|hậu\s+duệ|tổ\s+tiên)\s+(?:của\s+)?(?:tôi|mình|nhà\s+tôi|em)"
MODERN = r"(?iu)(?:máy\s+bay|xe\s+tăng|tên\s+lửa|điện\s+thoại|internet|máy\s+tính|súng\s+máy)"
OLD = r"(?iu)(?:vua|triều|hoàng\s+đế|phong\s+kiến|thời\s+(?:lý|trần|lê))|(?<!\d)(?:[6-9]\d{2}|1[0-8]\d{2})(?!\d)"
OLD_ARMS = r"(?iu)(?:súng\s+thần\s+cơ|hỏa\s+hổ|thần\s+công)"
LEGEND = r"(?iu)(?:truyền\s+thuyết|thần\s+thoại|nỏ\s+thần|rùa\s+vàng|thánh\s+gióng)"
KINSHIP_RELATIONS = ["ROYAL_LINEAGE", "PARENT_OF", "CHILD_OF", "SPOUSE_OF", "SIBLING_OF"]
REALM_RELATIONS = ["PART_OF", "HAPPENED_IN"]
PATTERNS = {"kin": KIN, "deed": DEED, "realm": REALM, "denied": DENIED, "flattery": FLATTERY, "modern": MODERN, "old": OLD, "old_arms": OLD_ARMS, "legend": LEGEND}


def premises(questions: DataFrame, mentions: DataFrame, edges: DataFrame, patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """The premise of each question and what the graph says of it (V08): question_id, kind, verdict, reason, src, tgt.

    ``questions``: question_id, text; ``mentions``: question_id, start, name, entity_id (null: unknown), type; ``edges``: src, rel, tgt. Checks in order, the first that applies holds:
    SAME_PERSON (two names of one known person, and no second known person): about a DEED, KINSHIP or else IDENTITY, always CORRECT_IT;
    KINSHIP of the first two persons, and REALM of the first person and era: SUPPORTED by an edge of such a relation, CONTRADICTED if the graph knows relations of that kind of the first but not this one (or the question denies one there is),
    else UNKNOWN; FLATTERY, ANACHRONISM (something modern in an old setting, no old arms), LEGEND: CORRECT_IT; NONE. Each premise is one triple, joined to the edges by its ends."""
    person, era = F.col("type") == PERSON, F.col("type") == ERA
    part = F.struct("start", "name", "entity_id")
    m = mentions.groupBy("question_id").agg(F.array_sort(F.collect_list(F.when(person, part))).alias("persons"), F.array_sort(F.collect_list(F.when(era, part))).alias("eras"))
    ids = F.array_distinct(F.filter(F.transform("persons", lambda p: p["entity_id"]), lambda i: i.isNotNull()))
    keys = F.array_distinct(F.transform("persons", lambda p: F.coalesce(p["entity_id"], F.lower(p["name"]))))
    known_names = F.size(F.array_distinct(F.transform(F.filter("persons", lambda p: p["entity_id"].isNotNull()), lambda p: F.lower(p["name"]))))
    q = questions.select("question_id", F.trim(F.coalesce("text", F.lit(""))).alias("text")).join(m, "question_id", "left")
    has = lambda k: F.col("text").rlike(patterns[k])
    same = F.coalesce((F.size(ids) == 1) & (known_names >= 2), F.lit(False))
    kin = F.coalesce(F.size(keys) >= 2, F.lit(False)) & has("kin")
    realm = F.coalesce((F.size(ids) >= 1) & (F.size("eras") >= 1), F.lit(False)) & has("realm")
    kind = (
        F.when(same, F.when(has("deed"), "SAME_PERSON_DEED").when(has("kin"), "SAME_PERSON_KINSHIP").otherwise("SAME_PERSON_IDENTITY")).when(kin, "KINSHIP").when(realm, "REALM")
        .when(has("flattery"), "FLATTERY").when(has("modern") & has("old") & ~has("old_arms"), "ANACHRONISM").when(has("legend"), "LEGEND").otherwise("NONE")
    )
    q = q.select("question_id", kind.alias("kind"), has("denied").alias("denied"), F.when(kind == "KINSHIP", F.get(keys, F.lit(0))).when(kind == "REALM", F.get(ids, F.lit(0))).alias("src"), F.when(kind == "KINSHIP", F.get(keys, F.lit(1))).when(kind == "REALM", F.get(F.col("eras"), F.lit(0))["entity_id"]).alias("tgt"))
    e = edges.filter(F.col("rel").isin(KINSHIP_RELATIONS + REALM_RELATIONS)).withColumn("kind", F.when(F.col("rel").isin(KINSHIP_RELATIONS), "KINSHIP").otherwise("REALM")).select("kind", "src", "tgt").distinct()
    turned = e.unionByName(e.filter("kind = 'KINSHIP'").select("kind", F.col("tgt").alias("src"), F.col("src").alias("tgt"))).distinct()
    hit = turned.withColumn("hit", F.lit(True))
    # Of the first end only whether the graph knows anything of the kind, so hubs are one row.
    some = turned.filter((F.col("kind") == "KINSHIP") | F.startswith("tgt", F.lit("dynasty_"))).select("kind", "src").distinct().withColumn("some", F.lit(True))
    j = q.join(hit, ["kind", "src", "tgt"], "left").join(some, ["kind", "src"], "left")
    verdict = (
        F.when(F.col("kind") == "NONE", "NONE").when(~F.col("kind").isin("KINSHIP", "REALM"), "CORRECT_IT")
        .when(F.col("hit").isNotNull(), F.when(F.col("denied"), "CONTRADICTED").otherwise("SUPPORTED")).when(F.col("some").isNotNull(), F.when(F.col("denied"), "SUPPORTED").otherwise("CONTRADICTED")).otherwise("UNKNOWN")
    )
    reason = F.when(F.col("hit").isNotNull(), "edge").when(F.col("some").isNotNull(), "other edges").when(F.col("kind").isin("KINSHIP", "REALM"), "no edge").otherwise("pattern")
    return j.select("question_id", "kind", verdict.alias("verdict"), F.when(F.col("kind") != "NONE", reason).alias("reason"), "src", "tgt")
