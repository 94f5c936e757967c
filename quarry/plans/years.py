"""Queries over years: questions, texts with people and places, branches, chunks' dates, and triples held against their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import dims
from quarry.operators import grounding as V
from quarry.operators import names as N
from quarry.operators import retrieval as X
from quarry.operators import years as Y
from quarry.plans.base import CHUNKS_SQL, chunks, table
from quarry.plans.registry import query
from quarry.plans.search import _PLAIN, _TYPES, NAMES

_END = r"(?:[^\p{L}\p{N}_]|$)"
_ROMAN = " ".join(Y.ROMAN)

# -- questions: the whole texts of all documents, and one question an order, with years of its date and customer
_REIGNS = [("Hồng Đức", 1470, 1497), ("Cảnh Hưng", 1740, 1786), ("Thái Bình", 970, 980)]
_Y = "(year(o_orderdate) - 1000 + o_custkey % 1100)"
_ASKED = f"""CASE o_orderkey % 13 WHEN 0 THEN concat('So sánh năm ', {_Y}, ' và ', {_Y} + 90) WHEN 1 THEN concat('Từ ', {_Y}, ' – ', {_Y} + 27, '?') WHEN 2 THEN concat('năm ', o_custkey % 400, ' TCN') WHEN 3 THEN concat('thế kỷ ', split_part('{_ROMAN}', ' ', CAST(o_custkey % 21 AS INT) + 1), ' và năm ', {_Y})
 WHEN 4 THEN concat('thế kỉ thứ ', o_custkey % 30, ' trước công nguyên') WHEN 5 THEN concat('đời Hồng Đức, vào năm ', o_custkey % 110) WHEN 6 THEN concat('hơn ', o_custkey, ' quân và ', {_Y}, ' năm') WHEN 7 THEN concat('khoảng ', o_custkey % 999, ', thời Thái Bình') WHEN 8 THEN concat('trong ', {_Y}, ' năm, top ', o_custkey % 900)
 WHEN 9 THEN concat({_Y}, '-', {_Y} - 5, ' hay 555-', {_Y}, ' hay 12345') WHEN 10 THEN concat(o_custkey, ' trước CN, ', {_Y}, 'một') WHEN 11 THEN concat('tk ', o_custkey % 25, ', niên hiệu Cảnh Hưng ', {_Y}, ' chữ') ELSE NULL END"""
_COUNTED = rf"^\s*(?:{Y.COUNTED}){_END}"


@query(
    "op_p16_question_years",
    rf"""WITH t AS (SELECT 'd' AS kind, doc_id AS id, lower(text) AS s FROM documents UNION ALL SELECT 'o', o_orderkey, lower({_ASKED}) FROM orders),
 l AS (SELECT kind, id, coalesce(s, '') AS s, regexp_extract_all(coalesce(s, ''), '\b\d{{3,4}}\b') AS n, string_split_regex(coalesce(s, ''), '\b\d{{3,4}}\b') AS p,
  ' ' || regexp_replace(coalesce(s, ''), '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' ' AS w FROM t),
 a AS (SELECT *, list_filter(list_transform(list_zip(regexp_extract_all(s, '\b(\d{{3,4}})\s*[-–—]\s*(\d{{3,4}})\b', 1), regexp_extract_all(s, '\b(\d{{3,4}})\s*[-–—]\s*(\d{{3,4}})\b', 2)), lambda x: [CAST(x[1] AS INT), CAST(x[2] AS INT)]), lambda x: list_min(x) >= 100 AND list_max(x) <= 2100) AS spans,
  list_filter(list_transform(regexp_extract_all(s, '(\d{{1,4}})\s*(?:{Y.BEFORE_ERA}){_END}', 1), lambda x: -CAST(x AS INT)), lambda x: x < 0) AS bc,
  list_filter(list_transform(regexp_extract_all(s, '(?:thế\s+kỷ|thế\s+kỉ|tk)\s*(?:thứ\s+)?([ivxlcdm]+|\d{{1,2}}){_END}', 1), lambda x: coalesce(TRY_CAST(x AS INT), list_position(string_split('{_ROMAN}', ' '), x))), lambda x: x BETWEEN 1 AND 21) AS cent,
  list_filter([{{'name': ' hồng đức ', 'm': 1484, 'a': 1470, 'b': 1497}}, {{'name': ' cảnh hưng ', 'm': 1763, 'a': 1740, 'b': 1786}}, {{'name': ' thái bình ', 'm': 975, 'a': 970, 'b': 980}}], lambda r: contains(w, r.name)) AS reigns,
  list_transform(list_filter(list_zip(regexp_extract_all(s, 'năm\s+(\d{{1,2}})\b(\s*(?:tcn|trước))?', 1), regexp_extract_all(s, 'năm\s+(\d{{1,2}})\b(\s*(?:tcn|trước))?', 2)), lambda x: coalesce(x[2], '') = '' AND CAST(x[1] AS INT) > 0), lambda x: CAST(x[1] AS INT)) AS short,
  list_transform(list_filter(list_transform(n, lambda y, i: {{'y': CAST(y AS INT), 'i': i, 'b': p[i], 'a': p[i + 1]}}), lambda r: r.y BETWEEN 100 AND 2100 AND NOT regexp_matches(r.a, '{_COUNTED}') AND NOT regexp_matches(r.a, '^\s*(?:{Y.BEFORE_ERA}){_END}')
   AND NOT (regexp_matches(r.a, '^\s*năm{_END}') AND NOT (r.i = 1 AND regexp_matches(r.b, '^\s*(?:{Y.OPENING})\s*$'))) AND NOT (regexp_matches(r.b, '(?:{Y.COUNTING})\s*$') AND r.y <= 500)), lambda r: r.y) AS plain FROM l),
 c AS (SELECT *, list_concat(flatten(spans), bc, list_transform(cent, lambda x: x * 100 - 50), list_transform(reigns, lambda r: r.m), short, plain) AS y FROM a)
 SELECT kind, id, coalesce(array_to_string(list_filter(y, lambda x, i: list_position(y, x) = i), ','), '') AS years,
  CAST(CASE WHEN len(spans) > 0 THEN list_min(spans[-1]) WHEN len(cent) > 0 THEN cent[1] * 100 - 99 ELSE reigns[1].a END AS INT) AS first, CAST(CASE WHEN len(spans) > 0 THEN list_max(spans[-1]) WHEN len(cent) > 0 THEN cent[1] * 100 ELSE reigns[1].b END AS INT) AS last FROM c""",
)
def _(spark, d):
    t = table(spark, d, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text").unionByName(table(spark, d, "orders").selectExpr("'o' AS kind", "o_orderkey AS id", f"{_ASKED} AS text"))
    t = t.select("kind", "id", Y.question_years(F.col("text"), _REIGNS).alias("y"))
    return t.select("kind", "id", F.array_join(F.col("y.years").cast("array<string>"), ",").alias("years"), F.col("y.range.start").alias("first"), F.col("y.range.end").alias("last"))


# -- texts with what they tell: whole documents after a line of their length's year; the dictionary are the names in all items
_NOTED = f"""concat(CASE doc_id % 6 WHEN 0 THEN concat('năm ', n_chars % 2100, '. ') WHEN 1 THEN concat(n_chars % 3100, ' TCN. ') WHEN 2 THEN concat('Thế kỷ ', upper(split_part('{_ROMAN}', ' ', CAST(n_chars % 21 AS INT) + 1)), ', nhà Trần. ')
 WHEN 3 THEN concat('Vua Gia Long, năm ', 1802 + n_chars % 18, '. ') WHEN 4 THEN concat('Nhà Lý và nhà Trần, ', 1000 + n_chars % 300, ' – ', 1225, '. ') ELSE '' END, text)"""
_MARKED = rf"(?i)(?:năm|thời gian|thế kỷ|thế kỉ|tk)\s+(\d{{1,4}}|[ivxlcdm]+)(?:\s*({Y.BEFORE_ERA}))?{_END}"
_GENERAL = rf"(?i)\b(\d{{1,4}})(?:\s*({Y.BEFORE_ERA}){_END}|\b)"
_REALM_SQL = "CASE " + " ".join(rf"WHEN regexp_matches(lower(text), '(?:^|[^\p{{L}}\p{{N}}])(?:{'|'.join(terms)})(?:[^\p{{L}}\p{{N}}]|$)') THEN '{name}'" for name, terms in Y.REALMS) + " END"


def _dictionary(spark, d) -> DataFrame:
    found = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(NAMES), F.lit(1))).alias("name")).distinct()
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.ascii(F.lower("name")) % len(_TYPES) + 1).cast("int"))
    return found.select(F.ascii(F.lower("name")).cast("long").alias("ord"), F.lower("name").alias("id"), F.col("name").alias("canonical"), "name", kind.alias("type"))


@query(
    "op_p15_enriched_texts",
    rf"""WITH d AS (SELECT doc_id, {_NOTED} AS text FROM documents),
 m AS (SELECT doc_id, unnest(list_zip(regexp_extract_all(text, '{_MARKED}', 1), regexp_extract_all(text, '{_MARKED}', 2))) AS x FROM d), g AS (SELECT doc_id, unnest(list_zip(regexp_extract_all(text, '{_GENERAL}', 1), regexp_extract_all(text, '{_GENERAL}', 2))) AS x FROM d),
 m2 AS (SELECT doc_id, coalesce(x[2], '') <> '' AS bc, TRY_CAST(x[1] AS INT) AS y, list_position(string_split('{_ROMAN}', ' '), lower(x[1])) AS c FROM m), g2 AS (SELECT doc_id, coalesce(x[2], '') <> '' AS bc, CAST(x[1] AS INT) AS y FROM g),
 y AS (SELECT doc_id, CASE WHEN bc THEN -y ELSE y END AS y FROM m2 WHERE y BETWEEN 1 AND 2026 UNION ALL SELECT doc_id, unnest([c * 100 - 99, c * 100]) FROM m2 WHERE c > 0 UNION ALL SELECT doc_id, CASE WHEN bc AND y BETWEEN 1 AND 3000 THEN -y ELSE y END FROM g2 WHERE (bc AND y BETWEEN 1 AND 3000) OR y BETWEEN 800 AND 2026),
 t AS (SELECT doc_id, CAST(min(y) AS INT) AS time_start, CAST(max(y) AS INT) AS time_end FROM y GROUP BY doc_id),
 n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{NAMES}', 1)) AS name FROM benchmark), f AS (SELECT lower(name) AS id, name, ascii(lower(name)) AS ord, unnest([lower(name), lower({_PLAIN.format('name')})]) AS form FROM n),
 k AS (SELECT form, arg_min(id, (-ord, id)) AS id FROM f GROUP BY form), told AS (SELECT id, min(ord) AS ord, min(name) AS canonical FROM f GROUP BY id),
 p AS (SELECT doc_id, unnest(l) AS part, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(lower(text), ' ') AS l FROM d)),
 b AS (SELECT doc_id, regexp_extract(part, '[\p{{L}}\p{{N}}]+$') || ' ' || regexp_extract(lead(part) OVER (PARTITION BY doc_id ORDER BY i), '^[\p{{L}}\p{{N}}]+') AS form FROM p),
 e AS (SELECT DISTINCT doc_id, ord, canonical FROM b JOIN k USING (form) JOIN told USING (id) WHERE ord % 5 < 2),
 w AS (SELECT doc_id, string_agg(canonical, ', ' ORDER BY ord, canonical) FILTER (ord % 5 = 0) AS figures, arg_min(canonical, (ord, canonical)) FILTER (ord % 5 = 1) AS location FROM e GROUP BY doc_id)
 SELECT doc_id, time_start, time_end, {_REALM_SQL} AS realm, dynasty_id, coalesce(figures, '') AS figures, location FROM d LEFT JOIN t USING (doc_id) LEFT JOIN w USING (doc_id) LEFT JOIN {dims.values_sql([(i, *r) for i, r in enumerate(dims.CHRONOLOGY)])} AS h(ord, epoch_id, dynasty_id, y0, y1) ON greatest(-2879, least(2026, time_start)) BETWEEN y0 AND y1 AND time_start IS NOT NULL""",
)
def _(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id", f"{_NOTED} AS text")
    return Y.enriched(docs, _dictionary(spark, d), dims.chronology(spark)).withColumn("figures", F.array_join("figures", ", "))


# -- branches: all items; every third compares three years, every third entities; an entity's stored name may be its words turned round
_Q = "item_id AS query, text || CASE WHEN item_id % 3 = 0 THEN concat(' So sánh năm ', 950 + item_id % 300, ', ', 1090 + item_id % 300, ' và ', 1020 + item_id % 300, '.') ELSE '' END AS text, item_id % 3 = 1 AS comparative"
_WHO = "CASE WHEN ascii(lower(name)) % 2 = 0 THEN concat(split_part(name, ' ', 2), ' ', split_part(name, ' ', 1)) ELSE name END AS name"
_WHEN = "900 + CAST(length(name) * 37 % 500 AS INT) AS first"


@query(
    "op_x13_question_branches",
    rf"""WITH q AS (SELECT {_Q} FROM benchmark), mentions AS (SELECT item_id AS query, unnest(regexp_extract_all(text, '{NAMES}', 1)) AS name, generate_subscripts(regexp_extract_all(text, '{NAMES}', 1), 1) - 1 AS ord FROM benchmark),
 m0 AS (SELECT * FROM mentions QUALIFY row_number() OVER (PARTITION BY query, lower(name) ORDER BY ord) = 1),
 m AS (SELECT query, ord, lower(name) AS id, {_WHO}, list_value({", ".join(f"'{t}'" for t in _TYPES)})[ascii(lower(name)) % 5 + 1] AS type, {_WHEN} FROM m0),
 al AS (SELECT query, string_agg(id, ',' ORDER BY ord) AS ids, count(*) AS n FROM m GROUP BY query),
 y AS (SELECT query, text, unnest([950 + query % 300, 1020 + query % 300, 1090 + query % 300]) AS y, unnest([0, 1, 2]) AS branch FROM q WHERE query % 3 = 0),
 fo AS (SELECT *, trim(regexp_replace(regexp_replace(text, '\b(' || array_to_string(list_filter([950 + query % 300, 1020 + query % 300, 1090 + query % 300], lambda o: o <> y), '|') || ')\b', '', 'g'), '\s+', ' ', 'g')) AS focus FROM y),
 bo AS (SELECT f.query, branch, string_agg(id, ',' ORDER BY ord) AS ids, string_agg(name, ' ' ORDER BY ord) FILTER (NOT contains(lower(focus), lower(name))) AS told FROM fo f JOIN m ON m.query = f.query AND y BETWEEN first - 15 AND first + 55 GROUP BY ALL),
 by_year AS (SELECT query, branch, trim(focus || ' ' || coalesce(told || ' ', '') || 'năm ' || y) AS text, y AS target_year, coalesce(bo.ids, al.ids, '') AS entities FROM fo LEFT JOIN bo USING (query, branch) LEFT JOIN al USING (query)),
 s AS (SELECT query, text, string_split(regexp_replace(text, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM q WHERE query % 3 = 1),
 r AS (SELECT query, text, s, name, id, first, row_number() OVER (PARTITION BY query ORDER BY contains(lower(s[-1]), lower(name)) DESC, type IN ('HISTORICAL_PERSON', 'DYNASTY_ERA', 'EVENT_BATTLE') DESC, ord) - 1 AS branch FROM s JOIN m USING (query) JOIN al USING (query) WHERE al.n >= 2),
 by_entity AS (SELECT query, branch, trim(regexp_replace(coalesce(list_filter(s, lambda x: contains(lower(x), lower(name)))[1], text) || ' ' || name, '\s+', ' ', 'g')) AS text, first AS target_year, id AS entities FROM r WHERE branch < 5),
 whole AS (SELECT query, 0, text, NULL, coalesce(ids, '') FROM q LEFT JOIN al USING (query) WHERE query % 3 = 2 OR (query % 3 = 1 AND coalesce(n, 0) < 2))
 SELECT query, CAST(branch AS INT) AS branch, text, CAST(target_year AS INT) AS target_year, entities FROM (SELECT * FROM by_year UNION ALL SELECT * FROM by_entity UNION ALL SELECT * FROM whole)""",
)
def _(spark, d):
    b = table(spark, d, "benchmark")
    found = b.select(F.col("item_id").alias("query"), F.posexplode(F.regexp_extract_all("text", F.lit(NAMES), F.lit(1))).alias("ord", "name"))
    first = found.groupBy("query", F.lower("name").alias("id")).agg(F.min(F.struct("ord", "name")).alias("m")).select("query", "id", "m.*")
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.ascii("id") % len(_TYPES) + 1).cast("int"))
    mentions = first.select("query", "ord", "id", F.expr(_WHO), kind.alias("type"), F.expr(_WHEN)).withColumn("last", F.col("first") + 40)
    return Y.branches(b.selectExpr(*[c.strip() for c in _Q.replace(", text ||", "\ntext ||").replace(", item_id % 3 = 1", "\nitem_id % 3 = 1").split("\n")]), mentions).withColumn("entities", F.array_join("entities", ","))


# -- premises: all items with a claim behind them, about the names in them as people
_CLAIM = "item_id AS query, text || CASE item_id % 5 WHEN 0 THEN ' Sơn Tinh ký hiệp định.' WHEN 1 THEN ' Xe tang ở Chi Lăng.' WHEN 2 THEN concat(' Vào năm ', 300 + item_id * 37 % 1500, '.') WHEN 3 THEN concat(' So sánh năm ', 300 + item_id * 37 % 1500, '.') ELSE concat(' Máy bay, Bạch Đằng, năm ', 1700 + item_id * 41 % 300, '.') END AS text"


@query(
    "op_p35_premise_conflicts",
    rf"""WITH q AS (SELECT {_CLAIM}, item_id % 5 AS k, 300 + item_id * 37 % 1500 AS y, 1700 + item_id * 41 % 300 AS late FROM benchmark), mentions AS (SELECT item_id AS query, unnest(regexp_extract_all(text, '{NAMES}', 1)) AS name, generate_subscripts(regexp_extract_all(text, '{NAMES}', 1), 1) - 1 AS ord FROM benchmark),
 m AS (SELECT query, ord, name, 900 + length(name) * 37 % 500 AS y0, CASE WHEN ord % 3 = 0 THEN 1860 ELSE 940 + length(name) * 37 % 500 END AS y1 FROM mentions),
 old AS (SELECT query, arg_min(name, ord) AS name FROM m WHERE y1 < 1850 GROUP BY query),
 off AS (SELECT query, arg_min(name, ord) AS name, any_value(y) AS y FROM (SELECT query, CASE WHEN k = 4 THEN late ELSE y END AS y FROM q WHERE k IN (2, 4)) JOIN m USING (query) WHERE (y < y0 - 60 OR y > y1 + 60) AND abs(y - y0) > 100 AND abs(y - y1) > 100 GROUP BY query)
 SELECT query, CASE WHEN k = 0 THEN '{Y.MYTH}' WHEN k IN (1, 4) AND (old.name IS NOT NULL OR k = 1 OR late < 1850) THEN '{Y.ANACHRONISM}' WHEN off.name IS NOT NULL THEN '{Y.MISMATCH}' END AS kind,
  CASE WHEN k = 0 THEN 'sơn tinh' WHEN k = 1 THEN 'xe tăng' WHEN k = 4 AND (old.name IS NOT NULL OR late < 1850) THEN 'máy bay' ELSE off.name END AS subject,
  CASE WHEN k = 0 THEN 'hiệp định' WHEN k = 1 THEN coalesce(old.name, 'chi lăng') WHEN k = 4 AND (old.name IS NOT NULL OR late < 1850) THEN coalesce(old.name, 'bạch đằng') ELSE CAST(off.y AS VARCHAR) END AS object FROM q LEFT JOIN old USING (query) LEFT JOIN off USING (query)""",
)
def _(spark, d):
    b = table(spark, d, "benchmark")
    found = b.select(F.col("item_id").alias("query"), F.posexplode(F.regexp_extract_all("text", F.lit(NAMES), F.lit(1))).alias("ord", "name"))
    people = found.selectExpr("query", "ord", "name", "900 + length(name) * 37 % 500 AS first", "CASE WHEN ord % 3 = 0 THEN 1860 ELSE 940 + length(name) * 37 % 500 END AS last")
    claims = b.selectExpr(*[c.strip() for c in _CLAIM.replace(", text ||", "\ntext ||").split("\n")])
    return Y.premise_conflicts(claims, people, ["sơn tinh", "thánh gióng"], ["hiệp định"], ["xe tăng", "máy bay"], ["bạch đằng", "chi lăng"])


# -- chunks dated by their title, their years, or their epoch or dynasty
_TITLED = "CASE chunk_id % 5 WHEN 0 THEN concat(title, ' ', 900 + chunk_id % 1200) WHEN 1 THEN concat(title, chunk_id) ELSE title END"
_BY_EPOCH = "CASE WHEN chunk_id % 4 = 1 THEN concat('EPOCH_0', 1 + chunk_id % 9) END"
_ERA = "CASE WHEN chunk_id % 3 = 0 THEN ' LE_' WHEN chunk_id % 3 = 1 THEN 'tran' END"


@query(
    "op_x20_effective_years",
    rf"""WITH {CHUNKS_SQL}, h AS (SELECT * FROM {dims.values_sql([(i, *r) for i, r in enumerate(dims.CHRONOLOGY)])} AS h(ord, epoch, name, y0, y1)),
 c AS (SELECT chunk_id, time_start, time_end, TRY_CAST(regexp_extract({_TITLED}, '\b(1\d{{3}}|20\d{{2}}|9\d{{2}})\b', 1) AS INT) AS ty, {_BY_EPOCH} AS epoch, lower(trim({_ERA})) AS era FROM chunks),
 l AS (SELECT c.*, CASE WHEN epoch IS NOT NULL THEN (SELECT arg_min({{'a': y0, 'b': y1}}, ord) FROM h WHERE h.epoch = c.epoch) ELSE (SELECT arg_min({{'a': y0, 'b': y1}}, ord) FROM h WHERE contains(h.name, c.era)) END AS f FROM c),
 b AS (SELECT chunk_id, CASE WHEN ty IS NOT NULL THEN ty WHEN time_start IS NOT NULL THEN time_start ELSE f.a END AS a, CASE WHEN ty IS NOT NULL THEN ty WHEN time_start IS NOT NULL THEN time_end ELSE f.b END AS b FROM l)
 SELECT chunk_id, CAST(a AS INT) AS first, CAST(b AS INT) AS last, (CASE WHEN a IS NULL THEN 1.0 ELSE (SELECT CASE WHEN g <= 2 THEN 1.1 WHEN g <= 30 THEN 1.0 WHEN g <= 100 THEN 0.85 WHEN g <= 500 THEN 0.7 WHEN g <= 1000 THEN 0.05 ELSE 0.001 END
  FROM (SELECT min(CASE WHEN y BETWEEN a AND b THEN 0 ELSE least(abs(y - a), abs(y - b), abs(y - (a + b) / 2.0)) END) AS g FROM (VALUES (40), (1288)) v(y))) END)::DOUBLE AS factor FROM b""",
)
def _(spark, d):
    c = chunks(spark, d).select("chunk_id", F.expr(_TITLED).alias("title"), "time_start", "time_end", F.expr(_BY_EPOCH).alias("epoch"), F.expr(_ERA).alias("era")).withColumn("years", F.array(F.lit(40), F.lit(1288)))
    epochs = F.when(F.col("epoch").isNotNull(), F.array("epoch"))
    c = c.withColumn("b", Y.effective_bounds(F.col("title"), F.col("time_start"), F.col("time_end"), epochs, F.col("era"), dims.CHRONOLOGY))
    return c.select("chunk_id", F.col("b.start").alias("first"), F.col("b.end").alias("last"), X.temporal_multiplier("years", F.col("b.start"), F.col("b.end")).alias("factor"))


# -- triples with a span of evidence: one a document; every third span is of a text turned round
_SAID = "concat(text, CASE doc_id % 5 WHEN 0 THEN ' tức là' WHEN 1 THEN ' hoàng tử' ELSE '' END)"
_EVIDENCE = "concat(CASE WHEN doc_id % 3 = 0 THEN reverse(substr(text, 1 + CAST(doc_id % 40 AS INT), 60)) ELSE concat(' ', replace(substr(text, 1 + CAST(doc_id % 40 AS INT), 60), 'e', 'E')) END, CASE WHEN doc_id % 11 = 0 THEN ' không phải' WHEN doc_id % 13 = 0 THEN ' ' ELSE '' END)"
_REL = "CASE doc_id % 4 WHEN 0 THEN 'ALIAS_OF' WHEN 1 THEN 'ROYAL_LINEAGE' WHEN 2 THEN 'LED_BY' ELSE 'PART_OF' END"
_CONF = "CAST(90 + doc_id % 11 AS DOUBLE) / 100"


def _has(c: str, terms: str) -> str:
    return rf"regexp_matches(lower({c}), '(?:^|[^\p{{L}}\p{{N}}])(?:{terms})(?:[^\p{{L}}\p{{N}}]|$)')"


@query(
    "op_g13_grounded_triples",
    rf"""WITH d AS (SELECT doc_id, {_SAID} AS text, {_EVIDENCE} AS evidence, {_REL} AS rel, {_CONF} AS c, doc_id % 8 = 4 AS known FROM documents)
 SELECT doc_id, rel, round(least(1.0, c + CASE WHEN length(trim(evidence, chr(32) || chr(9) || chr(10) || chr(13))) >= 3 AND contains(lower(text), lower(trim(evidence, chr(32) || chr(9) || chr(10) || chr(13)))) THEN 0.03 ELSE 0 END), 6)::DOUBLE AS confidence FROM d
 WHERE NOT {_has('evidence', V.NEGATION)} AND (rel <> 'ALIAS_OF' OR known OR {_has('text', V.ALIAS_WORDS)}) AND (rel <> 'ROYAL_LINEAGE' OR {_has('text', V.LINEAGE_WORDS)})""",
)
def _(spark, d):
    docs = table(spark, d, "documents")
    triples = docs.selectExpr("doc_id", f"{_REL} AS rel", f"{_CONF} AS confidence", f"{_EVIDENCE} AS evidence", "doc_id % 8 = 4 AS known")
    return V.grounded_triples(triples, docs.selectExpr("doc_id", f"{_SAID} AS text")).select("doc_id", "rel", F.round("confidence", 6).alias("confidence"))
