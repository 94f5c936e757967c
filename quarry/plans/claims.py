"""Queries of the ordered checks of claims, mentions, years and repeated passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import claims as C
from quarry.operators import evaluation as E
from quarry.plans.base import CHUNKS_SQL, chunks, table
from quarry.plans.more import STOP, STOP_SQL
from quarry.plans.registry import query

#: A text that holds years: shipping dates of lines, as a span where the line was returned.
_DATED = "concat_ws(' ', 'part', CAST(l_partkey AS STRING), CASE WHEN l_returnflag = 'R' THEN concat(year(l_shipdate), ' – ', year(l_shipdate) + l_linenumber) WHEN l_returnflag = 'A' THEN concat('from', year(l_shipdate)) ELSE concat('in ', year(l_shipdate), ' and ', l_suppkey) END)"


@query(
    "op_p17_routing_years",
    rf"""WITH t AS (SELECT l_orderkey, l_linenumber, {_DATED.replace("STRING", "VARCHAR")} AS text FROM lineitem),
 y AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\b\d{{3,4}}\b'), lambda x: CAST(x AS INT)), lambda x: x BETWEEN 100 AND 2050))) AS years,
  TRY_CAST(regexp_extract(text, '(?i)(\d{{3,4}})\s*(?:-|–|—|đến|tới)\s*(\d{{3,4}})', 1) AS INT) AS a, TRY_CAST(regexp_extract(text, '(?i)(\d{{3,4}})\s*(?:-|–|—|đến|tới)\s*(\d{{3,4}})', 2) AS INT) AS b FROM t)
 SELECT l_orderkey, l_linenumber, array_to_string(years, ',') AS years, CASE WHEN a BETWEEN 100 AND 2050 AND b BETWEEN 100 AND 2050 THEN least(a, b) ELSE list_min(years) END AS start_year,
  CASE WHEN a BETWEEN 100 AND 2050 AND b BETWEEN 100 AND 2050 THEN greatest(a, b) ELSE list_max(years) END AS end_year FROM y""",
)
def _(spark, d):
    t = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_DATED} AS text")
    return t.select("l_orderkey", "l_linenumber", F.array_join(C.routing_years(F.col("text")).cast("array<string>"), ",").alias("years"), C.time_range(F.col("text")).alias("r")).select("l_orderkey", "l_linenumber", "years", "r.*")


@query("op_p17_time_bounds")
def _(spark, d):
    t = table(spark, d, "documents").select("doc_id", C.time_bounds(F.concat_ws(" ", F.lit("năm"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, F.lit("TCN")), F.col("text"))).alias("years"))
    return t.select("doc_id", F.array_join(F.array_sort("years").cast("array<string>"), ",").alias("years"))


@query(
    "op_p30_text_dedup",
    r"""WITH d AS (SELECT doc_id, concat_ws(chr(10) || chr(10), text, source || ': ' || text, text) AS text FROM documents),
 p0 AS (SELECT doc_id, unnest(string_split_regex(text, '\n{2,}')) AS par, generate_subscripts(string_split_regex(text, '\n{2,}'), 1) AS p FROM d),
 p1 AS (SELECT doc_id, p, regexp_replace(par, '^\s+|\s+$', '', 'g') AS par FROM p0),
 p2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, regexp_replace(lower(par), '[.,!?:;\s]+', ' ', 'g') ORDER BY p) > 1 AS again FROM p1 WHERE par <> ''),
 s0 AS (SELECT doc_id, p, string_split(regexp_replace(par, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM p2 WHERE NOT again OR length(par) < 35),
 s1 AS (SELECT doc_id, p, unnest(l) AS sent, generate_subscripts(l, 1) AS s FROM s0),
 s2 AS (SELECT doc_id, p, s, regexp_replace(sent, '^\s+|\s+$', '', 'g') AS sent FROM s1),
 s3 AS (SELECT *, length(sent) >= 25 AND row_number() OVER (PARTITION BY doc_id, length(sent) >= 25, regexp_replace(lower(sent), '[.,!?:;\s]+', ' ', 'g') ORDER BY p, s) > 1 AS again FROM s2 WHERE sent <> ''),
 g AS (SELECT doc_id, p, string_agg(sent, ' ' ORDER BY s) AS line FROM s3 WHERE NOT again GROUP BY doc_id, p),
 k AS (SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY p) AS kept FROM g GROUP BY doc_id)
 SELECT doc_id, md5(coalesce(kept, text)) AS h FROM d LEFT JOIN k USING (doc_id)""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws("\n\n", "text", F.concat_ws(": ", "source", "text"), "text").alias("text"))
    return C.dedup_text(docs).select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))


_MENTION = "CASE l_linenumber % 4 WHEN 0 THEN upper('artifact_' || l_partkey) WHEN 1 THEN upper(p_name) WHEN 2 THEN 'the ' || p_name || ' of order ' || l_orderkey ELSE 'part ' || l_linenumber END"


@query(
    "op_p40_mention_snapping",
    f"""WITH j AS (SELECT l_orderkey, {_MENTION} AS mention, 'artifact_' || l_partkey AS id, p_name AS text, CASE WHEN p_partkey % 5 = 0 THEN 'UNKNOWN' ELSE p_type END AS type FROM lineitem JOIN part ON l_partkey = p_partkey),
 m AS (SELECT DISTINCT l_orderkey, mention FROM j), c AS (SELECT DISTINCT l_orderkey, id, text, type FROM j),
 s AS (SELECT m.*, c.id, c.text, c.type, CASE WHEN lower(trim(mention)) = lower(id) THEN 1 WHEN lower(trim(mention)) = lower(trim(text)) THEN 2 WHEN contains(lower(trim(mention)), lower(trim(text))) THEN 3 END AS step FROM m JOIN c USING (l_orderkey)),
 r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, mention ORDER BY step, CASE WHEN step = 3 AND type = 'UNKNOWN' THEN 1 ELSE 0 END, CASE WHEN step = 3 THEN -length(text) ELSE 0 END, id, text, type) AS rn FROM s WHERE step IS NOT NULL)
 SELECT m.l_orderkey, m.mention, r.id, r.text, r.type, CAST(r.step AS INT) AS step FROM m LEFT JOIN r ON m.l_orderkey = r.l_orderkey AND m.mention = r.mention AND rn = 1""",
)
def _(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    j = j.selectExpr("l_orderkey", f"{_MENTION} AS mention", "'artifact_' || l_partkey AS id", "p_name AS text", "CASE WHEN p_partkey % 5 = 0 THEN 'UNKNOWN' ELSE p_type END AS type")
    return C.snap_mentions(j, j, "l_orderkey")


_RULES = [
    C.Anchor("Urgent orders ship first.", pattern=r"\burgent\b"),
    C.Anchor("Two tariffs were in force.", years=(1995, 1996, 1997), words=("high", "medium")),
    C.Anchor("Customer 7 pays in advance.", entities=("person_7",)),
]


@query(
    "op_o11_chronology_anchors",
    r"""WITH q AS (SELECT o_orderkey, o_custkey, lower(o_orderpriority) AS t, year(o_orderdate) AS y FROM orders)
 SELECT o_orderkey AS query, concat_ws('/', CASE WHEN regexp_matches(t, '\burgent\b') THEN 'Urgent orders ship first.' END, CASE WHEN y IN (1995, 1996, 1997) AND (contains(t, 'high') OR contains(t, 'medium')) THEN 'Two tariffs were in force.' END, CASE WHEN o_custkey = 7 THEN 'Customer 7 pays in advance.' END) AS anchors,
  coalesce('- ' || c_name || ': Triều đại: ' || c_mktsegment || ' | Niên đại: ' || CASE WHEN c_nationkey < 5 THEN (500 - 100 * c_nationkey) || ' TCN' ELSE CAST(100 * c_nationkey - 500 AS VARCHAR) END || CASE WHEN c_custkey % 3 > 0 THEN ' - ' || CAST(2000 + c_nationkey AS VARCHAR) ELSE '' END, '') AS bullets
 FROM q LEFT JOIN customer ON o_custkey = c_custkey""",
)
def _(spark, d):
    q = table(spark, d, "orders").selectExpr("o_orderkey AS query", "o_orderpriority AS text", "array('person_' || o_custkey) AS ids", "array(year(o_orderdate)) AS years")
    e = table(spark, d, "customer").selectExpr("'person_' || c_custkey AS id", "c_name AS name", "c_mktsegment AS dynasty", "cast(100 * c_nationkey - 500 as int) AS first_year", "CASE WHEN c_custkey % 3 > 0 THEN cast(2000 + c_nationkey as int) END AS last_year")
    return C.chronology_anchors(q, e, _RULES).select("query", F.array_join("anchors", "/").alias("anchors"), F.array_join("bullets", "\n").alias("bullets"))


#: The given texts are of other languages: their words stand for the lists.
_TERMS = C.Terms(victory=["license", "tion"], defeat=["liability", "ment"], actions=["that", "und"], kinship=["part of", "copy of", "zu der"], passive="by", denial=r"not\s+the")
_NAMES = [("a", "with"), ("b", "from"), ("c", "this"), ("d", "die")]


@query("op_v02_ordered_entailment")
def _(spark, d):
    c = chunks(spark, d)
    p = c.select(F.col("chunk_id").alias("parent_id"), F.col("content").alias("evidence"))
    pairs = c.select("chunk_id", "parent_id", F.col("content").alias("claim")).join(p, "parent_id")
    pairs = pairs.withColumns({"claim_spans": C.name_spans(F.col("claim"), _NAMES), "evidence_spans": C.name_spans(F.col("evidence"), _NAMES)})
    return C.checked_entailment(pairs, STOP, _TERMS).select("chunk_id", "score", "verdict", "reason")


@query("op_p36_number_words")
def _(spark, d):
    n = F.expr("CASE o_orderkey % 3 WHEN 0 THEN o_orderkey WHEN 1 THEN -cast(o_totalprice as bigint) ELSE cast(o_totalprice * o_orderkey * 1000 as bigint) END")
    return table(spark, d, "orders").select("o_orderkey", T.number_words(n).alias("words"))


@query("op_m10_span_scores", """WITH s AS (SELECT event_id, user_id, epoch_us(ts) AS a, epoch_us(ts) + 1800000000 AS b, event_type || '_' || CAST(floor(value) AS BIGINT) AS name, event_id % 2 = 0 AS g, event_id % 3 = 0 AS oov FROM events),
 p AS (SELECT * FROM s WHERE NOT g), h AS (SELECT *, (EXISTS (FROM p WHERE p.user_id = s.user_id AND p.name = s.name)) OR (EXISTS (FROM p WHERE p.user_id = s.user_id AND p.a = s.a)) AS x, EXISTS (FROM p WHERE p.user_id = s.user_id AND greatest(p.a, s.a) < least(p.b, s.b)) AS t FROM s WHERE g),
 k AS (SELECT user_id, count(*) AS gold, count(*) FILTER (x) AS exact, count(*) FILTER (t AND NOT x) AS partial, count(*) FILTER (oov) AS oov, count(*) FILTER (oov AND (x OR t)) AS found FROM h GROUP BY 1), n AS (SELECT user_id, count(*) AS predicted FROM p GROUP BY 1),
 c AS (SELECT user_id, coalesce(gold, 0) AS gold, coalesce(predicted, 0) AS predicted, coalesce(exact, 0) AS exact, coalesce(partial, 0) AS partial, coalesce(oov, 0) AS oov, coalesce(found, 0) AS found FROM k FULL JOIN n USING (user_id)),
 r AS (SELECT *, CASE WHEN predicted > 0 THEN 100 * exact / predicted WHEN gold = 0 THEN 100.0 ELSE 0.0 END AS pr, CASE WHEN gold > 0 THEN 100 * exact / gold WHEN predicted = 0 THEN 100.0 ELSE 0.0 END AS re FROM c)
 SELECT user_id, gold, predicted, exact, partial, round(pr, 2)::DOUBLE AS precision, round(re, 2)::DOUBLE AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 2)::DOUBLE AS f1, round(CASE WHEN oov > 0 THEN 100 * found / oov ELSE 100.0 END, 2)::DOUBLE AS oov_recall FROM r""")
def _(spark, d):
    s = table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("start"), F.expr("event_type || '_' || cast(floor(value) as bigint)").alias("name"), (F.col("event_id") % 3 != 0).alias("known")).withColumn("end", F.col("start") + 1_800_000_000)
    return E.span_scores(s.filter("id % 2 = 1"), s.filter("id % 2 = 0"), "user_id", 1_800_000_000)
