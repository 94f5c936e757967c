"""Queries over string repair, spans, audits and orderings."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry import dims
from quarry.functions import text as T
from quarry.operators import graph as G
from quarry.operators import relational as R
from quarry.operators import text as O
from quarry.operators.ranks import ranked
from quarry.plans.base import CHUNKS_SQL, EDGES_SQL, NODES_SQL, chunks, edges, nodes, table
from quarry.plans.registry import query
from quarry.plans.relational import RULES_SQL
from quarry.plans.retrieval import DENSE_SQL, LEXICAL_SQL, dense, lexical


def _docs(spark, d):
    return table(spark, d, "documents")


def _md5(c):
    return F.md5(c.cast("binary")).alias("h")


@query("op_p03_inner_case", r"SELECT doc_id, md5(array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN regexp_matches(w, '^\p{L}*\p{Ll}\p{Lu}\p{L}*\n?$') THEN w[1] || lower(substr(w, 2)) ELSE w END), ' ')) AS h FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", _md5(T.repair_inner_case(F.col("text"))))


@query("op_p07_unhyphenate", r"SELECT doc_id, md5(regexp_replace(replace(text, 'tion ', 'ti-' || chr(10) || 'on '), '(\p{Ll})-\n(\p{Ll})', '\1\2', 'g')) AS h FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", _md5(T.unhyphenate(F.replace("text", F.lit("tion "), F.lit("ti-\non ")))))


@query(
    "op_p09_table_unwrap",
    r"""SELECT doc_id, md5(array_to_string(list_transform(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '^\s*\|?[\s:|+-]*[-=]{3,}[\s:|+=-]*$')),
 lambda x: CASE WHEN regexp_matches(x, '^\s*\|.*\|\s*$') THEN trim(regexp_replace(trim(x), '\s*\|\s*', ' ', 'g')) ELSE x END), chr(10))) AS h
 FROM (SELECT doc_id, '| ' || source || ' | ' || lang || ' |' || chr(10) || '|---|---|' || chr(10) || text AS t FROM documents)""",
)
def _(spark, d):
    docs = _docs(spark, d)
    return docs.select("doc_id", _md5(T.unwrap_tables(F.concat(F.lit("| "), "source", F.lit(" | "), "lang", F.lit(" |\n|---|---|\n"), "text"))))


@query("op_p13_term_normalise", "SELECT doc_id, md5(replace(replace(text, '###', ''), '%%%', '')) AS h FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", _md5(F.replace(F.replace("text", F.lit("###"), F.lit("")), F.lit("%%%"), F.lit(""))))


@query("op_p37_json_repair", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    broken = F.concat(F.lit("```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n```"))
    return table(spark, d, "events").select("event_id", F.get_json_object(T.repair_json(broken), "$.k").cast("long").alias("k"))


@query("op_f14_span_validity", r"SELECT p_partkey, length(p_name) BETWEEN 2 AND 80 AND len(regexp_split_to_array(p_name, '\s+')) <= 8 AND NOT regexp_matches(p_name, '^\d') AND NOT regexp_matches(p_name, '[\[\](){}<>]') AND lower(p_name) NOT IN ('part', 'thing') AS valid FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", T.valid_span(F.col("p_name"), ["part", "thing"]).alias("valid"))


@query("op_j14_dictionary_first_match")
def _(spark, d):
    spans = O.gazetteer_spans(_docs(spark, d), ["the", "of the", "und die", "de la"])
    order = F.create_map(*[x for k, n in enumerate(["of the", "de la", "und die", "the"]) for x in (F.lit(n), F.lit(k))])
    return R.keep_first(spans, ["doc_id"], [order[F.col("name")], F.col("start")])


@query("op_j18_frontier_step", f"WITH {EDGES_SQL}, f AS (SELECT 'person_' || c_custkey AS node FROM customer WHERE c_custkey % 100 = 0) SELECT node, src, rel, tgt FROM f JOIN edges ON (src = node OR (tgt = node AND rel IN ('LED_BY', 'PART_OF'))) WHERE confidence >= 0.5")
def _(spark, d):
    f = table(spark, d, "customer").filter("c_custkey % 100 = 0").selectExpr("concat('person_', c_custkey) AS node")
    e = G.oriented(G.walkable(edges(spark, d)))
    return f.join(e, f["node"] == e["at"]).select("node", "src", "rel", "tgt")


@query("op_q03_dangling_count", f"WITH {EDGES_SQL}, {NODES_SQL}, kept AS (SELECT id FROM nodes WHERE type <> 'document') SELECT count(*) AS dangling FROM (SELECT DISTINCT src, rel, tgt FROM edges WHERE src NOT IN (SELECT id FROM kept) OR tgt NOT IN (SELECT id FROM kept))")
def _(spark, d):
    return R.dangling(edges(spark, d).select("src", "rel", "tgt"), nodes(spark, d).filter("type <> 'document'")).agg(F.count(F.lit(1)).alias("dangling"))


@query("op_q08_degrees", f"WITH {EDGES_SQL}, g AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT tgt FROM edges) GROUP BY id) SELECT split_part(id, '_', 1) AS kind, count(*) AS nodes, max(degree) AS most, round(avg(degree), 6) AS mean FROM g GROUP BY 1")
def _(spark, d):
    e = edges(spark, d)
    g = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("tgt").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return g.groupBy(F.substring_index("id", "_", 1).alias("kind")).agg(F.count(F.lit(1)).alias("nodes"), F.max("degree").alias("most"), F.round(F.avg("degree"), 6).alias("mean"))


@query("op_q10_direction_inversions", f"WITH {EDGES_SQL}, {RULES_SQL}, turned AS (SELECT CASE WHEN confidence < 0.4 THEN tgt ELSE src END AS src, rel, CASE WHEN confidence < 0.4 THEN src ELSE tgt END AS tgt FROM edges) SELECT e.rel, count(*) AS total, count(*) FILTER (len(list_filter(sp, lambda p: starts_with(src, p))) > 0 AND len(list_filter(tp, lambda p: starts_with(tgt, p))) > 0) AS compliant, count(*) FILTER (len(list_filter(sp, lambda p: starts_with(tgt, p))) > 0 AND len(list_filter(tp, lambda p: starts_with(src, p))) > 0) AS inverted FROM turned e JOIN rules r ON e.rel = r.rel GROUP BY e.rel")
def _(spark, d):
    low = F.col("confidence") < 0.4
    turned = edges(spark, d).select(F.when(low, F.col("tgt")).otherwise(F.col("src")).alias("src"), "rel", F.when(low, F.col("src")).otherwise(F.col("tgt")).alias("tgt"))
    return G.directionality(turned, dims.directions(spark))


@query("op_t01_nearest_pairs", f"WITH {DENSE_SQL} SELECT query, chunk_id, round(similarity, 6) AS similarity FROM dense WHERE rank <= 20 ORDER BY dense.similarity DESC, query, chunk_id LIMIT 100")
def _(spark, d):
    return dense(spark, d, 20).orderBy(F.desc("similarity"), "query", "chunk_id").limit(100).select("query", "chunk_id", F.round("similarity", 6).alias("similarity"))


@query("op_t02_best_lexical", f"WITH {LEXICAL_SQL} SELECT query, chunk_id, CAST(score AS DOUBLE) AS score FROM lexical WHERE rank <= 20 ORDER BY lexical.score DESC, query, chunk_id LIMIT 100")
def _(spark, d):
    return lexical(spark, d, 20).orderBy(F.desc("score"), "query", "chunk_id").limit(100).select("query", "chunk_id", "score")


@query("op_t04_comparator_chain", f"WITH {CHUNKS_SQL} SELECT title, chunk_id, row_number() OVER (PARTITION BY title ORDER BY coalesce(abs(time_start - 938), 200), tier, parent_id IS NOT NULL, chunk_id) AS place FROM chunks")
def _(spark, d):
    order = [F.coalesce(F.abs(F.col("time_start") - 938), F.lit(200)), F.col("tier"), F.col("parent_id").isNotNull(), F.col("chunk_id")]
    return ranked(chunks(spark, d).drop("content"), ["title"], order, "place").select("title", "chunk_id", "place")


@query("op_r02_first_event_latency", "SELECT user_id, count(*) AS events, epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us, arg_min(event_id, (ts, event_id)) AS first FROM events GROUP BY user_id")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("span_us"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first"))


@query("op_n09_round_robin_share", f"WITH {CHUNKS_SQL}, r AS (SELECT dynasty, chunk_id, row_number() OVER (PARTITION BY dynasty ORDER BY chunk_id) AS rn, count(*) OVER (PARTITION BY dynasty) AS n FROM chunks) SELECT dynasty, chunk_id FROM r WHERE rn <= ceil(n / 4.0)")
def _(spark, d):
    r = ranked(chunks(spark, d).select("dynasty", "chunk_id"), ["dynasty"], [F.col("chunk_id")], "rn", "n")
    return r.filter("rn <= ceil(n / 4.0)").select("dynasty", "chunk_id")


@query("op_p02_soft_wraps")
def _(spark, d):
    return O.unwrap_lines(_docs(spark, d).select("doc_id", "text")).select("doc_id", _md5(F.col("text")))


@query("op_p06_syllable_healing")
def _(spark, d):
    return O.heal_syllables(_docs(spark, d).select("doc_id", "text"), ["inthe", "ofthe", "unddie"]).select("doc_id", _md5(F.col("text")))


@query("op_p38_rule_triples")
def _(spark, d):
    docs = _docs(spark, d)
    spans = O.gazetteer_spans(docs, ["the", "of", "und", "der", "de", "la"]).withColumn("kind", F.when(F.col("name").isin("the", "und", "de"), "a").otherwise("b"))
    return O.rule_triples(spans, docs, [("a", "b", "NEXT_TO", r"^ $", 10), ("a", "b", "NEAR", r"^ \w+ $", 40)])


@query("op_p01_composed_text", "SELECT doc_id, md5(nfc_normalize(text)) AS h FROM documents")
def _(spark, d):
    return O.composed(_docs(spark, d).select("doc_id", "text")).select("doc_id", _md5(F.col("text")))


@query("op_x04_small_vectors")
def _(spark, d):
    return O.small_vectors(_docs(spark, d))


@query("op_p19_alias_ngrams", f"WITH {CHUNKS_SQL}, w AS (SELECT chunk_id AS query, list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM chunks WHERE chunk_id % 100 = 0), g AS (SELECT DISTINCT query, alias FROM (SELECT query, unnest(w) AS alias FROM w)), a AS (SELECT DISTINCT lower(lang) AS alias, lang AS canonical FROM documents) SELECT query, g.alias, canonical, 1 AS n FROM g JOIN a ON g.alias = a.alias")
def _(spark, d):
    q = chunks(spark, d).filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query"), F.col("content").alias("text"))
    a = _docs(spark, d).select(F.lower("lang").alias("alias"), F.col("lang").alias("canonical")).distinct()
    return O.alias_hits(q, a)


@query("op_p15_metadata_enrichment")
def _(spark, d):
    return O.enrich(_docs(spark, d), dims.chronology(spark))


@query("op_p39_parentheticals", r"SELECT doc_id, unnest(regexp_extract_all(t, '(\p{Lu}[\p{L}]+(?: \p{Lu}[\p{L}]+)*) \((\p{Lu}[\p{L}]+(?: \p{Lu}[\p{L}]+)*)\)', 1)) AS name, unnest(regexp_extract_all(t, '(\p{Lu}[\p{L}]+(?: \p{Lu}[\p{L}]+)*) \((\p{Lu}[\p{L}]+(?: \p{Lu}[\p{L}]+)*)\)', 2)) AS other FROM (SELECT doc_id, 'Anna Bo (Carl) ' || text AS t FROM documents)")
def _(spark, d):
    return O.parenthetical_pairs(_docs(spark, d).select("doc_id", F.concat(F.lit("Anna Bo (Carl) "), "text").alias("text")))


@query("op_m07_bootstrap")
def _(spark, d):
    from quarry.operators.evaluation import bootstrap

    hits = dense(spark, d, 10).groupBy("query").agg(F.max("similarity").alias("best"), F.avg("similarity").alias("mean")).withColumn("run", F.lit("dense"))
    return bootstrap(hits, "run", "mean", other="best")


@query("op_m09_triple_scores", f"WITH RECURSIVE {EDGES_SQL}, rules(r1, r2, r3) AS (VALUES ('PART_OF', 'PART_OF', 'PART_OF'), ('LED_BY', 'PART_OF', 'HAPPENED_AT'), ('HAPPENED_AT', 'PART_OF', 'HAPPENED_AT')), g AS (SELECT DISTINCT src, rel, tgt FROM edges WHERE rel <> 'MENTIONED_IN' AND confidence >= 0.4), c AS (SELECT src, rel, tgt FROM g UNION SELECT c.src, r3, g.tgt FROM c JOIN rules ON c.rel = r1 JOIN g ON g.src = c.tgt AND g.rel = r2 WHERE c.src <> g.tgt), p AS (SELECT DISTINCT src, rel, tgt FROM edges WHERE rel <> 'MENTIONED_IN' UNION SELECT 'person_' || c_custkey, 'PART_OF', 'dynasty_' || c_custkey % 5 FROM customer), j AS (SELECT EXISTS (SELECT 1 FROM g WHERE g.src = p.src AND g.rel = p.rel AND g.tgt = p.tgt) AS e, EXISTS (SELECT 1 FROM c WHERE c.src = p.src AND c.rel = p.rel AND c.tgt = p.tgt) AS i, EXISTS (SELECT 1 FROM g WHERE g.src = p.tgt AND g.rel = p.rel AND g.tgt = p.src) AS r FROM p), n AS (SELECT count(*) AS predicted, count(*) FILTER (e) AS exact, count(*) FILTER (NOT e AND i) AS implied, count(*) FILTER (NOT e AND NOT i AND r) AS reversed, count(*) FILTER (NOT e AND NOT i AND NOT r) AS hallucinated, (SELECT count(*) FROM g) AS n_gold FROM j), s AS (SELECT *, (exact + implied) / predicted AS a, exact / n_gold AS b FROM n) SELECT predicted, exact, implied, reversed, hallucinated, round(a, 6) AS precision, round(b, 6) AS recall, round(2 * a * b / (a + b), 6) AS f1 FROM s")
def _(spark, d):
    from quarry.operators.evaluation import triple_scores

    e = edges(spark, d).filter("rel <> 'MENTIONED_IN'")
    wild = table(spark, d, "customer").selectExpr("concat('person_', c_custkey) AS src", "'PART_OF' AS rel", "concat('dynasty_', c_custkey % 5) AS tgt")
    return triple_scores(e.select("src", "rel", "tgt").unionByName(wild), e.filter("confidence >= 0.4"), G.transitive_closure)


@query("op_m11_chunk_quality", f"WITH {CHUNKS_SQL} SELECT dynasty, count(*) AS n, round(avg(len(string_split(content, ' '))), 4) AS words, round(avg(CASE WHEN len(string_split(content, ' ')) BETWEEN 280 AND 520 THEN 1.0 ELSE 0.0 END), 6) AS in_bounds FROM chunks GROUP BY dynasty")
def _(spark, d):
    words = F.size(F.split("content", " "))
    return chunks(spark, d).groupBy("dynasty").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(words), 4).alias("words"), F.round(F.avg(words.between(280, 520).cast("double")), 6).alias("in_bounds"))


@query("op_o03_facet_queries", "SELECT p_partkey, unnest([p_brand || ' history', p_brand || ' ' || lower(p_type), p_name]) AS facet FROM part")
def _(spark, d):
    facets = F.array(F.concat("p_brand", F.lit(" history")), F.concat("p_brand", F.lit(" "), F.lower("p_type")), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.explode(facets).alias("facet"))


@query("op_o08_stage_metrics", "SELECT conv_id, count(*) AS scenes, round(avg(len(string_split(text, ' '))), 4) AS words, count(*) FILTER (len(string_split(text, ' ')) NOT BETWEEN 14 AND 52) AS out_of_bounds FROM conversations GROUP BY conv_id")
def _(spark, d):
    words = F.size(F.split("text", " "))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("scenes"), F.round(F.avg(words), 4).alias("words"), F.count_if(~words.between(14, 52)).alias("out_of_bounds"))


@query("op_o13_message_history", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations")
def _(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.row_number().over(w).cast("long").alias("place"))


@query("op_r06_channel_validation", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 0 AND 50, false) AS accepted FROM events")
def _(spark, d):
    m = F.from_json("props", "k long")
    return table(spark, d, "events").select("event_id", m["k"].alias("k"), F.coalesce(m["k"].between(0, 50), F.lit(False)).alias("accepted"))
