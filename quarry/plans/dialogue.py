"""Queries over turns, scenes, caches and results."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators import dialogue as D
from quarry.operators import relational as R
from quarry.plans.base import CHUNKS_SQL, EDGES_SQL, POSTINGS_SQL, chunks, edges, postings, table
from quarry.plans.registry import query


@query("op_x05_embedding_batches")
def _(spark, d):
    return D.embedding_batches(table(spark, d, "documents").withColumn("slice", F.expr("doc_id div 1000")))


@query("op_x05_cached_vectors", "SELECT doc_id, text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) AS hit, 64 AS dims FROM documents")
def _(spark, d):
    import uuid

    from quarry.operators import store as K
    from quarry.operators.graph import checkpoint_dir
    from quarry.operators.text import hashed_vectors

    # A first run over half of the documents fills the store, a second one over all finds those.
    name = f"vectors_{uuid.uuid4().hex}"
    K.open_store(spark, name, f"{checkpoint_dir(spark)}/{name}", "ARRAY<DOUBLE>")
    vectors = lambda t: hashed_vectors(t.withColumnRenamed("key", "doc_id")).withColumnsRenamed({"doc_id": "key", "embedding": "value"})
    docs = table(spark, d, "documents").select("doc_id", "text")
    K.computed(docs.filter("doc_id % 2 = 0"), name, vectors)
    return K.computed(docs, name, vectors)[0].select("doc_id", "hit", F.size("value").alias("dims"))


@query("op_w16_cache_misses", "SELECT DISTINCT sha256(text) AS key FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    cache = docs.filter("doc_id % 2 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    return D.missing_from_cache(docs, cache, "text").select("key")


@query("op_o01_scene_packing")
def _(spark, d):
    return D.scenes(table(spark, d, "documents"))


@query("op_o02_keywords", f"WITH {CHUNKS_SQL}, {POSTINGS_SQL} SELECT chunk_id, token FROM postings WHERE length(token) >= 6 QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY tf DESC, token) <= 8")
def _(spark, d):
    p = postings(chunks(spark, d)).filter("length(token) >= 6")
    return R.top_per(p, ["chunk_id"], [F.desc("tf"), F.col("token")], 8).select("chunk_id", "token")


@query("op_o04_ordered_search", "WITH f AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL) SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM f QUALIFY place <= 3")
def _(spark, d):
    return D.ordered_search(table(spark, d, "events"), "user_id", "event_type", [F.col("event_id")], 3).select("user_id", "event_type", "event_id", F.col("place").cast("long").alias("place"))


@query("op_o05_provenance_and_used", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS rank FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders u WHERE u.o_orderkey % 50 = 0 AND (u.o_custkey = o.o_custkey OR u.o_totalprice = o.o_totalprice OR u.o_orderkey = o.o_orderkey))")
def _(spark, d):
    o = table(spark, d, "orders")
    used = o.filter("o_orderkey % 50 = 0")
    for key in ("o_custkey", "o_totalprice", "o_orderkey"):
        o = o.join(used.select(key).distinct(), key, "left_anti")
    return o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3).alias("rank"))


@query("op_o06_layout_inference", "SELECT doc_id, CASE WHEN contains(lower(source), 'src1') THEN 'MAP' WHEN length(text) > 5000 THEN 'GRID' ELSE ['FULL', 'FRAME', 'BLUR'][doc_id % 3 + 1] END AS layout FROM documents")
def _(spark, d):
    turn = F.element_at(F.array(*map(F.lit, ["FULL", "FRAME", "BLUR"])), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.when(F.lower("source").contains("src1"), "MAP").when(F.length("text") > 5000, "GRID").otherwise(turn).alias("layout"))


@query("op_o14_conversation_brief", "SELECT conv_id, count(*) AS turns, md5(left(string_agg(text, ' ' ORDER BY turn), 600)) AS summary FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def _(spark, d):
    c = table(spark, d, "conversations").filter("role <> 'system'")
    g = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return g.select("conv_id", "turns", F.md5(F.array_join("t.text", " ").substr(1, 600).cast("binary")).alias("summary"))


@query("op_p25_boundary_truncation", r"WITH h AS (SELECT doc_id, text, substr(text, 1, 1800) AS head FROM documents), c AS (SELECT *, regexp_extract(head, '(?s)^(.*[.!?])(?:\s|$)', 1) AS sentence, regexp_extract(head, '(?s)^(.*)\s', 1) AS space FROM h) SELECT doc_id, CASE WHEN length(text) <= 1800 THEN text WHEN length(sentence) >= 720 THEN sentence WHEN length(space) >= 900 THEN space ELSE head END AS cut FROM c")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", D.truncate_at_boundary(F.col("text"), 1800).alias("cut"))


@query("op_p33_topic_shift", r"WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 3)) AS w FROM conversations WHERE role = 'user'), l AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM w) SELECT conv_id, turn, round(CASE WHEN p IS NULL THEN 1.0 ELSE len(list_intersect(w, p)) / greatest(1, len(w)) END, 6) AS shared, p IS NOT NULL AND len(list_intersect(w, p)) / greatest(1, len(w)) < 0.1 AS shift FROM l")
def _(spark, d):
    return D.topic_shifts(table(spark, d, "conversations"))


@query("op_p42_dialogue_state", "WITH t AS (SELECT conv_id, role, turn, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, count(*) AS turns, md5(string_agg(text, chr(10) ORDER BY role = 'assistant', turn)) AS state FROM t WHERE role = 'user' OR (role = 'assistant' AND n <= 2) GROUP BY conv_id")
def _(spark, d):
    return D.dialogue_state(table(spark, d, "conversations")).withColumn("state", F.md5(F.col("state").cast("binary")))


@query("op_p35_premise_ranges", f"WITH {CHUNKS_SQL} SELECT c.chunk_id, CASE WHEN p.time_start IS NULL OR c.time_start IS NULL THEN 'UNKNOWN' WHEN c.time_start BETWEEN p.time_start - 60 AND p.time_end + 100 THEN 'OK' ELSE 'ANACHRONISM' END AS verdict FROM chunks c JOIN chunks p ON c.parent_id = p.chunk_id")
def _(spark, d):
    c = chunks(spark, d)
    p = c.select(F.col("chunk_id").alias("parent_id"), F.col("time_start").alias("born"), F.col("time_end").alias("died"))
    y = F.col("time_start")
    return c.join(p, "parent_id").select("chunk_id", F.when(F.col("born").isNull() | y.isNull(), "UNKNOWN").when(y.between(F.col("born") - 60, F.col("died") + 100), "OK").otherwise("ANACHRONISM").alias("verdict"))


@query("op_r05_circuit_breaker", "WITH c AS (SELECT user_id, event_id, ts, event_type = 'click' AS bad FROM events), g AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS n FROM g WHERE bad) SELECT user_id, event_id FROM r WHERE n = 3")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return D.breaker_trips(e, "user_id", F.col("event_type") == "click", 3).select("user_id", "event_id")


@query("op_v05_citation_coverage", f"WITH {CHUNKS_SQL} SELECT title, count(*) AS claims, count(parent_id) AS cited, round(count(parent_id) / count(*), 6) AS coverage, round(count(*) FILTER (parent_id IS NOT NULL AND tier = 'LEVEL_1') / greatest(1, count(parent_id)), 6) AS primary_share FROM chunks GROUP BY title")
def _(spark, d):
    n, cited = F.count(F.lit(1)), F.count("parent_id")
    return chunks(spark, d).groupBy("title").agg(n.alias("claims"), cited.alias("cited"), F.round(cited / n, 6).alias("coverage"), F.round(F.count_if(F.expr("parent_id is not null and tier = 'LEVEL_1'")) / F.greatest(F.lit(1), cited), 6).alias("primary_share"))


@query("op_m06_evidence_recall", f"WITH {CHUNKS_SQL}, {POSTINGS_SQL}, c AS (SELECT chunk_id, parent_id FROM chunks WHERE parent_id IS NOT NULL), h AS (SELECT c.chunk_id, count(*) AS total, count(q.token) AS found FROM c JOIN postings p ON p.chunk_id = c.chunk_id LEFT JOIN postings q ON q.chunk_id = c.parent_id AND q.token = p.token GROUP BY c.chunk_id) SELECT chunk_id, round(found / total, 6) AS share, found / total >= 0.75 AS recalled FROM h")
def _(spark, d):
    p = postings(chunks(spark, d)).select("chunk_id", "token")
    c = chunks(spark, d).filter("parent_id is not null").select("chunk_id", "parent_id")
    j = c.join(p, "chunk_id").join(p.select(F.col("chunk_id").alias("parent_id"), "token", F.lit(1).alias("hit")), ["parent_id", "token"], "left")
    g = j.groupBy("chunk_id").agg((F.count("hit") / F.count(F.lit(1))).alias("s"))
    return g.select("chunk_id", F.round("s", 6).alias("share"), (F.col("s") >= 0.75).alias("recalled"))


@query("op_m10_span_f1", "WITH s AS (SELECT event_id, user_id, epoch_us(ts) AS a, epoch_us(ts) + 1800000000 AS b, event_id % 2 = 0 AS gold FROM events), m AS (SELECT p.user_id, count(DISTINCT p.event_id) AS hit FROM s p JOIN s g ON p.user_id = g.user_id AND NOT p.gold AND g.gold AND greatest(p.a, g.a) < least(p.b, g.b) GROUP BY 1) SELECT user_id, count(*) FILTER (NOT gold) AS predicted, count(*) FILTER (gold) AS gold, coalesce(any_value(hit), 0) AS partial FROM s LEFT JOIN m USING (user_id) GROUP BY user_id")
def _(spark, d):
    s = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("a"), (F.col("event_id") % 2 == 0).alias("g"))
    # Spans of 30 minutes: two that overlap start less than that apart, so they meet in one cell or the next.
    cell = F.expr("a div 1800000000")
    p = s.filter("not g").withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    hit = p.join(s.filter("g").select("user_id", F.col("a").alias("b"), cell.alias("cell")), ["user_id", "cell"]).filter(F.abs(F.col("a") - F.col("b")) < 1_800_000_000).groupBy("user_id").agg(F.count_distinct("event_id").alias("partial"))
    n = s.groupBy("user_id").agg(F.count_if(~F.col("g")).alias("predicted"), F.count_if("g").alias("gold"))
    return n.join(hit, "user_id", "left").select("user_id", "predicted", "gold", F.coalesce("partial", F.lit(0)).alias("partial"))


@query("op_m14_pacing", "SELECT conv_id, round(avg(abs(length(text) / 15.0 - 5)), 4) AS error, round(avg(CASE WHEN length(text) / 15.0 BETWEEN 3 AND 8 THEN 1.0 ELSE 0.0 END), 6) AS compliant FROM conversations GROUP BY conv_id")
def _(spark, d):
    s = F.length("text") / 15.0
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.round(F.avg(F.abs(s - 5)), 4).alias("error"), F.round(F.avg(s.between(3, 8).cast("double")), 6).alias("compliant"))


@query("op_m14_reconciliation", "SELECT conv_id, turn, round(60.0 * length(text) / sum(length(text)) OVER (PARTITION BY conv_id), 6) AS seconds FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(60.0 * F.length("text") / F.sum(F.length("text")).over(W.partitionBy("conv_id")), 6).alias("seconds"))


@query("op_m17_dialogue_aggregates", "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, round(avg(length(text)), 4) AS chars, round(avg(CASE WHEN length(text) > 300 THEN 1.0 ELSE 0.0 END), 6) AS long_rate FROM conversations GROUP BY role")
def _(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.round(F.avg(F.length("text")), 4).alias("chars"), F.round(F.avg((F.length("text") > 300).cast("double")), 6).alias("long_rate"))


@query("op_m21_dialogue_checks", "SELECT conv_id, turn, length(text) >= 20 AS long_enough, contains(lower(text), 'the') OR contains(lower(text), 'der') OR contains(lower(text), 'que') AS has_phrase FROM conversations WHERE role = 'assistant'")
def _(spark, d):
    variants = F.array(*map(F.lit, ["the", "der", "que"]))
    return table(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", (F.length("text") >= 20).alias("long_enough"), F.exists(variants, lambda v: F.contains(F.lower("text"), v)).alias("has_phrase"))


@query("op_t08_longest_first", "SELECT DISTINCT c_name, length(c_name) AS n FROM customer ORDER BY n DESC, c_name LIMIT 100")
def _(spark, d):
    return table(spark, d, "customer").select("c_name", F.length("c_name").cast("long").alias("n")).distinct().orderBy(F.desc("n"), "c_name").limit(100)


@query("op_u03_distinct", f"WITH {EDGES_SQL} SELECT DISTINCT rel, tgt FROM edges")
def _(spark, d):
    return edges(spark, d).select("rel", "tgt").distinct()
