"""Queries over scans, predicates, joins, aggregates, windows, sets, snapshots and audits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.dims import CHRONOLOGY, DIRECTIONS, LINEAGE, chronology, directions, values_sql
from quarry.operators import ranks as K
from quarry.operators import relational as R
from quarry.plans.base import CHUNKS_SQL, EDGES_SQL, NODES_SQL, chunks, edges, nodes, table
from quarry.plans.registry import query

CHRONO_SQL = "chrono(ord, epoch_id, dynasty_id, start_year, end_year) AS " + values_sql([(i, *r) for i, r in enumerate(CHRONOLOGY)])
RULES_SQL = "rules(rel, sp, tp) AS " + values_sql(DIRECTIONS)
LINEAGE_SQL = ", ".join(map(repr, LINEAGE))


# -- scans and predicates
@query("op_s11_parameterised_scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice >= 250000 AND o_orderstatus = 'O'")
def _(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("quarry_orders")
    return spark.sql("SELECT o_orderkey, o_custkey, o_totalprice FROM quarry_orders WHERE o_totalprice >= :least AND o_orderstatus = :status", args={"least": 250000, "status": "O"})


@query("op_s05_catalog_lookup", "SELECT doc_id, source, n_name AS catalog_title, coalesce(n_regionkey, -1) AS reliability FROM documents LEFT JOIN nation ON substr(source, 4) = CAST(n_nationkey AS VARCHAR)")
def _(spark, d):
    cat = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("stem"), F.col("n_name").alias("catalog_title"), "n_regionkey")
    docs = table(spark, d, "documents").select("doc_id", "source", F.expr("substr(source, 4)").alias("stem"))
    return docs.join(cat, "stem", "left").select("doc_id", "source", "catalog_title", F.coalesce("n_regionkey", F.lit(-1)).alias("reliability"))


@query("op_s10_topics_by_epoch", f"WITH {CHRONO_SQL}, {CHUNKS_SQL} SELECT epoch_id, count(*) AS topics FROM chunks JOIN chrono ON time_start BETWEEN start_year AND end_year GROUP BY epoch_id")
def _(spark, d):
    c = chunks(spark, d).join(F.broadcast(chronology(spark)), F.col("time_start").between(F.col("start_year"), F.col("end_year")))
    return c.groupBy("epoch_id").agg(F.count(F.lit(1)).alias("topics"))


@query("op_f01_projection", "SELECT p_partkey, p_name, p_brand FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", "p_brand")


@query("op_f02_is_not_null", "SELECT doc_id, vec_id FROM documents LEFT JOIN embeddings ON doc_id = vec_id WHERE embedding IS NOT NULL")
def _(spark, d):
    e = table(spark, d, "embeddings")
    docs = table(spark, d, "documents").select("doc_id")
    return docs.join(e, docs.doc_id == e.vec_id, "left").filter("embedding is not null").select("doc_id", "vec_id")


@query("op_f03_any_of_parameter", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def _(spark, d):
    s = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, d, "lineitem").join(s, "l_suppkey", "left_semi").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("op_f04_array_membership", f"WITH {CHRONO_SQL}, {CHUNKS_SQL}, e AS (SELECT chunk_id, list(DISTINCT epoch_id) AS epochs FROM chunks JOIN chrono ON start_year <= time_end AND end_year >= time_start GROUP BY chunk_id) SELECT chunk_id FROM e WHERE list_contains(epochs, 'EPOCH_04')")
def _(spark, d):
    c = R.overlapping_epochs(chunks(spark, d).select("chunk_id", "time_start", "time_end"), chronology(spark), "time_start", "time_end")
    return c.filter(F.array_contains("epochs", "EPOCH_04")).select("chunk_id")


@query("op_f05_constant_list", f"WITH {EDGES_SQL} SELECT rel, count(*) AS n FROM edges WHERE rel IN ({LINEAGE_SQL}) GROUP BY rel")
def _(spark, d):
    return edges(spark, d).filter(F.col("rel").isin(LINEAGE)).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


@query("op_f06_like_json_path_or", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type LIKE 'c%' OR json_extract_string(props, '$.k') = '69'")
def _(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").filter(F.col("event_type").like("c%") | (k == "69")).select("event_id", "event_type", k.cast("long").alias("k"))


@query("op_f08_confidence_and_allowed_relations", f"WITH {EDGES_SQL} SELECT src, rel, tgt, confidence FROM edges WHERE confidence >= 0.5 AND rel NOT IN ('MENTIONED_IN', 'SAME_AS_LOCATION')")
def _(spark, d):
    from quarry.operators.graph import walkable

    return walkable(edges(spark, d))


@query("op_f10_word_count_gate", r"SELECT doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) - length(replace(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ', '')) + 1 AS words FROM documents WHERE length(trim(regexp_replace(text, '\s+', ' ', 'g'))) - length(replace(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ', '')) + 1 >= 150")
def _(spark, d):
    words = F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).cast("long")
    return table(spark, d, "documents").select("doc_id", words.alias("words")).filter("words >= 150")


@query("op_f11_stub_skip", "SELECT doc_id, len(string_split(text, ' ')) < 15 AND contains(lower(text), 'the') AS stub FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", ((F.size(F.split("text", " ")) < 15) & F.lower("text").contains("the")).alias("stub"))


@query("op_f12_quarantine_stub", "SELECT doc_id, contains(text, '%%%') OR (len(string_split(text, ' ')) < 250 AND source <> 'src1') AS quarantined FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.col("text").contains("%%%") | ((F.size(F.split("text", " ")) < 250) & (F.col("source") != "src1"))).alias("quarantined"))


@query("op_f15_directionality", f"WITH {EDGES_SQL}, {RULES_SQL} SELECT e.rel, count(*) AS total, count(*) FILTER (len(list_filter(sp, lambda p: starts_with(src, p))) > 0 AND len(list_filter(tp, lambda p: starts_with(tgt, p))) > 0) AS compliant, count(*) FILTER (len(list_filter(sp, lambda p: starts_with(tgt, p))) > 0 AND len(list_filter(tp, lambda p: starts_with(src, p))) > 0) AS inverted FROM edges e JOIN rules r ON e.rel = r.rel GROUP BY e.rel")
def _(spark, d):
    from quarry.operators.graph import directionality

    return directionality(edges(spark, d), directions(spark))


@query("op_f16_manifest_skip", "SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_shipdate >= o.o_orderdate AND l.l_returnflag = 'R')")
def _(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").filter("l_returnflag = 'R'")
    return o.join(li, (o.o_orderkey == li.l_orderkey) & (li.l_shipdate >= o.o_orderdate), "left_anti").select("o_orderkey", "o_custkey")


# -- joins
@query("op_j01_inner_equi", "SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_custkey", "c_name")


@query("op_j02_dimension_twice", f"WITH {EDGES_SQL}, {NODES_SQL} SELECT e.src, a.name AS source_name, e.rel, e.tgt, b.name AS target_name, e.confidence FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.tgt = b.id WHERE e.rel IN ({LINEAGE_SQL})")
def _(spark, d):
    from quarry.operators.graph import lineage_view

    return lineage_view(edges(spark, d), nodes(spark, d)).select("src", "source_name", "rel", "tgt", "target_name", "confidence")


@query("op_j03_theta_residual", f"WITH {EDGES_SQL}, {NODES_SQL} SELECT e.src, e.rel, e.tgt FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.tgt = b.id WHERE e.src <> e.tgt AND e.confidence >= 0.85")
def _(spark, d):
    e, n = edges(spark, d).filter("src <> tgt and confidence >= 0.85"), nodes(spark, d).select("id")
    return e.join(n.withColumnRenamed("id", "src"), "src").join(n.withColumnRenamed("id", "tgt"), "tgt").select("src", "rel", "tgt")


@query("op_j04_left_self_join", f"WITH {CHUNKS_SQL} SELECT c.chunk_id, c.parent_id, length(p.content) AS parent_length FROM chunks c LEFT JOIN chunks p ON c.parent_id = p.chunk_id")
def _(spark, d):
    c = chunks(spark, d)
    p = c.select(F.col("chunk_id").alias("parent_id"), F.length("content").cast("long").alias("parent_length"))
    return c.select("chunk_id", "parent_id").join(p, "parent_id", "left").select("chunk_id", "parent_id", "parent_length")


_KEPT_NODES = "kept AS (SELECT id FROM nodes WHERE NOT coalesce(type = 'person' AND TRY_CAST(substr(id, 8) AS BIGINT) % 13 = 0, false))"


@query("op_j05_dangling_edges", f"WITH {EDGES_SQL}, {NODES_SQL}, {_KEPT_NODES} SELECT DISTINCT src, rel, tgt, confidence FROM edges WHERE NOT EXISTS (SELECT 1 FROM kept WHERE id = src) OR NOT EXISTS (SELECT 1 FROM kept WHERE id = tgt)")
def _(spark, d):
    kept = nodes(spark, d).filter("not (type = 'person' and cast(substr(id, 8) as bigint) % 13 = 0)")
    return R.dangling(edges(spark, d), kept)


@query("op_j06_left_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").filter("o_totalprice > 300000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("op_j07_duplicate_keys_keep_least", "SELECT l_partkey, l_suppkey, min(l_orderkey * 10 + l_linenumber) AS id FROM lineitem GROUP BY ALL")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.expr("l_orderkey * 10 + l_linenumber").alias("id"))
    return R.keep_first(li, ["l_partkey", "l_suppkey"], [F.col("id")])


@query("op_j08_alias_resolution", "WITH c AS (SELECT c_custkey, c_name FROM customer) SELECT c_custkey, coalesce(n.n_name, r.r_name) AS canonical FROM c LEFT JOIN nation n ON n.n_nationkey = c_custkey % 40 LEFT JOIN region r ON r.r_regionkey = c_custkey % 7")
def _(spark, d):
    alias = table(spark, d, "nation").selectExpr("concat('n', n_nationkey) AS key", "n_name AS canonical").unionByName(table(spark, d, "region").selectExpr("concat('r', r_regionkey) AS key", "r_name AS canonical"))
    return R.resolve_names(table(spark, d, "customer").select("c_custkey"), alias, "c_custkey", [F.expr("concat('n', c_custkey % 40)"), F.expr("concat('r', c_custkey % 7)")])


@query("op_j09_rekey_merge", f"""WITH {EDGES_SQL}, m AS (SELECT 'person_' || c_custkey AS old, 'person_' || (c_custkey - c_custkey % 5) AS canonical FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey > 5),
 moved AS (SELECT coalesce(a.canonical, src) AS src, rel, coalesce(b.canonical, tgt) AS tgt, confidence, a.canonical IS NOT NULL OR b.canonical IS NOT NULL AS moved FROM edges LEFT JOIN m a ON src = a.old LEFT JOIN m b ON tgt = b.old)
 SELECT src, rel, tgt, confidence FROM moved WHERE src <> tgt QUALIFY row_number() OVER (PARTITION BY src, rel, tgt ORDER BY moved, confidence DESC) = 1""")
def _(spark, d):
    m = table(spark, d, "customer").filter("c_custkey % 5 <> 0 and c_custkey > 5").selectExpr("concat('person_', c_custkey) AS old", "concat('person_', c_custkey - c_custkey % 5) AS canonical")
    return R.rekey(edges(spark, d), m).select("src", "rel", "tgt", "confidence")


_EPOCHS = """e AS (SELECT chunk_id, time_start, time_end, epoch_id FROM chunks LEFT JOIN chrono ON start_year <= time_end AND end_year >= time_start
 UNION ALL SELECT chunk_id, time_start, time_end, unnest(['EPOCH_09', 'EPOCH_10']) FROM chunks WHERE time_start <= 1777 AND time_end >= 1771)"""


@query("op_j10_interval_overlap", f"WITH {CHRONO_SQL}, {CHUNKS_SQL}, {_EPOCHS} SELECT chunk_id, time_start, time_end, coalesce(string_agg(DISTINCT epoch_id, ',' ORDER BY epoch_id), '') AS epochs FROM e GROUP BY ALL")
def _(spark, d):
    c = R.overlapping_epochs(chunks(spark, d).select("chunk_id", "time_start", "time_end"), chronology(spark), "time_start", "time_end")
    return c.withColumn("epochs", F.array_join("epochs", ","))


@query("op_j11_point_in_interval", f"WITH {CHRONO_SQL}, {CHUNKS_SQL} SELECT chunk_id, epoch_id, dynasty_id FROM chunks LEFT JOIN chrono ON greatest(-2879, least(2026, time_start)) BETWEEN start_year AND end_year AND time_start IS NOT NULL")
def _(spark, d):
    return R.epoch_of_year(chunks(spark, d).select("chunk_id", "time_start").withColumn("time_start", F.col("time_start")), chronology(spark), "time_start").select("chunk_id", F.when(F.col("time_start").isNotNull(), F.col("epoch_id")).alias("epoch_id"), F.when(F.col("time_start").isNotNull(), F.col("dynasty_id")).alias("dynasty_id"))


@query("op_j12_nearest_in_time", f"WITH {CHUNKS_SQL} SELECT title, chunk_id, CAST(coalesce(abs(time_start - 1288), 200) AS INT) AS distance FROM chunks QUALIFY row_number() OVER (PARTITION BY title ORDER BY coalesce(abs(time_start - 1288), 200), chunk_id) <= 3")
def _(spark, d):
    c = chunks(spark, d).select("title", "chunk_id", F.coalesce(F.abs(F.col("time_start") - 1288), F.lit(200)).alias("distance"))
    return R.top_per(c, ["title"], [F.col("distance"), F.col("chunk_id")], 3).drop("rank")


@query("op_j13_contextual_lookup", """WITH e AS (SELECT n_name, n_nationkey, n_nationkey * 50 AS y0, n_nationkey * 50 + 80 AS y1, n_regionkey FROM nation), q AS (SELECT c_custkey, c_nationkey % 5 AS region, (c_custkey * 13) % 1300 AS year FROM customer)
 SELECT c_custkey, n_name FROM q JOIN e ON n_regionkey = region QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN year BETWEEN y0 AND y1 THEN 0 ELSE 1 END, n_nationkey) = 1""")
def _(spark, d):
    e = table(spark, d, "nation").selectExpr("n_name", "n_nationkey", "n_nationkey * 50 AS y0", "n_nationkey * 50 + 80 AS y1", "n_regionkey AS region")
    q = table(spark, d, "customer").selectExpr("c_custkey", "c_nationkey % 5 AS region", "(c_custkey * 13) % 1300 AS year")
    hit = F.when(F.col("year").between(F.col("y0"), F.col("y1")), 0).otherwise(1)
    return R.keep_first(q.join(e, "region"), ["c_custkey"], [hit, F.col("n_nationkey")]).select("c_custkey", "n_name")


@query("op_j21_containment", "SELECT s_suppkey, n_regionkey IN (0, 1, 2) AND s_nationkey = n_nationkey AS contained FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def _(spark, d):
    parents = table(spark, d, "nation").groupBy("n_nationkey").agg(F.collect_set("n_regionkey").alias("parents"))
    s = table(spark, d, "supplier")
    return s.join(parents, s.s_nationkey == parents.n_nationkey, "left").select("s_suppkey", F.arrays_overlap("parents", F.array(F.lit(0), F.lit(1), F.lit(2))).alias("contained"))


@query("op_j22_composition_anti", f"""WITH {EDGES_SQL}, comp AS (SELECT DISTINCT p.src AS person, p.tgt AS place FROM edges l JOIN edges p ON l.tgt = p.src WHERE l.rel = 'LED_BY' AND p.rel = 'PART_OF' AND l.confidence >= 0.9)
 SELECT src, tgt FROM edges WHERE rel = 'PART_OF' AND NOT EXISTS (SELECT 1 FROM comp WHERE person = src AND place = tgt)""")
def _(spark, d):
    from quarry.operators.graph import compose

    e = edges(spark, d)
    comp = compose(e.filter("rel = 'LED_BY' and confidence >= 0.9"), e.filter("rel = 'PART_OF'"))
    return e.filter("rel = 'PART_OF'").select("src", "tgt").join(comp, ["src", "tgt"], "left_anti")


# -- aggregates
@query("op_a01_count", "SELECT count(*) AS n FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("op_a02_count_by_group", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("op_a03_conditional_counts", f"WITH {CHUNKS_SQL} SELECT count(*) AS total, count(CASE WHEN parent_id IS NULL THEN 1 END) AS parents, count(CASE WHEN parent_id IS NOT NULL THEN 1 END) AS children, count(CASE WHEN time_start IS NOT NULL THEN 1 END) AS dated, count(CASE WHEN tier = 'LEVEL_1' THEN 1 END) AS level_1, count(CASE WHEN len(string_split(content, ' ')) > 100 THEN 1 END) AS long FROM chunks")
def _(spark, d):
    n = lambda c, name: F.count_if(F.expr(c)).alias(name)
    return chunks(spark, d).agg(F.count(F.lit(1)).alias("total"), n("parent_id is null", "parents"), n("parent_id is not null", "children"), n("time_start is not null", "dated"), n("tier = 'LEVEL_1'", "level_1"), n("size(split(content, ' ')) > 100", "long"))


@query("op_a04_distinct_over_union", f"WITH {EDGES_SQL} SELECT count(DISTINCT id) AS connected FROM (SELECT src AS id FROM edges UNION SELECT tgt FROM edges)")
def _(spark, d):
    e = edges(spark, d)
    return e.select(F.col("src").alias("id")).union(e.select("tgt")).distinct().agg(F.count("id").alias("connected"))


@query("op_a05_distinct_tuples", "SELECT count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem)")
def _(spark, d):
    return table(spark, d, "lineitem").agg(F.count_distinct(F.struct("l_partkey", "l_suppkey", "l_returnflag")).alias("n"))


@query("op_a06_best_per_key", "SELECT l_partkey, l_suppkey, l_orderkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) = 1")
def _(spark, d):
    return R.keep_first(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], [F.desc("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber")]).select("l_partkey", "l_suppkey", "l_orderkey", "l_quantity")


@query("op_a07_entity_signal", f"WITH {EDGES_SQL}, s AS (SELECT src AS id, confidence, 1 AS hop FROM edges UNION ALL SELECT tgt, confidence, 2 FROM edges) SELECT id, max(confidence) AS confidence, CAST(min(hop) AS INT) AS hop FROM s GROUP BY id")
def _(spark, d):
    e = edges(spark, d)
    s = e.select(F.col("src").alias("id"), "confidence", F.lit(1).alias("hop")).union(e.select("tgt", "confidence", F.lit(2)))
    return s.groupBy("id").agg(F.max("confidence").alias("confidence"), F.min("hop").alias("hop"))


@query("op_a08_chunk_rollup", "SELECT l_orderkey, round(max(l_discount * 10) * pow(0.6, min(l_linenumber) - 1), 6) AS graph_score FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.max(F.col("l_discount") * 10) * F.pow(F.lit(0.6), F.min("l_linenumber") - 1), 6).alias("graph_score"))


@query("op_a10_counter_map", "SELECT o_orderstatus, string_agg(o_orderpriority || '=' || n, ';' ORDER BY o_orderpriority) AS counts FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderstatus")
def _(spark, d):
    c = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    m = c.groupBy("o_orderstatus").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("o_orderpriority", "n")))).alias("m"))
    return m.select("o_orderstatus", F.expr("array_join(transform(map_entries(m), e -> concat(e.key, '=', e.value)), ';')").alias("counts"))


@query("op_a11_occurrences_latest", "SELECT user_id, event_type, count(*) AS n, arg_max(value, event_id) AS latest FROM events GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max_by("value", "event_id").alias("latest"))


@query("op_a12_set_collect", "SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))


@query("op_a13_weighted_mean", "SELECT o_orderstatus, round(sum(n * m) / sum(n), 4) AS weighted FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY ALL) GROUP BY o_orderstatus")
def _(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("m"))
    return g.groupBy("o_orderstatus").agg(F.round(F.sum(F.col("n") * F.col("m")) / F.sum("n"), 4).alias("weighted"))


@query("op_a14_moments", "SELECT event_type, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(stddev_pop(value), 6) AS deviation FROM events GROUP BY event_type")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.stddev_pop("value"), 6).alias("deviation"))


@query("op_a15_interpolated_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def _(spark, d):
    p = K.interpolated_percentiles(table(spark, d, "events"), ["event_type"], "value", [50, 90, 95, 99])
    return p.select("event_type", *[F.round(c, 6).alias(c) for c in p.columns[1:]])


@query("op_a16_discrete_percentiles", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (i = least(50 * n // 100, n - 1)) AS p50, max(value) FILTER (i = least(95 * n // 100, n - 1)) AS p95 FROM r GROUP BY event_type")
def _(spark, d):
    return K.discrete_percentiles(table(spark, d, "events"), ["event_type"], "value", [50, 95])


@query("op_a17_cumulative_histogram", "SELECT event_type, count(*) FILTER (value <= 1) AS le_1, count(*) FILTER (value <= 10) AS le_10, count(*) FILTER (value <= 100) AS le_100, count(*) AS le_inf FROM events GROUP BY event_type")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"le_{b}") for b in (1, 10, 100)], F.count(F.lit(1)).alias("le_inf"))


@query("op_a18_union_merge", "SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY conv_id")
def _(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set(F.array("role")).alias("parts"))
    return g.select("conv_id", F.array_join(F.array_sort(F.expr("aggregate(parts, cast(array() as array<string>), (a, x) -> array_union(a, x))")), ",").alias("roles"))


@query("op_a19_rates_and_thresholds", "SELECT o_orderpriority, round(avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END), 6) AS rate, avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END) >= 0.5 AS passed FROM orders GROUP BY o_orderpriority")
def _(spark, d):
    rate = F.avg((F.col("o_totalprice") > 150000).cast("double"))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(rate, 6).alias("rate"), (rate >= 0.5).alias("passed"))


@query("op_a22_running_bounds", f"WITH {CHUNKS_SQL} SELECT coalesce(parent_id, chunk_id) AS parent, CAST(min(time_start) AS INT) AS first_year, CAST(max(time_end) AS INT) AS last_year, min(tier) AS best_tier, count(*) AS n FROM chunks GROUP BY 1")
def _(spark, d):
    return chunks(spark, d).groupBy(F.coalesce("parent_id", "chunk_id").alias("parent")).agg(F.min("time_start").alias("first_year"), F.max("time_end").alias("last_year"), F.min("tier").alias("best_tier"), F.count(F.lit(1)).alias("n"))


@query("op_a23_throughput", "SELECT lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, round(sum(n_chars) / count(*), 4) AS chars_per_doc FROM documents GROUP BY lang")
def _(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), F.round(F.sum("n_chars") / F.count(F.lit(1)), 4).alias("chars_per_doc"))


@query("op_a24_alias_groups", "SELECT c_custkey - c_custkey % 5 AS canonical, coalesce(string_agg(c_name, ',' ORDER BY c_name) FILTER (c_custkey % 5 <> 0), '') AS aliases FROM customer GROUP BY 1")
def _(spark, d):
    c = table(spark, d, "customer").withColumn("canonical", F.expr("c_custkey - c_custkey % 5"))
    return c.groupBy("canonical").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("c_custkey") != F.col("canonical"), F.col("c_name")))), ",").alias("aliases"))


@query("op_a25_coreference", "SELECT o_custkey, count(*) AS mentions, count(DISTINCT o_orderpriority) AS forms, count(*) >= 2 AND count(DISTINCT o_orderpriority) = 1 AS same_entity FROM orders GROUP BY o_custkey")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("o_orderpriority").alias("forms")).withColumn("same_entity", F.expr("mentions >= 2 and forms = 1"))


# -- audits
@query("op_q01_self_loops", f"WITH {EDGES_SQL} SELECT count(*) FILTER (src = tgt) AS self_loops, count(*) AS total FROM edges")
def _(spark, d):
    return edges(spark, d).agg(F.count_if(F.col("src") == F.col("tgt")).alias("self_loops"), F.count(F.lit(1)).alias("total"))


@query("op_q02_duplicate_tuples", "SELECT count(*) AS total, (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) AS distinct_tuples FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("total"), F.count_distinct("l_partkey", "l_suppkey").alias("distinct_tuples"))


@query("op_q04_required_columns", "SELECT count(*) FILTER (text IS NULL OR text = '') AS no_text, count(*) FILTER (vec_id IS NULL) AS no_embedding, count(*) FILTER (source IS NULL) AS no_source FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("has"))
    return table(spark, d, "documents").join(e, "doc_id", "left").agg(F.count_if(F.expr("text is null or text = ''")).alias("no_text"), F.count_if(F.expr("has is null")).alias("no_embedding"), F.count_if(F.expr("source is null")).alias("no_source"))


@query("op_q05_health", f"WITH {EDGES_SQL} SELECT bool_and(src <> tgt) AND bool_and(confidence BETWEEN 0 AND 1) AS healthy FROM edges")
def _(spark, d):
    return edges(spark, d).agg(F.every(F.expr("src <> tgt and confidence between 0 and 1")).alias("healthy"))


@query("op_q06_completeness", f"WITH {CHUNKS_SQL} SELECT round(100.0 * (count(dynasty) + count(time_start) + count(tier)) / (3 * count(*)), 4) AS percent FROM chunks")
def _(spark, d):
    return chunks(spark, d).agg(F.round(100 * (F.count("dynasty") + F.count("time_start") + F.count("tier")) / (3 * F.count(F.lit(1))), 4).alias("percent"))


@query("op_q07_chunk_structure", f"WITH {CHUNKS_SQL}, s AS (SELECT c.parent_id IS NOT NULL AS child, len(string_split(c.content, ' ')) AS words, regexp_matches(c.content, '[.!?]\\s*$') AS ended, coalesce(contains(p.content, left(c.content, 60)), false) AS inside FROM chunks c LEFT JOIN chunks p ON c.parent_id = p.chunk_id) SELECT child, count(*) AS n, count(*) FILTER (CASE WHEN child THEN words BETWEEN 280 AND 520 ELSE words BETWEEN 100 AND 3500 END) AS in_bounds, count(*) FILTER (ended) AS ended, count(*) FILTER (inside) AS inside FROM s GROUP BY child")
def _(spark, d):
    c = chunks(spark, d)
    p = c.select(F.col("chunk_id").alias("parent_id"), F.col("content").alias("parent"))
    words = F.size(F.split("content", " "))
    s = c.join(p, "parent_id", "left").select(F.col("parent_id").isNotNull().alias("child"), words.alias("words"), F.col("content").rlike(r"[.!?]\s*$").alias("ended"), F.coalesce(F.contains("parent", F.expr("left(content, 60)")), F.lit(False)).alias("inside"))
    return s.groupBy("child").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.when(F.col("child"), F.col("words").between(280, 520)).otherwise(F.col("words").between(100, 3500))).alias("in_bounds"), F.count_if("ended").alias("ended"), F.count_if("inside").alias("inside"))


@query("op_q09_verified_rate", f"WITH {EDGES_SQL} SELECT rel, round(avg(CASE WHEN confidence >= 0.85 THEN 1.0 ELSE 0.0 END), 6) AS verified FROM edges GROUP BY rel")
def _(spark, d):
    return edges(spark, d).groupBy("rel").agg(F.round(F.avg((F.col("confidence") >= 0.85).cast("double")), 6).alias("verified"))


@query("op_q11_diagnostics", f"""WITH {CHUNKS_SQL} SELECT issue, severity, count(*) AS n FROM (SELECT chunk_id, 'SHORT' AS issue, 'WARN' AS severity FROM chunks WHERE length(content) < 100 UNION ALL SELECT chunk_id, 'UNDATED', 'INFO' FROM chunks WHERE time_start IS NULL
 UNION ALL SELECT chunk_id, 'INVERTED_YEARS', 'ERROR' FROM chunks WHERE time_end < time_start UNION ALL SELECT chunk_id, 'ORPHAN', 'ERROR' FROM chunks WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT chunk_id FROM chunks) UNION ALL SELECT chunk_id, 'NOISE', 'WARN' FROM chunks WHERE contains(content, '###')) GROUP BY ALL""")
def _(spark, d):
    c = chunks(spark, d)
    orphans = c.filter("parent_id is not null").join(c.select(F.col("chunk_id").alias("parent_id")), "parent_id", "left_anti")
    tag = lambda df, issue, severity: df.select("chunk_id", F.lit(issue).alias("issue"), F.lit(severity).alias("severity"))
    every = tag(c.filter("length(content) < 100"), "SHORT", "WARN").union(tag(c.filter("time_start is null"), "UNDATED", "INFO")).union(tag(c.filter("time_end < time_start"), "INVERTED_YEARS", "ERROR")).union(tag(orphans, "ORPHAN", "ERROR")).union(tag(c.filter("contains(content, '###')"), "NOISE", "WARN"))
    return every.groupBy("issue", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("op_q12_promote_quarantine", f"WITH {EDGES_SQL} SELECT src, rel, tgt, max(confidence) AS confidence FROM (SELECT src, rel, tgt, confidence FROM edges WHERE confidence >= 0.85 UNION ALL SELECT src, rel, tgt, confidence + 0.1 FROM edges WHERE confidence >= 0.75 AND confidence < 0.85 AND src <> tgt) GROUP BY ALL")
def _(spark, d):
    e = edges(spark, d).select("src", "rel", "tgt", "confidence")
    promoted = e.filter("confidence >= 0.75 and confidence < 0.85 and src <> tgt").withColumn("confidence", F.col("confidence") + 0.1)
    return R.upsert_max(e.filter("confidence >= 0.85"), promoted, ["src", "rel", "tgt"], "confidence")


@query("op_q13_regression_gates", "WITH cur AS (SELECT event_type, round(avg(value), 6) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type, round(avg(value), 6) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT b.event_type, CASE WHEN cur.v IS NULL THEN 'SKIPPED' WHEN cur.v < b.v - 0.5 THEN 'FAIL' ELSE 'PASS' END AS gate FROM b LEFT JOIN cur USING (event_type)")
def _(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))), 6).alias("now"), F.round(F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))), 6).alias("base"))
    return e.filter("base is not null").select("event_type", F.when(F.col("now").isNull(), "SKIPPED").when(F.col("now") < F.col("base") - 0.5, "FAIL").otherwise("PASS").alias("gate"))


@query("op_q14_cochran_sample", "SELECT lang, count(*) AS n, CAST(ceil(384.16 / (1 + (384.16 - 1) / count(*))) AS BIGINT) AS sample FROM documents GROUP BY lang")
def _(spark, d):
    n0 = 1.96**2 * 0.25 / 0.05**2
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("sample", F.ceil(n0 / (1 + (n0 - 1) / F.col("n"))))


# -- windows, sorts, sets
@query("op_n01_ranked_per_entity", "SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER w AS rank FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY abs(l_quantity - 25), CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, l_orderkey, l_linenumber) QUALIFY row_number() OVER w <= 6")
def _(spark, d):
    order = [F.abs(F.col("l_quantity") - 25), F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3), F.col("l_orderkey"), F.col("l_linenumber")]
    return R.top_per(table(spark, d, "lineitem"), ["l_partkey"], order, 6).select("l_partkey", "l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@query("op_n03_cap_per_source", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3")
def _(spark, d):
    return R.top_per(table(spark, d, "events"), ["user_id"], [F.desc("value"), F.col("event_id")], 3).select("user_id", "event_id")


@query("op_n04_running_budget", "WITH s AS (SELECT conv_id, turn, CAST(sum(ceil(length(text) / 3.5)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS spent, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) SELECT conv_id, turn, spent FROM s WHERE spent <= 800 OR n = 1")
def _(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.ceil(F.length("text") / 3.5).alias("cost"))
    return R.running_budget(c, ["conv_id"], [F.col("turn")], "cost", 800).drop("cost")


@query("op_n05_running_max", "SELECT o_custkey, o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM orders")
def _(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.max("o_totalprice").over(w).alias("so_far"))


@query("op_n06_islands", "WITH g AS (SELECT l_orderkey, l_linenumber, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS island FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R')) SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS n FROM g GROUP BY l_orderkey, island")
def _(spark, d):
    li = table(spark, d, "lineitem").filter("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber").distinct()
    g = li.withColumn("island", F.col("l_linenumber") - F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber")))
    return g.groupBy("l_orderkey", "island").agg(F.min("l_linenumber").alias("first"), F.max("l_linenumber").alias("last"), F.count(F.lit(1)).alias("n")).drop("island")


@query("op_n07_adjacent_rows", "SELECT user_id, event_id, coalesce(event_type = lag(event_type, 1) OVER w AND event_type = lag(event_type, 2) OVER w, false) AS looped FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.coalesce((F.col("event_type") == F.lag("event_type", 1).over(w)) & (F.col("event_type") == F.lag("event_type", 2).over(w)), F.lit(False)).alias("looped"))


@query("op_n08_first_occurrence", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def _(spark, d):
    return R.keep_first(table(spark, d, "events"), ["user_id", "event_type"], [F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("op_n09_stratified_sample", "WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn FROM documents) SELECT doc_id, lang, source FROM r ORDER BY rn, lang, source LIMIT 100")
def _(spark, d):
    r = table(spark, d, "documents").select("doc_id", "lang", "source").withColumn("rn", F.row_number().over(W.partitionBy("lang", "source").orderBy("doc_id"))).filter("rn <= 100")
    return r.orderBy("rn", "lang", "source").limit(100).drop("rn")


@query("op_n11_lost_in_the_middle", "WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, CASE WHEN rank = 1 THEN 0 WHEN rank = 2 THEN n ELSE rank END AS place FROM r")
def _(spark, d):
    w = W.partitionBy("conv_id")
    r = table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(w.orderBy("turn")).cast("long").alias("rank"), F.count(F.lit(1)).over(w).alias("n"))
    return r.select("conv_id", "turn", F.when(F.col("rank") == 1, 0).when(F.col("rank") == 2, F.col("n")).otherwise(F.col("rank")).alias("place"))


@query("op_t05_ordered_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("op_t06_threshold_top_k", "SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice >= 100000 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def _(spark, d):
    return R.top_per(table(spark, d, "orders").filter("o_totalprice >= 100000"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey")


@query("op_t07_dynamic_k", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= greatest(3, least(8, o_custkey % 10))")
def _(spark, d):
    k = F.greatest(F.lit(3), F.least(F.lit(8), F.col("o_custkey") % 10))
    return R.top_per(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], k).select("o_custkey", "o_orderkey")


@query("op_u01_union_all_tagged", f"WITH {EDGES_SQL} SELECT is_reverse, rel, count(*) AS n FROM (SELECT 0 AS is_reverse, rel FROM edges UNION ALL SELECT 1, rel FROM edges WHERE rel IN ('LED_BY', 'PART_OF')) GROUP BY ALL")
def _(spark, d):
    from quarry.operators.graph import oriented

    return oriented(edges(spark, d)).groupBy("is_reverse", "rel").agg(F.count(F.lit(1)).alias("n"))


@query("op_u02_union_distinct", "SELECT l_suppkey AS id FROM lineitem UNION SELECT s_suppkey FROM supplier")
def _(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id")).union(table(spark, d, "supplier").select("s_suppkey")).distinct()


@query("op_u04_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").select("o_custkey"))


@query("op_u05_intersection", "SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey").intersect(table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_custkey"))


@query("op_u06_collective_expansion", "SELECT c_custkey AS id, c_nationkey AS expanded FROM customer UNION SELECT a.c_custkey, a.c_nationkey + 1000 + n_regionkey FROM customer a JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    up = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("expanded"))
    return up.union(c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", F.expr("c_nationkey + 1000 + n_regionkey"))).distinct()


@query("op_u07_pair_suppression", f"WITH {EDGES_SQL}, a AS (SELECT * FROM edges WHERE confidence >= 0.6), b AS (SELECT tgt AS src, 'REV_' || rel AS rel, src AS tgt, confidence FROM edges WHERE confidence < 0.7) SELECT src, rel, tgt FROM a UNION ALL SELECT src, rel, tgt FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE least(a.src, a.tgt) = least(b.src, b.tgt) AND greatest(a.src, a.tgt) = greatest(b.src, b.tgt))")
def _(spark, d):
    from quarry.operators.graph import merge_unseen_pairs

    e = edges(spark, d)
    late = e.filter("confidence < 0.7").selectExpr("tgt AS src", "concat('REV_', rel) AS rel", "src AS tgt", "confidence")
    return merge_unseen_pairs(e.filter("confidence >= 0.6"), late).select("src", "rel", "tgt")


# -- snapshots: the stored table holds even line numbers, the batch the rest
_OLD, _NEW = "o_orderkey % 3 <> 0", "o_orderkey % 2 = 0"


@query("op_w02_upsert_aliases", f"WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS name, o_orderpriority AS alias FROM orders WHERE {_OLD}), n AS (SELECT o_orderkey AS id, 'new' AS name, lower(o_orderpriority) AS alias FROM orders WHERE {_NEW}) SELECT coalesce(n.id, o.id) AS id, coalesce(o.name, n.name) AS name, coalesce(n.alias, o.alias) AS alias FROM o FULL JOIN n ON o.id = n.id")
def _(spark, d):
    o = table(spark, d, "orders")
    return R.upsert_columns(o.filter(_OLD).selectExpr("o_orderkey AS id", "o_orderstatus AS name", "o_orderpriority AS alias"), o.filter(_NEW).selectExpr("o_orderkey AS id", "'new' AS name", "lower(o_orderpriority) AS alias"), ["id"], ["alias"])


@query("op_w03_last_write", "SELECT l_partkey, l_suppkey, l_quantity, seq FROM (SELECT l_partkey, l_suppkey, l_quantity, l_orderkey * 10 + l_linenumber AS seq FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY seq DESC) = 1")
def _(spark, d):
    li = table(spark, d, "lineitem").selectExpr("l_partkey", "l_suppkey", "l_quantity", "l_orderkey * 10 + l_linenumber AS seq")
    return R.upsert_last(li.filter("seq % 2 = 0"), li.filter("seq % 2 <> 0"), ["l_partkey", "l_suppkey"], "seq")


@query("op_w04_greatest", "SELECT l_partkey, l_suppkey, max(l_discount) AS confidence FROM lineitem GROUP BY ALL")
def _(spark, d):
    li = table(spark, d, "lineitem").selectExpr("l_partkey", "l_suppkey", "l_discount AS confidence", "l_linenumber")
    return R.upsert_max(li.filter("l_linenumber % 2 = 0").drop("l_linenumber"), li.filter("l_linenumber % 2 <> 0").drop("l_linenumber"), ["l_partkey", "l_suppkey"], "confidence")


@query("op_w05_additive_counter", "SELECT user_id, count(*) AS n, arg_max(event_type, event_id) AS sample FROM events GROUP BY user_id")
def _(spark, d):
    e = table(spark, d, "events").selectExpr("user_id", "1L AS n", "event_type AS sample", "event_id")
    return R.upsert_add(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 <> 0"), ["user_id"], "n", "sample", "event_id")


@query("op_w06_full_replace", f"SELECT o_orderkey, o_orderstatus, 0.0 AS o_totalprice FROM orders WHERE {_NEW} UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE {_OLD} AND NOT ({_NEW})")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return R.upsert_replace(o.filter(_OLD), o.filter(_NEW).withColumn("o_totalprice", F.lit(0.0)), ["o_orderkey"])


@query("op_w07_insert_ignore", f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_OLD} UNION ALL SELECT o_orderkey, -1.0 FROM orders WHERE {_NEW} AND NOT ({_OLD})")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return R.insert_ignore(o.filter(_OLD), o.filter(_NEW).withColumn("o_totalprice", F.lit(-1.0)), ["o_orderkey"])


@query("op_w08_array_union", "SELECT l_orderkey, string_agg(DISTINCT flag, ',' ORDER BY flag) AS flags FROM (SELECT l_orderkey, l_returnflag AS flag FROM lineitem UNION ALL SELECT l_orderkey, l_linestatus FROM lineitem) GROUP BY l_orderkey")
def _(spark, d):
    li = table(spark, d, "lineitem")
    u = R.upsert_union(li.select("l_orderkey", F.array("l_returnflag").alias("flags")), li.select("l_orderkey", F.array("l_linestatus").alias("flags")), ["l_orderkey"], "flags")
    return u.withColumn("flags", F.array_join("flags", ","))


@query("op_w09_replace_slice", "WITH n AS (SELECT l_orderkey, l_linenumber, 1.0 AS q FROM lineitem WHERE l_orderkey % 4 = 0 AND l_returnflag = 'R') SELECT * FROM n UNION ALL SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM n)")
def _(spark, d):
    li = table(spark, d, "lineitem")
    new = li.filter("l_orderkey % 4 = 0 and l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.lit(1.0).alias("q"))
    return R.replace_slice(li.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q")), new, "l_orderkey")


@query("op_w10_delete_where", f"WITH {EDGES_SQL} SELECT rel, count(*) AS n FROM edges WHERE NOT coalesce(src = tgt OR confidence < 0.4, false) GROUP BY rel")
def _(spark, d):
    return R.delete_where(edges(spark, d), F.expr("src = tgt or confidence < 0.4")).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


@query("op_w17_bounded_store", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20")
def _(spark, d):
    return R.top_per(table(spark, d, "events"), ["user_id"], [F.desc("event_id")], 20).select("event_id", "user_id")
