"""Queries of diagnostics, promotion and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import dims
from quarry.operators import audits as A
from quarry.plans.base import CHUNKS_SQL, EDGES_SQL, NODES_SQL, chunks, edges, nodes, table
from quarry.plans.registry import query

# -- diagnostics: one triple an order, in the chunk of its customer; masters are finished orders and the customers of twenty nations
_DYNASTY = "CASE WHEN chunk_id % 4 <> 1 THEN dynasty END"
_SOURCE = "CASE o_orderkey % 9 WHEN 0 THEN o_orderpriority WHEN 4 THEN 'unknown' ELSE concat('Order ', o_orderkey) END"
_TARGET = "CASE o_orderkey % 11 WHEN 0 THEN concat('[', o_custkey, ']') ELSE concat('Buyer ', o_custkey) END"
_TARGET_ID = "CASE o_orderkey % 17 WHEN 3 THEN 'doc:historical_context' ELSE concat('person_', o_custkey) END"
_CONF = "CAST(60 + o_orderkey * 7919 % 40 AS DOUBLE) / 100"
_GENERIC = ["unknown", "order"]


def _valid(c: str) -> str:
    return rf"(length({c}) BETWEEN 2 AND 80 AND len(regexp_split_to_array({c}, '\s+')) <= 8 AND NOT regexp_matches({c}, '^\d') AND NOT regexp_matches({c}, '[\[\](){{}}<>]') AND lower({c}) NOT IN ('unknown', 'order'))"


@query(
    "op_q11_ingest_diagnostics",
    rf"""WITH {CHUNKS_SQL}, m AS (SELECT 'Order ' || o_orderkey AS name FROM orders WHERE o_orderstatus = 'F' UNION SELECT 'Buyer ' || c_custkey FROM customer WHERE c_nationkey < 20),
 t AS (SELECT 'file ' || o_custkey % 7 AS document, o_custkey AS chunk_id, o_orderkey AS ord, {_SOURCE} AS s, 'LED_BY' AS rel, {_TARGET} AS t, {_TARGET_ID} AS tid, {_CONF} AS c FROM orders),
 v AS (SELECT *, {_valid('s')} AS vs, {_valid('t')} AS vt, s IN (SELECT name FROM m) AS ms, t IN (SELECT name FROM m) AS mt, tid = 'doc:historical_context' AS loose FROM t),
 i AS (SELECT 'file ' || chunk_id % 7 AS document, chunk_id, -1 AS ord, 0 AS step, 'TEMPORAL_SPATIAL_MISSING' AS issue, 'file ' || chunk_id % 7 AS item FROM chunks WHERE {_DYNASTY} IS NULL AND (time_start IS NULL OR time_end IS NULL)
  UNION ALL SELECT document, chunk_id, ord, 1, 'GENERIC_OR_HALLUCINATED_ENTITY', CASE WHEN vs THEN t ELSE s END FROM v WHERE NOT vs OR NOT vt UNION ALL SELECT document, chunk_id, ord, 2, 'UNMAPPED_ENTITY', s FROM v WHERE vs AND vt AND NOT ms
  UNION ALL SELECT document, chunk_id, ord, 3, 'UNMAPPED_ENTITY', t FROM v WHERE vs AND vt AND NOT mt AND NOT loose UNION ALL SELECT document, chunk_id, ord, 4, 'DANGLING_RELATIONSHIP', concat_ws(' ', s, rel, t) FROM v WHERE vs AND vt AND loose
  UNION ALL SELECT document, chunk_id, ord, 5, 'LOW_CONFIDENCE_RELATION', concat_ws(' ', s, rel, t) FROM v WHERE vs AND vt AND NOT loose AND c < 0.85),
 a AS (SELECT issue, item, min((document, chunk_id, ord, step)) AS w FROM i WHERE issue IN ('GENERIC_OR_HALLUCINATED_ENTITY', 'UNMAPPED_ENTITY') GROUP BY ALL),
 k AS (SELECT * FROM {dims.values_sql(list(enumerate(A.SEVERITY, 1)))} AS k(place, issue)),
 f AS (SELECT row_number() OVER (ORDER BY document, chunk_id, ord, step, issue, item) AS place, issue, item FROM i QUALIFY place <= 100), r AS (SELECT row_number() OVER (ORDER BY w, issue, item) AS place, issue, item FROM a QUALIFY place <= 20)
 SELECT 'summary' AS section, CAST(place AS INT) AS place, issue, NULL AS item, (SELECT count(*) FROM i WHERE i.issue = k.issue) AS n FROM k UNION ALL SELECT 'issue', place, issue, item, 1 FROM f UNION ALL SELECT 'recommendation', place, issue, item, 1 FROM r""",
)
def _(spark, d):
    c = chunks(spark, d).select(F.expr("concat('file ', chunk_id % 7)").alias("document"), "chunk_id", F.expr(_DYNASTY).alias("dynasty"), "time_start", "time_end")
    o = table(spark, d, "orders")
    t = o.selectExpr("concat('file ', o_custkey % 7) AS document", "o_custkey AS chunk_id", "o_orderkey AS ord", f"{_SOURCE} AS source_name", "'LED_BY' AS rel", f"{_TARGET} AS target_name", f"{_TARGET_ID} AS target_id", f"{_CONF} AS confidence")
    masters = o.filter("o_orderstatus = 'F'").selectExpr("concat('Order ', o_orderkey) AS name").unionByName(table(spark, d, "customer").filter("c_nationkey < 20").selectExpr("concat('Buyer ', c_custkey) AS name"))
    return A.diagnostic_report(A.diagnose(c, t, masters, _GENERIC))


# -- promotion: edges below 0.85 are in quarantine, some of them decided before; documents are no entities
_STATUS = "CASE WHEN confidence < 0.4 THEN 'REJECTED' ELSE 'PENDING_REVIEW' END"
_Q_ID = "src || ' ' || rel || ' ' || tgt"


@query(
    "op_q12_promoted_triples",
    f"""WITH {EDGES_SQL}, {NODES_SQL}, ent AS (SELECT id FROM nodes WHERE type <> 'document'), kept AS (SELECT src, rel, tgt, confidence FROM edges WHERE confidence >= 0.7), q AS (SELECT {_Q_ID} AS id, src, rel, tgt, confidence, {_STATUS} AS status FROM edges WHERE confidence < 0.85),
 p AS (SELECT * FROM q WHERE status = 'PENDING_REVIEW' AND confidence >= 0.6 AND src <> tgt AND src IN (SELECT id FROM ent) AND tgt IN (SELECT id FROM ent))
 SELECT 'relation' AS what, rel AS name, count(*) AS n, round(sum(confidence), 6) AS weight FROM (SELECT src, rel, tgt, max(confidence) AS confidence FROM (SELECT * FROM kept UNION ALL SELECT src, rel, tgt, confidence FROM p) GROUP BY ALL) GROUP BY rel
 UNION ALL SELECT 'quarantine', CASE WHEN id IN (SELECT id FROM p) THEN 'APPROVED' ELSE status END, count(*), round(sum(confidence), 6) FROM q GROUP BY 2 UNION ALL SELECT 'audit', entity_id, n, 0.0 FROM (SELECT src AS entity_id, count(*) AS n FROM p GROUP BY src)""",
)
def _(spark, d):
    e = edges(spark, d)
    q = e.filter("confidence < 0.85").selectExpr(f"{_Q_ID} AS id", "src", "rel", "tgt", "confidence", f"{_STATUS} AS status")
    stored, marked, audit = A.promote_triples(e.filter("confidence >= 0.7"), q, nodes(spark, d).filter("type <> 'document'"), 0.6)
    total = lambda df, what, name: df.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 6).alias("weight")).select(F.lit(what).alias("what"), "name", "n", "weight")
    noted = audit.groupBy(F.col("entity_id").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("audit").alias("what"), "name", "n", F.lit(0.0).alias("weight"))
    return total(stored, "relation", "rel").unionByName(total(marked, "quarantine", "status")).unionByName(noted)


# -- names of customers by segment: those of the first fifteen nations belong to stored entities
_RAW = "concat(c_mktsegment, ' ', c_custkey)"
_TYPE = "CASE c_custkey % 3 WHEN 0 THEN 'LOCATION' WHEN 1 THEN 'EVENT_BATTLE' END"
_OFTEN = "c_custkey * 31 % 40"
_TRIAGE = "CASE WHEN c_custkey % 7 = 0 THEN 'DISCARDED_AS_NOISE' ELSE 'PENDING_TRIAGE' END"


@query(
    "op_q12_promoted_entities",
    f"""WITH u AS (SELECT c_custkey AS id, {_RAW} AS raw_name, {_TYPE} AS inferred, {_OFTEN} AS often, {_TRIAGE} AS status, c_nationkey AS nation FROM customer), p AS (SELECT u.*, n_name FROM u JOIN nation ON n_nationkey = nation WHERE status = 'PENDING_TRIAGE' AND often >= 10),
 x AS (SELECT 'loc_' || n_nationkey AS id, 0 AS rank, 0 AS often, NULL AS k, n_name AS name, 'LOCATION' AS type FROM nation WHERE n_nationkey < 15 UNION ALL SELECT 'loc_' || nation, 1, -often, id, n_name, coalesce(inferred, 'ORGANIZATION') FROM p),
 a AS (SELECT 'loc_' || n_nationkey AS id, n_name AS alias FROM nation WHERE n_nationkey < 15 UNION SELECT 'loc_' || nation, unnest([raw_name, lower(n_name)]) FROM p),
 e AS (SELECT id, name, type FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, often, k) = 1)
 SELECT 'entity' AS what, id AS name, type AS detail, md5(string_agg(alias, ',' ORDER BY alias)) AS aliases, count(*) AS n FROM e JOIN a USING (id) GROUP BY ALL
 UNION ALL SELECT 'unmapped', CASE WHEN id IN (SELECT id FROM p) THEN 'PROMOTED' ELSE status END, NULL, NULL, count(*) FROM u GROUP BY 2 UNION ALL SELECT 'audit', 'loc_' || nation, NULL, NULL, count(*) FROM p GROUP BY 2""",
)
def _(spark, d):
    n = table(spark, d, "nation")
    stored = n.filter("n_nationkey < 15").selectExpr("concat('loc_', n_nationkey) AS id", "n_name AS name", "'LOCATION' AS type", "array(n_name) AS aliases")
    c = table(spark, d, "customer")
    unmapped = c.selectExpr("c_custkey AS id", f"{_RAW} AS raw_name", f"{_TYPE} AS inferred_type", f"{_OFTEN} AS occurrences", f"{_TRIAGE} AS status")
    resolved = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(f"{_RAW} AS raw_name", "concat('loc_', n_nationkey) AS entity_id", "n_name AS canonical", "'ORGANIZATION' AS type", "array(lower(n_name)) AS aliases")
    merged, marked, audit = A.promote_entities(stored, unmapped, resolved, 10)
    null = F.lit(None).cast("string")
    out = merged.select(F.lit("entity").alias("what"), F.col("id").alias("name"), F.col("type").alias("detail"), F.md5(F.array_join("aliases", ",").cast("binary")).alias("aliases"), F.size("aliases").cast("long").alias("n"))
    count = lambda df, what, name: df.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "name", null.alias("detail"), null.alias("aliases"), "n")
    return out.unionByName(count(marked, "unmapped", "status")).unionByName(count(audit, "audit", "entity_id"))


# -- gates: a run is a user; each metric is a mean of every sixth of its events, on the metric's scale; some runs lack some
_METRICS = [g[1] for g in A.GATES]
_SCALED = "CASE event_id % 6 WHEN 0 THEN 70 + v / 5 WHEN 1 THEN v / 5 WHEN 2 THEN 60 + v / 2 WHEN 3 THEN 0.6 + v / 400 WHEN 4 THEN 1000 + v * 10 ELSE 500 + v * 6 END"


@query(
    "op_q13_release_gates",
    f"""WITH e AS (SELECT user_id AS run, event_id % 6 AS k, sum(CAST(round(value * 100) AS BIGINT)) / 100.0 / count(*) AS v FROM events WHERE (user_id + event_id % 6) % 9 <> 0 GROUP BY ALL), b0 AS (SELECT event_id % 6 AS k, sum(CAST(round(value * 100) AS BIGINT)) / 100.0 / count(*) AS v FROM events GROUP BY 1),
 c AS (SELECT run, k, round({_SCALED.replace('event_id % 6', 'k')}, 4) AS value FROM e), b AS (SELECT k, round({_SCALED.replace('event_id % 6', 'k')}, 4) AS base FROM b0 WHERE k < 5),
 g AS (SELECT row_number() OVER () - 1 AS k, * FROM (SELECT * FROM {dims.values_sql([tuple(A.GATES[0]), *A.GATES[1:]]).replace('None', 'NULL')} AS g(gate, metric, floor, ceiling, fall, rise, digits, stand_in))),
 j AS (SELECT r.run, gate, coalesce(base, stand_in) AS baseline, value, floor, ceiling, fall, rise, digits FROM (SELECT DISTINCT run FROM c) r CROSS JOIN g LEFT JOIN b ON b.k = g.k LEFT JOIN c ON c.run = r.run AND c.k = g.k),
 h AS (SELECT *, coalesce(value >= floor, true) AND coalesce(value <= ceiling, true) AND coalesce(value - baseline >= -fall, true) AND coalesce(value - baseline <= rise, true) AS holds FROM j),
 s AS (SELECT run, gate, coalesce(value, 0)::DOUBLE AS value, (value IS NULL OR holds) AS passed, CASE WHEN value IS NULL THEN 'SKIPPED' WHEN holds THEN 'PASS' ELSE 'FAIL' END AS status FROM h)
 SELECT *, bool_and(passed) OVER (PARTITION BY run) AS all_passed FROM s""",
)
def _(spark, d):
    e = table(spark, d, "events").selectExpr("user_id AS run", "event_id % 6 AS k", "CAST(round(value * 100) AS BIGINT) AS cents")
    mean = (F.sum("cents") / 100 / F.count(F.lit(1))).alias("v")
    metric = F.element_at(F.array(*map(F.lit, _METRICS)), (F.col("k") + 1).cast("int")).alias("metric")
    scaled = F.round(F.expr(_SCALED.replace("event_id % 6", "k")), 4).alias("value")
    current = e.filter("(run + k) % 9 <> 0").groupBy("run", "k").agg(mean).select("run", metric, scaled)
    baseline = e.groupBy("k").agg(mean).filter("k < 5").select(metric, scaled)
    return A.regression_gates(current, baseline).select("run", "gate", "value", "passed", "status", "all_passed")
