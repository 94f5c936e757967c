"""Queries over the edge list."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.plans.base import CHUNKS_SQL, EDGES_SQL, NODES_SQL, chunks, edges, nodes, table
from quarry.plans.registry import query

_WALK = """w AS (SELECT src AS here, tgt AS nxt FROM edges WHERE confidence >= 0.5 AND rel NOT IN ('MENTIONED_IN', 'SAME_AS_LOCATION')
 UNION ALL SELECT tgt, src FROM edges WHERE confidence >= 0.5 AND rel IN ('LED_BY', 'PART_OF'))"""


def _seeds(spark, d):
    return table(spark, d, "orders").filter("o_orderkey % 100 = 0").selectExpr("o_orderkey AS query", "concat('event_', o_orderkey) AS node")


@query("op_g01_bounded_bfs", f"""WITH RECURSIVE {EDGES_SQL}, {_WALK}, r AS (SELECT o_orderkey AS query, 'event_' || o_orderkey AS node, 0 AS hop FROM orders WHERE o_orderkey % 100 = 0 UNION SELECT query, nxt, hop + 1 FROM r JOIN w ON here = node WHERE hop < 2)
 SELECT query, node, CAST(min(hop) AS INT) AS hop FROM r GROUP BY query, node""")
def _(spark, d):
    return G.bounded_bfs(G.walkable(edges(spark, d)), _seeds(spark, d), hops=2, budget=None)[0]


@query("op_g01_bfs_node_budget")
def _(spark, d):
    return G.bounded_bfs(G.walkable(edges(spark, d)), _seeds(spark, d), hops=3, budget=50)[1]


@query("op_g03_closure", f"""WITH RECURSIVE {EDGES_SQL}, rules(r1, r2, r3) AS (VALUES ('PART_OF', 'PART_OF', 'PART_OF'), ('ALIAS_OF', 'LED_BY', 'LED_BY'), ('LED_BY', 'PART_OF', 'HAPPENED_AT'), ('ROYAL_LINEAGE', 'ROYAL_LINEAGE', 'ROYAL_LINEAGE'), ('HAPPENED_AT', 'PART_OF', 'HAPPENED_AT')),
 e AS (SELECT DISTINCT src, rel, tgt FROM edges WHERE rel <> 'MENTIONED_IN'), c AS (SELECT src, rel, tgt FROM e UNION SELECT c.src, r3, e.tgt FROM c JOIN rules ON c.rel = r1 JOIN e ON e.src = c.tgt AND e.rel = r2 WHERE c.src <> e.tgt) SELECT src, rel, tgt FROM c""")
def _(spark, d):
    return G.transitive_closure(edges(spark, d).filter("rel <> 'MENTIONED_IN'"))


@query("op_g04_lineage_view", f"WITH {EDGES_SQL}, {NODES_SQL} SELECT e.rel, a.type AS source_type, b.type AS target_type, count(*) AS n, round(avg(confidence), 6) AS confidence FROM edges e JOIN nodes a ON src = a.id JOIN nodes b ON tgt = b.id WHERE e.rel <> 'MENTIONED_IN' GROUP BY ALL")
def _(spark, d):
    return G.lineage_view(edges(spark, d), nodes(spark, d)).groupBy("rel", "source_type", "target_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("op_g05_connectivity", f"WITH {EDGES_SQL}, {NODES_SQL}, g AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT tgt FROM edges) GROUP BY id) SELECT count(*) AS nodes, count(degree) AS connected, count(*) - count(degree) AS isolated, round(sum(coalesce(degree, 0)) / count(*), 6) AS mean_degree FROM nodes LEFT JOIN g USING (id)")
def _(spark, d):
    return G.connectivity(edges(spark, d), nodes(spark, d))


@query("op_g06_path_recall", f"WITH {EDGES_SQL}, {NODES_SQL}, gold AS (SELECT 'event_' || o_orderkey AS a, 'person_' || o_custkey AS b FROM orders), hit AS (SELECT DISTINCT least(src, tgt) AS a, greatest(src, tgt) AS b FROM edges WHERE confidence >= 0.5) SELECT count(*) AS gold, count(hit.a) AS found, round(count(hit.a) / count(*), 6) AS recall FROM gold LEFT JOIN hit ON least(gold.a, gold.b) = hit.a AND greatest(gold.a, gold.b) = hit.b")
def _(spark, d):
    gold = table(spark, d, "orders").selectExpr("concat('event_', o_orderkey) AS x", "concat('person_', o_custkey) AS y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    hit = edges(spark, d).filter("confidence >= 0.5").select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).distinct().withColumn("hit", F.lit(1))
    return gold.join(hit, ["a", "b"], "left").agg(F.count(F.lit(1)).alias("gold"), F.count("hit").alias("found")).withColumn("recall", F.round(F.col("found") / F.col("gold"), 6))


@query("op_g07_hop_precision", f"WITH RECURSIVE {EDGES_SQL}, {_WALK}, r AS (SELECT o_orderkey AS query, 'event_' || o_orderkey AS node, 0 AS hop FROM orders WHERE o_orderkey % 100 = 0 UNION SELECT query, nxt, hop + 1 FROM r JOIN w ON here = node WHERE hop < 2), v AS (SELECT query, node, min(hop) AS hop FROM r GROUP BY query, node) SELECT CAST(hop AS INT) AS hop, count(*) AS reached, count(*) FILTER (node LIKE 'person_%') AS persons, count(DISTINCT query) AS queries FROM v GROUP BY hop")
def _(spark, d):
    v = G.bounded_bfs(G.walkable(edges(spark, d)), _seeds(spark, d), hops=2, budget=None)[0]
    return v.groupBy("hop").agg(F.count(F.lit(1)).alias("reached"), F.count_if(F.col("node").like("person_%")).alias("persons"), F.count_distinct("query").alias("queries"))


@query("op_g08_conflicts", f"""WITH {CHUNKS_SQL}, s AS (SELECT coalesce(parent_id, chunk_id) AS key, chunk_id AS claim_id, tier, round((30 + (chunk_id * 17) % 70) / 100.0 * CASE tier WHEN 'LEVEL_1' THEN 1.0 WHEN 'LEVEL_2' THEN 0.8 ELSE 0.5 END, 9) AS score FROM chunks)
 SELECT a.key, a.claim_id AS a, b.claim_id AS b, CASE WHEN (a.tier = 'LEVEL_1' AND b.tier = 'LEVEL_1') OR round(abs(a.score - b.score), 9) <= 0.15 THEN 'MULTI_PERSPECTIVE' WHEN a.score > b.score THEN 'KEEP_A' ELSE 'KEEP_B' END AS outcome FROM s a JOIN s b ON a.key = b.key AND a.claim_id < b.claim_id""")
def _(spark, d):
    c = chunks(spark, d).select(F.coalesce("parent_id", "chunk_id").alias("key"), F.col("chunk_id").alias("claim_id"), "tier", F.expr("(30 + (chunk_id * 17) % 70) / 100D").alias("confidence"))
    return G.resolve_conflicts(c).select("key", F.col("a_claim_id").alias("a"), F.col("b_claim_id").alias("b"), "outcome")


@query("op_g09_quarantine_routing", f"WITH {EDGES_SQL}, {NODES_SQL}, kept AS (SELECT id FROM nodes WHERE NOT coalesce(type = 'person' AND TRY_CAST(substr(id, 8) AS BIGINT) % 13 = 0, false)), r AS (SELECT rel, CASE WHEN src = tgt THEN 'SELF_LOOP' WHEN confidence < 0.85 THEN 'LOW_CONFIDENCE' WHEN a.id IS NULL OR b.id IS NULL THEN 'DANGLING' ELSE 'PRODUCTION' END AS route FROM edges LEFT JOIN kept a ON src = a.id LEFT JOIN kept b ON tgt = b.id) SELECT rel, route, count(*) AS n FROM r GROUP BY ALL")
def _(spark, d):
    kept = nodes(spark, d).filter("not (type = 'person' and cast(substr(id, 8) as bigint) % 13 = 0)")
    return G.quarantine(edges(spark, d), kept).groupBy("rel", "route").agg(F.count(F.lit(1)).alias("n"))


@query("op_g11_spatial_level", "SELECT n_name, CASE WHEN lower(n_name) LIKE 'country%' OR lower(n_name) LIKE 'nation%' THEN 0 WHEN lower(n_name) LIKE 'region%' OR lower(n_name) LIKE 'province%' THEN 1 WHEN lower(n_name) LIKE 'district%' OR lower(n_name) LIKE 'prefecture%' THEN 2 WHEN lower(n_name) LIKE 'commune%' OR lower(n_name) LIKE 'town%' THEN 3 ELSE 4 END AS level FROM nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_name", G.spatial_level("n_name").alias("level"))


@query("op_g13_evidence_bonus", f"WITH {CHUNKS_SQL} SELECT c_custkey, round(least(1.0, (30 + (c_custkey * 31) % 70) / 100.0 + CASE WHEN contains(lower(p.content), lower(c.content)) THEN 0.03 ELSE 0 END), 6) AS confidence FROM customer JOIN chunks c ON c.chunk_id = c_custkey JOIN chunks p ON p.chunk_id = c.parent_id")
def _(spark, d):
    c = chunks(spark, d)
    p = c.select(F.col("chunk_id").alias("parent_id"), F.lower("content").alias("parent"))
    k = table(spark, d, "customer").select("c_custkey")
    j = k.join(c, k.c_custkey == c.chunk_id).join(p, "parent_id")
    bonus = F.when(F.contains("parent", F.lower("content")), 0.03).otherwise(0)
    return j.select("c_custkey", F.round(F.least(F.lit(1.0), F.expr("(30 + (c_custkey * 31) % 70) / 100D") + bonus), 6).alias("confidence"))


# -- closure with identities: leaders' places and realms, places within places, lineage by customer number, and one id in two spellings
_TRIPLES = [
    ("orders", "concat('event_', o_orderkey)", "LED_BY", "concat('person_', o_custkey)", "true"),
    ("orders", "concat('event_', o_orderkey)", "HAPPENED_AT", "concat('loc_', o_custkey % 25)", "o_orderkey % 7 = 0"),
    ("orders", "concat('event_', o_orderkey)", "HAPPENED_IN", "concat('dynasty_', o_custkey % 5)", "o_orderkey % 64 = 1"),
    ("nation", "concat('loc_', n_nationkey)", "HAPPENED_AT", "concat('loc_region_', n_regionkey)", "true"),
    ("customer", "concat('person_', c_custkey)", "ROYAL_LINEAGE", "concat('person_', 2 * c_custkey)", "c_custkey % 3 = 0"),
    ("supplier", "concat('doc_', s_suppkey)", "MENTIONED_IN", "concat('person_', s_suppkey)", "true"),
    ("part", "concat('artifact_', p_partkey)", "PART_OF", "concat('dynasty_', p_partkey % 5)", "p_partkey % 9 = 0"),
    ("customer", "concat('person_', c_custkey)", "ALIAS_OF", "concat(' Person_', c_custkey + 1)", "c_custkey % 40 = 0"),
    ("nation", "concat('loc_', n_nationkey)", "SAME_AS_LOCATION", "concat('loc_old_', n_nationkey)", "n_nationkey % 6 = 0"),
]


def _sql_prefixes(c: str, prefixes: list[str] | None) -> str:
    return "true" if prefixes is None else "(" + " OR ".join(f"starts_with({c}, '{p}')" for p in prefixes) + ")"


def _quotient_sql() -> str:
    from quarry.operators import closure as C

    base = " UNION ".join(f"SELECT trim(lower({s})) AS src, '{r}' AS rel, trim(lower({t})) AS tgt FROM {f} WHERE {w}" for f, s, r, t, w in _TRIPLES)
    turn = lambda turned: "tgt AS src, {0} AS rel, src AS tgt" if turned else "src, {0} AS rel, tgt"
    said = ["SELECT src, rel, tgt FROM t"] + [f"SELECT {turn(turned).format(repr(f))} FROM t WHERE rel = '{r}' AND {_sql_prefixes('src', s)} AND {_sql_prefixes('tgt', o)}" for r, s, o, f, turned in C.DIRECT]
    said += [f"SELECT src, '{f}', tgt FROM t WHERE rel = '{C.PART_IN[0]}' AND NOT ({_sql_prefixes('src', C.LEADERS)} AND {_sql_prefixes('tgt', C.LED)}) AND {_sql_prefixes('tgt', C.PART_IN[1])}" for f in C.PART_IN[2]]
    said += [f"SELECT {turn(turned).format(repr(r))} FROM t WHERE rel = 'ALIAS_OF' AND (starts_with(src, 'loc_') OR starts_with(tgt, 'loc_'))" for turned in (False, True) for r in ("SAME_AS_LOCATION", "HAPPENED_AT")]
    rules = ", ".join(map(str, C.RULES))
    return f"""WITH RECURSIVE t AS ({base}), pairs AS (SELECT src AS a, tgt AS b FROM t WHERE rel IN ('ALIAS_OF', 'SAME_AS_LOCATION')),
 reach(node, other) AS (SELECT a, a FROM pairs UNION SELECT b, b FROM pairs UNION SELECT node, CASE WHEN other = a THEN b ELSE a END FROM reach JOIN pairs ON other = a OR other = b),
 m AS (SELECT node, min(other) AS rep FROM reach GROUP BY node), said AS ({' UNION '.join(said)}), rules(r1, r2, r3) AS (VALUES {rules}),
 s AS (SELECT said.*, coalesce(x.rep, src) AS s, coalesce(y.rep, tgt) AS o FROM said LEFT JOIN m x ON x.node = src LEFT JOIN m y ON y.node = tgt)"""


def _identity_sql() -> str:
    """Rules join the facts with themselves, which DuckDB's recursion does not allow, so rounds are written out, more than the data need."""
    from quarry.operators import closure as C

    inner = [r for r, _, _ in C.SAID] + ["within", "child"]
    rounds = [" f0 AS MATERIALIZED (SELECT DISTINCT s AS src, rel, o AS tgt FROM s WHERE s <> o)"]
    most = 8
    rounds += [f" f{k + 1} AS MATERIALIZED (SELECT * FROM f{k} UNION SELECT a.src, r3, b.tgt FROM f{k} a JOIN rules ON a.rel = r1 JOIN f{k} b ON b.rel = r2 AND b.src = a.tgt WHERE a.src <> b.tgt)" for k in range(most)]
    outer = [f"SELECT src, rel, tgt FROM f{most} WHERE rel NOT IN ({', '.join(map(repr, inner))})"] + [f"SELECT src, '{rel}', tgt FROM f{most} WHERE rel = '{r}'" + (f" AND NOT {_sql_prefixes('src', but)}" if but else "") for r, rel, but in C.SAID]
    return f"""{_quotient_sql()}, {', '.join(r.strip() for r in rounds)}, o AS ({' UNION '.join(outer)}),
 e AS (SELECT coalesce(x.node, src) AS src, rel, coalesce(y.node, tgt) AS tgt FROM o LEFT JOIN m x ON x.rep = src LEFT JOIN m y ON y.rep = tgt
  UNION SELECT x.node, rel, y.node FROM s JOIN m x ON x.rep = s.s JOIN m y ON y.rep = s.s WHERE s.s = s.o AND src <> tgt AND upper(rel) = rel AND x.node <> y.node)
 SELECT rel, tgt, count(*) AS n, min(src) AS first FROM e GROUP BY ALL"""


@query("op_g03_identity_closure", _identity_sql())
def _(spark, d):
    from quarry.operators.closure import identity_closure

    t = None
    for f, s, r, o, w in _TRIPLES:
        df = table(spark, d, f).filter(w).selectExpr("0 AS `group`", f"{s} AS src", f"'{r}' AS rel", f"{o} AS tgt")
        t = df if t is None else t.unionByName(df)
    return identity_closure(t)[0].groupBy("rel", "tgt").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("first"))


@query("op_m09_three_pass")
def _(spark, d):
    from quarry.operators.closure import three_pass_match

    # A snippet is a customer with the orders: gold are the confident triples; predictions have all leaders, and places that follow only through them.
    o = table(spark, d, "orders").filter("o_orderkey % 5 = 0").withColumn("group", F.col("o_custkey").cast("string"))
    led = o.selectExpr("`group`", "o_orderkey * 2 AS n", "concat('event_', o_orderkey) AS src", "'LED_BY' AS rel", "concat('person_', o_custkey) AS tgt")
    at = o.selectExpr("`group`", "o_orderkey * 2 + 1 AS n", "concat('event_', o_orderkey) AS src", "'HAPPENED_AT' AS rel", "concat('loc_', o_custkey % 25) AS tgt")
    guess = o.filter("o_orderkey % 3 = 0").selectExpr("`group`", "o_orderkey * 2 + 1 AS n", "concat('person_', o_custkey) AS src", "'HAPPENED_AT' AS rel", "concat('loc_', (o_custkey + o_orderkey % 2) % 25) AS tgt")
    gold, predicted = led.filter("n % 4 = 0").unionByName(at), led.unionByName(guess)
    return three_pass_match(predicted.withColumnRenamed("n", "p"), gold.withColumnRenamed("n", "g")).groupBy("how").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("group").alias("snippets"))
