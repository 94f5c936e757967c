"""Queries over ranked branches. Queries are the rows whose id is divisible by 100, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import index as I
from quarry.operators import retrieval as X
from quarry.operators.relational import top_per
from quarry.plans.base import CHUNKS_SQL, EDGES_SQL, POSTINGS_SQL, TITLES_SQL, chunks, edges, occurrences, table
from quarry.plans.registry import query


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding")


def dense(spark, d, k: int) -> DataFrame:
    v = _vectors(spark, d)
    return X.dense_top_k(v.filter("vec_id % 100 = 0"), v, k)


def _cosine_sql(a: str, b: str) -> str:
    unit = lambda v: f"abs(sqrt(list_dot_product({v}::DOUBLE[], {v}::DOUBLE[])) - 1) < 1e-4"
    return f"CASE WHEN {unit(a)} AND {unit(b)} THEN list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) ELSE list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]) END"


DENSE_SQL = f"""sims AS (SELECT q.vec_id AS query, v.vec_id AS chunk_id, round({_cosine_sql("q.embedding", "v.embedding")}, 9) AS similarity FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
 dense AS (SELECT query, chunk_id, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, chunk_id) AS rank FROM sims)"""


def _terms(spark, d) -> DataFrame:
    """A query's terms: all tokens of its document's content and title."""
    return terms_of(chunks(spark, d).filter("chunk_id % 100 = 0"))


def terms_of(c: DataFrame) -> DataFrame:
    return occurrences(c).unionByName(occurrences(c, "title")).distinct().select(F.col("chunk_id").alias("query"), F.col("token").alias("term"))


def lexical(spark, d, k: int | None, cut=None) -> DataFrame:
    """The k best chunks of each query by term hits; all of them, without a rank, if k is None; ``cut`` as in ``search``."""
    return I.term_points(I.build_index(chunks(spark, d), positions=False), _terms(spark, d), k, cut=cut)


def content_index(spark, d) -> DataFrame:
    """The index of contents without titles: a point for each term that the content has."""
    return I.build_index(chunks(spark, d).withColumn("title", F.lit(None).cast("string")), positions=False)


TERMS_SQL = f"{TITLES_SQL}, terms AS (SELECT chunk_id AS query, token AS term FROM postings WHERE chunk_id % 100 = 0 UNION SELECT chunk_id, token FROM titles WHERE chunk_id % 100 = 0)"
LEXICAL_SQL = f"{CHUNKS_SQL}, {POSTINGS_SQL}, {TERMS_SQL}, hits AS (SELECT query, chunk_id, CAST(sum(points) AS BIGINT) AS score FROM terms JOIN (SELECT token, chunk_id, 1 AS points FROM postings UNION ALL SELECT token, chunk_id, 2 FROM titles) ON term = token GROUP BY ALL), lexical AS (SELECT query, chunk_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS rank FROM hits)"


HYBRID_SQL = f"""{DENSE_SQL}, {LEXICAL_SQL},
 parts AS (SELECT query, chunk_id, CASE WHEN query % 200 = 0 THEN 0.2 ELSE 0.5 END / (60 + rank) AS part FROM dense WHERE rank <= 30 UNION ALL SELECT query, chunk_id, CASE WHEN query % 200 = 0 THEN 0.8 ELSE 0.5 END / (60 + rank) FROM lexical WHERE rank <= 30),
 fused AS (SELECT query, chunk_id, sum(part) AS score FROM parts GROUP BY ALL),
 boosted AS (SELECT f.query, f.chunk_id, round(score * CASE WHEN c.tier = 'LEVEL_1' THEN 1.35 ELSE 1.0 END * CASE WHEN c.parent_id IS NOT NULL THEN 1.15 ELSE 1.0 END
   * CASE WHEN q.time_start IS NULL OR c.time_start IS NULL THEN 1.0 ELSE (CASE WHEN g <= 0 THEN 1.25 WHEN g <= 2 THEN 1.10 WHEN g <= 5 THEN 1.0 WHEN g <= 15 THEN 0.75 WHEN g <= 30 THEN 0.40 ELSE 0.15 END) END, 9) AS score
   FROM fused f JOIN chunks c USING (chunk_id) JOIN chunks q ON q.chunk_id = f.query, LATERAL (SELECT greatest(c.time_start - q.time_start, q.time_start - c.time_end, 0) AS g)),
 hybrid AS (SELECT query, chunk_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS rank FROM boosted)"""


def hybrid(spark, d, k: int = 10) -> DataFrame:
    c = chunks(spark, d)
    intent = F.when(F.col("chunk_id") % 200 == 0, "FACTOID_LOOKUP").otherwise("COMPARATIVE_SYNTHESIS")
    q = c.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query"), X.weights(F.lit(""), intent).alias("w"), F.col("time_start").alias("year"))
    return X.hybrid(dense(spark, d, X.OVERFETCH * k), lexical(spark, d, X.OVERFETCH * k), c, q, k)


@query("op_x01_dense_top_k", f"WITH {DENSE_SQL} SELECT query, chunk_id, rank, round(similarity, 6) AS similarity, round(1 / (2 - similarity), 6) AS score FROM dense WHERE rank <= 20")
def _(spark, d):
    return dense(spark, d, 20).select("query", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


@query("op_x02_cosine", f"SELECT e.vec_id, round({_cosine_sql('e.embedding', 'q.embedding')}, 6) AS similarity FROM embeddings e JOIN embeddings q ON q.vec_id = e.vec_id - e.vec_id % 100")
def _(spark, d):
    e = _vectors(spark, d).withColumn("at", F.expr("vec_id - vec_id % 100"))
    q = _vectors(spark, d).select(F.col("vec_id").alias("at"), F.col("embedding").alias("other"))
    return e.join(q, "at").select("vec_id", F.round(X.cosine("embedding", "other"), 6).alias("similarity"))


@query("op_x09_lexical_top_k", f"WITH {LEXICAL_SQL} SELECT query, chunk_id, CAST(score AS DOUBLE) AS score, rank FROM lexical WHERE rank <= 20")
def _(spark, d):
    return lexical(spark, d, 20).withColumn("rank", F.col("rank").cast("long"))


#: Questions of every kind from the texts: with a stem and branch, with a year, on a concept, or of an intent.
_ASKED = """CASE doc_id % 5 WHEN 0 THEN concat_ws(' ', text, 'Canh  Thìn.') WHEN 1 THEN concat_ws(' ', lower(text), 'nguyên nhân') WHEN 2 THEN concat_ws(' ', text, 'nguyên nhân') WHEN 3 THEN concat_ws(' ', text, 900 + doc_id % 200) ELSE concat_ws(' ', text, 'canhthìn') END"""
_INTENT = "CASE doc_id % 11 WHEN 0 THEN 'FACTOID_LOOKUP' WHEN 1 THEN 'GENEALOGY_RELATION' WHEN 2 THEN 'BATTLE_TACTICS' WHEN 3 THEN 'COMPARATIVE_SYNTHESIS' END"


@query("op_x10_adaptive_weights", rf"""WITH q AS (SELECT doc_id, {_ASKED} AS t, {_INTENT} AS i FROM documents) SELECT doc_id, CASE i WHEN 'FACTOID_LOOKUP' THEN 0.2 WHEN 'GENEALOGY_RELATION' THEN 0.4 WHEN 'BATTLE_TACTICS' THEN 0.6 WHEN 'COMPARATIVE_SYNTHESIS' THEN 0.5 ELSE
 CASE WHEN regexp_matches(t, '(^|[^0-9A-Za-z_])\d{{3,4}}([^0-9A-Za-z_]|$)') OR regexp_matches(lower(t), '{X.SEXAGENARY}') THEN 0.3 WHEN regexp_matches(t, 'nguyên\s+nhân') AND NOT regexp_matches(t, '(^|[^0-9A-Za-z_])[A-ZÀ-Ỹ]') THEN 0.6 ELSE 0.5 END END::DOUBLE AS dense FROM q""")
def _(spark, d):
    q = table(spark, d, "documents").selectExpr("doc_id", f"{_ASKED} AS t", f"{_INTENT} AS i")
    return q.select("doc_id", X.weights(F.col("t"), F.col("i"))["dense"].alias("dense"))


@query("op_x11_hybrid_rrf", f"WITH {HYBRID_SQL} SELECT query, chunk_id, round(score, 6) AS score, rank FROM hybrid WHERE rank <= 10")
def _(spark, d):
    return hybrid(spark, d).select("query", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("op_x12_phrase_match", f"WITH {CHUNKS_SQL}, p AS (SELECT item_id, ' ' || array_to_string(regexp_split_to_array(lower(trim(text)), '[^\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS phrase FROM benchmark), t AS (SELECT chunk_id, ' ' || array_to_string(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS body FROM chunks) SELECT item_id, chunk_id FROM p JOIN t ON contains(body, rtrim(phrase))")
def _(spark, d):
    from quarry.operators.text import phrase_matches

    return phrase_matches(table(spark, d, "benchmark").select("item_id", "text"), chunks(spark, d).select("chunk_id", "content"))


@query("op_x15_balanced_fusion", f"WITH {DENSE_SQL}, {LEXICAL_SQL}, u AS (SELECT query, chunk_id, 0.5 / (60 + rank) AS p FROM dense WHERE rank <= 15 UNION ALL SELECT query, chunk_id, 0.5 / (60 + rank) FROM lexical WHERE rank <= 15) SELECT query, chunk_id, round(sum(p), 6) AS score FROM u GROUP BY ALL")
def _(spark, d):
    return X.fuse([(dense(spark, d, 15), 0.5), (lexical(spark, d, 15), 0.5)]).withColumn("score", F.round("score", 6))


@query("op_x16_causal_expansion", f"WITH {DENSE_SQL}, {LEXICAL_SQL}, u AS (SELECT query, chunk_id, 0.6 / (60 + rank) AS p FROM lexical WHERE rank <= 20 UNION ALL SELECT query, chunk_id, 0.4 / (60 + rank) FROM dense WHERE rank <= 20) SELECT query, chunk_id, round(sum(p), 6) AS score FROM u GROUP BY ALL")
def _(spark, d):
    return X.fuse([(lexical(spark, d, 20), 0.6), (dense(spark, d, 20), 0.4)]).withColumn("score", F.round("score", 6))


GRAPH_SQL = "graph AS (SELECT query, chunk_id, 0.9 * pow(0.6, rank % 3) AS graph_score, rank % 3 + 1 AS hop, rank FROM lexical WHERE rank <= 25 AND chunk_id % 2 = 0)"


def _graph(spark, d) -> DataFrame:
    return lexical(spark, d, 25).filter("chunk_id % 2 = 0").select("query", "chunk_id", F.expr("0.9D * pow(0.6D, rank % 3)").alias("graph_score"), F.expr("rank % 3 + 1").alias("hop"), "rank")


CO_SQL = f"{DENSE_SQL}, {LEXICAL_SQL}, {GRAPH_SQL}, c AS (SELECT query, chunk_id, 1 / (2 - similarity) AS score FROM dense WHERE rank <= 20), co AS (SELECT coalesce(c.query, g.query) AS query, coalesce(c.chunk_id, g.chunk_id) AS chunk_id, round(CASE WHEN c.score IS NOT NULL THEN c.score + CASE WHEN g.rank IS NOT NULL THEN 0.05 * g.graph_score ELSE 0 END ELSE 0.010 * g.graph_score / greatest(1, g.hop) END, 9) AS score, c.score IS NOT NULL AND g.rank IS NOT NULL AS co_retrieved FROM c FULL JOIN graph g ON c.query = g.query AND c.chunk_id = g.chunk_id WHERE c.score IS NOT NULL OR g.rank <= 10)"


@query("op_x17_graph_co_retrieval", f"WITH {CO_SQL} SELECT query, chunk_id, round(score, 6) AS score, co_retrieved FROM co")
def _(spark, d):
    return X.co_retrieved(dense(spark, d, 20).select("query", "chunk_id", "score"), _graph(spark, d)).withColumn("score", F.round("score", 6))


@query("op_x18_rerank_fallback", f"WITH {HYBRID_SQL} SELECT query, chunk_id, round(greatest(0.40, 0.85 - 0.03 * (rank - 1)), 6)::DOUBLE AS score FROM hybrid WHERE rank <= 10")
def _(spark, d):
    return hybrid(spark, d, 10).select("query", "chunk_id", F.round(X.rerank_fallback(), 6).alias("score"))


FINAL_SQL = """final AS (SELECT h.query, h.chunk_id, c.title, length(c.content) AS n, rank, round(greatest(0.40, 0.85 - 0.03 * (rank - 1)) * (1 + 0.2 * CASE c.tier WHEN 'LEVEL_1' THEN 1.0 WHEN 'LEVEL_2' THEN 0.5 ELSE 0.0 END)
 * CASE WHEN q.time_start IS NULL OR c.time_start IS NULL THEN 1.0 ELSE (CASE WHEN g <= 2 THEN 1.1 WHEN g <= 30 THEN 1.0 WHEN g <= 100 THEN 0.85 WHEN g <= 500 THEN 0.7 WHEN g <= 1000 THEN 0.05 ELSE 0.001 END) END + CASE WHEN h.chunk_id % 2 = 0 THEN 0.05 ELSE 0 END, 9) AS score
 FROM hybrid h JOIN chunks c USING (chunk_id) JOIN chunks q ON q.chunk_id = h.query, LATERAL (SELECT CASE WHEN q.time_start BETWEEN c.time_start AND c.time_end THEN 0 ELSE least(abs(q.time_start - c.time_start), abs(q.time_start - c.time_end)) END AS g) WHERE rank <= 10)"""


def final_scores(spark, d) -> DataFrame:
    """Final scores of the hybrid search's chunks; texts are estimated before they are joined, so that they are not shuffled."""
    c = chunks(spark, d).withColumn("tokens", X.token_estimate(F.col("content"), F.col("title"))).drop("content")
    q = c.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query"), F.array_compact(F.array("time_start")).alias("years"))
    h = hybrid(spark, d).select("query", "chunk_id", "rank").join(c, "chunk_id").join(q, "query")
    t = X.temporal_multiplier("years", F.col("time_start"), F.col("time_end"))
    return h.select("query", "chunk_id", "title", "tokens", "rank", F.round(X.bayesian(X.rerank_fallback(), F.col("tier"), t, F.col("chunk_id") % 2 == 0), 9).alias("score"))


@query("op_x19_bayesian_fusion", f"WITH {HYBRID_SQL}, {FINAL_SQL} SELECT query, chunk_id, round(score, 6)::DOUBLE AS score FROM final")
def _(spark, d):
    return final_scores(spark, d).select("query", "chunk_id", F.round("score", 6).alias("score"))


@query("op_x20_temporal_multiplier", f"WITH {CHUNKS_SQL} SELECT chunk_id, CASE WHEN time_start IS NULL THEN 1.0 ELSE (SELECT CASE WHEN g <= 2 THEN 1.1 WHEN g <= 30 THEN 1.0 WHEN g <= 100 THEN 0.85 WHEN g <= 500 THEN 0.7 WHEN g <= 1000 THEN 0.05 ELSE 0.001 END FROM (SELECT least(CASE WHEN 40 BETWEEN time_start AND time_end THEN 0 ELSE least(abs(40 - time_start), abs(40 - time_end)) END, CASE WHEN 1288 BETWEEN time_start AND time_end THEN 0 ELSE least(abs(1288 - time_start), abs(1288 - time_end)) END) AS g)) END::DOUBLE AS factor FROM chunks")
def _(spark, d):
    c = chunks(spark, d).withColumn("years", F.array(F.lit(40), F.lit(1288)))
    return c.select("chunk_id", X.temporal_multiplier("years", F.col("time_start"), F.col("time_end")).alias("factor"))


@query("op_x21_entity_chunks", "WITH ec AS (SELECT DISTINCT l_partkey AS entity, l_orderkey AS chunk FROM lineitem) SELECT entity, chunk FROM ec JOIN orders ON chunk = o_orderkey QUALIFY row_number() OVER (PARTITION BY entity ORDER BY abs(year(o_orderdate) - 1995), CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, chunk) <= 6")
def _(spark, d):
    ec = table(spark, d, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("chunk")).distinct()
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk"), "o_orderdate", "o_orderstatus")
    status = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return top_per(ec.join(o, "chunk"), ["entity"], [F.abs(F.year("o_orderdate") - 1995), status, F.col("chunk")], 6).select("entity", "chunk")


@query("op_x22_context_selection")
def _(spark, d):
    ranked = top_per(final_scores(spark, d), ["query"], [F.desc("score"), F.col("chunk_id")], 20, "place").drop("rank").withColumnRenamed("place", "rank")
    return X.select_context(ranked.select("query", "chunk_id", "rank", "score", F.col("title").alias("source"), "tokens"))


@query("op_x23_sibling_stitching")
def _(spark, d):
    c = chunks(spark, d).filter("parent_id is not null").select("parent_id", F.expr("chunk_id % 10").alias("idx"), "content")
    return X.stitch(c)


@query("op_x24_context_assembly", f"WITH {HYBRID_SQL} SELECT query, md5(string_agg('[' || title || '] ' || left(content, 1200), chr(10) ORDER BY CASE WHEN rank = 1 THEN 0 WHEN rank = 2 THEN 99 ELSE rank END)) AS digest FROM hybrid JOIN chunks USING (chunk_id) WHERE rank <= 10 GROUP BY query")
def _(spark, d):
    # Lines are cut before the join, so that texts are not shuffled as a whole.
    lines = chunks(spark, d).select("chunk_id", F.concat(F.lit("["), "title", F.lit("] "), F.expr("left(content, 1200)")).alias("line"))
    h = hybrid(spark, d).join(lines, "chunk_id")
    place = F.when(F.col("rank") == 1, 0).when(F.col("rank") == 2, 99).otherwise(F.col("rank"))
    g = h.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), "line"))).alias("parts"))
    return g.select("query", F.md5(F.array_join("parts.line", "\n").cast("binary")).alias("digest"))


@query("op_x25_triple_pruning", f"WITH {EDGES_SQL}, t AS (SELECT tgt AS query, src, rel, tgt, confidence, CASE WHEN CAST(o_orderkey AS BIGINT) % 4 = 0 THEN 100 ELSE 10 END AS priority FROM edges JOIN orders ON src = 'event_' || o_orderkey WHERE rel = 'LED_BY') SELECT query, src, CAST(priority AS INT) AS priority FROM t QUALIFY row_number() OVER (PARTITION BY query ORDER BY priority DESC, confidence DESC, src, rel, tgt) <= 15")
def _(spark, d):
    t = edges(spark, d).filter("rel = 'LED_BY'").withColumn("query", F.col("tgt"))
    bridges = table(spark, d, "orders").filter("o_orderkey % 4 = 0").selectExpr("concat('event_', o_orderkey) AS node", "concat('person_', o_custkey) AS query")
    return X.prune_triples(t, bridges, ["query"]).select("query", "src", "priority")


@query("op_x26_history_pruning", """WITH t AS (SELECT conv_id, turn, least(250, CAST(ceil(length(text) / 3.5) AS BIGINT)) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
 s AS (SELECT conv_id, turn, n, CAST(sum(CASE WHEN n = 1 THEN 0 ELSE cost END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) + max(CASE WHEN n = 1 THEN cost ELSE 0 END) OVER (PARTITION BY conv_id) AS spent FROM t) SELECT conv_id, turn FROM s WHERE n = 1 OR spent <= 800""")
def _(spark, d):
    from quarry.operators.text import prune_history

    return prune_history(table(spark, d, "conversations")).select("conv_id", "turn")


@query("op_x27_prompt_clamp", "SELECT conv_id, turn, CASE WHEN length(text) > 875 THEN left(text, 875) || '...' ELSE text END AS clamped FROM conversations")
def _(spark, d):
    from quarry.operators.text import clamp

    return table(spark, d, "conversations").select("conv_id", "turn", clamp(F.col("text"), 250).alias("clamped"))


@query("op_j17_claim_argmax", f"WITH {LEXICAL_SQL} SELECT query, chunk_id AS best, score FROM lexical WHERE rank = 1")
def _(spark, d):
    return lexical(spark, d, 1).select("query", F.col("chunk_id").alias("best"), F.col("score").cast("long").alias("score"))


@query("op_m15_rrf_sweep", f"WITH {DENSE_SQL}, {LEXICAL_SQL}, ks(k) AS (VALUES (20), (40), (60), (80), (100)), u AS (SELECT k, query, chunk_id, 0.5 / (k + rank) AS p FROM dense, ks WHERE rank <= 15 UNION ALL SELECT k, query, chunk_id, 0.5 / (k + rank) FROM lexical, ks WHERE rank <= 15), f AS (SELECT k, query, chunk_id, round(sum(p), 9) AS s FROM u GROUP BY ALL) SELECT k, query, chunk_id FROM f QUALIFY row_number() OVER (PARTITION BY k, query ORDER BY s DESC, chunk_id) <= 5")
def _(spark, d):
    ks = F.explode(F.array(*map(F.lit, (20, 40, 60, 80, 100)))).alias("k")
    u = dense(spark, d, 15).select("query", "chunk_id", "rank").unionByName(lexical(spark, d, 15).select("query", "chunk_id", "rank")).select("*", ks)
    f = u.groupBy("k", "query", "chunk_id").agg(F.round(F.sum(0.5 / (F.col("k") + F.col("rank"))), 9).alias("s"))
    return top_per(f, ["k", "query"], [F.desc("s"), F.col("chunk_id")], 5).select("k", "query", "chunk_id")
