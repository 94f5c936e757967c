"""How the given tables stand in for chunks, entities and the edge list, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CHUNK_COLUMNS = """doc_id AS chunk_id, text AS content, source AS title, lang AS dynasty,
 CASE doc_id % 3 WHEN 0 THEN 'LEVEL_1' WHEN 1 THEN 'LEVEL_2' ELSE 'LEVEL_3' END AS tier,
 CASE WHEN doc_id % 10 <> 0 THEN doc_id - doc_id % 10 END AS parent_id,
 CASE WHEN doc_id % 7 <> 0 THEN CAST(-3000 + (doc_id * 37) % 5100 AS INT) END AS time_start,
 CASE WHEN doc_id % 7 <> 0 THEN CAST(-3000 + (doc_id * 37) % 5100 + doc_id % 90 AS INT) END AS time_end"""
CHUNKS_SQL = f"chunks AS (SELECT {CHUNK_COLUMNS} FROM documents)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks: every document, with tier, parent and years derived from its id."""
    return table(spark, sf_dir, "documents").selectExpr(*[c.strip() for c in _split(CHUNK_COLUMNS)])


def _split(columns: str) -> list[str]:
    """Select-list items at the top level."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[at:i])
            at = i + 1
    return [*out, columns[at:]]


#: (source table, source, relation, target, confidence in per cent)
_EDGES = [
    ("orders", "'event_' || o_orderkey", "LED_BY", "'person_' || o_custkey", "30 + (o_orderkey * 7919) % 70"),
    ("customer", "'person_' || c_custkey", "PART_OF", "'loc_' || c_nationkey", "30 + (c_custkey * 31) % 70"),
    ("nation", "'loc_' || n_nationkey", "PART_OF", "'dynasty_' || n_regionkey", "90"),
    ("(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)", "'artifact_' || l_partkey", "MENTIONED_IN", "'doc_' || l_suppkey", "30 + (l_partkey * 17 + l_suppkey) % 70"),
]
_NODES = [("orders", "'event_' || o_orderkey", "o_orderpriority", "event"), ("customer", "'person_' || c_custkey", "c_name", "person"), ("nation", "'loc_' || n_nationkey", "n_name", "location"), ("region", "'dynasty_' || r_regionkey", "r_name", "dynasty"), ("part", "'artifact_' || p_partkey", "p_name", "artifact"), ("supplier", "'doc_' || s_suppkey", "s_name", "document")]
EDGES_SQL = "edges AS (" + " UNION ALL ".join(f"SELECT {s} AS src, '{r}' AS rel, {t} AS tgt, CAST({c} AS DOUBLE) / 100 AS confidence FROM {f}" for f, s, r, t, c in _EDGES) + ")"
NODES_SQL = "nodes AS (" + " UNION ALL ".join(f"SELECT {i} AS id, {n} AS name, '{t}' AS type FROM {f}" for f, i, n, t in _NODES) + ")"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, rel, tgt, confidence): the edge list."""
    out = None
    for f, s, r, t, c in _EDGES:
        df = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct() if "lineitem" in f else table(spark, sf_dir, f)
        df = df.selectExpr(f"{s} AS src", f"'{r}' AS rel", f"{t} AS tgt", f"CAST({c} AS DOUBLE) / 100 AS confidence")
        out = df if out is None else out.unionByName(df)
    return out


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, type): the entities."""
    out = None
    for f, i, n, t in _NODES:
        df = table(spark, sf_dir, f).selectExpr(f"{i} AS id", f"{n} AS name", f"'{t}' AS type")
        out = df if out is None else out.unionByName(df)
    return out


#: Lower-cased words of three letters or more, as both engines split them.
TOKENS = "filter(split(lower(content), '[^\\\\p{L}\\\\p{N}]+'), x -> length(x) >= 3)"
TOKENS_SQL = "list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 3)"


def postings(chunk_rows: DataFrame) -> DataFrame:
    """(token, chunk_id, tf): the inverted index of ``content``."""
    words = chunk_rows.select("chunk_id", F.explode(F.expr(TOKENS)).alias("token"))
    return words.groupBy("token", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))


def occurrences(chunk_rows: DataFrame, column: str = "content") -> DataFrame:
    """(token, chunk_id): which chunks have a token in ``column``, without counts and so without a shuffle."""
    return chunk_rows.select("chunk_id", F.explode(F.expr(f"array_distinct({TOKENS.replace('content', column)})")).alias("token"))


TITLES_SQL = f"titles AS (SELECT DISTINCT chunk_id, unnest({TOKENS_SQL.replace('content', 'title')}) AS token FROM chunks)"
POSTINGS_SQL = f"postings AS (SELECT token, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest({TOKENS_SQL}) AS token FROM chunks) GROUP BY ALL)"
