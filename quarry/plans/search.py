"""Queries over the positional index: enhanced queries, phrases, unaccented terms and cover density. Queries are all benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import index as I
from quarry.operators import names as N
from quarry.operators import retrieval as X
from quarry.plans.base import CHUNKS_SQL, POSTINGS_SQL, chunks, table
from quarry.plans.registry import query
from quarry.plans.retrieval import TERMS_SQL, _terms

#: The names in an item are the two words that begin a sentence; those with one first letter are names of one entity.
NAMES = r"[.]\s+(\p{L}+ \p{L}+)"
_PLAIN = "replace(replace(strip_accents({0}), 'đ', 'd'), 'Đ', 'D')"
_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= {1})"
CLAUSES_SQL = f"""q AS (SELECT item_id AS query, text FROM benchmark),
 base AS (SELECT DISTINCT query, unnest(list_concat({_WORDS.format('text', 2)}, {_WORDS.format(_PLAIN.format('text'), 2)})) AS clause FROM q),
 mentions AS (SELECT query, substr(lower(name), 1, 1) AS entity, place, lower(trim(name)) AS name FROM (SELECT query, unnest(regexp_extract_all(text, '{NAMES}', 1)) AS name, generate_subscripts(regexp_extract_all(text, '{NAMES}', 1), 1) - 1 AS place FROM q)),
 named AS (SELECT * FROM mentions QUALIFY row_number() OVER (PARTITION BY query, name ORDER BY entity, place) = 1),
 forms AS (SELECT query, entity, place, array_to_string({_WORDS.format('name', 1)}, ' ') AS clean, array_to_string({_WORDS.format(_PLAIN.format('name'), 1)}, ' ') AS plain FROM named),
 looked AS (SELECT *, contains(plain, ' ') AS long FROM forms QUALIFY coalesce(sum(CASE WHEN contains(plain, ' ') THEN 1 ELSE 0 END) OVER (PARTITION BY query, entity ORDER BY place, clean ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 4),
 phrases AS (SELECT query, plain AS clause FROM looked WHERE long UNION SELECT query, clean FROM looked WHERE long),
 parts AS (SELECT query, unnest(list_concat(string_split(clean, ' '), string_split(plain, ' '))) AS clause FROM looked),
 clauses AS (SELECT * FROM phrases UNION SELECT * FROM base WHERE query NOT IN (SELECT query FROM phrases) OR NOT EXISTS (SELECT 1 FROM parts p WHERE p.query = base.query AND p.clause = base.clause))"""
#: Where a clause of one word or two occurs.
PLACES_SQL = f"""tokens AS MATERIALIZED (SELECT chunk_id, unnest(l) AS token, generate_subscripts(l, 1) AS pos FROM (SELECT chunk_id, list_concat({_WORDS.format('title', 1)}, {_WORDS.format('content', 1)}) AS l FROM chunks)),
 one AS (SELECT query, chunk_id, pos AS a, pos AS b FROM clauses JOIN tokens ON clause = token),
 two AS (SELECT query, s.chunk_id, s.pos AS a, t.pos AS b FROM clauses JOIN tokens s ON s.token = split_part(clause, ' ', 1) JOIN tokens t ON t.chunk_id = s.chunk_id AND t.pos = s.pos + 1 AND t.token = split_part(clause, ' ', 2) WHERE contains(clause, ' '))"""


def _clauses(spark, d) -> DataFrame:
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    found = q.select("query", F.posexplode(F.regexp_extract_all("text", F.lit(NAMES), F.lit(1))).alias("place", "name"))
    return I.enhanced_query(q, found.withColumn("entity", F.substring(F.lower("name"), 1, 1)))


def _index(spark, d) -> DataFrame:
    boost = F.when(F.col("tier") == "LEVEL_1", X.TIER_BOOST).otherwise(1.0) * F.when(F.col("parent_id").isNotNull(), X.CHILD_BOOST).otherwise(1.0)
    return I.build_index(chunks(spark, d), 1, boost)


@query("op_x07_enhanced_query", f"WITH {CLAUSES_SQL} SELECT query, clause FROM clauses")
def _(spark, d):
    return _clauses(spark, d)


@query("op_f07_phrase_match", f"WITH {CHUNKS_SQL}, {CLAUSES_SQL}, {PLACES_SQL} SELECT DISTINCT query, chunk_id FROM two")
def _(spark, d):
    phrases = _clauses(spark, d).filter(F.contains("clause", F.lit(" "))).withColumn("group", F.lit(0))
    return I.cover_density(_index(spark, d), phrases, None).select("query", "chunk_id")


@query("op_x08_cover_density", f"""WITH {CHUNKS_SQL}, {CLAUSES_SQL}, {PLACES_SQL},
 covers AS (SELECT * FROM one UNION SELECT * FROM two WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.query = two.query AND one.chunk_id = two.chunk_id AND one.a BETWEEN two.a AND two.b)),
 n AS (SELECT query, chunk_id, count(*) AS n FROM covers GROUP BY ALL),
 s AS (SELECT query, chunk_id, round(0.1 * n * CASE WHEN tier = 'LEVEL_1' THEN 1.35 ELSE 1.0 END * CASE WHEN parent_id IS NOT NULL THEN 1.15 ELSE 1.0 END, 9)::DOUBLE AS score FROM n JOIN chunks USING (chunk_id))
 SELECT query, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 20""")
def _(spark, d):
    found = I.cover_density(_index(spark, d), _clauses(spark, d).withColumn("group", F.lit(0)), 20)
    return found.select("query", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("op_x09_unaccented_top_k", f"""WITH {CHUNKS_SQL}, {POSTINGS_SQL}, {TERMS_SQL},
 h AS (SELECT DISTINCT {_PLAIN.format('token')} AS token, chunk_id, 1 AS points FROM postings UNION SELECT DISTINCT {_PLAIN.format('token')}, chunk_id, 2 FROM titles),
 s AS (SELECT query, chunk_id, sum(points)::DOUBLE AS score FROM (SELECT DISTINCT query, {_PLAIN.format('term')} AS term FROM terms) JOIN h ON term = token GROUP BY ALL)
 SELECT query, chunk_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 20""")
def _(spark, d):
    found = I.term_points(I.build_index(chunks(spark, d), positions=False), _terms(spark, d), 20, plain=True)
    return found.withColumn("rank", F.col("rank").cast("long"))


# -- names: the dictionary are the names in all items; their first letters tell the types apart
_TYPES = [N.PERSON, N.PLACE, N.EVENT, N.ERA, N.WORK]


def _dictionary(spark, d) -> DataFrame:
    found = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(NAMES), F.lit(1))).alias("name")).distinct()
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.ascii(F.lower("name")) % len(_TYPES) + 1).cast("int"))
    return found.select(F.xxhash64("name").alias("ord"), F.lower("name").alias("id"), F.col("name").alias("canonical"), "name", kind.alias("type"))


@query("op_j14_dictionary_entities", rf"""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{NAMES}', 1)) AS name FROM benchmark),
 f AS (SELECT DISTINCT lower(name) AS id, unnest([lower(name), lower({_PLAIN.format('name')})]) AS form FROM n),
 g AS (SELECT form, coalesce(max(CASE WHEN form = id THEN id END), min(id)) AS id FROM f GROUP BY form),
 p AS (SELECT doc_id, unnest(l) AS part, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(lower(text), ' ') AS l FROM documents)),
 b AS (SELECT doc_id, regexp_extract(part, '[\p{{L}}\p{{N}}]+$') || ' ' || regexp_extract(lead(part) OVER (PARTITION BY doc_id ORDER BY i), '^[\p{{L}}\p{{N}}]+') AS form FROM p)
 SELECT DISTINCT doc_id, id AS entity_id FROM b JOIN g USING (form)""")
def _(spark, d):
    return N.dictionary_entities(table(spark, d, "documents").select("doc_id", "text"), _dictionary(spark, d))


@query("op_p18_layered_names")
def _(spark, d):
    return N.layered_names(table(spark, d, "documents").select("doc_id", "text"), _dictionary(spark, d)).select("doc_id", "start", "end", "name", "type", "layer", "entity_id", "enclosed")
