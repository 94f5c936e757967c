"""Queries over scanned text: page structure and torn syllables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import pages as P
from quarry.operators.syllables import heal
from quarry.plans.base import table
from quarry.plans.registry import query

_KEY = "regexp_replace(lower({0}), '\\d+', '#', 'g')"


#: The documents of one parent are the pages of a book.
@query("op_s07_structured_pages", rf"""WITH p AS (SELECT doc_id - doc_id % 10 AS doc, doc_id AS page, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM documents),
 l AS (SELECT doc, page, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i, len(lines) AS n FROM p), k AS (SELECT *, {_KEY.format('line')} AS key FROM l),
 e AS (SELECT DISTINCT doc, page, 'T' AS side, key FROM k WHERE i < 2 UNION SELECT DISTINCT doc, page, 'B', key FROM k WHERE i >= n - 2),
 r AS (SELECT doc, side, key FROM (SELECT doc, side, key, count(*) AS n FROM e GROUP BY ALL) JOIN (SELECT doc, count(DISTINCT page) AS pages FROM p GROUP BY doc) USING (doc) WHERE n >= 3 AND n >= 0.5 * pages),
 t AS (SELECT *, i < 2 AND (EXISTS (SELECT 1 FROM r WHERE r.doc = k.doc AND side = 'T' AND r.key = k.key) OR (i = 0 AND regexp_matches(line, '(?i)^(?:trang|page)\s+\d+'))) AS top FROM k),
 s AS (SELECT *, i >= n - 2 AND NOT top AND (EXISTS (SELECT 1 FROM r WHERE r.doc = t.doc AND side = 'B' AND r.key = t.key) OR (i = n - 1 AND regexp_matches(line, '^\d+$'))) AS foot FROM t)
 SELECT p.page, count(*) FILTER (top) AS headers, count(*) FILTER (foot) AS footers, count(*) FILTER (NOT top AND NOT foot AND (regexp_matches(line, '{P.HEADING.replace("(?iu)", "(?i)")}') OR regexp_matches(line, '{P.CAPITALS}'))) AS headings,
  md5(coalesce(string_agg(CASE WHEN NOT top AND NOT foot THEN line END, chr(10) ORDER BY i), '')) AS content FROM p LEFT JOIN s USING (page) GROUP BY p.page""")
def _(spark, d):
    pages = table(spark, d, "documents").select((F.col("doc_id") - F.col("doc_id") % 10).alias("doc"), F.col("doc_id").alias("page"), F.col("text").alias("content"))
    size = lambda c: F.size(c).cast("long").alias(c + "s" if c != "headings" else c)
    return P.structured_pages(pages).select("page", size("header"), size("footer"), size("headings"), F.md5(F.col("content").cast("binary")).alias("content"))


@query("op_p06_syllable_lexicon")
def _(spark, d):
    return heal(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text"))


@query("op_p14_sections")
def _(spark, d):
    from quarry.operators.chunker import chunk_sections

    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("realm"), "text")
    return chunk_sections(docs).select("chunk_id", "doc_id", "parent_chunk_id", "section", "first_word", "n_words", F.md5(F.col("content").cast("binary")).alias("content"))
