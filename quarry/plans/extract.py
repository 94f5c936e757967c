"""Queries of pairs of names and the relations that the words between them tell, over whole documents. The names are those in all items; rules have words of the given languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import extract as E
from quarry.operators import names as N
from quarry.plans.base import table
from quarry.plans.registry import query
from quarry.plans.search import _PLAIN, _TYPES, NAMES
from quarry.plans.years import _dictionary

_RULES = (
    E.Relation("LED_BY", (N.EVENT, N.WORK), (N.PERSON, N.ERA), 75, r"\p{L}{1,3}", behind=True),
    E.Relation("LED_BY", (N.PLACE,), (N.PERSON,), 90, "in|that|les|que|die", 0.9, but="and|zu", across=True),
    E.Relation("HAPPENED_AT", (N.PERSON, N.EVENT, N.ERA), (N.PLACE,), 110, r"\p{L}{2,4}", but="der|les|to"),
    E.Relation("MENTIONED_IN", (N.PERSON, N.ERA, N.PLACE), (N.WORK,), 120, r"of|the|\p{L}{4}", bare=True, across=True),
    E.Relation("HAPPENED_IN", (N.EVENT, N.WORK), (N.ERA,), 120, r"\p{L}{2}", 0.95, across=True),
    E.Relation("ALIAS_OF", (N.PERSON,), (N.PERSON,), 60, r"\p{L}+", 1.0, either=False),
)
_MOST = max(r.most for r in _RULES)
_NEAR_SQL = rf"""n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{NAMES}', 1)) AS name FROM benchmark), f AS (SELECT lower(name) AS id, ascii(lower(name)) AS ord, unnest([lower(name), lower({_PLAIN.format('name')})]) AS form FROM n),
 k AS (SELECT form, arg_min(id, (-ord, id)) AS id FROM f GROUP BY form), p0 AS (SELECT doc_id, text, unnest(l) AS part, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, text, string_split(text, ' ') AS l FROM documents)),
 p AS (SELECT *, sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(part) - 1 AS pos, lead(part) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM p0),
 b AS (SELECT doc_id, text, pos, length(part) AS n, regexp_extract(part, '[\p{{L}}\p{{N}}]+$') AS x, regexp_extract(after, '^[\p{{L}}\p{{N}}]+') AS y FROM p),
 s AS (SELECT doc_id, text, CAST(pos + n - length(x) AS INT) AS s, CAST(pos + n + 1 + length(y) AS INT) AS e, id, list_value({", ".join(f"'{t}'" for t in _TYPES)})[ascii(id) % 5 + 1] AS type FROM b JOIN k ON form = lower(x) || ' ' || lower(y)),
 near AS MATERIALIZED (SELECT a.doc_id, a.s AS a_start, a.id AS a_id, a.type AS a_type, c.s AS b_start, c.id AS b_id, c.type AS b_type, substr(a.text, a.e + 1, c.s - a.e) AS gap, substr(a.text, c.e + 1, 35) AS after FROM s a JOIN s c ON a.doc_id = c.doc_id AND c.s BETWEEN a.e AND a.e + {_MOST})"""


def _has(c: str, words: str) -> str:
    return rf"regexp_matches(lower({c}), '(?:^|[^\p{{L}}\p{{N}}])(?:{words})(?:[^\p{{L}}\p{{N}}]|$)')"


def _fits_sql(r: E.Relation, source: str, target: str) -> str:
    types = lambda t: "(" + ", ".join(f"'{x}'" for x in t) + ")"
    told = [_has("gap", r.words), *([r"regexp_matches(gap, '^\s*,?\s*$')"] if r.bare else []), *([_has("after", r.words)] if r.behind and source == "a" else [])]
    return f"({source}_type IN {types(r.source)} AND {target}_type IN {types(r.target)} AND length(gap) <= {r.most} AND ({' OR '.join(told)}) AND a_id <> b_id" + ("" if r.across else r" AND NOT regexp_matches(gap, '[.\n]')") + (f" AND NOT {_has('gap', r.but)}" if r.but else "") + ")"


def _relation_sql(name: str) -> str:
    cases = [(_fits_sql(r, *way), way, r.confidence) for r in _RULES if r.name == name for way in ([("a", "b"), ("b", "a")] if r.either else [("a", "b")])]
    pick = lambda of: "CASE " + " ".join(f"WHEN {c} THEN {of(way, conf)}" for c, way, conf in cases) + " END"
    return f"SELECT doc_id, {pick(lambda w, c: w[0] + '_id')} AS src, '{name}' AS rel, {pick(lambda w, c: w[1] + '_id')} AS tgt, {pick(lambda w, c: c)}::DOUBLE AS confidence FROM near"


@query("op_j15_near_names", f"WITH {_NEAR_SQL} SELECT doc_id, a_start, a_id, b_start, b_id, md5(gap) AS gap FROM near")
def _(spark, d):
    pairs = N.near_names(table(spark, d, "documents"), _dictionary(spark, d), (), _MOST)
    return pairs.select("doc_id", "a_start", "a_id", "b_start", "b_id", F.md5(F.col("gap").cast("binary")).alias("gap"))


@query("op_p38_extracted_triples", f"WITH {_NEAR_SQL}, t AS ({' UNION ALL '.join(map(_relation_sql, dict.fromkeys(r.name for r in _RULES)))}) SELECT doc_id, src, rel, tgt, max(confidence) AS confidence FROM t WHERE src IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return E.extracted_triples(table(spark, d, "documents").select("doc_id", "text"), _dictionary(spark, d), _RULES, ())
