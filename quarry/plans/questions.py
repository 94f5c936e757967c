"""Queries over references across turns and over the premises of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import references as R
from quarry.plans.base import table
from quarry.plans.registry import query

#: Names in turns: a capitalised word and the next one; their length gives the kind.
_NAMED = r"\p{Lu}\p{Ll}+ \p{L}+"
_KINDS = [R.PERSON, R.ADVERSARY, R.WORK, R.PLACE]


def _mentions(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(_NAMED), F.lit(0))).alias("start", "name"))
    return t.withColumn("kind", F.element_at(F.array(*map(F.lit, _KINDS)), F.length("name") % 4 + 1))


@query("op_p33_salience", rf"""WITH m AS (SELECT conv_id, turn, role, name, len(name) % 4 AS kind, start FROM (SELECT conv_id, turn, role, unnest(regexp_extract_all(text, '{_NAMED}')) AS name, generate_subscripts(regexp_extract_all(text, '{_NAMED}'), 1) AS start FROM conversations)),
 u AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'),
 late AS (SELECT u.conv_id, u.turn, c.turn AS at FROM u JOIN conversations c ON c.conv_id = u.conv_id AND c.turn < u.turn AND c.role = 'assistant' QUALIFY row_number() OVER (PARTITION BY u.conv_id, u.turn ORDER BY c.turn DESC) <= 2),
 seen AS (SELECT u.conv_id, u.turn, name, kind, m.turn * 1000000 + start AS o FROM u JOIN m ON m.conv_id = u.conv_id AND m.turn < u.turn AND m.role = 'user' UNION ALL SELECT l.conv_id, l.turn, name, kind, 1000000000000 + m.turn * 1000000 + start FROM late l JOIN m ON m.conv_id = l.conv_id AND m.turn = l.at),
 f AS (SELECT conv_id, turn, kind, name, min(o) AS o FROM seen GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, kind ORDER BY o) AS n FROM f),
 w AS (SELECT conv_id, turn, max(CASE WHEN kind = 0 AND n = 1 THEN name END) AS person, max(CASE WHEN kind = 0 AND n = 2 THEN name END) AS second, max(CASE WHEN kind = 1 AND n = 1 THEN name END) AS foe, max(CASE WHEN kind = 2 AND n = 1 THEN name END) AS work, max(CASE WHEN kind = 3 AND n = 1 THEN name END) AS place FROM r GROUP BY ALL)
 SELECT u.conv_id, u.turn, person, second, foe, work, place, coalesce(person, foe, work, place) AS subject, EXISTS (SELECT 1 FROM m WHERE m.conv_id = u.conv_id AND m.turn = u.turn) AS named FROM u LEFT JOIN w USING (conv_id, turn)""")
def _(spark, d):
    return R.salient(table(spark, d, "conversations"), _mentions(spark, d))


@query("op_p33_rewritten_turns")
def _(spark, d):
    return R.rewritten(table(spark, d, "conversations"), _mentions(spark, d))


#: Questions about customers: descent from another, two names of one, a realm, a boast, an anachronism or nothing; some are denied.
_TEXT = "concat(CASE (c_custkey + 1) % 6 WHEN 0 THEN 'is it a child of' WHEN 1 THEN 'a child of' WHEN 2 THEN 'are they two who fought' WHEN 3 THEN 'was in the realm of' WHEN 4 THEN 'my own ancestor' ELSE CASE WHEN (c_custkey + 1) % 4 = 1 THEN 'a king in an aeroplane' ELSE 'an aeroplane' END END, CASE WHEN (c_custkey + 1) % 5 = 0 THEN ' never' ELSE '' END)"
_QUESTIONS = f"SELECT (c_custkey + 1) AS k, (c_custkey + 1) % 6 AS v, {_TEXT} AS text FROM customer"
_PATTERNS = R.PATTERNS | {"kin": "child", "deed": "fought", "realm": "realm", "denied": "never", "flattery": "my own ancestor", "modern": "aeroplane", "old": "king"}


@query("op_v08_premises", f"""WITH q AS ({_QUESTIONS}), kin AS (SELECT (c_custkey + 1) AS a, 2 * (c_custkey + 1) AS b FROM customer WHERE (c_custkey + 1) % 4 <> 2), turned AS (SELECT a, b FROM kin UNION SELECT b, a FROM kin),
 j AS (SELECT k, v, text, contains(text, 'never') AS denied, CASE v WHEN 0 THEN 2 * k WHEN 1 THEN 2 * k + 1 END AS other FROM q),
 e AS (SELECT j.*, CASE WHEN v <= 1 THEN EXISTS (SELECT 1 FROM turned t WHERE t.a = k AND t.b = other) WHEN v = 3 THEN k % 2 = 1 AND (k % 5) = (k % 3) ELSE false END AS hit, CASE WHEN v <= 1 THEN EXISTS (SELECT 1 FROM turned t WHERE t.a = k) WHEN v = 3 THEN k % 2 = 1 ELSE false END AS others FROM j)
 SELECT k AS question_id, CASE v WHEN 0 THEN 'KINSHIP' WHEN 1 THEN 'KINSHIP' WHEN 2 THEN 'SAME_PERSON_DEED' WHEN 3 THEN 'REALM' WHEN 4 THEN 'FLATTERY' ELSE CASE WHEN contains(text, 'king') THEN 'ANACHRONISM' ELSE 'NONE' END END AS kind,
  CASE WHEN v IN (2, 4) THEN 'CORRECT_IT' WHEN v = 5 THEN CASE WHEN contains(text, 'king') THEN 'CORRECT_IT' ELSE 'NONE' END WHEN hit THEN CASE WHEN denied THEN 'CONTRADICTED' ELSE 'SUPPORTED' END WHEN others THEN CASE WHEN denied THEN 'SUPPORTED' ELSE 'CONTRADICTED' END ELSE 'UNKNOWN' END AS verdict,
  CASE WHEN v = 5 AND NOT contains(text, 'king') THEN NULL WHEN v IN (2, 4, 5) THEN 'pattern' WHEN hit THEN 'edge' WHEN others THEN 'other edges' ELSE 'no edge' END AS reason,
  CASE WHEN v IN (0, 1, 3) THEN 'person_' || k END AS src, CASE WHEN v IN (0, 1) THEN 'person_' || other WHEN v = 3 THEN 'dynasty_' || k % 3 END AS tgt FROM e""")
def _(spark, d):
    c = table(spark, d, "customer").selectExpr("(c_custkey + 1) AS k", "(c_custkey + 1) % 6 AS v")
    one = c.selectExpr("k AS question_id", "0 AS start", "concat('P', k) AS name", "concat('person_', k) AS entity_id", f"'{R.PERSON}' AS type")
    more = c.filter("v <= 3").selectExpr("k AS question_id", "9 AS start", "CASE v WHEN 0 THEN concat('P', 2 * k) WHEN 1 THEN concat('P', 2 * k + 1) WHEN 2 THEN concat('Also', k) ELSE concat('D', k % 3) END AS name", "CASE v WHEN 0 THEN concat('person_', 2 * k) WHEN 1 THEN concat('person_', 2 * k + 1) WHEN 2 THEN concat('person_', k) ELSE concat('dynasty_', k % 3) END AS entity_id", f"CASE WHEN v = 3 THEN '{R.ERA}' ELSE '{R.PERSON}' END AS type")
    kin = c.filter("k % 4 <> 2").selectExpr("concat('person_', k) AS src", "'ROYAL_LINEAGE' AS rel", "concat('person_', 2 * k) AS tgt")
    realm = c.filter("k % 2 = 1").selectExpr("concat('person_', k) AS src", "'PART_OF' AS rel", "concat('dynasty_', k % 5) AS tgt")
    questions = table(spark, d, "customer").selectExpr("(c_custkey + 1) AS question_id", f"{_TEXT} AS text")
    return R.premises(questions, one.unionByName(more), kin.unionByName(realm), _PATTERNS)
