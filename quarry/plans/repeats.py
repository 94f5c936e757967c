"""Queries over texts that repeat themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.plans.base import table
from quarry.plans.registry import query
from quarry.streaming import repeats as R

_LONG = "length({0}) >= 60 AND NOT (regexp_matches({0}, '^(?:#{{1,6}}|\\*{{2}}|-\\s*\\*{{2}})') AND length({0}) < 120)"
_SHOWN = "regexp_replace(lower({0}), '[.,!?:;\\s]+', ' ', 'g')"


#: A document's lines, four times over for some, so that paragraphs come often enough.
@query("op_r01_repeats", f"""WITH l AS (SELECT doc_id AS stream, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS seq FROM (SELECT doc_id, string_split(CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || text || chr(10) || text || chr(10) || text ELSE text END, chr(10)) AS s FROM documents)),
 t AS (SELECT stream, seq, trim(line, ' ') AS text FROM l),
 a AS (SELECT stream, seq, 0 AS o FROM (SELECT stream, seq, {_SHOWN.format('text')} AS k, lag({_SHOWN.format('text')}) OVER w AS k1, lag({_SHOWN.format('text')}, 2) OVER w AS k2 FROM t WHERE length(text) >= 25 WINDOW w AS (PARTITION BY stream ORDER BY seq)) WHERE k = k1 AND k = k2),
 p AS (SELECT stream, seq, 1 AS o FROM t WHERE {_LONG.format('text')} QUALIFY row_number() OVER (PARTITION BY stream, {_SHOWN.format('text')} ORDER BY seq) > 3),
 u AS (SELECT stream, seq, trim(unnest(x), ' ') AS text, generate_subscripts(x, 1) AS place FROM (SELECT stream, seq, string_split(regexp_replace(text, '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS x FROM t)),
 s AS (SELECT stream, seq, 2 AS o FROM u WHERE {_LONG.format('text')} QUALIFY row_number() OVER (PARTITION BY stream, {_SHOWN.format('text')} ORDER BY seq, place) > 3),
 h AS (SELECT * FROM a UNION ALL SELECT * FROM p UNION ALL SELECT * FROM s)
 SELECT stream, min(seq) AS seq, ['LINE', 'PARAGRAPH', 'SENTENCE'][CAST(arg_min(o, seq * 3 + o) AS INT) + 1] AS verdict FROM h GROUP BY stream""")
def _(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("\n", "text", "text", "text", "text")).otherwise(F.col("text"))
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("stream"), F.posexplode(F.split(text, "\n")).alias("seq", "line"))
    return R.repeats_in_batch(lines)
