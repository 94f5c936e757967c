"""Queries over texts, sources, metrics and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import evaluation as E
from quarry.operators import text as O
from quarry.operators.graph import staged
from quarry.plans.base import table
from quarry.plans.registry import query
from quarry.plans.retrieval import DENSE_SQL, dense
from quarry.sources import documents as S
from quarry.streaming import state as R

STOPWORDS = ["the", "and", "was", "der", "die", "das", "les", "que", "con", "los"]
STOP_SQL = ", ".join(map(repr, STOPWORDS))


def _docs(spark, d):
    return table(spark, d, "documents")


# -- sources
@query("op_s02_front_matter", "SELECT doc_id, source AS title, lang AS dynasty, md5(text) AS body FROM documents")
def _(spark, d):
    raw = S.as_markdown(["title", "Dynasty", "text"], "text")
    m = _docs(spark, d).select("doc_id", F.concat(F.lit('"'), "source", F.lit('"')).alias("title"), F.col("lang").alias("Dynasty"), "text").select("doc_id", S.front_matter(raw).alias("m"))
    return m.select("doc_id", F.col("m.metadata")["title"].alias("title"), F.col("m.metadata")["dynasty"].alias("dynasty"), F.md5(F.col("m.body").cast("binary")).alias("body"))


@query("op_s03_json_document", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN md5('not json') ELSE md5(text) END AS content, CASE WHEN doc_id % 5 <> 0 THEN source END AS title FROM documents")
def _(spark, d):
    raw = F.when(F.col("doc_id") % 5 == 0, "{").when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("text").alias("content"), F.col("source").alias("title")))).otherwise(F.to_json(F.struct("text", F.col("source").alias("title"))))
    j = _docs(spark, d).select("doc_id", S.json_document(raw).alias("j"))
    return j.select("doc_id", F.md5(F.coalesce("j.content", F.lit("not json")).cast("binary")).alias("content"), F.col("j.title").alias("title"))


@query("op_s07_page_splitter", r"WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents) SELECT doc_id, CAST(page AS INT) AS page, length(content) AS n FROM p WHERE trim(content) <> ''")
def _(spark, d):
    return S.pages_of(_docs(spark, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\f")).alias("text"))).select("doc_id", "page", F.length("content").cast("long").alias("n"))


@query("op_s09_html_scrape")
def _(spark, d):
    return S.scrape(table(spark, d, "pages"))


# -- string functions
@query("op_p04_split_glued", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(\p{Ll})(\p{Lu}|\d)', '\1 \2', 'g'), '(\d)(\p{L})', '\1 \2', 'g')) AS h FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.split_glued(F.col("text")).cast("binary")).alias("h"))


@query("op_p05_punctuation_spacing", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\s+([,.;:!?])', '\1', 'g'), '([,;:!?])(\p{L})', '\1 \2', 'g')) AS h FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.space_punctuation(F.col("text")).cast("binary")).alias("h"))


@query("op_p08_wiki_cleanup", r"SELECT doc_id, md5(lang || text) AS h FROM documents")
def _(spark, d):
    wiki = F.concat(F.lit("[[a|"), "lang", F.lit("]]{{x}}'''"), F.lit("<ref>r</ref>"), "text")
    return _docs(spark, d).select("doc_id", F.md5(T.clean_wiki(wiki).cast("binary")).alias("h"))


@query("op_p10_marks_cleanup", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[#%$*&]{3,}', '', 'g'), '\[\d{1,3}\]', '', 'g')) AS h FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.clean_marks(F.col("text")).cast("binary")).alias("h"))


@query("op_p12_quality_score", r"SELECT doc_id, greatest(0.0, least(100.0, 100 - 0.5 * len(regexp_extract_all(text, '\|')) - 0.5 * len(regexp_extract_all(text, '[#%$*&]{3}')) - 1.0 * len(regexp_extract_all(text, '�'))))::DOUBLE AS score FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", T.quality_score(F.col("text")).alias("score"))


@query("op_p21_slug", "SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.slug(F.col("c_name")).alias("slug"))


@query("op_p22_unaccent", "SELECT doc_id, md5(replace(replace(strip_accents(text), 'đ', 'd'), 'Đ', 'D')) AS h FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.unaccent(F.col("text")).cast("binary")).alias("h"))


@query("op_p23_whitespace", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.normal_space(F.col("text")).cast("binary")).alias("h"))


@query("op_p27_banner_strip", r"SELECT doc_id, md5(regexp_replace('[' || source || '] [' || lang || ']' || chr(10) || text, '^(\[[^\]]*\]\s*)+', '')) AS h FROM documents")
def _(spark, d):
    docs = _docs(spark, d)
    return docs.select("doc_id", F.md5(T.strip_banner(F.concat(F.lit("["), "source", F.lit("] ["), "lang", F.lit("]\n"), "text")).cast("binary")).alias("h"))


@query("op_p28_token_estimate", "SELECT lang, CAST(sum(CAST(ceil(length(text) / 3.5) AS BIGINT)) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def _(spark, d):
    return _docs(spark, d).groupBy("lang").agg(F.sum(T.token_count(F.col("text"))).alias("tokens"))


@query("op_p29_query_normal", r"SELECT doc_id, md5(trim(regexp_replace(lower(regexp_replace(text, '([!?.,])[!?.,]+', '\1', 'g')), '\s+', ' ', 'g'))) AS h FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.query_normal(F.col("text")).cast("binary")).alias("h"))


@query("op_p30_passage_dedup", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), r AS (SELECT doc_id, pos, length(trim(line)) >= 25 AND row_number() OVER (PARTITION BY doc_id, lower(trim(line)) ORDER BY pos) > 1 AS again FROM l) SELECT doc_id, count(*) FILTER (NOT again) AS kept_lines, count(*) FILTER (again) AS dropped_lines FROM r GROUP BY doc_id")
def _(spark, d):
    return O.dedup_passages(_docs(spark, d)).select("doc_id", "kept_lines", "dropped_lines")


@query("op_p31_list_breaks", r"SELECT doc_id, md5(regexp_replace(text, '([.:;]) +([-*•]|\d+\.) ', '\1' || chr(10) || '\2 ', 'g')) AS h FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.break_lists(F.col("text")).cast("binary")).alias("h"))


@query("op_p32_intent_cascade", "SELECT doc_id, CASE WHEN contains(lower(text), 'shall') THEN 'LEGAL' WHEN contains(lower(text), 'license') THEN 'LICENSE' WHEN regexp_matches(lower(text), 'https?://') THEN 'LINK' ELSE 'OTHER' END AS intent FROM documents")
def _(spark, d):
    rules = [("LEGAL", "shall"), ("LICENSE", "license"), ("LINK", "https?://")]
    return _docs(spark, d).select("doc_id", T.classify(F.col("text"), rules, "OTHER").alias("intent"))


@query("op_x06_query_sanitize", f"WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(lower(text), '[&|!():*<>''\"\\\\]', ' ', 'g'), '\\s+'), lambda w: w <> '') AS ws FROM conversations WHERE role = 'user') SELECT conv_id, turn, array_to_string(CASE WHEN len(list_filter(ws, lambda w: w NOT IN ({STOP_SQL}))) > 0 THEN list_filter(ws, lambda w: w NOT IN ({STOP_SQL})) ELSE ws END, ' ') AS terms FROM w")
def _(spark, d):
    c = table(spark, d, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", F.array_join(T.sanitize_terms(F.col("text"), STOPWORDS), " ").alias("terms"))


@query("op_p14_hierarchical_chunks")
def _(spark, d):
    return O.chunk_documents(_docs(spark, d))


@query("op_p16_years", r"WITH d AS (SELECT doc_id, concat_ws(' ', text, 1000 + doc_id, doc_id * 7919, (doc_id % 900) || '.', doc_id || ',5') AS text FROM documents), y AS (SELECT doc_id, list_filter(list_transform(list_filter(regexp_extract_all(text, '[\d.,]+'), lambda x: regexp_matches(x, '^\d{3,4}[.,]*$')), lambda x: CAST(rtrim(x, '.,') AS INT)), lambda x: x <= 2100) AS y FROM d) SELECT doc_id, array_to_string(list_filter(y, lambda x, i: list_position(y, x) = i), ',') AS years FROM y")
def _(spark, d):
    docs = _docs(spark, d).select("doc_id", F.expr("concat_ws(' ', text, 1000 + doc_id, doc_id * 7919, (doc_id % 900) || '.', doc_id || ',5')").alias("text"))
    return docs.select("doc_id", F.array_join(O.extract_years(F.col("text")).cast("array<string>"), ",").alias("years"))


@query("op_p18_gazetteer_spans")
def _(spark, d):
    return O.gazetteer_spans(_docs(spark, d), ["the", "of the", "the in", "und", "de la", "que"])


@query("op_j15_span_proximity")
def _(spark, d):
    docs = _docs(spark, d)
    spans = O.gazetteer_spans(docs, ["the", "of", "und", "der", "de", "la"]).withColumn("kind", F.when(F.col("name").isin("the", "und", "de"), "a").otherwise("b"))
    return O.near_spans(spans, docs, "a", "b", 75)


#: The sentences of ``text`` as a list.
SENTENCES_SQL = r"""list_filter(list_transform(string_split(regexp_replace(text, '([^\d\s][^\d\s][.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"""


@query("op_p24_sentences", f"WITH s AS (SELECT doc_id, {SENTENCES_SQL} AS l FROM documents) SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS pos, unnest(l) AS sentence FROM s")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(O.sentences(F.col("text"))).alias("pos", "sentence"))


@query("op_v01_claims", rf"WITH s AS (SELECT doc_id, {SENTENCES_SQL} AS l FROM documents), u AS (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS pos, regexp_replace(unnest(l), '^\s*(?:[-*•]|\d+[.)])\s*', '') AS claim FROM s) SELECT * FROM u WHERE length(claim) >= 12")
def _(spark, d):
    return O.extract_claims(_docs(spark, d))


@query("op_x03_hashed_vectors")
def _(spark, d):
    return O.hashed_vectors(_docs(spark, d))


# -- metrics
GOLD_SQL = "gold AS (SELECT q.vec_id AS query, v.vec_id AS chunk_id, 1 + v.vec_id % 3 AS grade FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)"
METRICS_SQL = f"""WITH {DENSE_SQL}, {GOLD_SQL}, t AS (SELECT d.query, d.rank, coalesce(g.grade, 0) AS grade, sum(CASE WHEN g.grade > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY d.query ORDER BY d.rank) AS hits FROM dense d LEFT JOIN gold g ON d.query = g.query AND d.chunk_id = g.chunk_id WHERE d.rank <= 5),
 got AS (SELECT query, sum((pow(2, grade) - 1) / log2(rank + 1.0)) AS dcg, min(rank) FILTER (grade >= 2) AS first, coalesce(sum(hits / rank) FILTER (grade > 0), 0) AS ap, count(*) FILTER (grade > 0) AS found, count(*) AS returned FROM t GROUP BY query),
 ideal AS (SELECT query, sum((pow(2, grade) - 1) / log2(place + 1.0)) FILTER (place <= 5) AS idcg, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, chunk_id) AS place FROM gold) GROUP BY query)
 SELECT query, round(CASE WHEN n IS NULL THEN 1.0 ELSE dcg / idcg END, 6) AS ndcg, round(coalesce(1.0 / first, 0), 6) AS mrr, round(CASE WHEN n IS NULL THEN 1.0 ELSE ap / least(n, 5) END, 6) AS map, round(CASE WHEN n IS NULL THEN 1.0 ELSE found / n END, 6) AS recall, round(CASE WHEN n IS NULL THEN 0.0 ELSE found / returned END, 6) AS precision FROM got LEFT JOIN ideal USING (query)"""


@query("op_m01_ranking_metrics", METRICS_SQL)
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "label")
    gold = q.join(e, "label").filter("vec_id <> query").select("query", F.col("vec_id").alias("chunk_id"), F.expr("1 + vec_id % 3").alias("grade"))
    return E.ranking_metrics(dense(spark, d, 5), gold)


@query("op_m04_pairwise_accuracy", "WITH s AS (SELECT lang, length(text) // 500 AS score, quality AS grade FROM documents JOIN labels USING (doc_id)) SELECT a.lang, count(*) AS pairs, count(*) FILTER (a.score > b.score) AS \"right\", round(count(*) FILTER (a.score > b.score) / count(*), 6) AS accuracy FROM s a JOIN s b ON a.lang = b.lang AND a.grade > b.grade GROUP BY a.lang")
def _(spark, d):
    s = _docs(spark, d).join(table(spark, d, "labels"), "doc_id").select("lang", F.expr("length(text) div 500").alias("score"), F.col("quality").alias("grade"))
    return E.pair_accuracy(s, "lang", "score", "grade")


@query("op_a20_confusion_matrix", "SELECT quality, count(*) FILTER (toxic = 0) AS \"0\", count(*) FILTER (toxic = 1) AS \"1\" FROM labels GROUP BY quality")
def _(spark, d):
    return E.confusion(table(spark, d, "labels"), "quality", "toxic", [0, 1])


REPORT_SQL = "WITH p AS (SELECT label, CAST(vec_id % 10 AS INT) AS called FROM embeddings), c AS (SELECT label AS cls, count(*) AS support FROM p GROUP BY 1), k AS (SELECT called AS cls, count(*) AS n FROM p GROUP BY 1), t AS (SELECT label AS cls, count(*) AS tp FROM p WHERE label = called GROUP BY 1), j AS (SELECT cls, coalesce(support, 0) AS support, coalesce(n, 0) AS called, coalesce(tp, 0) AS tp FROM c FULL JOIN k USING (cls) LEFT JOIN t USING (cls)), s AS (SELECT cls, support, CASE WHEN called > 0 THEN tp / called ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM j) SELECT cls, support, round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6)::DOUBLE AS f1 FROM s"


@query("op_a21_class_report", REPORT_SQL)
def _(spark, d):
    return E.class_report(table(spark, d, "embeddings").select("label", F.expr("cast(vec_id % 10 as int)").alias("called")), "label", "called")


@query("op_a21_class_averages", f"""WITH e AS (SELECT label, CAST(vec_id % 10 AS INT) AS called FROM embeddings), r AS ({REPORT_SQL}),
 m AS (SELECT count(*) AS classes, round(avg(precision), 5) AS macro_precision, round(avg(recall), 5) AS macro_recall, round(avg(f1), 5) AS macro_f1 FROM r),
 t AS (SELECT count(*) AS rows, round(avg(CASE WHEN label = called THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy FROM e)
 SELECT rows, accuracy, accuracy AS micro_precision, accuracy AS micro_recall, accuracy AS micro_f1, m.* FROM t, m""")
def _(spark, d):
    return E.class_averages(table(spark, d, "embeddings").select("label", F.expr("cast(vec_id % 10 as int)").alias("called")), "label", "called")


@query("op_m08_paired_t", """WITH s AS (SELECT l_returnflag, count(*) AS n, avg(l_tax - l_discount) AS mean, avg(l_tax - l_discount) / (stddev_samp(l_tax - l_discount) / sqrt(count(*))) AS t FROM lineitem GROUP BY l_returnflag),
 k AS (SELECT *, 1 / (1 + 0.2316419 * abs(t)) AS k FROM s), p AS (SELECT *, least(1.0, 2 * 0.3989423 * exp(-t * t / 2) * k * (0.3193815 + k * (-0.3565638 + k * (1.781478 + k * (-1.821256 + k * 1.330274))))) AS p FROM k)
 SELECT l_returnflag, n, round(mean, 6) AS mean, round(t, 4) AS t, round(p, 6)::DOUBLE AS p, p < 0.01 AS significant FROM p""")
def _(spark, d):
    return E.paired_t(table(spark, d, "lineitem"), "l_returnflag", "l_discount", "l_tax")


@query("op_m13_kendall_flow", "WITH p AS (SELECT a.l_orderkey, count(*) AS n, count(*) FILTER (a.l_quantity < b.l_quantity) AS c, count(*) FILTER (a.l_quantity > b.l_quantity) AS d FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY 1) SELECT l_orderkey, round(50 * ((c - d) / sqrt(n * greatest(1, c + d)) + 1), 6) AS flow FROM p")
def _(spark, d):
    return E.kendall(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity")


@query("op_m16_hit_at_k", f"WITH {DENSE_SQL} SELECT count(DISTINCT query) AS queries, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(top), 6) AS top_similarity FROM (SELECT d.query, bool_or(v.label = q.label AND v.vec_id <> q.vec_id) AS hit, max(similarity) FILTER (rank = 2) AS top FROM dense d JOIN embeddings v ON d.chunk_id = v.vec_id JOIN embeddings q ON d.query = q.vec_id WHERE rank <= 5 GROUP BY d.query)")
def _(spark, d):
    e = table(spark, d, "embeddings")
    j = dense(spark, d, 5).join(e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("found")), "chunk_id").join(e.select(F.col("vec_id").alias("query"), "label"), "query")
    g = j.groupBy("query").agg(F.bool_or((F.col("found") == F.col("label")) & (F.col("chunk_id") != F.col("query"))).alias("hit"), F.max(F.when(F.col("rank") == 2, F.col("similarity"))).alias("top"))
    return g.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"), F.round(F.avg("top"), 6).alias("top_similarity"))


@query("op_m18_rejection_rates", "SELECT lang, round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def _(spark, d):
    return table(spark, d, "labels").join(_docs(spark, d), "doc_id").groupBy("lang").agg(F.round(F.avg((F.col("toxic") == 1).cast("double")), 6).alias("rate"), F.count(F.lit(1)).alias("n"))


@query("op_m19_words_per_minute", "SELECT conv_id, turn, round(len(string_split(text, ' ')) / (length(text) / 15.0) * 60, 4) AS wpm, greatest(0, 130 - len(string_split(text, ' ')) / (length(text) / 15.0) * 60, len(string_split(text, ' ')) / (length(text) / 15.0) * 60 - 170) > 0 AS off FROM conversations WHERE length(text) > 0")
def _(spark, d):
    wpm = F.size(F.split("text", " ")) / (F.length("text") / 15.0) * 60
    return table(spark, d, "conversations").filter("length(text) > 0").select("conv_id", "turn", F.round(wpm, 4).alias("wpm"), ((wpm < 130) | (wpm > 170)).alias("off"))


@query("op_m20_set_scores", "WITH p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R'), g AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'F'), c AS (SELECT coalesce(p.l_orderkey, g.l_orderkey) AS l_orderkey, count(p.l_partkey) AS np, count(g.l_partkey) AS ng, count(*) FILTER (p.l_partkey IS NOT NULL AND g.l_partkey IS NOT NULL) AS nb FROM p FULL JOIN g ON p.l_orderkey = g.l_orderkey AND p.l_partkey = g.l_partkey GROUP BY 1), s AS (SELECT l_orderkey, CASE WHEN np > 0 THEN nb / np ELSE 0 END AS a, CASE WHEN ng > 0 THEN nb / ng ELSE 0 END AS b FROM c) SELECT l_orderkey, round(a, 6)::DOUBLE AS precision, round(b, 6)::DOUBLE AS recall, round(CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0 END, 6)::DOUBLE AS f1 FROM s")
def _(spark, d):
    li = table(spark, d, "lineitem")
    return E.set_scores(li.filter("l_returnflag <> 'R'"), li.filter("l_linestatus = 'F'"), "l_orderkey", "l_partkey")


# -- streams and caches
@query("op_r01_loop_detector", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents), g AS (SELECT doc_id, seq, trim(line) AS t, lag(trim(line), 1) OVER w AS a, lag(trim(line), 2) OVER w AS b FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) SELECT CAST(doc_id AS VARCHAR) AS stream, min(seq) AS seq FROM g WHERE t = a AND t = b AND length(t) >= 25 GROUP BY doc_id")
def _(spark, d):
    source = spark.readStream.schema(_docs(spark, d).schema).parquet(f"{d}/documents.parquet*")
    lines = source.select(F.col("doc_id").cast("string").alias("stream"), F.posexplode(F.split("text", "\n")).alias("seq", "line")).withColumn("seq", F.col("seq").cast("long"))
    at = f"{spark.sparkContext.getCheckpointDir() or _own(spark)}/{uuid.uuid4().hex}"
    return R.run_once(R.detect_loops(lines), f"{at}/rows", f"{at}/checkpoint").select("stream", "seq")


def _own(spark) -> str:
    staged(spark.range(1))
    return spark.sparkContext.getCheckpointDir()


@query("op_r01_loops_in_batch", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents), g AS (SELECT doc_id, seq, trim(line) AS t, lag(trim(line), 1) OVER w AS a, lag(trim(line), 2) OVER w AS b FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) SELECT CAST(doc_id AS VARCHAR) AS stream, min(seq) AS seq FROM g WHERE t = a AND t = b AND length(t) >= 25 GROUP BY doc_id")
def _(spark, d):
    lines = _docs(spark, d).select(F.col("doc_id").cast("string").alias("stream"), F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    return R.loops_in_batch(lines).select("stream", F.col("seq").cast("long").alias("seq"))


@query("op_r03_lru_contents", "SELECT user_id, max(event_id) AS last, count(*) AS reads FROM events GROUP BY user_id ORDER BY last DESC, user_id LIMIT 50")
def _(spark, d):
    return R.cache_contents(table(spark, d, "events"), "user_id", "event_id", 50)


@query("op_r04_limiter_audit", "WITH g AS (SELECT user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events) SELECT user_id, event_id, gap_us FROM g WHERE gap_us < 3600000000")
def _(spark, d):
    return R.limiter_audit(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 3_600_000).select("user_id", "event_id", "gap_us")


@query("op_ext_tumbling_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return R.tumbling_counts(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("op_ext_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g) SELECT user_id, count(DISTINCT k) AS sessions, count(*) AS n FROM s GROUP BY user_id")
def _(spark, d):
    s = R.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("n"))
