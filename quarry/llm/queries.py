"""The registered queries of the training-data operators, their parameters, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, chat, lexical, secrets, token_counts, vectorcode
from quarry.llm.binpack import packed_digest, write_packed
from quarry.llm.common import stage
from quarry.llm.dedup_exact import exact_duplicates
from quarry.llm.jaccard import jaccard_classes
from quarry.llm.packing import pack
from quarry.llm.quality import quality_verdicts
from quarry.llm.sharding import place
from quarry.llm.url_filter import url_verdicts

SHARDS = [f"shard-{k:03d}" for k in range(64)]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.decode(bpe.encode(_documents(spark, sf_dir)))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(_documents(spark, sf_dir), SHARDS)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_documents(spark, sf_dir))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_documents(spark, sf_dir), width=3, num=90, den=100)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digest(stage(chat.format_windows(rows.unionByName(more))))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(_documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir)).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "shard")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_documents(spark, sf_dir))


def op10_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(write_packed(_documents(spark, sf_dir)))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(_documents(spark, sf_dir)))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build_index(_documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=50)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcode.digest(vectorcode.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=4, entries=256, rounds=4))


def _lloyd_sql(rounds: int) -> str:
    """The rounds written out one after the other; whole numbers only."""
    nearest = "SELECT vec_id, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM (SELECT vec_id, part, entry, sum((x - y) * (x - y)) AS d FROM c JOIN b{r} USING (part, pos) GROUP BY ALL) GROUP BY ALL"
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(r=r)})")
        steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT b{r}.part, b{r}.entry, b{r}.pos, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM b{r} LEFT JOIN
            (SELECT part, entry, pos, sum(x)::BIGINT AS s, count(*) AS n FROM a{r} JOIN c USING (vec_id, part) GROUP BY ALL) USING (part, entry, pos))""")
    return ",\n".join([*steps, f"a{rounds} AS MATERIALIZED ({nearest.format(r=rounds)})"])


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_sharding": op2_sharding,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_chat_format": op5_chat_format,
    "op6_token_counts": op6_token_counts,
    "op7_packing": op7_packing,
    "op8_url_filter": op8_url_filter,
    "op9_quality": op9_quality,
    "op10_binary_output": op10_binary_output,
    "op11_secrets": op11_secrets,
    "op12_lexical_search": op12_lexical_search,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL = {
    "op3_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    # Pages hold no canonical links or refreshes here; the alias rule is tested against brute force. SQL keeps aliases of one address.
    "op8_url_filter": """
        WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
        rules(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
        SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, coalesce(arg_max(v, length(rh || rp)), 'allow') AS verdict
        FROM h LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
        GROUP BY page_id, host, path""",
    "op12_lexical_search": r"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
        s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM d),
        f AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT docs FROM s) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY term),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // l))))::BIGINT AS score
              FROM q JOIN p USING (term) JOIN f USING (term) JOIN d USING (doc_id), s GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 50""",
    "op13_vector_codes": f"""
        WITH k AS MATERIALIZED (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c AS MATERIALIZED (SELECT vec_id, i // w AS part, i % w AS pos, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS x
                           FROM (SELECT vec_id, len(embedding) // 4 AS w, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM k)),
        b0 AS MATERIALIZED (SELECT part, entry, pos, x AS y FROM c JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < 256) USING (vec_id)),
        {_lloyd_sql(4)},
        e AS (SELECT vec_id, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY vec_id)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b4) AS codebooks_sha256
        FROM e JOIN k USING (vec_id)""",
}
