"""Queries on ingestion, text functions and the tables of the indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.common import r6, table
from quern.functions import text as tx
from quern.operators import chunking, dense, ingest, lexical, tasks


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages of the sources that they name."""
    return table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("int").alias("page"), F.col("doc_id").alias("doc_ord"), F.col("text").alias("content"))


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files of one page each."""
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source"), F.lit(None).cast("int").alias("page"), F.lit(0).cast("long").alias("doc_ord"), F.col("text").alias("content"), "doc_id")


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: one each."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("chunk_ord"), "source", F.col("text").alias("content"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))


def source_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.fingerprints(pages_of(spark, sf_dir))


def old_manifest(files: DataFrame) -> DataFrame:
    """A state before the files: every seventh wasn't there, every eleventh was another, and some were there that are gone."""
    rows = files.where("doc_id % 7 <> 0").select("source", F.when(F.col("doc_id") % 11 == 0, F.lit("another")).otherwise(tx.content_hash(F.col("content"))).alias("hash"))
    return rows.unionByName(files.where("doc_id % 13 = 0").select(F.concat(F.lit("old"), F.col("doc_id").cast("string")).alias("source"), F.lit("gone").alias("hash")))


def changes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = files_of(spark, sf_dir)
    return ingest.diff(ingest.fingerprints(files), old_manifest(files))


def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes_of(spark, sf_dir)


def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the message that a finished ingest shows. Chunks are so large that a file with text is one, which SQL can count."""
    files, changes = files_of(spark, sf_dir), changes_of(spark, sf_dir)
    fresh = changes.where(F.col("status").isin("new", "changed")).select("source")
    added = chunking.chunked(files.join(fresh, "source", "left_semi"), 1 << 30).agg(F.count(F.lit(1)).alias("__added"))
    counts = ingest.counters(changes).crossJoin(F.broadcast(added))
    return counts.withColumn("message", tasks.final_message(F.col("__added"), F.col("changed_files"), F.col("removed_files"))).drop("__added")


def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = table(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return split.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.corpus_stats(chunks_of(spark, sf_dir)).select("n_chunks", r6(F.col("avg_tokens")).alias("avg_tokens"))


def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_stats(chunks_of(spark, sf_dir)).select("term", "df", r6(F.col("idf")).alias("idf"))


def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's postings, summed up by term."""
    postings = lexical.index(chunks_of(spark, sf_dir))["postings"]
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("chunks"), F.sum("tf").alias("occurrences"))


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per bucket that isn't zero."""
    made = dense.hash_embeddings(table(spark, sf_dir, "documents"), "doc_id", "text")
    return made.select("doc_id", F.posexplode("embedding").alias("bucket", "v")).where("v <> 0").select("doc_id", "bucket", r6(F.col("v")).alias("weight"))


def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunked(pages_of(spark, sf_dir)).select("chunk_id", "source", "page", "chunk_ord", "content_hash", F.length("content").alias("n_chars"))


def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks per source: what readiness and status views count."""
    return chunking.chunked(pages_of(spark, sf_dir)).groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("content_hash").alias("distinct_chunks"))


def corpus_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("topic_"), F.col("source"), F.lit("-"), F.col("lang"), F.lit("_0a1b2c3d.md")).alias("source")).distinct()
    return ingest.corpus_topics(files)


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.safe_stem(F.col("url")).alias("stem"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


def question_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions from conversations and, with their tags, from pages."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("id"), F.col("text").alias("q"))
    pages = table(spark, sf_dir, "pages").select(F.concat_ws("-", F.lit("p"), "page_id").alias("id"), F.col("html").alias("q"))
    both = turns.unionByName(pages)
    error = tx.question_error(F.col("q"))
    return both.select("id", F.coalesce(error, F.lit("valid")).alias("verdict"), F.when(error.isNull(), tx.cleaned_question(F.col("q"))).alias("cleaned"))


QUERIES = {f.__name__: f for f in (content_hash, source_fingerprint, manifest_diff, ingest_counters, dedup_exact, tokenize_counts, bm25_corpus_stats, bm25_term_stats, bm25_postings, hash_embedding, recursive_chunks, index_counts, corpus_topics, safe_names, snippets, question_validation)}

_CHANGES = """WITH f AS (SELECT 'doc' || doc_id AS source, doc_id, sha256(text) AS hash FROM documents),
m AS (SELECT source, CASE WHEN doc_id % 11 = 0 THEN 'another' ELSE hash END AS hash FROM f WHERE doc_id % 7 <> 0 UNION ALL SELECT 'old' || doc_id, 'gone' FROM f WHERE doc_id % 13 = 0),
c AS (SELECT coalesce(f.source, m.source) AS source, CASE WHEN f.source IS NULL THEN 'removed' WHEN m.source IS NULL THEN 'new' WHEN f.hash = m.hash THEN 'skipped' ELSE 'changed' END AS status FROM f FULL OUTER JOIN m ON f.source = m.source)
"""
TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
_DF = f"WITH t AS (SELECT doc_id, unnest(list_distinct({TOKENS.format('text')})) AS term FROM documents), d AS (SELECT term, count(*) AS df FROM t GROUP BY term), n AS MATERIALIZED (SELECT count(*) AS n FROM documents), r AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM d, n)"

SQL = {
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "source_fingerprint": "SELECT source, sha256(coalesce(string_agg(text, chr(0) ORDER BY doc_id, text), '')) AS hash, count(*) AS n_pages FROM documents GROUP BY source",
    "manifest_diff": _CHANGES + "SELECT * FROM c",
    "ingest_counters": _CHANGES + "SELECT count(*) FILTER (WHERE status IN ('new', 'changed')) AS changed_files, count(*) FILTER (WHERE status = 'skipped') AS skipped_files, count(*) FILTER (WHERE status = 'removed') AS removed_files, 'Indexed ' || count(*) FILTER (WHERE status IN ('new', 'changed') AND regexp_matches(text, '[^\\s]')) || ' chunks.' AS message FROM c LEFT JOIN (SELECT 'doc' || doc_id AS source, text FROM documents) USING (source)",
    "dedup_exact": "SELECT sha256(text) AS content_hash, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1",
    "tokenize_counts": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)",
    "bm25_corpus_stats": f"SELECT count(*) AS n_chunks, round(avg(len({TOKENS.format('text')})), 6) AS avg_tokens FROM documents",
    "bm25_term_stats": _DF + ", m AS MATERIALIZED (SELECT avg(raw) AS mean FROM r) SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END, 6) AS idf FROM r, m",
    "bm25_postings": f"WITH t AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS chunks, count(*) AS occurrences FROM t GROUP BY term",
    "hash_embedding": r"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS w FROM documents),
b AS (SELECT doc_id, CAST('0x' || substr(sha256(w), 63, 2) AS INT) % 64 AS bucket, count(*) AS n FROM w GROUP BY ALL)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM b""",
    "corpus_topics": "SELECT string_agg(topic, '; ' ORDER BY name) AS topics FROM (SELECT DISTINCT 'topic_' || source || '-' || lang || '_0a1b2c3d.md' AS name, 'topic ' || source || ' ' || lang AS topic FROM documents)",
    "safe_names": r"""WITH b AS (SELECT page_id, list_extract(string_split(url, '/'), -1) AS base FROM pages), s AS (SELECT page_id, CASE WHEN regexp_matches(base, '^.+\.[^.]+$') THEN regexp_replace(base, '\.[^.]*$', '') ELSE base END AS stem FROM b)
SELECT page_id, coalesce(nullif(trim(regexp_replace(stem, '[^A-Za-z0-9_-]+', '_', 'g'), '_'), ''), 'upload') AS stem FROM s""",
    "snippets": "SELECT doc_id, substr(text, 1, 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END AS snippet FROM documents",
    "question_validation": r"""WITH q AS (SELECT 'c-' || conv_id || '-' || turn AS id, text AS q FROM conversations UNION ALL SELECT 'p-' || page_id, html FROM pages),
c AS (SELECT *, regexp_replace(regexp_replace(q, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g') AS clean FROM q),
v AS (SELECT *, CASE WHEN q IS NULL OR length(q) < 1 THEN 'empty' WHEN length(q) > 2000 THEN 'too long' WHEN clean = '' THEN 'empty' WHEN len(regexp_extract_all(clean, '[\p{L}\p{N}_]')) / length(clean) < 0.1 THEN 'no words' ELSE 'valid' END AS verdict FROM c)
SELECT id, verdict, CASE WHEN verdict = 'valid' THEN clean END AS cleaned FROM v""",
}
