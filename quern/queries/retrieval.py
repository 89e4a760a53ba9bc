"""Queries on retrieval, fusion, grading and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.common import fits, r6, table
from quern.functions import text as tx
from quern.operators import decisions, dense, fusion, lexical, report
from quern.plans import research
from quern.queries.indexing import TOKENS, chunks_of, pages_of
from quern.settings import DEFAULTS
from quern.sources import web


def asked_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(asked_of(spark, sf_dir), chunks_of(spark, sf_dir))
    return found.select("query_id", "rank", F.col("chunk_ord").alias("doc_id"), r6(F.col("score")).alias("score"))


def bm25_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the tables of an index."""
    found = lexical.search_index(asked_of(spark, sf_dir), lexical.index(chunks_of(spark, sf_dir)))
    return found.select("query_id", "rank", F.col("chunk_ord").alias("doc_id"), r6(F.col("score")).alias("score"))


def hash_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = dense.hash_embeddings(asked_of(spark, sf_dir), "query_id", "query")
    stored = dense.hash_embeddings(chunks_of(spark, sf_dir), "chunk_ord", "content").withColumnRenamed("chunk_ord", "id")
    return dense.search(asked, stored, kind="long").select("query_id", "rank", F.col("id").alias("doc_id"), r6(F.col("distance")).alias("distance"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector, by id, against all."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = vectors.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    return dense.search(asked, vectors, kind="long").select("query_id", "rank", F.col("id").alias("vec_id"), r6(F.col("distance")).alias("distance"))


def questions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as questions: user turns are the sub-queries, the id gives the route."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    listed = turns.groupBy(F.col("conv_id").alias("question_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("__t"))
    return listed.select("question_id", F.get("__t.text", F.lit(0)).alias("question"), F.get(F.array(*map(F.lit, ("vector", "web", "both", "none"))), (F.col("question_id") % 4).cast("int")).alias("route"), F.col("__t.text").alias("sub_queries"))


def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.fan_out(questions_of(spark, sf_dir))
    return out.select("question_id", "sub_query_ord", "path", tx.content_hash(F.col("sub_query")).alias("sub_query_hash"))


def web_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.searched_pages(asked_of(spark, sf_dir), table(spark, sf_dir, "pages")).select("query_id", "rank", "title", "url", tx.content_hash(F.col("content")).alias("content_hash"))


def hit_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lists per benchmark item: by vector, by words, and from the pages."""
    texts = chunks_of(spark, sf_dir).select(F.col("chunk_ord").alias("doc_id"), "content", "source")
    # Every query finds top_k at most; what is found goes to the texts, which aren't shuffled.
    sent = F.broadcast if fits(asked_of(spark, sf_dir), DEFAULTS.broadcast_rows // DEFAULTS.top_k) else lambda df: df
    listed = lambda found, path: sent(found).join(texts, "doc_id").select(F.col("query_id").alias("question_id"), F.lit(path).alias("path"), F.lit(fusion.PATHS[path]).alias("path_ord"), F.lit(0).alias("sub_query_ord"), "rank", "content", F.col("source").alias("source_id"))
    found = web.searched_pages(asked_of(spark, sf_dir), table(spark, sf_dir, "pages"))
    pages = found.select(F.col("query_id").alias("question_id"), F.lit("web").alias("path"), F.lit(fusion.PATHS["web"]).alias("path_ord"), F.lit(0).alias("sub_query_ord"), "rank", "content", F.col("url").alias("source_id"))
    return fusion.all_hits(listed(hash_vector_topk(spark, sf_dir), "vector"), listed(bm25_topk(spark, sf_dir), "bm25"), pages)


def _shown(fused: DataFrame) -> DataFrame:
    return fused.select("question_id", "fused_rank", "content_hash", "source_id", r6(F.col("rrf_score")).alias("rrf_score"))


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(fusion.fused(hit_lists(spark, sf_dir)))


def rrf_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rrf_fuse(spark, sf_dir).where("fused_rank <= 6")


def corrective_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion without the web, and again with the web's hits where the word and vector lists share nothing.

    The fused documents are a question's different contents, which are counted as the hits pass by: they are found once.
    """
    web_hit, content = F.col("path") == "web", F.coalesce(tx.content_hash(F.col("content")), F.lit(""))
    local = F.size(F.collect_set(F.when(~web_hit, content)).over(Window.partitionBy("question_id")))
    counted = hit_lists(spark, sf_dir).withColumn("__local", local)
    return _shown(fusion.fused(counted.where(~web_hit | ((F.col("__local") >= 8) & F.col("question_id").isNotNull())).drop("__local")))


def grades_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as grades: fifty documents are one question, good ones are relevant."""
    labels = table(spark, sf_dir, "labels")
    return labels.select(F.floor(F.col("doc_id") / 50).alias("question_id"), (F.col("doc_id") % 50 + 1).cast("int").alias("fused_rank"), (F.col("quality") == 1).alias("relevant"), (F.col("doc_id") % 10 / 10).alias("score"))


def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    grades = grades_of(spark, sf_dir)
    questions = grades.select("question_id").distinct().withColumn("route", F.when(F.col("question_id") % 3 == 0, "both").otherwise("vector")).withColumn("correction_attempted", F.col("question_id") % 5 == 0)
    return decisions.gate(questions, grades).select("question_id", "route", r6(F.col("confidence")).alias("confidence"), "needs_correction")


def grade_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = asked_of(spark, sf_dir).select(F.col("query_id").alias("question_id"), F.col("query").alias("question"))
    return decisions.graded(fusion.fused(hit_lists(spark, sf_dir)), questions).select("question_id", "fused_rank", "relevant", r6(F.col("score")).alias("score"))


def grade_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades as they come; where one is missing, all of the question's documents count as relevant."""
    documents = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 5).alias("question_id"), (F.col("doc_id") % 5 + 1).cast("int").alias("fused_rank"))
    labels = table(spark, sf_dir, "labels").select(F.floor(F.col("doc_id") / 5).alias("question_id"), (F.col("doc_id") % 5 + 1).cast("int").alias("fused_rank"), (F.col("quality") == 1).alias("relevant"), (F.col("doc_id") % 10 / 10).alias("score"))
    return decisions.checked_grades(documents, labels)


def route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("question"))
    return decisions.routed(questions, F.lit("de; la; nicht; thanedble; the latest")).select("conv_id", "turn", "route", "reasoning")


def decompose_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.posexplode(decisions.sub_queries(F.concat("text", F.lit("? What is it; and when? ")))).alias("sub_query_ord", "sub_query"))


def answers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = asked_of(spark, sf_dir).select(F.col("query_id").alias("question_id"), F.lit("both").alias("route"))
    return report.extracted_answers(fusion.fused(hit_lists(spark, sf_dir)), questions)


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The citations that answers use."""
    used = answers_of(spark, sf_dir).select("question_id", tx.markers(F.col("answer")).alias("__m"), F.posexplode("citations").alias("citation_ord", "c"))
    return used.where(F.array_contains("__m", F.col("c.marker"))).select("question_id", "citation_ord", "c.marker", "c.source_id")


def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports on fixed answers: each cites the first three documents of its item and repeats the second."""
    cited = rrf_topn(spark, sf_dir).groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("fused_rank", "source_id"))).alias("__d"))
    listed = F.transform("__d", lambda x: F.struct(F.concat(F.lit("["), x["fused_rank"].cast("string"), F.lit("]")).alias("marker"), x["source_id"].alias("source_id")))
    answer = F.when(F.col("question_id") % 4 == 0, "Nothing to cite.").otherwise(F.concat(F.lit("Item "), F.col("question_id").cast("string"), F.lit(" is known [1][2], and again [3] [2].")))
    return cited.select("question_id", report.report_text(answer, listed).alias("report"))


def numbered_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = fusion.fused(hit_lists(spark, sf_dir)).where("fused_rank <= 6")
    listed = top.groupBy("question_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("fused_rank", "source_id", "content"))), lambda x: F.struct(x["source_id"].alias("source_id"), x["content"].alias("content"))).alias("d"))
    prompt = decisions.rendered(decisions.ANSWER_PROMPT, question=F.col("question_id").cast("string"), context=report.numbered_context(F.col("d")))
    return listed.select("question_id", F.sha2(report.numbered_context(F.col("d")), 256).alias("context_hash"), F.sha2(report.numbered_context(F.col("d"), with_source=False), 256).alias("grading_hash"), F.sha2(prompt, 256).alias("prompt_hash"))


def retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = hit_lists(spark, sf_dir)
    questions = asked_of(spark, sf_dir).select(F.col("query_id").alias("question_id"))
    return report.retrieval_counts(questions, hits, fusion.fused(hits))


def research_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan: benchmark items as questions, documents as chunks."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    manifest = pages_of(spark, sf_dir).select("source").distinct()
    done = research.research(questions, chunks_of(spark, sf_dir), table(spark, sf_dir, "pages"), manifest)
    out = done.summary.join(done.reports.select("question_id", "report"), "question_id")
    return out.select("question_id", "route", F.size("sub_queries").alias("n_sub_queries"), r6(F.col("confidence")).alias("confidence"), "correction_attempted", "vector", "bm25", "web", "fused", F.sha2("report", 256).alias("report_hash"))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_index_topk, hash_vector_topk, vector_topk, fan_out, web_hits, rrf_fuse, rrf_topn, corrective_union, confidence_gate, grade_documents, grade_fallback, route_questions, decompose_questions, citations, report_text, numbered_context, retrieval_summary, research_summary)}


def _bm25(name: str, key: str, text: str, source: str) -> str:
    """CTEs that end in {name}: query_id, rank, key, score of the best four."""
    return f"""{name}_d AS (SELECT {key} AS k, {TOKENS.format(text)} AS t FROM {source}),
{name}_df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM {name}_d) GROUP BY term),
{name}_n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {name}_d),
{name}_r AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM {name}_df, {name}_n),
{name}_i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {name}_r) ELSE raw END AS idf FROM {name}_r),
{name}_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
{name}_tf AS (SELECT k, dl, term, count(*) AS tf FROM (SELECT k, len(t) AS dl, unnest(t) AS term FROM {name}_d) WHERE term IN (SELECT term FROM {name}_q) GROUP BY ALL),
{name}_s AS (SELECT query_id, k, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM {name}_tf JOIN {name}_q USING (term) JOIN {name}_i USING (term), {name}_n GROUP BY query_id, k),
{name} AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, k) AS rank, k AS {key}, score FROM {name}_s WHERE round(score, 9) > 0 QUALIFY rank <= 4)"""


def _hashed(name: str, key: str, text: str, source: str) -> str:
    return rf"""{name}_w AS (SELECT {key} AS k, unnest(list_filter(string_split_regex(lower({text}), '\s+'), lambda x: x <> '')) AS w FROM {source}),
{name}_b AS (SELECT k, CAST('0x' || substr(sha256(w), 63, 2) AS INT) % 64 AS b, count(*) AS n FROM {name}_w GROUP BY ALL),
{name} AS (SELECT k, b, n / sqrt(sum(n * n) OVER (PARTITION BY k)) AS v FROM {name}_b)"""


_VECTORS = f"""{_hashed('hd', 'doc_id', 'text', 'documents')}, {_hashed('hq', 'item_id', 'text', 'benchmark')},
vec AS (SELECT q.k AS query_id, d.k AS doc_id, 1 - sum(q.v * d.v) AS distance FROM hq q JOIN hd d USING (b) GROUP BY ALL),
byvec AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), doc_id) AS rank, doc_id, distance FROM vec QUALIFY rank <= 4)"""
_PAGES = r"pg AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, url, regexp_replace(html, '<[^>]+>', '', 'g') AS content FROM pages)"
_HITS = f"""{_VECTORS}, {_bm25('lex', 'doc_id', 'text', 'documents')}, {_PAGES}, {_bm25('wb', 'page_id', 'content', 'pg')},
hits AS (SELECT query_id AS question_id, 'vector' AS path, 0 AS path_ord, rank, text AS content, source AS source_id FROM byvec JOIN documents USING (doc_id)
UNION ALL SELECT query_id, 'bm25', 1, rank, text, source FROM lex JOIN documents USING (doc_id)
UNION ALL SELECT query_id, 'web', 2, rank, content, url FROM wb JOIN pg USING (page_id))"""


def _fused(name: str, hits: str) -> str:
    return f"""{name}_s AS (SELECT question_id, sha256(content) AS content_hash, sum(1.0 / (60 + rank)) AS rrf_score, min(path_ord * 1000 + rank) AS first, arg_min(source_id, path_ord * 1000 + rank) AS source_id, any_value(content) AS content FROM {hits} GROUP BY ALL HAVING true),
{name} AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY round(rrf_score, 9) DESC, first) AS fused_rank, content_hash, source_id, rrf_score, content FROM {name}_s)""".replace("GROUP BY ALL HAVING true", "GROUP BY question_id, sha256(content)")


_SHOWN = "SELECT question_id, fused_rank, content_hash, source_id, round(rrf_score, 6) AS rrf_score"
_ANSWERS = rf"""WITH {_HITS}, {_fused('f', 'hits')},
a AS (SELECT question_id, string_agg(regexp_extract(content, '^\s*([^.!?\n]*[.!?]?)', 1) || ' [' || fused_rank || ']', ' ' ORDER BY fused_rank) FILTER (WHERE fused_rank <= 3) AS answer FROM f GROUP BY question_id)"""

SQL = {
    "bm25_topk": f"WITH {_bm25('lex', 'doc_id', 'text', 'documents')} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM lex",
    "bm25_index_topk": f"WITH {_bm25('lex', 'doc_id', 'text', 'documents')} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM lex",
    "hash_vector_topk": f"WITH {_VECTORS} SELECT query_id, rank, doc_id, round(distance, 6) AS distance FROM byvec",
    "vector_topk": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT q.vec_id AS query_id, e.vec_id, 1 - list_cosine_similarity(q.v, e.v) AS distance FROM e q, e WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, round(distance, 6) + 0.0 AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id) AS rank FROM d) WHERE rank <= 4""",
    "fan_out": """WITH t AS (SELECT conv_id AS question_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS sub_query_ord FROM conversations WHERE role = 'user'),
r(route, path) AS (VALUES (0, 'vector'), (0, 'bm25'), (1, 'web'), (2, 'vector'), (2, 'bm25'), (2, 'web'))
SELECT question_id, sub_query_ord, path, sha256(text) AS sub_query_hash FROM t JOIN r ON question_id % 4 = route""",
    "web_hits": f"WITH {_PAGES}, {_bm25('wb', 'page_id', 'content', 'pg')} SELECT query_id, rank, title, url, sha256(content) AS content_hash FROM wb JOIN pg USING (page_id)",
    "rrf_fuse": f"WITH {_HITS}, {_fused('f', 'hits')} {_SHOWN} FROM f",
    "rrf_topn": f"WITH {_HITS}, {_fused('f', 'hits')} {_SHOWN} FROM f WHERE fused_rank <= 6",
    "corrective_union": f"""WITH {_HITS}, l AS (SELECT * FROM hits WHERE path <> 'web'), {_fused('g', 'l')}, need AS (SELECT question_id FROM g GROUP BY question_id HAVING count(*) >= 8),
u AS (SELECT * FROM l UNION ALL SELECT * FROM hits WHERE path = 'web' AND question_id IN (SELECT question_id FROM need)), {_fused('f', 'u')} {_SHOWN} FROM f""",
    "confidence_gate": """WITH g AS (SELECT doc_id // 50 AS question_id, quality = 1 AS relevant, (doc_id % 10) / 10 AS score FROM labels),
c AS (SELECT question_id, CASE WHEN question_id % 3 = 0 THEN 'both' ELSE 'vector' END AS route, coalesce(avg(score) FILTER (WHERE relevant), 0.0) AS confidence FROM g GROUP BY question_id)
SELECT question_id, route, round(confidence, 6) AS confidence, confidence < 0.6 AND route = 'vector' AND question_id % 5 <> 0 AS needs_correction FROM c""",
    "grade_documents": f"""WITH {_HITS}, {_fused('f', 'hits')}, s AS (SELECT question_id, fused_rank, len(list_intersect(list_distinct({TOKENS.format('b.text')}), list_distinct({TOKENS.format('f.content')}))) / greatest(len(list_distinct({TOKENS.format('b.text')})), 1) AS score FROM f JOIN benchmark b ON b.item_id = question_id WHERE fused_rank <= 6)
SELECT question_id, fused_rank, score >= 1 / 3 AS relevant, round(score, 6) AS score FROM s""",
    "grade_fallback": """WITH d AS (SELECT doc_id // 5 AS question_id, doc_id % 5 + 1 AS fused_rank, doc_id FROM documents), j AS (SELECT d.*, l.quality = 1 AS relevant, (l.doc_id % 10) / 10 AS score, count(*) OVER (PARTITION BY question_id) = count(l.doc_id) OVER (PARTITION BY question_id) AS fits FROM d LEFT JOIN labels l USING (doc_id))
SELECT question_id, fused_rank, CASE WHEN fits THEN relevant ELSE true END AS relevant, CASE WHEN fits THEN score ELSE 1.0 END AS score FROM j""",
    "route_questions": f"""WITH q AS (SELECT conv_id, turn, {TOKENS.format('text')} AS t FROM conversations), l AS (SELECT *, list_has_any(t, ['nicht', 'thanedble', 'latest']) AS loc, list_has_any(t, ['today', 'latest', 'current', 'currently', 'now', 'recent', 'recently', 'news', 'yesterday', 'tomorrow']) AS rec, len(t) <= 3 AND list_has_any(t, ['hello', 'hi', 'hey', 'thanks', 'thank', 'bye', 'goodbye']) AS chat FROM q)
SELECT conv_id, turn, CASE WHEN chat THEN 'none' WHEN rec AND loc THEN 'both' WHEN rec THEN 'web' WHEN loc THEN 'vector' ELSE 'both' END AS route, CASE WHEN chat THEN 'small talk' WHEN rec AND loc THEN 'recent and local' WHEN rec THEN 'recent' WHEN loc THEN 'local topic' ELSE 'unknown topic' END AS reasoning FROM l""",
    "citations": _ANSWERS + "SELECT question_id, fused_rank - 1 AS citation_ord, '[' || fused_rank || ']' AS marker, source_id FROM f JOIN a USING (question_id) WHERE contains(answer, '[' || fused_rank || ']')",
    "report_text": f"""WITH {_HITS}, {_fused('f', 'hits')}, u AS (SELECT question_id, source_id, string_agg('[' || fused_rank || ']', '' ORDER BY fused_rank) AS m, min(fused_rank) AS first FROM f WHERE fused_rank <= 3 AND question_id % 4 <> 0 GROUP BY ALL),
s AS (SELECT question_id, string_agg('- ' || m || ' ' || source_id, chr(10) ORDER BY first) AS lines FROM u GROUP BY question_id)
SELECT question_id, CASE WHEN question_id % 4 = 0 THEN 'Nothing to cite.' || chr(10) ELSE 'Item ' || question_id || ' is known [1][2], and again [3] [2].' || chr(10) || chr(10) || '**Sources:**' || chr(10) || lines || chr(10) END AS report FROM (SELECT DISTINCT question_id FROM f) LEFT JOIN s USING (question_id)""".replace("GROUP BY ALL),\ns AS", "GROUP BY question_id, source_id),\ns AS"),
    "numbered_context": f"""WITH {_HITS}, {_fused('f', 'hits')}, c AS (SELECT question_id, string_agg('[' || fused_rank || '] (source: ' || source_id || ')' || chr(10) || content, chr(10) || chr(10) ORDER BY fused_rank) AS a, string_agg('[' || fused_rank || '] ' || content, chr(10) || chr(10) ORDER BY fused_rank) AS g FROM f WHERE fused_rank <= 6 GROUP BY question_id)
SELECT question_id, sha256(a) AS context_hash, sha256(g) AS grading_hash, sha256('Answer from the numbered sources alone and mark what you use, as [1].' || chr(10) || 'Question: ' || question_id || chr(10) || 'Sources:' || chr(10) || a) AS prompt_hash FROM c""",
    "retrieval_summary": f"""WITH {_HITS}, {_fused('f', 'hits')} SELECT item_id AS question_id, count(*) FILTER (WHERE path = 'vector') AS vector, count(*) FILTER (WHERE path = 'bm25') AS bm25, count(*) FILTER (WHERE path = 'web') AS web, (SELECT count(*) FROM f WHERE question_id = item_id) AS fused FROM benchmark LEFT JOIN hits ON question_id = item_id GROUP BY item_id""",
}
