"""Queries on progress views, tasks, the cache, rates and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.common import constants, r6, table
from quern.functions import text as tx
from quern.operators import evaluate, report, tasks

#: What the five kinds of events stand for in the queries below.
NODES = [("signup", "route_query"), ("view", "retrieve_vector"), ("click", "retrieve_bm25"), ("purchase", "grade_and_score"), ("error", "synthesize_answer")]
_NODES_SQL = "n(event_type, node) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in NODES) + ")"
#: A moment after all events, in seconds of Unix time.
NOW = 1_900_000_000


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def visits_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as visits: a user is a run, the value is the time that a step took."""
    nodes = constants(spark, NODES, "event_type string, node string")
    events = table(spark, sf_dir, "events").join(nodes, "event_type")
    return report.visit_sequence(events.select(F.col("user_id").alias("run_id"), "ts", "event_id", "node", F.col("value").alias("latency_ms"), (F.col("event_id") % 2 == 0).alias("loading")), "run_id", ["ts", "event_id"])


def visit_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visits_of(spark, sf_dir).select("run_id", "event_id", "node", "seq")


def latency_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.latency_by_stage(visits_of(spark, sf_dir)).select("run_id", "stage_ord", "label", r6(F.col("latency_ms")).alias("latency_ms"))


def total_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run, in tenths; with whole numbers of thousandths, so that no order of adding shows."""
    whole = visits_of(spark, sf_dir).withColumn("v", F.round(F.col("latency_ms") * 1000).cast("long"))
    return whole.groupBy("run_id").agg(F.sum("v").alias("thousandths"), report.total_latency(F.floor(F.col("v") / 100) / 10).alias("total_ms"))


def formatted_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.floor(F.col("value") * 100)
    return table(spark, sf_dir, "events").select("event_id", tx.milliseconds(ms).alias("shown"))


def visits_by_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.visits_by_node(visits_of(spark, sf_dir))


def stage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.stage_status(visits_of(spark, sf_dir))


def stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events sent as frames, the last of which is cut off, and read again."""
    frame = F.concat(F.lit("event: progress\ndata: {\"node\": \""), F.col("event_type"), F.lit("\", \"seq\": "), F.col("event_id").cast("string"), F.lit("}\n\n"))
    sent = table(spark, sf_dir, "events").select("event_id", F.concat(frame, frame, F.lit("data: {\"node\": \"cut")).alias("body"))
    read = sent.select("event_id", F.posexplode(report.stream_events(F.col("body"), "node string, seq long")).alias("frame", "e"))
    return read.select("event_id", "frame", "e.node", "e.seq")


def task_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as updates of tasks: a user is a task; each kind of event sets its own fields."""
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    stage = F.when(kind == "signup", "queued").when(kind == "view", "parsing").when(kind == "click", "indexing").when(kind == "purchase", "indexed")
    message = F.when(kind != "error", F.concat(F.lit("message "), F.col("event_id").cast("string")))
    error = F.when(kind == "error", F.concat(F.lit("error "), F.col("event_id").cast("string")))
    return events.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), _seconds(F.col("ts")).alias("ts"), stage.alias("stage"), message.alias("message"), error.alias("error"), F.when(kind == "purchase", F.col("event_id") % 100).alias("indexed_chunks"))


def task_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = tasks.task_state(task_log(spark, sf_dir), ["stage", "message", "error", "indexed_chunks"])
    return state.select("task_id", "stage", "message", "error", "indexed_chunks", r6(F.col("created_at")).alias("created_at"), r6(F.col("updated_at")).alias("updated_at"))


def registry_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry's newest tasks; their number is the registry's feature."""
    first = task_log(spark, sf_dir).groupBy("task_id").agg(F.min("seq").alias("inserted"))
    return tasks.newest_tasks(first, "inserted")


def upload_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = tasks.task_state(task_log(spark, sf_dir), ["stage", "message", "error"])
    shown = state.withColumn("stage", F.coalesce("stage", F.lit("failed"))).withColumn("created_at", F.when(F.col("task_id") % 2 == 0, F.lit(float(NOW - 10))).otherwise(F.col("created_at")))
    return tasks.upload_status(shown, F.lit(float(NOW)))


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as writes, turns as requests: the key is the id modulo 997, and what a user wrote holds for a while."""
    key = lambda c: tx.cache_key("router", (c % 997).cast("string"), F.lit("topics"))
    log = table(spark, sf_dir, "events").select(key(F.col("user_id")).alias("key"), F.col("event_type").alias("value"), _seconds(F.col("ts")).alias("written_at"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, 10_000_000_000).otherwise(300).alias("ttl"))
    requests = table(spark, sf_dir, "conversations").select("conv_id", "turn", key(F.col("conv_id") * 7 + F.col("turn")).alias("key"))
    return tasks.looked_up(requests, tasks.cache_state(log), F.lit(float(NOW))).select("conv_id", "turn", "key", "value", "hit")


def rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = tasks.request_rates(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", per_key=1, overall=3)
    return rates.select(F.unix_seconds("minute").alias("minute"), "user_id", "requests", "all_requests", "limited")


def route_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by rule: the source that a label expects, and those that its document and the next have."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("actual"), "lang")
    labels = table(spark, sf_dir, "labels").join(docs, "doc_id")
    results = labels.select("doc_id", F.when(F.col("lang") == "en", "vector").otherwise("web").alias("route"), F.when(F.col("quality") == 1, "vector").otherwise("web").alias("expected_route"), F.when(F.col("toxic") == 1, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")))).alias("expected_sources"), F.array("actual", F.lit("src1")).alias("actual_sources"))
    return evaluate.route_checks(results).select("doc_id", "route_match", "source_overlap")


def contexts_of(spark: SparkSession, sf_dir: str, bare: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each item is a question whose reference is its text; what was retrieved are all documents, and for two of three items their own text, changed a little.

    Texts are whole; bare ones lack characters beyond ASCII, so that characters and bytes are the same for every engine.
    """
    whole = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[^ -~]", "") if bare else F.coalesce(c, F.lit(""))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), whole(F.col("text")).alias("reference"))
    n = items.count()
    texts = table(spark, sf_dir, "documents").select((F.col("doc_id") % n).alias("question_id"), F.floor(F.col("doc_id") / n).alias("rank"), whole(F.col("text")).alias("retrieved"))
    own = items.where("question_id % 3 <> 0").select("question_id", F.lit(-1).cast("long").alias("rank"), F.concat(F.lit("seen: "), F.col("reference")).alias("retrieved"))
    return items.select("question_id"), items.select("question_id", F.lit(0).alias("ref_no"), "reference"), texts.unionByName(own)


def _recall(contexts: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    questions, refs, got = contexts
    return evaluate.context_recall(evaluate.context_pairs(got, refs), questions, refs).select("question_id", r6(F.col("recall")).alias("recall"))


def _precision(contexts: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    questions, refs, got = contexts
    return evaluate.context_precision(evaluate.context_pairs(got, refs), questions).select("question_id", r6(F.col("precision")).alias("precision"))


def context_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recall(contexts_of(spark, sf_dir, bare=True))


def context_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _precision(contexts_of(spark, sf_dir, bare=True))


def context_recall_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All characters count; engines that count bytes can't say this in SQL."""
    return _recall(contexts_of(spark, sf_dir, bare=False))


def context_precision_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As context_recall_whole."""
    return _precision(contexts_of(spark, sf_dir, bare=False))


def metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of numbers some of which aren't: NaN is skipped."""
    rows = table(spark, sf_dir, "labels").select(F.when(F.col("toxic") == 1, F.lit(float("nan"))).otherwise(F.col("quality").cast("double")).alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    means = evaluate.metric_means(rows, ["quality", "toxic"])
    cost = F.lit(evaluate.estimated_calls(13, judged=False)).alias("calls"), F.lit(evaluate.estimated_calls(13, judged=True)).alias("calls_judged")
    return means.select(r6(F.col("quality")).alias("quality"), r6(F.col("toxic")).alias("toxic"), *cost)


def question_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three user questions of each conversation, in order: a limit is by place, never by chance."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return listed.select("conv_id", F.posexplode(F.slice("t", 1, 3)).alias("line_no", "t")).select("conv_id", "line_no", "t.turn", F.sha2("t.text", 256).alias("question_hash"))


QUERIES = {f.__name__: f for f in (visit_sequence, latency_by_stage, total_latency, formatted_latency, visits_by_node, stage_status, stream_frames, task_state, registry_evict, upload_status, cache_lookup, rate_windows, route_match, context_recall, context_precision, context_recall_whole, context_precision_whole, metric_means, question_limit)}

_VISITS = f"WITH {_NODES_SQL}, v AS (SELECT user_id AS run_id, ts, event_id, node, value AS latency_ms, event_id % 2 = 0 AS loading, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events JOIN n USING (event_type))"
_STATE = """WITH l AS (SELECT user_id AS task_id, event_id AS seq, epoch_us(ts) / 1000000 AS ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'indexing' WHEN 'purchase' THEN 'indexed' END AS stage, CASE WHEN event_type <> 'error' THEN 'message ' || event_id END AS message, CASE WHEN event_type = 'error' THEN 'error ' || event_id END AS error, CASE WHEN event_type = 'purchase' THEN event_id % 100 END AS indexed_chunks FROM events),
s AS (SELECT task_id, arg_max(stage, seq) AS stage, arg_max(message, seq) AS message, arg_max(error, seq) AS error, arg_max(indexed_chunks, seq) AS indexed_chunks, round(min(ts), 6) AS created_at, round(max(ts), 6) AS updated_at FROM l GROUP BY task_id)
"""
_LABELS = "CASE WHEN node LIKE 'retrieve%' THEN 'Retrieval' WHEN node = 'route_query' THEN 'Route' WHEN node = 'grade_and_score' THEN 'Grading' WHEN node = 'synthesize_answer' THEN 'Synthesis' ELSE node END"
_KEY = "'v1:router:' || sha256(({0} % 997) || '|topics')"
_CONTEXTS = """WITH n AS MATERIALIZED (SELECT count(*) AS n FROM benchmark),
refs AS MATERIALIZED (SELECT item_id AS question_id, 0 AS ref_no, regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g') AS reference FROM benchmark),
got AS (SELECT doc_id % n AS question_id, doc_id // n AS rank, regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g') AS retrieved FROM documents, n UNION ALL SELECT question_id, -1, 'seen: ' || reference FROM refs WHERE question_id % 3 <> 0),
p AS MATERIALIZED (SELECT question_id, rank, ref_no, CASE WHEN least(length(retrieved), length(reference)) < 0.5 * greatest(length(retrieved), length(reference)) THEN 0.0 WHEN greatest(length(retrieved), length(reference)) = 0 THEN 1.0 ELSE 1 - levenshtein(retrieved, reference) / greatest(length(retrieved), length(reference)) END AS similarity FROM got JOIN refs USING (question_id))
"""

SQL = {
    "visit_sequence": _VISITS + " SELECT run_id, event_id, node, seq FROM v",
    "latency_by_stage": _VISITS + f", g AS (SELECT run_id, {_LABELS} AS label, sum(latency_ms) AS ms, min(seq) AS first FROM v GROUP BY run_id, {_LABELS}) SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY first) AS stage_ord, label, round(ms, 6) AS latency_ms FROM g",
    "total_latency": _VISITS + ", w AS (SELECT run_id, CAST(round(latency_ms * 1000) AS BIGINT) AS v FROM v) SELECT run_id, CAST(sum(v) AS BIGINT) AS thousandths, round(sum(v // 100) / 10, 1) AS total_ms FROM w GROUP BY run_id",
    "formatted_latency": """WITH m AS (SELECT event_id, floor(value * 100) AS ms, floor(value * 100) / 1000 AS q FROM events),
h AS (SELECT *, CAST(CASE WHEN ms % 10 = 5 THEN floor(ms / 10) + CASE WHEN ms - q * 1024 + q * 16 + q * 8 <= 0 THEN 1 ELSE 0 END ELSE floor(ms / 10 + 0.5) END AS BIGINT) AS n FROM m)
SELECT event_id, CASE WHEN ms >= 1000 THEN (n // 100) || '.' || lpad(CAST(n % 100 AS VARCHAR), 2, '0') || ' s' ELSE CAST(ms AS BIGINT) || ' ms' END AS shown FROM h""",
    "visits_by_node": _VISITS + " SELECT run_id, node, count(*) AS visits FROM v GROUP BY run_id, node",
    "stage_status": _VISITS + """, s AS (SELECT run_id, list(DISTINCT node) AS seen, arg_max(node, seq) AS last, arg_max(loading, seq) AS loading FROM v GROUP BY run_id),
st(stage, nodes) AS (VALUES ('route_query', ['route_query']), ('decompose_query', ['decompose_query']), ('retrieve', ['retrieve_vector', 'retrieve_bm25', 'web_search']), ('fuse_results', ['fuse_results']), ('grade_and_score', ['grade_and_score']), ('corrective_web_search', ['corrective_web_search']), ('synthesize_answer', ['synthesize_answer']), ('format_report', ['format_report']))
SELECT run_id, stage, CASE WHEN list_has_any(nodes, seen) THEN CASE WHEN loading AND list_contains(nodes, last) THEN 'active' ELSE 'done' END WHEN stage = 'corrective_web_search' AND list_contains(seen, 'grade_and_score') AND list_contains(seen, 'synthesize_answer') THEN 'skipped' ELSE 'pending' END AS status FROM s, st""",
    "stream_frames": "SELECT event_id, frame, event_type AS node, event_id AS seq FROM events, range(2) r(frame)",
    "task_state": _STATE + "SELECT * FROM s",
    "registry_evict": "SELECT user_id AS task_id, min(event_id) AS inserted FROM events GROUP BY user_id ORDER BY inserted DESC LIMIT 500",
    "upload_status": _STATE + f", t AS (SELECT task_id, coalesce(stage, 'failed') AS stage, message, error, CASE WHEN task_id % 2 = 0 THEN {NOW - 10} ELSE created_at END AS created_at FROM s), u AS (SELECT *, stage NOT IN ('indexed', 'failed') AND {NOW} - created_at > 300 AS late FROM t) SELECT task_id, CASE WHEN late THEN 'failed' ELSE stage END AS stage, CASE WHEN late THEN 'Timed out waiting for indexing to finish.' WHEN stage = 'failed' THEN coalesce(error, message) ELSE message END AS message FROM u",
    "cache_lookup": f"""WITH l AS (SELECT {_KEY.format('user_id')} AS key, event_type AS value, epoch_us(ts) / 1000000 AS w, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 10000000000 ELSE 300 END AS ttl FROM events),
c AS (SELECT key, value, w + ttl AS expires_at FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY w DESC, seq DESC) = 1),
r AS (SELECT conv_id, turn, {_KEY.format('(conv_id * 7 + turn)')} AS key FROM conversations)
SELECT conv_id, turn, r.key, value, value IS NOT NULL AS hit FROM r LEFT JOIN (SELECT * FROM c WHERE expires_at > {NOW}) c ON r.key = c.key""",
    "rate_windows": "WITH m AS (SELECT epoch(date_trunc('minute', ts))::BIGINT AS minute, user_id, count(*) AS requests FROM events GROUP BY ALL), a AS (SELECT *, CAST(sum(requests) OVER (PARTITION BY minute) AS BIGINT) AS all_requests FROM m) SELECT minute, user_id, requests, all_requests, requests > 1 OR all_requests > 3 AS limited FROM a",
    "route_match": "SELECT doc_id, (CASE WHEN lang = 'en' THEN 'vector' ELSE 'web' END) = (CASE WHEN quality = 1 THEN 'vector' ELSE 'web' END) AS route_match, toxic <> 1 AND ('src' || doc_id % 20) IN (source, 'src1') AS source_overlap FROM labels JOIN documents USING (doc_id)",
    "context_recall": _CONTEXTS + ", b AS (SELECT question_id, ref_no, max(similarity) AS best FROM p GROUP BY ALL) SELECT question_id, round(avg(CASE WHEN best > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS recall FROM refs LEFT JOIN b USING (question_id, ref_no) GROUP BY question_id",
    "context_precision": _CONTEXTS + ", v AS (SELECT question_id, rank, CASE WHEN max(similarity) >= 0.5 THEN 1.0 ELSE 0.0 END AS v FROM p GROUP BY question_id, rank), a AS (SELECT question_id, v, v * sum(v) OVER w / count(*) OVER w AS p FROM v WINDOW w AS (PARTITION BY question_id ORDER BY rank)), m AS (SELECT question_id, sum(p) / (sum(v) + 1e-10) AS precision FROM a GROUP BY question_id) SELECT r.question_id, round(precision, 6) AS precision FROM refs r LEFT JOIN m USING (question_id)",
    "question_limit": "SELECT conv_id, line_no, turn, sha256(text) AS question_hash FROM (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS INT) AS line_no FROM conversations WHERE role = 'user') WHERE line_no < 3",
    "metric_means": "SELECT round(avg(quality) FILTER (WHERE toxic <> 1), 6) AS quality, round(avg(toxic), 6) AS toxic, 52 AS calls, 78 AS calls_judged FROM labels",
}
