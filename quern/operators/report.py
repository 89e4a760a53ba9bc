"""Answers with citations, reports, summaries, and what a progress view shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.common import constants
from quern.functions.text import markers

#: The stage that each step of the plan is shown under.
STAGE_LABELS = {
    "route_query": "Route",
    "decompose_query": "Decompose",
    "retrieve_vector": "Retrieval",
    "retrieve_bm25": "Retrieval",
    "web_search": "Retrieval",
    "fuse_results": "Fusion",
    "grade_and_score": "Grading",
    "corrective_web_search": "Corrective Search",
    "synthesize_answer": "Synthesis",
    "format_report": "Formatting",
}
STAGES = ("route_query", "decompose_query", "retrieve", "fuse_results", "grade_and_score", "corrective_web_search", "synthesize_answer", "format_report")
RETRIEVAL = ("retrieve_vector", "retrieve_bm25", "web_search")


def numbered_context(documents: Column, with_source: bool = True) -> Column:
    """The documents (structs of content and source_id, in order) as numbered passages."""
    said = lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), *((F.lit("(source: "), x["source_id"], F.lit(")\n")) if with_source else ()), x["content"])
    return F.array_join(F.transform(documents, said), "\n\n")


def extracted_answers(fused: DataFrame, questions: DataFrame, sentences: int = 3) -> DataFrame:
    """question_id, answer, citations: the first sentence of each of the top documents, with its marker.

    Every fused document is cited; without documents the answer says that there are none, or, on the
    route none, that no sources were asked for. A question's fused documents are bounded by the hits.
    """
    listed = F.sort_array(F.collect_list(F.struct("fused_rank", "source_id", F.regexp_extract("content", r"^\s*([^.!?\n]*[.!?]?)", 1).alias("first"))))
    per = fused.groupBy("question_id").agg(listed.alias("__docs"))
    marker = lambda x: F.concat(F.lit("["), x["fused_rank"].cast("string"), F.lit("]"))
    said = F.array_join(F.transform(F.slice("__docs", 1, sentences), lambda x: F.concat(x["first"], F.lit(" "), marker(x))), " ")
    none = F.when(F.col("route") == "none", "Answered without sources.").otherwise("No sources were found for this question.")
    out = questions.join(per, "question_id", "left")
    cited = F.coalesce(F.transform("__docs", lambda x: F.struct(marker(x).alias("marker"), x["source_id"].alias("source_id"))), F.array().cast("array<struct<marker:string,source_id:string>>"))
    return out.select("question_id", F.when(F.col("__docs").isNull(), none).otherwise(said).alias("answer"), cited.alias("citations"))


def report_text(answer: Column, citations: Column) -> Column:
    """The answer and, if it uses any, its sources: one line per source, its markers first, in order of first use."""
    used = F.filter(citations, lambda c: F.array_contains(markers(answer), c["marker"]))
    sources = F.array_distinct(F.transform(used, lambda c: c["source_id"]))
    line = lambda s: F.concat(F.lit("- "), F.array_join(F.transform(F.filter(used, lambda c: c["source_id"] == s), lambda c: c["marker"]), ""), F.lit(" "), s)
    body = F.concat(answer, F.lit("\n\n**Sources:**\n"), F.array_join(F.transform(sources, line), "\n"), F.lit("\n"))
    return F.when(F.size(used) > 0, body).otherwise(F.concat(answer, F.lit("\n")))


def retrieval_counts(questions: DataFrame, hits: DataFrame, fused: DataFrame) -> DataFrame:
    """question_id, vector, bm25, web (hits before fusion) and fused (documents after it); zeros where there are none."""
    by_path = hits.groupBy("question_id").agg(*[F.count_if(F.col("path") == p).alias(p) for p in ("vector", "bm25", "web")])
    documents = fused.groupBy("question_id").agg(F.count(F.lit(1)).alias("fused"))
    out = questions.select("question_id").join(by_path, "question_id", "left").join(documents, "question_id", "left")
    return out.na.fill(0, ["vector", "bm25", "web", "fused"])


def total_latency(ms: Column) -> Column:
    """Sum to one decimal, half to even; 0.0 without any."""
    return F.bround(F.coalesce(F.sum(ms), F.lit(0.0)), 1)


def latency_by_stage(timings: DataFrame, run: str = "run_id") -> DataFrame:
    """run, stage_ord, label, latency_ms: timings (run, seq, node, latency_ms) summed by stage, in order of first sight."""
    labels = constants(timings.sparkSession, list(STAGE_LABELS.items()), "node string, label string")
    named = timings.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    summed = named.groupBy(run, "label").agg(F.sum("latency_ms").alias("latency_ms"), F.min("seq").alias("__first"))
    return summed.select(run, F.row_number().over(Window.partitionBy(run).orderBy("__first")).alias("stage_ord"), "label", "latency_ms")


def visits_by_node(visits: DataFrame, run: str = "run_id") -> DataFrame:
    return visits.groupBy(run, "node").agg(F.count(F.lit(1)).alias("visits"))


def visit_sequence(events: DataFrame, run: str, order: list[str]) -> DataFrame:
    """events with seq: 1, 2, ... per run. A run is one question's steps, so its window is short."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(run).orderBy(*order)))


def stage_status(visits: DataFrame, run: str = "run_id") -> DataFrame:
    """run, stage, status for all stages: pending, active, done or skipped.

    visits: run, seq, node, loading. The corrective search is skipped if grading and synthesis were
    seen without it; the stage of the latest visit is active while loading.
    """
    state = visits.groupBy(run).agg(F.collect_set("node").alias("__seen"), F.max_by("node", "seq").alias("__last"), F.max_by("loading", "seq").alias("__loading"))
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), F.array(*map(F.lit, RETRIEVAL if s == "retrieve" else (s,))).alias("nodes")) for s in STAGES])
    each = state.select(run, "__seen", "__last", "__loading", F.inline(stages))
    seen = F.arrays_overlap("nodes", "__seen")
    latest = F.array_contains(F.col("nodes"), F.col("__last")) & F.col("__loading")
    skipped = (F.col("stage") == "corrective_web_search") & F.array_contains("__seen", "grade_and_score") & F.array_contains("__seen", "synthesize_answer")
    return each.select(run, "stage", F.when(seen & latest, "active").when(seen, "done").when(skipped, "skipped").otherwise("pending").alias("status"))


def stream_events(frames: Column, schema: str) -> Column:
    """The events in a body of server-sent frames: the data line of each complete frame, parsed."""
    complete = F.slice(F.split(frames, "\n\n"), 1, F.greatest(F.size(F.split(frames, "\n\n")) - 1, F.lit(0)))
    line = lambda f: F.get(F.filter(F.split(f, "\n"), lambda x: x.startswith("data: ")), F.lit(0))
    data = F.filter(F.transform(complete, line), lambda x: x.isNotNull())
    return F.transform(data, lambda x: F.from_json(F.substring(x, 7, 1 << 30), schema))
