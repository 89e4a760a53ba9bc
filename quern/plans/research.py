"""The whole way from questions to reports, for a set of questions at once.

Route, decompose, fan out, retrieve by three paths, fuse, grade, correct once where confidence is low,
answer, report. The one corrective pass is unrolled: its hits are added to the first ones, and what
needs none keeps the result it has.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import schemas
from quern.common import fits
from quern.functions.text import cache_key, cleaned_question, question_error
from quern.operators import decisions, dense, fusion, ingest, lexical, report, tasks
from quern.settings import DEFAULTS, Settings
from quern.sources.web import searched_pages


@dataclass(frozen=True)
class Providers:
    """What may call a model, several of each, the first that doesn't fail counts; where none is given or all fail, the rules decide.

    router: (question, topics) to a route; decomposer: (question,) to a list of questions; grader: (question, content) to
    {"relevant", "score"}; synthesizer: (prompt,) to an answer. Each gets a batch of them as a list. Routes and answers go
    through the cache `log` (see operators.tasks) as of `now`: only what isn't live there is asked for.
    """

    router: Sequence[Callable[[list[tuple]], list]] = ()
    decomposer: Sequence[Callable[[list[tuple]], list]] = ()
    grader: Sequence[Callable[[list[tuple]], list]] = ()
    synthesizer: Sequence[Callable[[list[tuple]], list]] = ()
    log: DataFrame | None = None
    now: float = 0.0


@dataclass(frozen=True)
class Research:
    questions: DataFrame
    hits: DataFrame
    fused: DataFrame
    grades: DataFrame
    reports: DataFrame
    summary: DataFrame
    #: Rows to add to the cache's log.
    writes: tuple[DataFrame, ...] = ()
    #: Tables that are kept while the plan's results are in use.
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


def _asked(retrievals: DataFrame, path: str) -> DataFrame:
    """The retrievals of one path, with a number for each sub-query; no question has more of them than the factor."""
    most = retrievals.agg(F.max("sub_query_ord")).first()[0] or 0
    return retrievals.where(F.col("path") == path).withColumn("query_id", F.col("question_id") * (most + 1) + F.col("sub_query_ord"))


def _hits(asked: DataFrame, found: DataFrame) -> DataFrame:
    keys = asked.select("query_id", "question_id", "path", "path_ord", "sub_query_ord", "sub_query")
    return keys.join(found, "query_id").select("question_id", "path", "path_ord", "sub_query_ord", "sub_query", "rank", "content", "source_id")


def retrieved_web(retrievals: DataFrame, pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    asked = _asked(retrievals, "web")
    return _hits(asked, searched_pages(asked.select("query_id", F.col("sub_query").alias("query")), pages, settings.web_results).withColumnRenamed("url", "source_id"))


def retrieved_local(retrievals: DataFrame, chunks: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Hits by vector and by words of all retrievals (question_id, sub_query_ord, sub_query, path, path_ord).

    Chunks (chunk_id, chunk_ord, source, content) are searched by id; contents are joined to what is found.
    """
    local = chunks.select("chunk_id", "content", F.col("source").alias("source_id"))
    lex, vec = _asked(retrievals, "bm25"), _asked(retrievals, "vector")
    by_words = lexical.search(lex.select("query_id", F.col("sub_query").alias("query")), chunks, settings.top_k, settings)
    asked = dense.hash_embeddings(vec.select("query_id", "sub_query"), "query_id", "sub_query")
    stored = dense.hash_embeddings(chunks, "chunk_id", "content").select(F.col("chunk_id").alias("id"), "embedding")
    by_vector = dense.search(asked, stored, settings.top_k).withColumnRenamed("id", "chunk_id")
    # Every sub-query finds top_k at most.
    sent = F.broadcast if fits(retrievals, settings.broadcast_rows // settings.top_k) else lambda df: df
    found = [_hits(a, local.join(sent(f.select("query_id", "rank", "chunk_id")), "chunk_id")) for a, f in ((vec, by_vector), (lex, by_words))]
    return found[0], found[1]


def _through(df: DataFrame, key: Column, name: str, inputs: list[str], makers: Sequence[Callable], providers: Providers, ttl: int) -> tuple[DataFrame, list[DataFrame]]:
    """df with `name`, a string from the cache or from the first of makers that doesn't fail; null where all fail. And the cache's new rows."""
    keyed = df.withColumn("key", key)

    def compute(missing: DataFrame) -> DataFrame:
        once = keyed.join(missing, "key", "left_semi").select("key", *inputs).dropDuplicates(["key"])
        return decisions.provided(once, inputs, makers, "value", "string").select("key", "value").where("value IS NOT NULL")

    if providers.log is None:
        return decisions.provided(df, inputs, makers, name, "string"), []
    answered, writes = tasks.through_cache(keyed.select("key").distinct(), providers.log, compute, providers.now, ttl)
    return keyed.join(answered.withColumnRenamed("value", name), "key", "left").drop("key"), [writes]


def _steps(questions: DataFrame, chunks: DataFrame, pages: DataFrame, manifest: DataFrame, settings: Settings, providers: Providers) -> Generator[tuple[str, DataFrame], None, Research]:
    """The plan step by step: each step's name and table, none of which has run yet."""
    held: list[DataFrame] = []
    writes: list[DataFrame] = []

    # With providers the logical plan is too large to carry on from step to step: it is cut where there is a folder for that.
    sc = questions.sparkSession.sparkContext
    cut = any((providers.router, providers.decomposer, providers.grader, providers.synthesizer)) and (sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir())

    def hold(df: DataFrame) -> DataFrame:
        if cut:
            return df.checkpoint()
        held.append(df.cache())
        return held[-1]

    valid = questions.where(question_error(F.col("question"), settings.question_chars).isNull()).select("question_id", cleaned_question(F.col("question")).alias("question"))
    asked = decisions.routed_by(valid, decisions.topic_words(manifest), settings)
    if providers.router:
        # Only a prompt has all topics in one text; it is as long as a model can read.
        said = asked.crossJoin(F.broadcast(ingest.corpus_topics(manifest)))
        said, more = _through(said, cache_key("router", F.concat_ws("|", "question", "topics")), "__route", ["question", "topics"], providers.router, providers, settings.route_ttl)
        writes += more
        good = F.col("__route").isin(*schemas.ROUTES)
        asked = said.withColumn("reasoning", F.when(good, "model").otherwise(F.col("reasoning"))).withColumn("route", F.when(good, F.col("__route")).otherwise(F.col("route"))).drop("__route", "topics")
    asked = asked.withColumn("sub_queries", decisions.sub_queries(F.col("question")))
    if providers.decomposer:
        made = decisions.provided(asked, ["question"], providers.decomposer, "__parts", "array<string>")
        asked = made.withColumn("sub_queries", F.when(F.size("__parts") > 0, F.col("__parts")).otherwise(F.col("sub_queries"))).drop("__parts")
    asked = hold(asked)

    def grades_of(fused: DataFrame) -> DataFrame:
        if not providers.grader:
            return decisions.graded(fused, asked, settings)
        first = fused.where(F.col("fused_rank") <= settings.graded).join(asked.select("question_id", "question"), "question_id")
        made = decisions.provided(first, ["question", "content"], providers.grader, "__g", "struct<relevant:boolean,score:double>")
        return decisions.checked_grades(fused, made.where("__g IS NOT NULL").select("question_id", "fused_rank", "__g.relevant", "__g.score"), settings)

    yield "route_query", asked.select("question_id", "route")
    yield "decompose_query", asked.select("question_id", "sub_queries")
    retrievals = fusion.fan_out(asked)
    by_vector, by_words = (hold(x) for x in retrieved_local(retrievals, chunks, settings))
    by_web = hold(retrieved_web(retrievals, pages, settings))
    yield "retrieve_vector", by_vector
    yield "retrieve_bm25", by_words
    yield "web_search", by_web
    first = fusion.all_hits(by_vector, by_words, by_web)
    fused = fusion.fused(first, settings.rrf_k)
    yield "fuse_results", fused
    state = hold(decisions.gate(asked.withColumn("correction_attempted", F.lit(False)), grades_of(fused), settings))
    yield "grade_and_score", state
    # The corrective pass: the web, for every sub-query of the questions that need it.
    needed = state.where("needs_correction")
    again = hold(retrieved_web(fusion.fan_out(needed.withColumn("route", F.lit("web"))), pages, settings))
    yield "corrective_web_search", again
    hits = first.unionByName(again)
    fused = hold(fusion.fused(hits, settings.rrf_k))
    yield "fuse_results", fused
    grades = grades_of(fused)
    done = decisions.gate(state.select("question_id", "question", "route", "reasoning", "sub_queries", F.col("needs_correction").alias("correction_attempted")), grades, settings)
    yield "grade_and_score", done
    answers = report.extracted_answers(fused, asked)
    if providers.synthesizer:
        listed = fused.groupBy("question_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("fused_rank", "source_id", "content"))), lambda x: F.struct(x["source_id"].alias("source_id"), x["content"].alias("content"))).alias("__docs"))
        said = answers.join(asked.select("question_id", "question", "route"), "question_id").join(listed, "question_id", "left")
        filled = {"question": F.col("question"), "context": F.when(F.col("__docs").isNotNull(), report.numbered_context(F.col("__docs")))}
        template = F.when(F.col("route") == "none", decisions.rendered(decisions.GENERAL_PROMPT, **filled)).when(F.col("__docs").isNull(), decisions.rendered(decisions.NO_SOURCES_PROMPT, **filled))
        said = said.withColumn("__prompt", template.otherwise(decisions.rendered(decisions.ANSWER_PROMPT, **filled))).select(*answers.columns, "__prompt")
        said, more = _through(said, cache_key("answer", F.col("__prompt")), "__said", ["__prompt"], providers.synthesizer, providers, settings.answer_ttl)
        writes += more
        answers = said.withColumn("answer", F.coalesce("__said", "answer")).select(*answers.columns)
    yield "synthesize_answer", answers
    reports = answers.withColumn("report", report.report_text(F.col("answer"), F.col("citations")))
    yield "format_report", reports
    summary = done.select("question_id", "route", "sub_queries", "confidence", "correction_attempted").join(report.retrieval_counts(asked, hits, fused), "question_id")
    return Research(done, hits, fused, grades, reports, summary, tuple(writes), tuple(held))


def research(questions: DataFrame, chunks: DataFrame, pages: DataFrame, manifest: DataFrame, settings: Settings = DEFAULTS, providers: Providers = Providers()) -> Research:
    """questions: question_id, question. Refused ones (see question_error) are left out; release() the result when it is done with."""
    steps = _steps(questions, chunks, pages, manifest, settings, providers)
    while True:
        try:
            next(steps)
        except StopIteration as end:
            return end.value


@dataclass(frozen=True)
class Event:
    """One of progress (a step has run), done, error: the last of a stream is done or error."""

    kind: str
    node: str | None = None
    latency_ms: float | None = None
    rows: int | None = None
    message: str | None = None
    result: Research | None = None


def events(questions: DataFrame, chunks: DataFrame, pages: DataFrame, manifest: DataFrame, settings: Settings = DEFAULTS, deadline: float = 45.0, providers: Providers = Providers()) -> Iterator[Event]:
    """The plan as it goes: each step is run before the next is begun, and timed. The deadline is for all steps."""
    began, steps = time.monotonic(), _steps(questions, chunks, pages, manifest, settings, providers)
    try:
        while True:
            at = time.monotonic()
            try:
                node, df = next(steps)
            except StopIteration as end:
                yield Event("done", result=end.value)
                return
            rows = df.count()
            yield Event("progress", node, round((time.monotonic() - at) * 1000, 1), rows)
            if time.monotonic() - began > deadline:
                yield Event("error", message="deadline passed")
                return
    except Exception as e:  # noqa: BLE001  a stream ends with an event, not with a traceback
        yield Event("error", message=str(e))
