"""Decision and generation steps, as expressions that need no model, or through providers that may call one.

A provider is a function from a list of inputs to a list of outputs, run on the executors with one call
per batch; the first of several that doesn't fail is used, and a step has a defined result when all fail.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.common import bounded
from quern.functions.text import stripped, tokens, topic
from quern.settings import DEFAULTS, Settings

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RECENT = ("today", "latest", "current", "currently", "now", "recent", "recently", "news", "yesterday", "tomorrow")
SMALL_TALK = ("hello", "hi", "hey", "thanks", "thank", "bye", "goodbye")

ROUTER_PROMPT = "Choose vector, web, both or none for the question.\nLocal topics: {topics}\nQuestion: {question}"
DECOMPOSE_PROMPT = "Split the question into two to five questions that can be searched apart, or return it alone.\nQuestion: {question}"
GRADING_PROMPT = "Say of each passage whether it helps to answer the question, and how sure you are.\nQuestion: {question}\nPassages:\n{context}"
ANSWER_PROMPT = "Answer from the numbered sources alone and mark what you use, as [1].\nQuestion: {question}\nSources:\n{context}"
NO_SOURCES_PROMPT = "Nothing was found. Say so, and don't answer from memory.\nQuestion: {question}"
GENERAL_PROMPT = "Answer briefly from general knowledge.\nQuestion: {question}"


def rendered(template: str, **values: Column) -> Column:
    """The template with {name} filled in for each value, null as nothing; braces within values are left alone."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(values[p], F.lit("")) if i % 2 and p in values else F.lit(f"{{{p}}}" if i % 2 else p) for i, p in enumerate(parts)])


def routed(questions: DataFrame, topics: Column) -> DataFrame:
    """questions with route and reasoning, by rules, for topics that are one text."""
    return _by_rules(questions, F.arrays_overlap(_long(F.col("question")), _long(topics)))


def topic_words(manifest: DataFrame) -> DataFrame:
    """word: the distinct words of more than three letters in what the sources are about."""
    return manifest.select(F.explode(_long(topic(F.col("source")))).alias("word")).distinct()


def routed_by(questions: DataFrame, words: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """As routed(), for a table of topic words: questions' words meet them, and no text of all topics is made. question_id is the key."""
    asked = questions.select("question_id", F.explode(F.array_distinct(_long(F.col("question")))).alias("word"))
    local = asked.join(bounded(words, settings.broadcast_rows), "word", "left_semi").select("question_id").distinct().withColumn("__local", F.lit(True))
    return _by_rules(questions.join(local, "question_id", "left"), F.coalesce("__local", F.lit(False))).drop("__local")


def _long(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: F.length(t) > 3)


def _by_rules(questions: DataFrame, local: Column) -> DataFrame:
    """none for small talk; web for what asks for news; vector for what shares a word with the topics; both
    if it is both, or neither.
    """
    asked = tokens(F.col("question"))
    recent = F.arrays_overlap(asked, F.array(*map(F.lit, RECENT)))
    chat = (F.size(asked) <= 3) & F.arrays_overlap(asked, F.array(*map(F.lit, SMALL_TALK)))
    route = F.when(chat, "none").when(recent & local, "both").when(recent, "web").when(local, "vector").otherwise("both")
    why = F.when(chat, "small talk").when(recent & local, "recent and local").when(recent, "recent").when(local, "local topic").otherwise("unknown topic")
    return questions.withColumn("route", route).withColumn("reasoning", why)


def sub_queries(question: Column) -> Column:
    """The questions within a question, all of them: cut at question marks, semicolons and `and` before a question word."""
    cut = F.split(question, r"(?i)\?\s+|;\s*|,?\s+and\s+(?=(?:who|what|when|where|why|how|which)\b)")
    parts = F.filter(F.transform(cut, stripped), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(question))


def graded(fused: DataFrame, questions: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """question_id, fused_rank, relevant, score for the first documents of each question.

    The score is the share of the question's distinct tokens that the document has; from a third on it is
    relevant. Documents without tokens to share score 0.
    """
    first = fused.where(F.col("fused_rank") <= settings.graded)
    asked = F.array_distinct(tokens(F.col("question")))
    both = first.join(questions.select("question_id", asked.alias("__asked")), "question_id")
    share = F.size(F.array_intersect("__asked", tokens(F.col("content")))) / F.greatest(F.size("__asked"), F.lit(1))
    return both.select("question_id", "fused_rank", (share >= 1 / 3).alias("relevant"), share.alias("score"))


def checked_grades(fused: DataFrame, grades: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Grades by place: where a question's grades aren't one per document, every document is relevant with 1.0."""
    first = fused.where(F.col("fused_rank") <= settings.graded).select("question_id", "fused_rank")
    n = Window.partitionBy("question_id")
    counted = first.withColumn("__n", F.count(F.lit(1)).over(n)).join(grades.withColumn("__g", F.count(F.lit(1)).over(n)), ["question_id", "fused_rank"], "left")
    # A question's first documents are few (settings.graded), so this window is too.
    fits = F.coalesce(F.min(F.coalesce("__g", F.lit(-1))).over(n) == F.col("__n"), F.lit(False))
    return counted.select("question_id", "fused_rank", F.when(fits, F.col("relevant")).otherwise(F.lit(True)).alias("relevant"), F.when(fits, F.col("score")).otherwise(F.lit(1.0)).alias("score"))


def gate(questions: DataFrame, grades: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """questions with confidence (mean score of relevant grades, 0.0 without any) and needs_correction.

    questions: question_id, route, correction_attempted. Correction is for low confidence on the vector route, once.
    """
    mean = grades.groupBy("question_id").agg(F.avg(F.when(F.col("relevant"), F.col("score"))).alias("__mean"))
    out = questions.join(mean, "question_id", "left").withColumn("confidence", F.coalesce("__mean", F.lit(0.0))).drop("__mean")
    return out.withColumn("needs_correction", (F.col("confidence") < settings.confidence) & (F.col("route") == "vector") & ~F.col("correction_attempted"))


def provided(df: DataFrame, inputs: Sequence[str], providers: Sequence[Callable[[list[tuple]], list]], output: str, kind: str, otherwise: object = None) -> DataFrame:
    """df with `output` (of the SQL type kind), from the first provider that gives one value per row.

    Providers get the input columns of one batch at a time; if all fail on it, its rows get `otherwise`.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_type(_parse_datatype_string(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs), strict=True))
            values = [otherwise] * len(rows)
            for provider in providers:
                try:
                    got = list(provider(rows))
                except Exception:  # noqa: BLE001  the next provider's turn
                    continue
                if len(got) == len(rows):
                    values = got
                    break
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow)], names=[*batch.schema.names, output])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, `{output}` {kind}")
