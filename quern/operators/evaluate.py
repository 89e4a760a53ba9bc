"""Evaluation of answers against golden questions, without a model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.settings import DEFAULTS

if TYPE_CHECKING:
    from quern.plans.research import Research


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length, in characters; two empty texts are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def context_pairs(retrieved: DataFrame, references: DataFrame, least: float = 0.5) -> DataFrame:
    """question_id, rank, ref_no, similarity of a question's retrieved contexts and references: both are short lists.

    Texts whose lengths alone keep them below `least` aren't compared: their similarity is 0.
    """
    both = retrieved.join(references, "question_id")
    a, b = F.length("retrieved"), F.length("reference")
    near = F.least(a, b) >= F.lit(least) * F.greatest(a, b)
    return both.select("question_id", "rank", "ref_no", F.when(near, similarity(F.col("retrieved"), F.col("reference"))).otherwise(0.0).alias("similarity"))


def context_recall(pairs: DataFrame, questions: DataFrame, references: DataFrame, least: float = 0.5) -> DataFrame:
    """question_id, recall: the share of references that some retrieved context is similar to (above least); null without references."""
    found = pairs.groupBy("question_id", "ref_no").agg(F.max("similarity").alias("best"))
    hit = references.select("question_id", "ref_no").join(found, ["question_id", "ref_no"], "left").withColumn("__hit", F.coalesce((F.col("best") > least).cast("double"), F.lit(0.0)))
    return questions.select("question_id").join(hit.groupBy("question_id").agg(F.avg("__hit").alias("recall")), "question_id", "left")


def context_precision(pairs: DataFrame, questions: DataFrame, least: float = 0.5) -> DataFrame:
    """question_id, precision: mean precision at the ranks of contexts that are similar to some reference (least or more)."""
    verdict = pairs.groupBy("question_id", "rank").agg((F.max("similarity") >= least).cast("double").alias("__v"))
    w = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    at = verdict.withColumn("__p", F.sum("__v").over(w) / F.count("__v").over(w) * F.col("__v"))
    mean = at.groupBy("question_id").agg((F.sum("__p") / (F.sum("__v") + 1e-10)).alias("precision"))
    return questions.select("question_id").join(mean, "question_id", "left")


def route_checks(results: DataFrame) -> DataFrame:
    """results with route_match and source_overlap (false if no source was expected)."""
    overlap = F.coalesce(F.arrays_overlap("expected_sources", "actual_sources"), F.lit(False))
    return results.withColumn("route_match", F.col("route").eqNullSafe(F.col("expected_route"))).withColumn("source_overlap", overlap)


def metric_means(results: DataFrame, metrics: list[str]) -> DataFrame:
    """The mean of every metric over the rows that have a number."""
    return results.agg(*[F.avg(F.nanvl(F.col(m), F.lit(None).cast("double"))).alias(m) for m in metrics])


def estimated_calls(questions: int, judged: bool) -> int:
    """Model calls that an evaluation makes: four per question, two more with a judge."""
    return questions * (6 if judged else 4)


@dataclass(frozen=True)
class Evaluation:
    """results: one row per question, with its checks and metrics; metrics: their means, in one row."""

    results: DataFrame
    metrics: DataFrame

    def write(self, path: str) -> None:
        """results and metrics as JSON lines, in folders of these names."""
        self.results.write.mode("overwrite").json(f"{path}/results")
        self.metrics.write.mode("overwrite").json(f"{path}/metrics")


def run_eval(golden: DataFrame, run: Callable[[DataFrame], Research], limit: int | None = DEFAULTS.eval_questions) -> Evaluation:
    """The plan over golden questions (question_id by place in the file, and the columns of the golden set).

    run makes a Research of questions (question_id, question). The first `limit` questions by place are asked; a
    refused one has a row without route or numbers. Sources are those of all fused documents.
    """
    golden = golden if limit is None else golden.where(F.col("question_id") < limit)
    done = run(golden.select("question_id", "question"))
    fused = done.fused.select("question_id", F.col("fused_rank").alias("rank"), F.col("content").alias("retrieved"), "source_id")
    sources = fused.groupBy("question_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "source_id"))), lambda x: x["source_id"]).alias("actual_sources"))
    asked = golden.join(done.summary.select("question_id", "route", "confidence", "correction_attempted"), "question_id", "left").join(sources, "question_id", "left")
    asked = route_checks(asked.withColumn("actual_sources", F.coalesce("actual_sources", F.array().cast("array<string>"))))
    references = golden.select("question_id", F.posexplode("reference_contexts").alias("ref_no", "reference"))
    pairs = context_pairs(fused.drop("source_id"), references)
    results = asked.join(context_recall(pairs, golden, references).withColumnRenamed("recall", "context_recall"), "question_id").join(context_precision(pairs, golden).withColumnRenamed("precision", "context_precision"), "question_id")
    numbers = results.select(F.col("route_match").cast("double").alias("route_match"), F.col("source_overlap").cast("double").alias("source_overlap"), "context_recall", "context_precision")
    return Evaluation(results, metric_means(numbers, numbers.columns))
