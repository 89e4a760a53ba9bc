"""Reciprocal rank fusion of hit lists, and what comes before and after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.common import constants
from quern.functions.text import content_hash
from quern.settings import DEFAULTS

#: Order in which the paths' lists are fused.
PATHS = {"vector": 0, "bm25": 1, "web": 2}


def fan_out(questions: DataFrame) -> DataFrame:
    """question_id, sub_query_ord, sub_query, path for every retrieval of routed, decomposed questions.

    questions: question_id, question, route, sub_queries. Without sub-queries the question stands for itself.
    """
    routes = [("vector", "vector", 0), ("vector", "bm25", 1), ("web", "web", 2), ("both", "vector", 0), ("both", "bm25", 1), ("both", "web", 2)]
    paths = constants(questions.sparkSession, routes, "route string, path string, path_ord int")
    asked = F.when(F.size("sub_queries") > 0, F.col("sub_queries")).otherwise(F.array("question"))
    return questions.select("question_id", "route", F.posexplode(asked).alias("sub_query_ord", "sub_query")).join(paths, "route").drop("route")


def fused(hits: DataFrame, k: int = DEFAULTS.rrf_k) -> DataFrame:
    """question_id, fused_rank, content_hash, content, source_id, rrf_score.

    hits: question_id, path_ord, sub_query_ord, rank, content, source_id. Each hit votes 1 / (k + rank) for
    its content; equal contents are one document, with the source of their first hit. Contents travel
    once: the votes are summed under their hashes, and ties keep the order of first sight.
    """
    seen = F.struct("path_ord", "sub_query_ord", "rank")
    votes = hits.withColumn("content_hash", content_hash(F.col("content"))).withColumn("__seen", seen)
    summed = votes.groupBy("question_id", "content_hash").agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("rrf_score"), F.min("__seen").alias("__first"), F.min_by(F.struct("content", "source_id"), "__seen").alias("__doc"))
    order = Window.partitionBy("question_id").orderBy(F.round("rrf_score", 9).desc(), "__first")
    return summed.select("question_id", F.row_number().over(order).alias("fused_rank"), "content_hash", "__doc.content", "__doc.source_id", "rrf_score")


def all_hits(*lists: DataFrame) -> DataFrame:
    """The hit lists of all paths in one table; each says its path."""
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out
