"""A corpus pipeline over `documents`: each stage is one operator, reads what the last one kept and is a table.

STAGES: quality classifier, near duplicates, benchmark decontamination, personal data, encoding.
Rows with null ids or texts go through each stage as the operators' docstrings say; columns that the
stages don't know are handed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, jaccard_groups, personal_data, subword_classifier, template_leaks
from quern.llm.common import forget, keep_ids, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, doesn't reject."""
    return subword_classifier.kept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component of near duplicates; null ids stay."""
    found = jaccard_groups.digest(docs)
    gone = written(found.where("component_id <> doc_id").select("doc_id").distinct(), "pipeline-duplicates")
    return keep_ids(docs, gone, "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, re-parameterised or not."""
    return template_leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return personal_data.without_personal_data(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and lang, where there are such columns, with token ids, their number and the decoded text."""
    keep = [c for c in ("doc_id", "source", "lang") if c in docs.columns]
    out = bpe.encoded(docs, bpe.vocabulary_path("word_bpe_49k.json"), keep)
    return out.select(*keep, F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("personal_data", redacted), ("encoding", encoded)]

#: SQL can't express the classifier, the components or the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in sf_dir."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            forget(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
