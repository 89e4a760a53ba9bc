"""Streaming forms: files into the index, and live state of tasks and rates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.ingest import Index, IndexResult


def file_stream(spark: SparkSession, directory: str, files_per_batch: int = 1000) -> DataFrame:
    """New text files of a directory, as pages."""
    files = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.{md,txt}").text(directory, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("source"), F.lit(None).cast("int").alias("page"), F.lit(0).cast("long").alias("doc_ord"), F.replace("value", F.lit("\r\n"), F.lit("\n")).alias("content"))


def ingest_stream(pages: DataFrame, index: Index, checkpoint: str, on_batch: Callable[[int, IndexResult], None] | None = None) -> StreamingQuery:
    """Bring the index up to date with each batch of files; a batch that is run again changes nothing.

    Of a source that comes twice in a batch, all rows count as its pages.
    """

    def each(batch: DataFrame, number: int) -> None:
        result = index.build(batch, complete=False)
        if on_batch:
            on_batch(number, result)

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_tasks(log: DataFrame) -> DataFrame:
    """The latest stage and message of every task of a stream of updates (task_id, seq, stage, message); for update mode."""
    latest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return log.groupBy("task_id").agg(latest("stage"), latest("message"))


def live_rates(events: DataFrame, key: str, late: str = "2 minutes") -> DataFrame:
    """Requests per minute and key of a stream with an event time `ts`."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute").alias("minute"), F.col(key)).agg(F.count(F.lit(1)).alias("requests"))
