"""What the operators of this subpackage share: tables, shared storage, id-safe filters."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every word-based contract: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD_CHARS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only on one machine (a local master, as in tests), where the session names no such folder, a temporary one is
    made and set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Tables whose number of rows has a known bound are written by one task for so many, and not by one for each shuffle partition.
ROWS_PER_TASK = 20_000


#: Whether Spark deletes the shuffles of a query when the query ends; else they stay until the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder: the lineage is cut, and a lost executor costs nothing. rows: a bound, if one is known.

    The shuffles behind the table are deleted when it is written, as nothing reads them again.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_PER_TASK)))).write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more, not even lazily or after the loss of an executor."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Batches sent to Python hold no more than this, whatever a session allows: two tasks of an executor hold some each,
#: outside the JVM's heap, where a vector takes three times its size while it grows and pools keep what they once had.
BATCH_ROWS, BATCH_BYTES = 2_000, 1 << 20


def lean_batches(spark: SparkSession) -> None:
    """Lower the session's limits on Arrow batches to BATCH_ROWS and BATCH_BYTES, if they are higher or off."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("bB")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def returning(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function for mapInArrow, after which a worker gives memory that it no longer uses back to the system.

    Spark keeps workers for later tasks, whatever those do, and what their allocators hold by then is missing to the JVM beside them.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return whole


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in order; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than it needs to tell."""
    return df.limit(rows + 1).count() <= rows


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it is checked to have at most so many rows, else as it is."""
    return F.broadcast(df) if small_enough(df, rows) else df


def broadcast_if(df: DataFrame, most: int, weight: Column) -> DataFrame:
    """df with a broadcast hint if the sum of weight, such as the length of an array, and the number of rows are checked to be `most` or less."""
    rows, sum_ = df.agg(F.count(F.lit(1)), F.sum(weight)).first()
    return F.broadcast(df) if rows <= most and (sum_ or 0) <= most else df


def keep_ids(docs: DataFrame, ids: DataFrame, how: str, rows: int = 1_000_000) -> DataFrame:
    """docs with (left_semi) or without (left_anti) the doc_id in ids; a null id equals a null id."""
    ids = bounded(ids.select(F.col("doc_id").alias("__id")), rows)
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["__id"]), how)
