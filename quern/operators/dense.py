"""Dense retrieval: the hashing embedding, and exact cosine top-k in blocks."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.settings import DEFAULTS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Queries that go through the vectors together; more queries take more passes, not more memory.
QUERY_BLOCK = 4096
#: Words whose buckets a task remembers.
CACHED_WORDS = 500_000


def hash_embeddings(df: DataFrame, key: str, text: str, buckets: int = 64) -> DataFrame:
    """key and embedding: counts of words in lower case, hashed by SHA-256, of length 1; zeros for a text without words.

    A row is worked out where it lies: nothing is shuffled. Words' buckets are remembered, within a bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                if len(known) > CACHED_WORDS:
                    known.clear()
                for t in part.column(1).to_pylist():
                    words = (t or "").lower().split()
                    for w in set(words).difference(known):
                        known[w] = int.from_bytes(sha256(w.encode()).digest()) % buckets
                    counts = np.bincount(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), minlength=buckets).astype(np.float64)
                    rows.append(counts / max(np.sqrt((counts * counts).sum()), 1.0))
                made = pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * buckets + 1, buckets, dtype=np.int32)), pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([part.column(0), made], names=[key, "embedding"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {kind}, embedding array<double>")


def search(queries: DataFrame, vectors: DataFrame, k: int = DEFAULTS.top_k, kind: str = "string") -> DataFrame:
    """query_id, rank, id, distance of the k nearest vectors by cosine distance, exactly.

    queries: query_id (long), embedding; vectors: id (of the given kind), embedding. Query blocks of one
    length and a fixed size are sent to the vectors, each batch keeps its own best k, and the best of those are
    ranked: what is shuffled is k rows per query and batch. Zero vectors have distance 1 to all; ties go
    by distance to nine places, then id. Vectors of another length than the query's are not compared.
    """
    spark = queries.sparkSession
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    found = None
    for width, count in sorted(tuple(r) for r in asked.groupBy(F.size("embedding")).count().collect()):
        blocks = -(-count // QUERY_BLOCK)
        for i in range(blocks):
            rows = asked.where(F.size("embedding") == width).where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()
            part = _nearest(vectors, [r["query_id"] for r in rows], [r["embedding"] for r in rows], k, kind) if rows else None
            found = part if found is None else found if part is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"query_id long, rank int, id {kind}, distance double")
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _nearest(vectors: DataFrame, ids: list[int], queries: list[list[float]], k: int, kind: str) -> DataFrame:
    """The best k of every batch for queries of one length."""
    sent = vectors.sparkSession.sparkContext.broadcast((np.array(ids), np.array(queries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = sent.value
        q = q / np.maximum(np.sqrt((q * q).sum(1, keepdims=True)), 1e-300)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                values = part.column(1)
                sizes = np.asarray(values.value_lengths().fill_null(-1))
                rows = np.flatnonzero(sizes == q.shape[1])
                if not len(rows):
                    continue
                v = np.array(values.take(pa.array(rows)).flatten(), np.float64).reshape(len(rows), q.shape[1])
                v = v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)
                distance = 1 - q @ v.T
                keep = min(k, len(rows))
                near, ids = np.round(distance, 9), part.column(0).take(pa.array(rows))
                by_id = np.argsort(np.argsort(np.array(ids.to_pylist(), object), kind="stable"))
                edge = np.partition(near, keep - 1, axis=1)[:, keep - 1 : keep]
                # Of equal distances at the edge the lowest ids stay: k rows per query and batch at most.
                qs, vs = [], []
                for i, at_most in enumerate(edge[:, 0]):
                    c = np.flatnonzero(near[i] <= at_most)
                    c = c[np.lexsort((by_id[c], near[i][c]))[:keep]]
                    qs.append(np.full(len(c), i))
                    vs.append(c)
                qs, vs = np.concatenate(qs), np.concatenate(vs)
                yield pa.RecordBatch.from_arrays([pa.array(qid[qs]), ids.take(pa.array(vs)), pa.array(distance[qs, vs])], names=["query_id", "id", "distance"])

    return vectors.select("id", F.col("embedding").cast("array<double>")).mapInArrow(run, f"query_id long, id {kind}, distance double")
