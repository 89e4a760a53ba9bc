"""Incremental ingestion: fingerprints, change detection, chunk tables in generations."""

from __future__ import annotations

import hashlib
import json
import sys
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import schemas
from quern.common import bounded
from quern.functions.text import content_hash, topic
from quern.operators.chunking import chunked
from quern.settings import DEFAULTS, Settings

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def fingerprints(pages: DataFrame) -> DataFrame:
    """source, hash, n_pages: SHA-256 of the contents joined by NUL in order of doc_ord, at any number of pages; null contents are passed over.

    A source is a file: its pages go through the hash one after the other, in one task, that holds one batch of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, state, n, first = None, None, 0, True
        for batch in batches:
            done = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or name != source:
                    if state is not None:
                        done.append((source, state.hexdigest(), n))
                    source, state, n, first = name, hashlib.sha256(), 0, True
                n += 1
                if content is not None:
                    state.update(content.encode() if first else b"\0" + content.encode())
                    first = False
            if done:
                yield _hashes(done)
        if state is not None:
            yield _hashes([(source, state.hexdigest(), n)])

    ordered = pages.select("source", "doc_ord", "content").repartition("source").sortWithinPartitions("source", "doc_ord", "content")
    return ordered.select("source", "content").mapInArrow(run, "source string, hash string, n_pages long")


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["source", "hash", "n_pages"])


def diff(scanned: DataFrame, manifest: DataFrame) -> DataFrame:
    """source, status: new, changed, skipped or removed, from (source, hash) now and before."""
    now = scanned.select("source", F.col("hash").alias("__now"))
    both = now.join(manifest.select("source", F.col("hash").alias("__before")), "source", "full_outer")
    status = F.when(F.col("__now").isNull(), "removed").when(F.col("__before").isNull(), "new").when(F.col("__now") == F.col("__before"), "skipped").otherwise("changed")
    return both.select("source", status.alias("status"))


def counters(changes: DataFrame) -> DataFrame:
    """changed_files (new ones too), skipped_files, removed_files in one row."""
    return changes.agg(F.count_if(F.col("status").isin("new", "changed")).alias("changed_files"), F.count_if(F.col("status") == "skipped").alias("skipped_files"), F.count_if(F.col("status") == "removed").alias("removed_files"))


def corpus_topics(manifest: DataFrame) -> DataFrame:
    """One row, topics: what the corpus is about, in order of the file names. The manifest has a row per file."""
    listed = F.sort_array(F.collect_list(F.struct("source", topic(F.col("source")).alias("topic"))))
    said = F.array_join(F.transform(listed, lambda x: x["topic"]), "; ")
    return manifest.agg(F.when(F.count(F.lit(1)) == 0, "(empty -- no documents indexed yet)").otherwise(said).alias("topics"))


@dataclass(frozen=True)
class IndexResult:
    indexed_chunks: int
    changed_files: int
    skipped_files: int
    removed_files: int


class Index:
    """Chunks and manifest in one folder, as a list of deltas behind numbered pointers.

    A run writes one delta: the chunks of new and changed sources, and their manifest rows; gone sources have a row that
    says so. What stays isn't written again. Then the next pointer, a file with the names of all deltas, comes into being
    under its number, by a rename: readers take the highest number, so they see the old state or the new one. A run that dies
    leaves a delta that no pointer names. Of two runs at the same time the second to finish fails, as its number is taken.
    After COMPACT_AT deltas a run writes all that is alive as one, and removes what only the pointer before the last one needs.
    """

    COMPACT_AT = 32
    ROWS = "source string, hash string, chunk_ids array<string>, gone boolean"
    _locks: dict[str, threading.Lock] = {}

    def __init__(self, spark: SparkSession, path: str, settings: Settings = DEFAULTS) -> None:
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings
        self.lock = self._locks.setdefault(self.path, threading.Lock())

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def pointer(self) -> tuple[int, list[str]]:
        """The highest pointer's number, 0 without one, and the deltas that it names, oldest first."""
        fs, p = self._fs(f"{self.path}/pointers")
        numbers = [int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()] if fs.exists(p) else []
        if not numbers:
            return 0, []
        return max(numbers), self._deltas(max(numbers))

    def _deltas(self, number: int) -> list[str]:
        rows = self.spark.read.text(f"{self.path}/pointers/{number}", wholetext=True).collect()
        return json.loads(rows[0].value)["deltas"]

    def _read(self, what: str, schema: str, deltas: list[str]) -> DataFrame:
        """Rows of all deltas, with __delta, the place of theirs in the list."""
        out = self.spark.createDataFrame([], schema).withColumn("__delta", F.lit(0))
        if deltas:
            at = self.spark.read.schema(schema).parquet(*[f"{self.path}/{what}/{d}" for d in deltas])
            place = F.create_map(*[F.lit(x) for i, d in enumerate(deltas) for x in (d, i)])
            out = at.withColumn("__delta", F.element_at(place, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)))
        return out

    def _alive(self, deltas: list[str]) -> DataFrame:
        """The newest manifest row of every source that isn't gone, with the __delta that it is of."""
        rows = self._read("manifest", self.ROWS, deltas)
        last = rows.groupBy("source").agg(F.max_by(F.struct("hash", "chunk_ids", "gone", "__delta"), "__delta").alias("__last"))
        return last.select("source", "__last.*").where("NOT gone").drop("gone")

    def chunks(self) -> DataFrame:
        return self._chunks(self.pointer()[1])

    def _chunks(self, deltas: list[str]) -> DataFrame:
        names = self.spark.createDataFrame([], schemas.CHUNKS).columns
        return self._read("chunks", schemas.CHUNKS, deltas).join(bounded(self._alive(deltas).select("source", "__delta"), self.settings.broadcast_rows), ["source", "__delta"], "left_semi").select(*names)

    def manifest(self) -> DataFrame:
        return self._alive(self.pointer()[1]).select("source", "hash", "chunk_ids")

    def ready(self) -> tuple[bool, str | None]:
        """Whether the chunks can be counted, else why not."""
        try:
            self.chunks().count()
        except Exception as e:  # noqa: BLE001  this is what it reports
            return False, str(e)
        return True, None

    def build(self, pages: DataFrame, incremental: bool = True, on_stage: Callable[[str, str], None] | None = None, complete: bool = True) -> IndexResult:
        """Bring the index up to date with pages (source, page, doc_ord, content): all that there is now.

        Unless complete, pages are only what came in: sources that aren't among them stay.

        Sources whose fingerprint is in the manifest keep their chunks; gone and changed ones lose
        them; new and changed ones are split. A source without chunks has a manifest row too.
        """
        said = on_stage or (lambda stage, message: None)
        with self.lock:
            said("parsing", "reading documents")
            number, deltas = self.pointer()
            old = self._alive(deltas)
            scanned = fingerprints(pages).cache()
            changes = diff(scanned, old if incremental else old.limit(0))
            changes = (changes if complete else changes.where("status <> 'removed'")).cache()
            said("indexing", "updating the index")
            fresh = changes.where(F.col("status").isin("new", "changed")).select("source")
            split = chunked(pages.join(bounded(fresh, self.settings.broadcast_rows), "source", "left_semi"), self.settings.chunk_size, self.settings.chunk_overlap)
            name = f"{number + 1:08d}-{uuid.uuid4().hex}"
            kept = [] if not incremental else deltas
            compact = len(kept) >= self.COMPACT_AT
            if compact:
                stays = old.select("source", "hash").join(changes.where("status <> 'skipped'"), "source", "left_anti")
                carried = self._chunks(deltas).join(stays, "source", "left_semi")
                carried.select(*split.columns).unionByName(split).write.parquet(f"{self.path}/chunks/{name}")
                kept = []
            else:
                split.write.parquet(f"{self.path}/chunks/{name}")
            chunks = self.spark.read.schema(schemas.CHUNKS).parquet(f"{self.path}/chunks/{name}")
            ids = chunks.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_ord", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
            hashes = scanned.select("source", "hash").join(fresh, "source", "left_semi")
            rows = (hashes.unionByName(stays) if compact else hashes).join(ids, "source", "left").select("source", "hash", F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"), F.lit(False).alias("gone"))
            gone = changes.where("status = 'removed'").select("source", F.lit(None).cast("string").alias("hash"), F.array().cast("array<string>").alias("chunk_ids"), F.lit(True).alias("gone"))
            rows.unionByName(gone if kept else gone.limit(0)).write.parquet(f"{self.path}/manifest/{name}")
            n = counters(changes).first()
            added = (chunks.join(fresh, "source", "left_semi") if compact else chunks).count()
            if n["changed_files"] or n["removed_files"]:
                said("indexing", "updating the lexical index")
            self._point_to(number + 1, [*kept, name])
            scanned.unpersist()
            changes.unpersist()
        return IndexResult(added, n["changed_files"], n["skipped_files"], n["removed_files"])

    def _point_to(self, number: int, deltas: list[str]) -> None:
        fs, new = self._fs(f"{self.path}/pointers/{number}")
        _, draft = self._fs(f"{self.path}/pointers/_draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"deltas": deltas}).encode()))
        out.close()
        if fs.exists(new) or not fs.rename(draft, new):
            fs.delete(draft, False)
            raise RuntimeError("another run has changed the index meanwhile")
        # Readers of the pointer before may still be at work; what is older goes.
        if number > 2 and (old := set(self._deltas(number - 2)) - {d for n in (number - 1, number) for d in self._deltas(n)}):
            for d in old:
                for what in ("chunks", "manifest"):
                    fs.delete(self._fs(f"{self.path}/{what}/{d}")[1], True)


def exact_duplicates(docs: DataFrame, key: str, content: str) -> DataFrame:
    """content_hash, first (the smallest key) and copies of every content; contents aren't shuffled."""
    return docs.select(key, content_hash(F.col(content)).alias("content_hash")).groupBy("content_hash").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies"))
