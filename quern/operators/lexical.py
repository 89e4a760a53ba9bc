"""BM25 over chunks: an inverted index as tables, and top-k search for a set of queries."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.common import fits
from quern.functions.text import tokens
from quern.settings import DEFAULTS, Settings

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Queries whose scores of some chunks are worked out together, and such chunks.
QUERY_BLOCK, CHUNK_BLOCK = 4096, 64


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: n_chunks and the mean number of tokens; chunks without tokens count."""
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg(F.size(tokens(F.col("content")))).alias("avg_tokens"))


def term_stats(chunks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """term, df, idf. A negative idf becomes a fraction of the mean idf of all terms; zero stays.

    Each chunk names a term once, so that the shuffle holds one row per term and task.
    """
    n = chunks.count()
    # The filter is one that joins bring along: with it, what is counted for the mean and for the terms is shuffled once.
    df = chunks.select(F.explode(F.array_distinct(tokens(F.col("content")))).alias("term")).where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg((F.avg("raw") * settings.bm25_floor).alias("floor"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def index(chunks: DataFrame, settings: Settings = DEFAULTS) -> dict[str, DataFrame]:
    """The tables of an index: postings (chunk_id, chunk_ord, dl, term, tf), term_stats, corpus_stats.

    Postings carry their chunk's length and place, so that a search joins nothing to them.
    """
    listed = chunks.select("chunk_id", "chunk_ord", tokens(F.col("content")).alias("__t"))
    postings = listed.select("chunk_id", "chunk_ord", F.size("__t").alias("dl"), F.explode("__t").alias("term")).groupBy("chunk_id", "chunk_ord", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    return {"postings": postings, "term_stats": term_stats(chunks, settings), "corpus_stats": corpus_stats(chunks)}


def save_index(chunks: DataFrame, path: str, settings: Settings = DEFAULTS) -> dict[str, DataFrame]:
    """The index as tables in a folder; postings and terms are dealt and sorted by term."""
    for name, df in index(chunks, settings).items():
        dealt = df.repartition("term").sortWithinPartitions("term") if "term" in df.columns else df
        dealt.write.mode("overwrite").parquet(f"{path}/{name}")
    return load_index(chunks.sparkSession, path)


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "term_stats", "corpus_stats")}


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def _ranked(tf: DataFrame, terms: DataFrame, stats: DataFrame, k: int, settings: Settings) -> DataFrame:
    k1, b = settings.bm25_k1, settings.bm25_b
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("__avg")))
    average = F.broadcast(stats.select(F.col("avg_tokens").alias("__avg")))
    return _best(tf.join(terms, "term").crossJoin(average).groupBy("query_id", "chunk_id", "chunk_ord").agg(F.sum(part).alias("score")), k)


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_ord")
    ranked = scored.where(F.round("score", 9) > 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "chunk_id", "chunk_ord", "score")


def search_index(queries: DataFrame, tables: dict[str, DataFrame], k: int = DEFAULTS.top_k, settings: Settings = DEFAULTS) -> DataFrame:
    """As search(), over an index: postings of the queries' terms are all that is read on."""
    asked = _asked(queries)
    sent = F.broadcast if fits(asked, settings.broadcast_rows) else lambda df: df
    terms = sent(tables["term_stats"].join(sent(asked), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")))
    return _ranked(tables["postings"], terms, tables["corpus_stats"], k, settings)


def search(queries: DataFrame, chunks: DataFrame, k: int = DEFAULTS.top_k, settings: Settings = DEFAULTS) -> DataFrame:
    """query_id, rank, chunk_id, chunk_ord, score of the best k chunks with a positive score.

    queries: query_id, query. A term counts as often as the query has it. Ties keep the chunks' order. A chunk is
    scored where it lies and each batch keeps its own best k, so what is shuffled is k rows per query and batch.
    Chunks that share an id count together; where there are any, or the queries' terms are too many to be sent to the
    chunks, all chunks' terms that some query has are shuffled, and summed up by chunk.
    """
    asked = _asked(queries)
    # Whether the queries' terms can be broadcast is settled once, on the queries alone.
    small = fits(asked, settings.broadcast_rows)
    sent = F.broadcast if small else lambda df: df
    terms = term_stats(chunks, settings).join(sent(asked), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    listed = chunks.select("chunk_id", "chunk_ord", tokens(F.col("content")).alias("__t"))
    if small and chunks.groupBy("chunk_id", "chunk_ord").count().where("count > 1").isEmpty():
        return _best(_scored(listed, terms, corpus_stats(chunks).first()["avg_tokens"], queries.schema["query_id"].dataType.simpleString(), k, settings), k)
    every = listed.select("chunk_id", "chunk_ord", F.size("__t").alias("dl"), F.explode("__t").alias("term"))
    found = every.join(sent(asked.select("term").distinct()), "term", "left_semi")
    tf = found.groupBy("chunk_id", "chunk_ord", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    return _ranked(tf, sent(terms), corpus_stats(chunks), k, settings)


def _scored(listed: DataFrame, terms: DataFrame, average: float | None, kind: str, k: int, settings: Settings) -> DataFrame:
    """query_id (of the given kind), chunk_id, chunk_ord, score of the best k of every batch for every query.

    listed: chunk_id, chunk_ord, __t (all tokens), a row per chunk. Tokens come as one string, as they hold no spaces.
    """
    rows = terms.collect()
    ids = list(dict.fromkeys(r["query_id"] for r in rows))
    places, number = {x: i for i, x in enumerate(ids)}, {}
    which = np.array([number.setdefault(r["term"], len(number)) for r in rows], np.int64)
    query, weight = np.array([places[r["query_id"]] for r in rows], np.int64), np.array([r["weight"] for r in rows], np.float64)
    by_query = np.argsort(query, kind="stable")
    sent = listed.sparkSession.sparkContext.broadcast((ids, number, which[by_query], query[by_query], weight[by_query]))
    k1, b = settings.bm25_k1, settings.bm25_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, number, which, query, weight = sent.value
        blocks = []
        for low in range(0, len(ids), QUERY_BLOCK):
            of = slice(*np.searchsorted(query, (low, low + QUERY_BLOCK)))
            by_term = np.argsort(which[of], kind="stable")
            first = np.searchsorted(which[of][by_term], np.arange(len(number) + 1))
            blocks.append((low, min(QUERY_BLOCK, len(ids) - low), first, query[of][by_term] - low, weight[of][by_term]))
        for batch in batches:
            place, chunk, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for at in range(0, batch.num_rows, CHUNK_BLOCK):
                texts, lengths = (batch.column(i).slice(at, CHUNK_BLOCK).to_pylist() for i in (3, 4))
                counts = [Counter(filter(number.__contains__, t.split(" "))) for t in texts]
                each = np.array([len(c) for c in counts])
                n = int(each.sum())
                doc, dl = np.repeat(np.arange(len(texts)), each), np.repeat(np.array(lengths, np.float64), each)
                term, tf = np.fromiter((number[w] for c in counts for w in c), np.int64, n), np.fromiter((x for c in counts for x in c.values()), np.float64, n)
                part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / average)) if n else tf
                for low, size, first, queries, weights in blocks:
                    many = first[term + 1] - first[term]
                    entry = np.repeat(first[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    sums = np.bincount(np.repeat(doc, many) * size + queries[entry], np.repeat(part, many) * weights[entry], len(texts) * size)
                    found = np.flatnonzero(np.round(sums, 9) > 0)
                    place.append(found % size + low)
                    chunk.append(found // size + at)
                    score.append(sums[found])
            place, chunk, score = np.concatenate(place), np.concatenate(chunk), np.concatenate(score)
            order = np.asarray(batch.column(2).fill_null(np.iinfo(np.int64).min))[chunk]
            taken = np.lexsort((order, -np.round(score, 9), place))
            place, chunk, score = place[taken], chunk[taken], score[taken]
            best = np.arange(len(place)) - np.searchsorted(place, place) < k
            rows = pa.array(chunk[best])
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in place[best].tolist()], wanted), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(score[best])], names=["query_id", "chunk_id", "chunk_ord", "score"])

    wanted = pa.int64() if kind == "bigint" else None
    text = listed.select("chunk_id", "chunk_ord", F.col("chunk_ord").cast("long").alias("__ord"), F.array_join("__t", " ").alias("__text"), F.size("__t").alias("__dl"))
    own = ", ".join(f"{c} {listed.schema[c].dataType.simpleString()}" for c in ("chunk_id", "chunk_ord"))
    return text.mapInArrow(run, f"query_id {kind}, {own}, score double")
