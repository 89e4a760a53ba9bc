"""State kept as tables: the cache with expiry, the log of ingest tasks, request rates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.settings import DEFAULTS


def cache_state(log: DataFrame) -> DataFrame:
    """key, value, expires_at: the last write of each key, from writes (key, value, written_at, seq, ttl)."""
    last = log.groupBy("key").agg(F.max_by(F.struct("value", "written_at", "ttl"), F.struct("written_at", "seq")).alias("__w"))
    return last.select("key", "__w.value", (F.col("__w.written_at") + F.col("__w.ttl")).alias("expires_at"))


def looked_up(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """requests (with key) and value, hit: what has expired is a miss."""
    live = cache.where(F.col("expires_at") > now).select(F.col("key").alias("__key"), F.col("value"), F.lit(True).alias("__hit"))
    return requests.join(live, requests["key"] == live["__key"], "left").withColumn("hit", F.coalesce("__hit", F.lit(False))).drop("__key", "__hit")


def misses(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """The keys that have to be worked out, each once."""
    return requests.select("key").distinct().join(cache.where(F.col("expires_at") > now), "key", "left_anti")


def through_cache(requests: DataFrame, log: DataFrame, compute: Callable[[DataFrame], DataFrame], now: float, ttl: int) -> tuple[DataFrame, DataFrame]:
    """requests (with key) and value, and the writes to add to the log: only what isn't live is worked out.

    compute gives (key, value) for the missing keys; a key that it leaves out stays null and isn't written.
    """
    cache = cache_state(log)
    live = cache.where(F.col("expires_at") > now).select("key", "value")
    fresh = compute(misses(requests, cache, F.lit(now))).select("key", "value").cache()
    writes = fresh.select("key", "value", F.lit(now).alias("written_at"), F.xxhash64("key").alias("seq"), F.lit(ttl).alias("ttl"))
    return requests.join(live.unionByName(fresh), "key", "left"), writes


def task_state(log: DataFrame, fields: list[str]) -> DataFrame:
    """task_id, fields, created_at, updated_at: the last given value of every field, from partial updates in order of seq."""
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields]
    return log.groupBy("task_id").agg(*last, F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))


def newest_tasks(tasks: DataFrame, order: str, most: int = DEFAULTS.tasks_kept) -> DataFrame:
    """The tasks that a bounded registry keeps: the newest by insertion."""
    return tasks.orderBy(F.col(order).desc()).limit(most)


def upload_status(tasks: DataFrame, now: Column, timeout: int = DEFAULTS.upload_timeout) -> DataFrame:
    """What a poller shows: the error of a failed task if it has one, else the message; too old means failed."""
    late = ~F.col("stage").isin("indexed", "failed") & (now - F.col("created_at") > timeout)
    shown = F.when(F.col("stage") == "failed", F.coalesce("error", "message")).otherwise(F.col("message"))
    return tasks.select("task_id", F.when(late, "failed").otherwise(F.col("stage")).alias("stage"), F.when(late, "Timed out waiting for indexing to finish.").otherwise(shown).alias("message"))


def final_message(result_chunks: Column, changed: Column, removed: Column) -> Column:
    """What a finished ingest says."""
    nothing = (changed == 0) & (removed == 0)
    return F.when(nothing, "No changes detected.").otherwise(F.concat(F.lit("Indexed "), result_chunks.cast("string"), F.lit(" chunks.")))


def request_rates(events: DataFrame, key: str, ts: str, per_key: int = 10, overall: int = 30) -> DataFrame:
    """minute, key, requests, all_requests, limited: counts per minute against both limits."""
    minute = F.date_trunc("minute", F.col(ts))
    counts = events.groupBy(minute.alias("minute"), F.col(key)).agg(F.count(F.lit(1)).alias("requests"))
    total = counts.groupBy("minute").agg(F.sum("requests").alias("all_requests"))
    out = counts.join(total, "minute")
    return out.withColumn("limited", (F.col("requests") > per_key) | (F.col("all_requests") > overall))


