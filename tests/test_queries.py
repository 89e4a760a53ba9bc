import hashlib
import re

import pytest
from compare import connection, same

from quern.queries import catalogue

QUERIES, SQL = catalogue()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_what_its_sql_says(spark, data, name):
    same(QUERIES[name](spark, data), connection(data), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_chunks_against_brute_force(spark, data):
    """recursive_chunks and index_counts over whole documents: pages in order, ids counted over a source, what is split is what the pages hold."""
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    wanted, counts = {}, {}
    for r in sorted(docs, key=lambda r: (r.source, r.doc_id)):
        for chunk in brute_split(r.text or ""):
            n = counts.setdefault(r.source, [])
            wanted[f"{r.source}::{len(n)}"] = (r.source, r.doc_id, hashlib.sha256(chunk.encode()).hexdigest(), len(chunk))
            n.append(chunk)
    out = {r.chunk_id: (r.source, r.page, r.content_hash, r.n_chars) for r in QUERIES["recursive_chunks"](spark, data).collect()}
    assert out == wanted
    assert {r.source: (r.chunks, r.distinct_chunks) for r in QUERIES["index_counts"](spark, data).collect()} == {s: (len(n), len(set(n))) for s, n in counts.items()}


def brute_split(text, size=800, overlap=100, separators=("\n\n", "\n", " ", "")):
    """Chunk by chunk with lists of pieces: the coarsest separator that is there, kept at the start of what follows it."""
    separator, finer = next(((s, separators[i + 1 :]) for i, s in enumerate(separators) if not s or s in text))
    pieces = [p for p in (re.split(f"(?={re.escape(separator)})", text) if separator else list(text)) if p]
    if separator == "\n" or separator == " " or separator == "\n\n":
        head, *rest = text.split(separator)
        pieces = [p for p in [head, *[separator + x for x in rest]] if p]
    out, good = [], []

    def merge(parts):
        now = []
        for p in parts:
            if now and sum(map(len, now)) + len(p) > size:
                out.append("".join(now).strip())
                while sum(map(len, now)) > overlap or (now and sum(map(len, now)) + len(p) > size):
                    now.pop(0)
            now.append(p)
        if now:
            out.append("".join(now).strip())

    for p in pieces:
        if len(p) < size:
            good.append(p)
            continue
        merge(good)
        good = []
        out.extend(brute_split(p, size, overlap, finer) if finer else [p])
    merge(good)
    return [c for c in out if c]


def test_decomposition_against_brute_force(spark, data):
    turns = spark.read.parquet(f"{data}/conversations.parquet").collect()
    out = {}
    for r in QUERIES["decompose_questions"](spark, data).collect():
        out.setdefault((r.conv_id, r.turn), []).append((r.sub_query_ord, r.sub_query))
    wanted = {}
    for r in turns:
        parts = [p.strip() for p in re.split(r"(?i)\?\s+|;\s*|,?\s+and\s+(?=(?:who|what|when|where|why|how|which)\b)", r.text + "? What is it; and when? ", flags=re.A)]
        wanted.setdefault((r.conv_id, r.turn), []).extend(enumerate([p for p in parts if p]))
    assert {k: sorted(v) for k, v in out.items() if k in wanted} == {k: sorted(v) for k, v in wanted.items() if k in out} and len(out) > 10


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["question_id", "fused_rank", "content_hash", "source_id", "rrf_score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
