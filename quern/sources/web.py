"""Web search as a source of hits: over a table of pages, or through a client."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.common import fits
from quern.functions.text import without_tags
from quern.operators import lexical
from quern.settings import DEFAULTS

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def page_texts(pages: DataFrame) -> DataFrame:
    """chunk_id, chunk_ord, title, url, content of pages (page_id, url, html)."""
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return pages.select(F.col("page_id").cast("string").alias("chunk_id"), F.col("page_id").alias("chunk_ord"), title.alias("title"), "url", without_tags(F.col("html")).alias("content"))


def searched_pages(queries: DataFrame, pages: DataFrame, most: int = DEFAULTS.web_results) -> DataFrame:
    """query_id, rank, title, url, content of the best pages for queries (query_id, query); no network.

    Pages are searched by their ids; titles and texts are joined to what is found.
    """
    texts = page_texts(pages)
    found = lexical.search(queries, texts, most).select("query_id", "rank", "chunk_id")
    # Every query finds `most` at most.
    found = F.broadcast(found) if fits(queries, DEFAULTS.broadcast_rows // max(1, most)) else found
    return texts.join(found, "chunk_id").select("query_id", "rank", "title", "url", "content")


def searched(queries: DataFrame, client: Callable[[str, int], list[dict]], most: int = DEFAULTS.web_results) -> DataFrame:
    """As searched_pages(), through a client that gives dicts of title, href and body for a query.

    What a dict lacks is an empty string; a query whose search fails has no hits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for query_id, query in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = list(client(query, most))[:most]
                except Exception:  # noqa: BLE001  no hits is the defined result
                    found = []
                rows += [(query_id, i, x.get("title", ""), x.get("href", ""), x.get("body", "")) for i, x in enumerate(found, 1)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], names=["query_id", "rank", "title", "url", "content"])

    return queries.select("query_id", "query").mapInArrow(run, "query_id long, rank int, title string, url string, content string")
