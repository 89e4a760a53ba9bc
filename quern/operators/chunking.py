"""Recursive splitting of documents into overlapping chunks, and their ids."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import content_hash
from quern.settings import DEFAULTS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: From coarse to fine; the last cuts between any two characters.
SEPARATORS = ("\n\n", "\n", " ", "")


def _cut(text: str, separator: str) -> list[str]:
    """Pieces of the text; each but the first begins with the separator."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


def _packed(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Chunks of pieces in a row, of `size` characters at most, that share up to `overlap` with the one before."""
    begin, total = 0, 0
    for end, piece in enumerate(pieces):
        if begin < end and total + len(piece) > size:
            yield "".join(pieces[begin:end]).strip()
            while total > overlap or (total and total + len(piece) > size):
                total -= len(pieces[begin])
                begin += 1
        total += len(piece)
    if begin < len(pieces):
        yield "".join(pieces[begin:]).strip()


def split(text: str, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """The chunks of a text, by the coarsest separator in it; pieces that are still too long are split finer."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    finer = separators[at + 1 :]
    out: list[str] = []
    run: list[str] = []
    for piece in [*_cut(text, separators[at]), None]:
        if piece is not None and len(piece) < size:
            run.append(piece)
            continue
        out += (c for c in _packed(run, size, overlap) if c)
        run = []
        if piece is not None:
            out += split(piece, size, overlap, finer) if finer else [piece]
    return out


def chunked(pages: DataFrame, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap) -> DataFrame:
    """chunk_id, source, page, chunk_ord, content, content_hash of documents (source, page, doc_ord, content).

    Pages are split apart; ids count over all pages of a source. Counting goes page by page from the
    numbers of chunks, so that no window holds contents; a source's window holds one row per page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                chunks = [split(t or "", size, overlap) for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(chunks, pa.list_(pa.string()))], names=["source", "page", "doc_ord", "chunks"])

    parts = pages.select("source", F.col("page").cast("int").alias("page"), F.col("doc_ord").cast("long").alias("doc_ord"), "content").mapInArrow(run, "source string, page int, doc_ord long, chunks array<string>")
    before = Window.partitionBy("source").orderBy("doc_ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("__base", F.coalesce(F.sum(F.size("chunks")).over(before), F.lit(0)))
    flat = placed.select("source", "page", "__base", F.posexplode("chunks").alias("__at", "content"))
    ordinal = (F.col("__base") + F.col("__at")).cast("long")
    return flat.select(F.concat_ws("::", "source", ordinal.cast("string")).alias("chunk_id"), "source", "page", ordinal.alias("chunk_ord"), "content", content_hash(F.col("content")).alias("content_hash"))
