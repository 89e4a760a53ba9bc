"""Files as tables: text directories, PDF pages, golden questions, uploads."""

from __future__ import annotations

import re
import sys
import uuid
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import schemas
from quern.settings import DEFAULTS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SUFFIXES = (".md", ".txt", ".pdf")


def simple_pdf_pages(data: bytes) -> list[str]:
    """The text of each page of a plain PDF: literal strings shown by Tj and TJ, in order of the page objects.

    A stand-in where no PDF library is installed; anything else may be given instead. Raises
    ValueError for what isn't a PDF.
    """
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S)}
    pages = []
    for body in objects.values():
        if not re.search(rb"/Type\s*/Page\b(?!s)", body):
            continue
        refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        said = []
        for ref in re.findall(rb"(\d+)\s+\d+\s+R", refs[1]) if refs else ():
            stream = re.search(rb"(.*?)stream\r?\n(.*?)\r?\n?endstream", objects.get(int(ref), b""), re.S)
            if not stream:
                continue
            content = zlib.decompress(stream[2]) if b"/FlateDecode" in stream[1] else stream[2]
            for shown in re.findall(rb"(\((?:\\.|[^\\()])*\)|\[(?:[^\]\\]|\\.)*\])\s*T[jJ]", content, re.S):
                parts = re.findall(rb"\(((?:\\.|[^\\()])*)\)", shown, re.S)
                said.append(re.sub(rb"\\([()\\])", rb"\1", b"".join(parts)).decode("latin-1"))
        pages.append("\n".join(said))
    return pages


def pdf_pages(spark: SparkSession, directory: str, parse: Callable[[bytes], list[str]] = simple_pdf_pages) -> DataFrame:
    """One row per page with text, numbered from 1; a file that can't be read has none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(directory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    pages = parse(content)
                except Exception:  # noqa: BLE001  a broken file is no reason to fail the others
                    pages = []
                rows += [(source, i, p.strip()) for i, p in enumerate(pages, 1) if p.strip()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[1] - 1 for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["source", "page", "doc_ord", "content"])

    return files.select(F.element_at(F.split("path", "/"), -1).alias("source"), "content").mapInArrow(run, schemas.DOCUMENTS)


def text_files(spark: SparkSession, directory: str) -> DataFrame:
    """One row per Markdown or text file right in the directory; suffixes are told by case, line ends become \\n."""
    files = spark.read.text(directory, wholetext=True, pathGlobFilter="*.{md,txt}")
    return files.select(F.col("_metadata.file_name").alias("source"), F.lit(None).cast("int").alias("page"), F.lit(0).cast("long").alias("doc_ord"), F.replace(F.replace("value", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")).alias("content"))


def documents(spark: SparkSession, directory: str, parse: Callable[[bytes], list[str]] = simple_pdf_pages) -> DataFrame:
    """All supported files of a directory (source, page, doc_ord, content)."""
    return text_files(spark, directory).unionByName(pdf_pages(spark, directory, parse))


def golden_questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Golden questions of a JSON lines file, in its order (question_id from 0); a bad row is an error, blank lines aren't rows.

    The file is a hand-written set, read whole by one task; `limit` takes the first rows of it.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")).alias("__no", "__line"))
    rows = lines.select(F.col("__no").cast("long").alias("question_id"), F.from_json("__line", schemas.GOLDEN, {"mode": "FAILFAST"}).alias("__row")).select("question_id", "__row.*")
    return rows.where(F.col("question_id") < limit) if limit is not None else rows


class UploadError(ValueError):
    """An upload that is refused; status is as in HTTP."""

    def __init__(self, status: int, reason: str) -> None:
        super().__init__(reason)
        self.status = status


def land_file(directory: str | Path, name: str, content: Iterator[bytes], most: int = DEFAULTS.upload_bytes) -> str:
    """Write an upload into the corpus directory under a safe, new name, and return that name.

    Refused are unknown suffixes (400), empty files (400), and files over the limit (413), of which
    nothing stays.
    """
    base = re.split(r"[\\/]", name)[-1]
    stem, dot, suffix = base.rpartition(".")
    if not stem or f".{suffix.lower()}" not in SUFFIXES:
        raise UploadError(400, "unsupported file type")
    safe = re.sub("[^A-Za-z0-9_-]+", "_", stem).strip("_") or "upload"
    path, size = Path(directory) / f"{safe}_{uuid.uuid4().hex[:8]}.{suffix.lower()}", 0
    try:
        with path.open("wb") as f:
            for block in content:
                size += len(block)
                if size > most:
                    raise UploadError(413, "file too large")
                f.write(block)
        if not size:
            raise UploadError(400, "empty file")
    except UploadError:
        path.unlink(missing_ok=True)
        raise
    return path.name
