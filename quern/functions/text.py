"""Text functions as column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.settings import DEFAULTS


def content_hash(content: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in hex."""
    return F.sha2(content, 256)


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the text in lower case; other letters end a token."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def stripped(text: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.regexp_replace(text, r"^(?U:\s)+|(?U:\s)+$", "")


def cache_key(namespace: str, *parts: Column) -> Column:
    """A key for a namespace and parts; null if a part is."""
    joined = F.concat(*[x for i, p in enumerate(parts) for x in ((F.lit("|"), p) if i else (p,))])
    return F.concat(F.lit(f"v1:{namespace}:"), F.sha2(joined, 256))


def cleaned_question(text: Column) -> Column:
    """The question without tags and outer white space."""
    return stripped(F.regexp_replace(text, "<[^>]+>", ""))


def question_error(text: Column, longest: int = DEFAULTS.question_chars) -> Column:
    """Why a question is refused, or null: its length is judged as sent, the rest after cleaning."""
    clean = cleaned_question(text)
    letters = F.regexp_count(clean, F.lit(r"(?U)\w"))
    return (
        F.when(text.isNull() | (F.length(text) < 1), "empty")
        .when(F.length(text) > longest, "too long")
        .when(clean == "", "empty")
        .when(letters / F.length(clean) < 0.1, "no words")
    )


def file_stem(name: Column) -> Column:
    """The last part of a path without its last suffix; a leading dot begins no suffix."""
    base = F.element_at(F.split(F.regexp_replace(name, r"[\\]", "/"), "/"), -1)
    return F.when(base.rlike(r"^.+\.[^.]+$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)


def safe_stem(name: Column) -> Column:
    """A stem that is safe as a file name: odd characters as one underscore, none at the ends, never empty."""
    safe = F.regexp_replace(file_stem(name), "[^A-Za-z0-9_-]+", "_")
    return F.coalesce(F.nullif(F.btrim(safe, F.lit("_")), F.lit("")), F.lit("upload"))


def topic(source: Column) -> Column:
    """What a source is about, from its file name: no suffix, no upload mark, words apart."""
    return F.btrim(F.translate(F.regexp_replace(file_stem(source), "_[0-9a-f]{8}$", ""), "_-", "  "))


def snippet(content: Column, chars: int = 200) -> Column:
    return F.concat(F.substring(content, 1, chars), F.when(F.length(content) > chars, "...").otherwise(""))


def markers(answer: Column) -> Column:
    """The distinct citation markers `[n]` in an answer, in order."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[\d+\]"), F.lit(0)))


def without_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def milliseconds(ms: Column) -> Column:
    """`x.xx s` from a second on, else whole milliseconds.

    Hundredths are rounded by the exact value of the quotient in binary: where the thousandth is a
    five, what the division left over tells on which side of the tie it is. All steps of that sum are exact.
    """
    q = ms / 1000
    left = ms - q * 1024 + q * 16 + q * 8
    hundredths = F.when(F.pmod(ms, F.lit(10.0)) == 5, F.floor(ms / 10) + F.when(left <= 0, 1).otherwise(0)).otherwise(F.floor(ms / 10 + 0.5)).cast("long")
    seconds = F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit(" s"))
    return F.when(ms >= 1000, seconds).otherwise(F.concat(F.floor(ms + 0.5).cast("string"), F.lit(" ms")))


def hash_bucket(word: Column, buckets: int = 64) -> Column:
    """SHA-256 of a word modulo the buckets, a power of two up to 256: its last byte tells."""
    return F.conv(F.substring(F.sha2(word, 256), 63, 2), 16, 10).cast("int") % buckets


def words(text: Column) -> Column:
    """Words of the text in lower case, between white space of any kind."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != "")
