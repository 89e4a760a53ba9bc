"""Benchmark decontamination by templates: items are found again when their numbers, names or units have changed.

Texts become templates: numbers, names and units turn into typed placeholders. Windows of eight words
are joined on their hash, by the template's words and by the text's own in lower case; runs of windows with
one offset make a passage, and the slots of a passage must be filled consistently: each value of the item by one
value of the text, and each value of the text for one of the item.
Built from DataFrame functions alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import bounded, keep_ids, table, words_of, written

WINDOW = 8
#: A window with fewer words that aren't placeholders is told by its own words alone, not by its template too.
LITERALS = 4
#: A passage is a leak from so many words on, or from half the item's words if those are fewer.
PASSAGE_WORDS = 13
#: Benchmarks of up to so many windows are broadcast; larger ones are joined by a shuffle.
BROADCAST_WINDOWS = 2_000_000

NUMBER, NAME, UNIT = "0num", "0name", "0unit"
UNITS = "km|cm|mm|nm|mi|miles?|met(?:er|re)s?|feet|foot|ft|inch(?:es)?|kg|mg|g|grams?|lbs?|pounds?|ounces?|oz|tons?|tonnes?|ml|cl|l|lit(?:er|re)s?|gallons?|s|sec(?:ond)?s?|min(?:ute)?s?|h|hours?|hrs?|days?|weeks?|months?|years?|ms|hz|khz|mhz|ghz|kb|mb|gb|tb|v|volts?|w|watts?|kw|kwh|j|joules?|n|pa|k|mol|percent|dollars?|euros?|cents?|usd|eur|gbp"
SPACE = r"\x20\x09-\x0D"
# Marks within words go, and so do words of marks alone, from the text and from its template alike.
MARKS = rf"[^\p{{L}}\p{{N}}{SPACE}]+"
# Each pattern begins with what is rare, so that most characters are passed over at once.
NUMBERS = r"[0-9](?<![\p{L}\p{N}][0-9])[0-9]*(?:[.,:/][0-9]+)*(?![\p{L}\p{N}])"
AFTER_NUMBER = rf"(?i){NUMBER}([{SPACE}-]?)(?:{UNITS})(?![\p{{L}}\p{{N}}])"
# A word with a capital, wherever it stands: a name may begin a sentence. Its own words tell a window, too, so that
# a passage is found in another case.
NAMES = r"\p{Lu}(?<![\p{L}\p{N}]\p{Lu})\p{Ll}+(?![\p{L}\p{N}])"
#: A word of the template that has a placeholder in it.
SLOT = f"^(?:{NUMBER}|{NAME}|{UNIT})"


def _without_marks(text: Column) -> Column:
    return F.regexp_replace(text, MARKS, "")


def _numbered(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, NUMBERS, NUMBER), AFTER_NUMBER, f"{NUMBER}$1{UNIT}")


def _templated(df: DataFrame, key: str) -> DataFrame:
    """key, own (the words), words (the template's, word for word beside them), both in lower case.

    Numbers and units are replaced in the text as it is, marks go, and names are replaced in what is left. Without
    placeholders own is null: the words are the template's.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    out = df.select(F.col(key), text.alias("__text"), _without_marks(text).alias("__bare"))
    out = out.withColumn("__template", F.regexp_replace(F.when(F.col("__text").rlike("[0-9]"), _without_marks(_numbered(F.col("__text")))).otherwise(F.col("__bare")), NAMES, NAME))
    changed = F.col("__bare") != F.col("__template")
    return out.select(key, F.when(changed, words_of(F.lower("__bare"))).alias("own"), words_of(F.lower("__template")).alias("words"))


def _window_hashes(own: Column, words: Column, at: Column, size: int, rule: bool) -> Column:
    """Hashes of a window: that of its own words, and that of its template's.

    With rule, the template's is left out if the window has no placeholder or is mostly placeholders, which begin with 0.
    It is enough that the items keep the rule: a text's window that equals an item's by template is as literal.
    Places count from 0. Elements are taken one by one: slice() would copy the whole array for each window.
    """
    part = [F.get(words, at + k) for k in range(size)]
    verbatim, typed = F.xxhash64(*[F.get(own, at + k) for k in range(size)]), F.xxhash64(*part)
    if not rule:
        return F.array(verbatim, typed)
    literal = sum((F.when(w.startswith("0"), 0).otherwise(1) for w in part), F.lit(0))
    return F.when((literal >= LITERALS) & (literal < size), F.array(verbatim, typed)).otherwise(F.array(verbatim))


#: Items with fewer words than this are too short to be told from chance and never match.
SHORTEST = 5


def _windows(df: DataFrame, key: str, strides: dict[int, int], at: str, rule: bool = False) -> DataFrame:
    """key, at and hash of windows of the given sizes, each at every stride-th place; rule: see _window_hashes."""

    def of(size: int, stride: int) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)), F.lit(stride))
        both = F.flatten(F.transform(places, lambda i: F.transform(_window_hashes(F.col("own"), F.col("words"), i, size, rule), lambda h: F.struct(i.alias(at), h.alias("hash")))))
        # Without placeholders there is one kind of words.
        one = F.transform(places, lambda i: F.struct(i.alias(at), F.xxhash64(*[F.get("words", i + k) for k in range(size)]).alias("hash")))
        none = F.array().cast(f"array<struct<{at}:int,hash:bigint>>")
        return F.when(F.size("words") < size, none).when(F.col("own").isNotNull(), both).otherwise(one)

    return reduce(DataFrame.unionByName, [df.select(key, F.inline(of(size, stride))) for size, stride in strides.items()])


def _having(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of texts whose doc_id is in ids; a null id equals a null id."""
    return keep_ids(texts, ids, "left_semi", BROADCAST_WINDOWS)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows (of the item, found), n_item_windows, changed: pairs that are leaks.

    changed: some slot holds another value than the item's. Null or empty texts on either side and items
    of fewer than SHORTEST words match nothing; repeated items and ids are pooled by id, null ids too;
    other columns play no part.
    """
    items = benchmark.select("item_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct().withColumn("__item", F.xxhash64("item_id", "text"))
    names = items.select("__item", "item_id")
    items = _templated(items, "__item").where(F.size("words") >= SHORTEST)
    items = written(items.withColumn("size", F.least(F.size("words"), F.lit(WINDOW))), "op2-items")
    n_windows = (F.size("words") - F.col("size") + 1).cast("long")
    items = items.withColumn("n_item_windows", n_windows).withColumn("enough", F.least(F.lit(PASSAGE_WORDS - WINDOW + 1), F.ceil(n_windows / 2)).cast("int"))
    strides = {r["size"]: r["stride"] for r in items.groupBy("size").agg(F.min("enough").alias("stride")).orderBy("size").collect()}
    if not strides:
        return docs.select("doc_id").limit(0).crossJoin(names.select("item_id").limit(0)).select("doc_id", "item_id", F.lit(0).cast("long").alias("n_windows"), F.lit(0).cast("long").alias("n_item_windows"), F.lit(False).alias("changed"))
    wanted = reduce(DataFrame.unionByName, [_windows(items.where(F.col("size") == s), "__item", {s: 1}, "item_at", True) for s in strides])
    wanted = bounded(wanted, BROADCAST_WINDOWS)

    # A passage is a run of windows, each the next of the one before, in text and item. A run of
    # `enough` windows has one at a place that the least of these numbers divides: those places tell
    # which texts can have a passage, and only these are looked at in every place.
    texts = docs.select("doc_id", "text")
    touched = _windows(_templated(texts, "doc_id"), "doc_id", strides, "at").join(wanted, "hash", "left_semi")
    touched = written(touched.select("doc_id").distinct(), "op2-touched")
    some = _having(texts, touched)
    hits = _windows(_templated(some, "doc_id"), "doc_id", dict.fromkeys(strides, 1), "at").join(wanted, "hash").select("doc_id", "__item", (F.col("at") - F.col("item_at")).alias("offset"), "item_at").distinct()
    run = F.col("item_at") - F.row_number().over(Window.partitionBy("doc_id", "__item", "offset").orderBy("item_at"))
    runs = hits.withColumn("__run", run).groupBy("doc_id", "__item", "offset", "__run").agg(F.count(F.lit(1)).alias("found"), F.min("item_at").alias("first"), F.max("item_at").alias("last"))
    passages = runs.join(bounded(items.select("__item", "n_item_windows", "size", "enough"), BROADCAST_WINDOWS), "__item")
    passages = written(passages.where(F.col("found") >= F.col("enough")), "op2-passages")

    # Only texts with a passage are made into words again, to compare what fills the slots.
    again = _templated(_having(texts, passages.select("doc_id").distinct()), "doc_id")
    again = again.select(F.col("doc_id").alias("__id"), F.coalesce("own", "words").alias("doc_own"), F.col("words").alias("doc_words"))
    both = again.join(passages, again["__id"].eqNullSafe(passages["doc_id"])).join(bounded(items.select("__item", F.coalesce("own", "words").alias("own"), "words"), BROADCAST_WINDOWS // WINDOW), "__item")
    length = F.col("last") - F.col("first") + F.col("size")
    theirs, mine = F.col("first") + F.col("offset") + 1, F.col("first") + 1
    both = both.withColumn("slots", F.filter(
        F.zip_with(
            F.arrays_zip(F.slice("words", mine, length).alias("t"), F.slice("own", mine, length).alias("v")),
            F.arrays_zip(F.slice("doc_words", theirs, length).alias("t"), F.slice("doc_own", theirs, length).alias("v")),
            lambda x, y: F.struct(x["t"].alias("t"), y["t"].alias("u"), x["v"].alias("v"), y["v"].alias("w")),
        ),
        lambda s: s["t"].rlike(SLOT) & (s["t"] == s["u"]),
    ))
    pairs = F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["t"], s["v"], s["w"]))))
    values = F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["t"], s["v"]))))
    fillings = F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["t"], s["w"]))))
    sound = both.where((pairs == values) & (pairs == fillings)).withColumn("changed", F.exists("slots", lambda s: s["v"] != s["w"]))
    out = sound.select("doc_id", "__item", "found", "n_item_windows", "changed").join(bounded(names, BROADCAST_WINDOWS), "__item")
    return out.groupBy("doc_id", "item_id").agg(F.max("found").alias("n_windows"), F.max("n_item_windows").alias("n_item_windows"), F.min("changed").alias("changed"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, that hold no item of the benchmark. Rows with a null id go or stay together."""
    return keep_ids(docs, written(leaks(docs, benchmark).select("doc_id").distinct(), "op2-leaks"), "left_anti")


def op2_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it leaks."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
