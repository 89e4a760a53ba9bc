import pytest
from pyspark.sql import functions as F

from quern.functions import text as tx


def one(spark, f, *values):
    schema = ", ".join(f"c{i} {'double' if isinstance(v, float) else 'string'}" for i, v in enumerate(values))
    df = spark.createDataFrame([values], schema)
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


@pytest.mark.parametrize(
    ("question", "error"),
    [(None, "empty"), ("", "empty"), ("   ", "empty"), ("x" * 2001, "too long"), ("!!!@@@###$$$%%%^^^&&&", "no words"), ("<b>What is X?</b>", None), ("Où est-ce\u00a0?", None)],
)
def test_question_error(spark, question, error):
    assert one(spark, tx.question_error, question) == error


def test_cleaned_question(spark):
    assert one(spark, tx.cleaned_question, "\t<b>What is X?</b>\u00a0\n") == "What is X?"


@pytest.mark.parametrize(("name", "stem"), [("../../etc/passwd.md", "passwd"), ("a b(1).txt", "a_b_1"), ("...", "upload"), ("", "upload"), ("__x__.pdf", "x"), ("C:\\d\\Report v2.md", "Report_v2")])
def test_safe_stem(spark, name, stem):
    assert one(spark, tx.safe_stem, name) == stem


def test_topic(spark):
    assert one(spark, tx.topic, "deep-sea_life_0a1b2c3d.md") == "deep sea life"


def test_cache_key_joins_parts(spark):
    import hashlib

    assert one(spark, lambda a, b: tx.cache_key("router", a, b), "q", "t") == "v1:router:" + hashlib.sha256(b"q|t").hexdigest()
    assert one(spark, lambda a, b: tx.cache_key("router", a, b), "q", None) is None


@pytest.mark.parametrize(("ms", "shown"), [(0.0, "0 ms"), (999.4, "999 ms"), (1000.0, "1.00 s"), (3815.0, "3.81 s"), (6625.0, "6.63 s"), (12345.6, "12.35 s")])
def test_milliseconds(spark, ms, shown):
    assert one(spark, tx.milliseconds, ms) == shown


def test_tokens_split_at_other_letters(spark):
    assert one(spark, tx.tokens, "Café No.7, naïve") == ["caf", "no", "7", "na", "ve"]
    assert one(spark, tx.tokens, None) == []


def test_markers_and_snippet(spark):
    assert one(spark, tx.markers, "a [1][3] b [1] [x]") == ["[1]", "[3]"]
    assert one(spark, tx.snippet, "é" * 201) == "é" * 200 + "..."
    assert one(spark, tx.snippet, "é" * 200) == "é" * 200
