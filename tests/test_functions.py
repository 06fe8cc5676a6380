import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sessionlake.functions import text as X
from sessionlake.operators import active, search


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("r")).first().r


def test_redaction_order_and_prose(spark):
    assert one(spark, "password: sk-abcdefghijklmnop12", X.redact) == "password: [REDACTED_SECRET]"
    assert one(spark, "Authorization: Bearer abcdefghijkl.mn", X.redact) == "Authorization: Bearer [REDACTED_TOKEN]"
    assert one(spark, "the password policy is fine", X.redact) == "the password policy is fine"


def test_word_edges_are_ascii(spark):
    assert "fix" in one(spark, "éfixé", lambda c: F.when(X.matches(c, r"(?i)\bfix\b"), "fix").otherwise("no"))


def test_signal_and_snippet(spark):
    assert one(spark, "failed, but exit code 0", X.signal) == "success"
    assert one(spark, "it failed", X.signal) == "failure"
    assert one(spark, "fixed and failed", X.signal) == "unknown"
    cut = one(spark, "word " * 100, X.snippet)
    assert len(cut) == 220 and cut.endswith("…")


def test_guard_raises_on_missing_rows(spark):
    df = spark.createDataFrame([("a",), ("b",)], "hash string")
    assert active.guarded(df, "hash", 2).count() == 2
    with pytest.raises(PySparkException):
        active.guarded(df, "hash", 3).collect()


def test_phrase_terms():
    assert search.terms('foo-bar "a b" baz') == [["foo", "bar"], ["a", "b"], ["baz"]]
