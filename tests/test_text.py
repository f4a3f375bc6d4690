"""Cleaning and tokenising against fixed rows and a plain Python model."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelloom.functions import chars
from labelloom.functions import text as tx
from labelloom.operators import audit, cleaning

FIXED = [
    ("#नेपाल राम्रो https://a.b/c", "नेपाल राम्रो"),
    ("हेर्नुहोस् www.foo.com अब", "हेर्नुहोस् अब"),
    ("@ram राम्रो", "राम्रो"),
    ("@नेपाल राम्रो", "ेपाल राम्रो"),
    ("a@b.com", "a.com"),
    ("https://youtu.be/abc123", ""),
    ("क \u001cख\nग", "क ख ग"),
    ("क\u00a0ख", "क ख"),
    (None, ""),
    ("ABC 12 😀", "ABC 12 😀"),
]


def model(s):
    if s is None:
        return ""
    for pattern, keep in ((r"https?://\S+", ""), (r"www\.\S+", ""), (r"@\w+", ""), (r"#(\w+)", r"\1"), (r"\s+", " ")):
        s = re.sub(pattern, keep, s)
    return s.strip()


def run(spark, texts, expr):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def test_clean_fixed_rows(spark):
    assert run(spark, [a for a, _ in FIXED], tx.clean(F.col("text"))) == [b for _, b in FIXED]


def test_clean_mark_aware(spark):
    assert run(spark, ["@नेपाल राम्रो"], tx.clean(F.col("text"), mark_aware=True)) == ["राम्रो"]


PIECES = st.sampled_from(["http", "s://", "https://x", "www.", "@", "#", "a", "म", "्", "े", " ", "\n", "\u00a0",
                          "\u001c", "\u2003", "9", "०", "_", ".", "😀", "।", "é"])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=30, max_size=60))
def test_clean_matches_python(spark, texts):
    assert run(spark, texts, tx.clean(F.col("text"))) == [model(s) for s in texts]


def test_drop_empty_counts(spark, corpus):
    from pyspark.sql import Observation
    seen = Observation()
    out = cleaning.drop_empty(cleaning.clean_rows(corpus([("https://a", 1), ("क", 1), (None, 0)])), seen)
    assert [r.text for r in out.collect()] == ["क"]
    assert seen.get == {"rows_in": 3, "rows_blank": 2}


def test_cleaning_runs_once(spark, corpus):
    """The blank filter must not repeat the cleaning expression below it."""
    plan = cleaning.drop_empty(cleaning.clean_rows(corpus([("a", 1)])))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("https?://") == 1


def test_tokens_and_bigrams(spark):
    toks = tx.tokens(F.col("text"))
    assert run(spark, ["राम्रो छ।", "राम्रो", "", None], toks) == [["राम्रो", "छ।"], ["राम्रो"], [], []]
    assert run(spark, ["A b c", "one", ""], tx.ngrams(toks)) == [["a", "b", "c", "a b", "b c"], ["one"], []]
    assert run(spark, ["राम्रो छ।"], tx.tokens(F.col("text"), chars.TOKEN_WITHOUT_DANDA)) == [["राम्रो", "छ"]]
    fragments = run(spark, ["राम्रो काम"], tx.tokens(F.col("text"), chars.PLAIN_TOKEN))[0]
    assert all(f not in ("राम्रो", "काम") for f in fragments)


def test_words_and_previews(spark):
    assert run(spark, [" a  b\u00a0c ", None], F.size(tx.words(F.col("text")))) == [3, 0]
    assert run(spark, ["abcdef", "abc"], tx.shorten(F.col("text"), 3)) == ["abc…", "abc"]
    assert run(spark, ["a\nb"], tx.snippet(F.col("text"))) == ["a b"]


def test_normalize_labels(spark, corpus):
    rows = cleaning.normalize_labels(corpus([("a", -1), ("b", 0), ("c", 1), ("d", 5), ("e", None)])).collect()
    assert [(r.text, r.label) for r in rows] == [("a", 0), ("b", 1), ("c", 2)]


def test_noise_audit(spark, corpus):
    df = corpus([("see https://x.y now", 0), ("www.a.b", 0), ("@u #t", 0), ("😀☀", 0), ("  \u00a0", 0), ("०१", 0), (None, 0)])
    got = {r.pattern: r.n for r in audit.noise_audit(df).collect()}
    assert got == {"http_url": 1, "www_url": 1, "mention": 1, "hashtag": 1, "latin": 3, "digit": 1, "emoji": 1, "blank": 2}


def test_script_mix(spark, corpus):
    row = audit.script_mix(corpus([("कa1 ", 0), ("", 0)])).first()
    assert (row.devanagari, row.latin, row.digit, row.whitespace, row.other) == (12.5, 12.5, 12.5, 12.5, 0.0)
    one = audit.script_mix(corpus([("ab", 0), ("12", 0)]), first_rows=1).first()
    assert one.latin == 100.0 and one.digit == 0.0


@pytest.mark.parametrize("ch", ["²", "①", "०", "5"])
def test_any_digit(spark, ch):
    assert ch.isdigit() and run(spark, [ch], tx.class_count(F.col("text"), chars.ANY_DIGIT)) == [1]
