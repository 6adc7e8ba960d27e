"""Names mentioned in texts, against one pattern per name."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tsalign.functions.mentions import mention_share, mentions


def by_patterns(text, terms):
    low = (text or "").lower()
    return sorted(
        name for name, words in terms.items()
        if any(re.search(r"\b" + re.escape(w.lower()) + r"\b", low, re.ASCII) for w in words)
    )


def test_equals_one_pattern_per_name(spark):
    rng = random.Random(5)
    letters = ["a", "b", "ab", "ba", "b_a", "a1"]
    gaps = [" ", " ", "-", "&", ", ", "  "]
    texts = ["".join(x for _ in range(rng.randrange(40)) for x in (rng.choice(letters), rng.choice(gaps))) for _ in range(300)]
    texts += ["", None, "   ", "A&B", "a b a b a", "&a&", "ab" * 5000, "a " * 5000 + "b_a-a1"]
    terms = {
        "one": ["a1"], "pair": ["a b"], "triple": ["A B a"], "joined": ["a&b", "b_a-a1"], "either": ["abab", "ba"],
        "also ba": ["BA"], "wide": ["a  b"], "comma": ["ba, ab"], "never": ["zz"],
    }
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = dict(df.select("i", mentions(F.col("text"), terms)).collect())
    assert {i: list(v) for i, v in got.items()} == {i: by_patterns(t, terms) for i, t in enumerate(texts)}
    words = {k: v for k, v in terms.items() if k in ("one", "either", "also ba", "never")}
    got = dict(df.select("i", mentions(F.col("text"), words)).collect())
    assert {i: list(v) for i, v in got.items()} == {i: by_patterns(t, words) for i, t in enumerate(texts)}


def test_many_terms(spark):
    terms = {f"n{i}": [f"w{i}", f"w{i} x"] for i in range(1000)}
    df = spark.createDataFrame([("w7, w999 x and w1000",), ("none",)], "text string")
    rows = [r[0] for r in df.select(mentions(F.col("text"), terms)).collect()]
    assert rows == [["n7", "n999"], []]


def test_quotes(spark):
    terms = {"it's": ["o'b", "a\\b"], "back\\": ["a\\b", "a\nb"]}
    df = spark.createDataFrame([("o'b",), ("x a\\b",), ("a\nb",), ("a b",)], "text string")
    assert [r[0] for r in df.select(mentions(F.col("text"), terms)).collect()] == [["it's"], ["back\\", "it's"], ["back\\"], []]


def test_edges(spark):
    df = spark.createDataFrame([("a",), (None,)], "text string")
    assert [r[0] for r in df.select(mentions(F.col("text"), {})).collect()] == [[], []]
    for term in ("", " a", "a.", "&"):
        with pytest.raises(ValueError):
            mentions(F.col("text"), {"x": [term]})


def test_share(spark):
    df = spark.createDataFrame([(["a", "a", "b"],), (["a", "other"],), ([],), (None,)], "found array<string>")
    rows = [tuple(r) for r in mention_share(df, "found", ["a", "b", "c"]).collect()]
    assert rows == [("a", 2, 50.0), ("b", 1, 25.0), ("c", 0, 0.0)]
    assert [tuple(r) for r in mention_share(df.limit(0), "found", ["a"]).collect()] == [("a", 0, None)]
