"""Literal cases for parsing, normalisation, snippets and highlights."""

import pytest
from pyspark.sql import functions as F

from scriptlens.functions.query import display_parts, parse_query, query_parts, query_type
from scriptlens.functions.snippet import highlight, snippet
from scriptlens.functions.text import (
    normalize_baseline,
    normalize_classifier,
    normalize_search,
    require_columns,
    search_tokens,
    title_boosted,
)
from scriptlens.functions.wordlists import HIGHLIGHT_CLOSE, HIGHLIGHT_OPEN


@pytest.mark.parametrize("q,qtype,parts", [
    ("coffee", "phrase", ["coffee"]),
    ("coffee&shop", "and", ["coffee", "shop"]),
    ("coffee/shop", "or", ["coffee", "shop"]),
    ("wedding&cake&beautiful", "and", ["wedding", "cake", "beautiful"]),
    ("  coffee & shop  ", "and", ["coffee", "shop"]),
    ("a&b/c", "and", ["a", "b/c"]),
    ("&", "and", []),
    ("  Coffee Shop ", "phrase", ["coffee shop"]),
])
def test_parse(one, q, qtype, parts):
    assert one(query_type, q) == qtype
    assert one(query_parts, q) == parts
    r = one(parse_query, q)
    assert r["type"] == qtype and list(r["terms"]) == parts


def test_display_parts_split_on_both(one):
    assert one(display_parts, "a&b/c") == ["a", "b", "c"]


def test_normalize_removes_urls_and_digits(one):
    out = one(normalize_search, "Check this out https://example.com cool")
    assert "https" not in out and "example" not in out and out == "check this out cool"
    assert one(normalize_search, "I have 123 apples") == "i have apples"


def test_normalize_null_number_empty(spark):
    df = spark.createDataFrame([(None, 123, "")], "a string, b int, c string")
    r = df.select(normalize_search("a").alias("a"), normalize_search("b").alias("b"),
                  normalize_search("c").alias("c")).first()
    assert (r.a, r.b, r.c) == ("", "", "")


def test_normalize_repeats_and_long_words(one):
    assert one(normalize_search, "Sooooo goooood") == "soo good"
    # repeated letters are reduced before long words are dropped
    assert one(normalize_search, "x " + "a" * 10 + "b" * 25 + " y").split() == ["x", "aabb", "y"]
    assert one(normalize_search, "x " + "abcdefghij" * 3 + " y").split() == ["x", "y"]
    assert one(normalize_search, "x " + "abcdefghi" * 3 + " y").split() == ["x", "abcdefghi" * 3, "y"]


def test_tokens_drop_stop_words_and_names(one):
    assert "the" not in one(search_tokens, "the quick brown fox")
    toks = one(search_tokens, "ross said hello")
    assert "ross" not in toks and "hello" in toks


def test_title_boost(one):
    out = one(lambda d, t: title_boosted(d, t, 2), "This is dialogue", "Title")
    assert out.count("Title") >= 2
    assert one(lambda d, t: title_boosted(d, t, 0), "d", "Title") == "d"
    assert one(lambda d, t: title_boosted(d, t, 2.9), "d", "T") == "d T T"


def test_snippet_context(one):
    text = "We met yesterday.\nThey run coffee shops downtown.\nSee you later."
    out = one(lambda t: snippet(t, F.array(F.lit("coffee"))), text)
    assert "coffee" in out
    assert out == "We met yesterday. They run coffee shops downtown. See you later."


def test_snippet_truncates(one):
    out = one(lambda t: snippet(t, F.array(F.lit("a")), 100), "a " * 500)
    assert len(out) <= 103 and out.endswith("...")


def test_snippet_no_match_first_line(one):
    out = one(lambda t: snippet(t, F.array(F.lit("zebra"))), "First line here.\nSecond line.\nThird.")
    assert out == "First line here."


def test_snippet_sentence_branch_for_multiline_part(one):
    text = "Alpha beta. Gamma\ndelta here. End."
    out = one(lambda t: snippet(t, F.array(F.lit("gamma\ndelta"))), text)
    assert out == "Gamma\ndelta here."


def test_highlight_both_parts(one):
    out = one(lambda t: highlight(t, display_parts(F.lit("coffee&tea"))), "I love coffee and tea")
    assert out == f"I love {HIGHLIGHT_OPEN}coffee{HIGHLIGHT_CLOSE} and {HIGHLIGHT_OPEN}tea{HIGHLIGHT_CLOSE}"


def test_highlight_case_insensitive_and_literal(one):
    out = one(lambda t: highlight(t, F.array(F.lit("a.b"))), "A.B axb")
    assert out == f"{HIGHLIGHT_OPEN}A.B{HIGHLIGHT_CLOSE} axb"


def test_classifier_names_removed(one):
    out = one(lambda t: normalize_classifier(t), "Ross said hello to Monica")
    assert "ross" not in out and "monica" not in out and out == "said hello to"
    # punctuation stays attached, so "ross," survives
    assert "ross," in one(lambda t: normalize_classifier(t), "Ross, hi")


def test_classifier_type_words(one):
    out = one(lambda t: normalize_classifier(t, True), "I am an INTJ personality type")
    assert "intj" not in out
    assert "intj" in one(lambda t: normalize_classifier(t, False), "I am an INTJ personality type")


def test_classifier_missing_column(spark):
    df = spark.createDataFrame([("x",)], "a string")
    with pytest.raises(ValueError):
        require_columns(df, ["posts"])


def test_baseline_sentence_markers_and_repeats(one):
    out = one(lambda t: normalize_baseline(t), "Hello. How are you? Great!")
    assert "eostokendot" in out and "eostokenquest" in out and "eostokenexs" in out
    assert "ooo" not in one(lambda t: normalize_baseline(t), "Hellooooo world")
