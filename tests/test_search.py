"""Search on the three-episode fixture against hand-derived BM25 values."""

import pytest

from scriptlens.operators.index import build_index, materialize_index
from scriptlens.operators.search import search, search_all_shows


def rows(spark, idx, q, k=5, w=2):
    out = search(spark, idx, [q], k, w).orderBy("rank").collect()
    return [((r.season, r.episode), r.relevance_score) for r in out]


@pytest.fixture()
def idx(spark, sample_episode_lines):
    return build_index(sample_episode_lines)


def test_phrase_coffee(spark, idx):
    assert rows(spark, idx, "coffee") == [((1, 2), pytest.approx(4.190182)), ((1, 1), pytest.approx(0.111748))]


def test_phrase_two_words(spark, idx):
    assert rows(spark, idx, "coffee shop") == [((1, 1), pytest.approx(0.633241))]


def test_and(spark, idx):
    assert rows(spark, idx, "wedding&beautiful") == [((2, 1), pytest.approx(5.448262))]


def test_or(spark, idx):
    assert rows(spark, idx, "wedding/coffee") == [
        ((2, 1), pytest.approx(4.891918)), ((1, 2), pytest.approx(4.190182)), ((1, 1), pytest.approx(0.111748))]


def test_stop_word_only_query_tie(spark, idx):
    assert rows(spark, idx, "the") == [((1, 2), 4.0), ((2, 1), 4.0)]


def test_no_match_is_empty_with_schema(spark, idx):
    df = search(spark, idx, ["dinosaur&spaceship"])
    assert df.count() == 0
    assert {"season", "episode", "episode_title", "relevance_score", "snippet_highlight"} <= set(df.columns)


def test_top_k_one(spark, idx):
    assert len(rows(spark, idx, "the", k=1)) <= 1


def test_materialized_index_same_result(spark, sample_episode_lines):
    idx = materialize_index(spark, sample_episode_lines)
    assert rows(spark, idx, "wedding/coffee") == [
        ((2, 1), pytest.approx(4.891918)), ((1, 2), pytest.approx(4.190182)), ((1, 1), pytest.approx(0.111748))]


def test_snippet_highlight_in_result(spark, idx):
    r = search(spark, idx, ["coffee"]).orderBy("rank").first()
    assert "\x1b[1;33mcoffee\x1b[0m" in r.snippet_highlight


def test_multi_line_document_snippet_crosses_rows(spark):
    lines = spark.createDataFrame([
        ("s", 1, 1, "T", 0, "a", "first line"),
        ("s", 1, 1, "T", 1, "b", "hello coffee\nsecond part"),
        ("s", 1, 1, "T", 2, "c", "third line"),
        ("s", 1, 2, "U", 3, "a", "nothing here"),
    ], "show_key string, season int, episode bigint, episode_title string, line_no bigint, "
       "character string, dialogue string")
    idx = build_index(lines)
    out = search(spark, idx, ["coffee"]).collect()
    assert len(out) == 1
    assert out[0].snippet_highlight == "first line hello \x1b[1;33mcoffee\x1b[0m second part"


def test_title_tail_match_on_last_line(spark):
    # the phrase spans the last line and the title: "... coffee" + " " + "Shop Talk"
    lines = spark.createDataFrame([
        ("s", 1, 1, "Shop Talk", 0, "a", "we like"),
        ("s", 1, 1, "Shop Talk", 1, "a", "good coffee"),
    ], "show_key string, season int, episode bigint, episode_title string, line_no bigint, "
       "character string, dialogue string")
    idx = build_index(lines)
    assert search(spark, idx, ["coffee shop"]).count() == 1


def test_search_all_shows_overall_rank(spark, sample_episode_lines):
    other = sample_episode_lines.selectExpr("'tbbt' as show_key", "season", "episode", "episode_title",
                                            "line_no", "character", "dialogue")
    idx = build_index(sample_episode_lines.unionByName(other))
    out = search_all_shows(spark, idx, ["coffee"]).orderBy("overall_rank").collect()
    assert [r.overall_rank for r in out] == [1, 2, 3, 4]
    assert {r.show_key for r in out} == {"friends", "tbbt"}


def test_many_parts_use_anchor_path(spark, sample_episode_lines):
    from scriptlens.operators.search import FEW_PARTS
    idx = build_index(sample_episode_lines)
    words = ["coffee", "wedding", "perk", "zzz", "everyone", "talk", "shop", "more", "welcome",
             "beautiful", "loved", "central", "let", "us", "about", "was", "it", "this"]
    assert len(words) > FEW_PARTS
    q = "/".join(words)
    n_or = search(spark, idx, [q], 10).count()
    assert n_or == 3
    q_and = "&".join(["coffee"] * 17)
    assert search(spark, idx, [q_and], 10).count() == 2


def test_show_filter_prunes_to_one_show(spark, sample_episode_lines):
    other = sample_episode_lines.selectExpr("'tbbt' as show_key", "season", "episode", "episode_title",
                                            "line_no", "character", "dialogue")
    idx = materialize_index(spark, sample_episode_lines.unionByName(other))
    out = search(spark, idx, ["coffee"], show_keys="tbbt").collect()
    assert {r.show_key for r in out} == {"tbbt"} and len(out) == 2
    # statistics are per show, so the scores equal the single-show ones
    assert sorted(r.relevance_score for r in out) == [pytest.approx(0.111748), pytest.approx(4.190182)]


def test_unknown_show_is_an_error(spark, sample_episode_lines):
    idx = build_index(sample_episode_lines)
    with pytest.raises(ValueError, match="nope"):
        search(spark, idx, ["coffee"], show_keys="nope")


def test_parts_of_all_lengths_match_like_plain_containment(spark):
    from scriptlens.operators.search import matched_documents, prepare_queries, query_table
    texts = ["abc def", "ABCD", "x\U0001F600yz", "", None, "aab baa", "ab", "line one\nline two", "é ü abc"]
    rows = [("s", 1, i, "t", i, "c", t, True) for i, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, "show_key string, season int, episode bigint, episode_title string, "
                                        "line_no bigint, character string, dialogue string, is_last boolean")
    parts = ["abc", "a", "b ", "x\U0001F600y", "\U0001F600yz", "one\nline", "ü abc", "def t", "zzz", "ab", "aab b",
             "bcd", "e one", "é ü", "baa", "abcd", "c d", "yz"]
    got = {(r.query_id, r.episode) for r in matched_documents(
        lines, prepare_queries(query_table(spark, parts))).collect()}
    want = {(q, i) for q, p in enumerate(parts) for i, t in enumerate(texts)
            if p.strip().lower() in ((t or "") + " t").lower()}
    assert got == want
