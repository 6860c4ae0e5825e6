"""Top-k search by score bounds against the full search."""

import random

import pytest
from pyspark.sql import functions as F

from scriptlens.operators import search as S
from scriptlens.operators import topk as T
from scriptlens.operators.index import build_index, materialize_index

LINES = "show_key string, season int, episode bigint, episode_title string, line_no bigint, character string, dialogue string"


@pytest.fixture(scope="module")
def index(spark):
    """Documents in which a few are short and full of a term, most mention it once."""
    rng = random.Random(3)
    rows = []
    for e in range(400):
        filler = rng.choices([f"filler{chr(97 + j)}{chr(97 + k)}" for j in range(20) for k in range(6)], k=rng.randrange(5, 60))
        words = filler + rng.choice([[], ["coffee"], ["coffee"], ["dinosaur"], ["coffee", "dinosaur"]])
        if e % 40 == 0:
            words = ["coffee"] * 6 + ["dinosaur"] * (e % 3)
        rng.shuffle(words)
        rows.append((f"show{e % 2}", 1, e, rng.choice(["Coffee", "Pilot"]) if e % 50 == 7 else "Pilot", e, "x", " ".join(words)))
    return materialize_index(spark, spark.createDataFrame(rows, LINES).withColumn("is_last", F.lit(True)))


QUERIES = ["coffee", "dinosaur", "coffee/dinosaur", "coffee&dinosaur", "coffee coffee", "zzz", "the", "fillerab/coffee"]


@pytest.mark.parametrize("per_show,weight", [(True, 2), (False, 2), (True, 0)])
def test_pruned_top_k_equals_the_full_one(spark, index, per_show, weight):
    impacts = T.build_impacts(spark, index)
    prepared = S.prepare_queries(S.query_table(spark, QUERIES))
    groups = ["query_id", "show_key"] if per_show else ["query_id"]
    order = [F.desc("relevance_score"), "season", "episode", "episode_title"]

    def top(ranked):
        return sorted(tuple(r) for r in S.top_k(ranked, groups, order, 3).select(
            "query_id", "show_key", "episode", "bm25_score", "title_hit_count", "relevance_score", "rank").collect())

    pruned, read = T.pruned_matches(index, impacts, prepared, 3, weight, per_show)
    assert top(pruned) == top(S.ranked_matches(index, prepared, weight))
    every = T.bounded_blocks(impacts, index, prepared, weight, S.query_bounds(prepared))
    # postings rows, of all queries and of one that no title answers to
    for part, most in ((F.lit(True), 0.95), (F.col("query_id") == 1, 0.5)):
        n_read, n_all = (d.where(part).agg(F.sum("n")).first()[0] for d in (read, every))
        assert 0 < n_read < most * n_all


def test_block_bounds_hold(spark, index):
    impacts = T.build_impacts(spark, index)
    prepared = S.prepare_queries(S.query_table(spark, QUERIES))
    blocks = T.bounded_blocks(impacts, index, prepared, 2, S.query_bounds(prepared))
    rows = impacts.postings.join(blocks.select("query_id", "show_key", "term", "block", "qtf", "idf", "avgdl", "bound"),
                                 ["show_key", "term", "block"])
    assert rows.where(T.term_score(2) > F.col("bound") + 1e-9).count() == 0 and rows.count() > 300


def test_terms_of_negative_weight_read_everything(spark):
    rows = [("s", 1, k, "T", k, "x", "all " + ("all " * (k % 3)) + ("some" if k % 4 == 0 else "")) for k in range(40)]
    idx = build_index(spark.createDataFrame(rows, LINES))
    idx = materialize_index(spark, idx.lines)
    prepared = S.prepare_queries(S.query_table(spark, ["some/all", "some"]))
    impacts = T.build_impacts(spark, idx)
    pruned, read = T.pruned_matches(idx, impacts, prepared, 2, 2)
    full = S.top_k(S.ranked_matches(idx, prepared, 2), ["query_id", "show_key"], [F.desc("relevance_score"), "episode"], 2)
    got = S.top_k(pruned, ["query_id", "show_key"], [F.desc("relevance_score"), "episode"], 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, full.collect()))
