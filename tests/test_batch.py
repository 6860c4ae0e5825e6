"""Batches ranked document by document against the full ranking."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptlens.operators import search as S
from scriptlens.operators.batch import half_up
from scriptlens.operators.index import materialize_index
from scriptlens.operators.trigrams import build_trigrams

COLUMNS = "show_key string, season int, episode long, episode_title string, line_no long, character string, dialogue string"
WORDS = ["lamp", "window", "garden", "river", "copper", "violet", "thunder", "meadow"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for episode in range(60):
        title = " ".join(rng.sample(WORDS, 2)) if episode % 7 else ""
        for _ in range(rng.randint(1, 4)):
            n += 1
            rows.append((f"show{episode % 2}", episode % 3, episode, title, n, "a", " ".join(rng.choices(WORDS, k=rng.randint(0, 6)))))
    lines = spark.createDataFrame(rows, COLUMNS).repartition(6, "episode")
    return lines, materialize_index(spark, lines)


def queries(spark):
    rng = random.Random(6)
    texts = [sep.join(rng.sample(WORDS, 3)) for sep in (" ", "&", "/") for _ in range(8)]
    texts += ["lamp/lamp", "&", "the", "lamp lamp & river", "zzz", ""]
    return spark.createDataFrame([(100 + 3 * i, t) for i, t in enumerate(texts)], "query_id bigint, query string")


@pytest.mark.parametrize("per_show,grams", [(True, False), (False, True)])
def test_a_batch_ranks_as_the_full_ranking(spark, corpus, per_show, grams):
    lines, index = corpus
    if grams:
        index = replace(index, grams=build_trigrams(spark, index.lines, block_chars=200))
    prepared = S.prepare_queries(queries(spark))
    groups, k = ["query_id"] + ["show_key"] * per_show, 2
    order = [*S.search_order(), "show_key"]
    cut = S.ranked_matches(index, prepared, 2, first=(k, per_show))
    full = S.ranked_matches(index, prepared, 2)

    def top(df):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r)
                      for r in S.top_k(df, groups, order, k).select("query_id", *S.DOC_KEYS, "bm25_score", "title_hit_count",
                                                                   "relevance_score", "rank").collect())

    assert top(cut) == top(full) != []


def test_a_task_sends_the_first_rows_only(spark, corpus):
    prepared = S.prepare_queries(queries(spark))
    full, cut = (df.groupBy("query_id", F.spark_partition_id()).count() for df in (
        S.ranked_matches(corpus[1], prepared, 2), S.ranked_matches(corpus[1], prepared, 2, first=(1, False))))
    assert full.agg(F.max("count")).first()[0] > cut.agg(F.max("count")).first()[0] == 1


def test_batches_with_met_or_null_ids_are_ranked_in_full(spark, corpus):
    rows = [(1, "lamp&river"), (1, "violet/garden")] + [(i, "lamp/river/copper/meadow") for i in range(2, 9)]
    prepared = S.prepare_queries(spark.createDataFrame(rows, "query_id bigint, query string"))
    assert S.batch_matches(corpus[1], prepared, 2, 1, True) is None


def test_a_text_in_a_block_of_many_parts_is_read_once_for_all(spark):
    """Null for the block's parts: all are told by their marks, none is tried by itself."""
    parts = [f"word{k:03d}" for k in range(300)] + ["x"]
    table = S.PartTable([{"query_id": i, "qtype": "or", "n_parts": 1, "part_idx": 0, "part": p} for i, p in enumerate(parts)])
    rows = [(1, "word007 word250", None), (2, "word007 word250", [250]), (3, "word001 x", []), (4, "wor", None)]
    texts = spark.createDataFrame(rows, "k int, text string, asked array<int>")
    for grouped in (True, False):
        got = {r["k"]: sorted(r["held"]) for r in S.held_parts(texts, ["k"], table, "text", "asked", grouped).collect()}
        assert got == {1: [7, 250], 2: [250], 3: [300]}


def test_half_up_rounds_decimals():
    x = np.array([0.0000005, -0.0000005, 1.2345675, 2.0000015, 1.23456749, -1e-9, 0.0])
    assert half_up(x).tolist() == [1e-6, -1e-6, 1.234568, 2.000002, 1.234567, 0.0, 0.0]
