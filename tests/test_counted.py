"""Packed term counts and sorted runs: the rows of the grouped formulation, without its shuffles."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptlens.operators.counted import counted_terms, sorted_runs, unpacked, unpacked_runs
from scriptlens.operators.index import build_index, materialize_index, searchable_lines
from scriptlens.operators.search import prepare_queries, query_table, top_k, top_terms
from scriptlens.operators.topk import build_impacts
from scriptlens.operators.trigrams import TrigramIndex, build_trigrams, gram_runs, matched_by_trigrams

LINES = ("show_key string, season int, episode bigint, episode_title string, line_no bigint, "
         "character string, dialogue string")


def corpus(spark, n=60):
    words = ["coffee", "table", "window", "garden", "yellow"]
    rows = [("ab"[i % 2], 1, i % 7, f"title {i % 7} garden", i, "c", None if i % 11 == 0 else
             " ".join(words[k] for k in range(5) for _ in range((i + k) % 3))) for i in range(n)]
    return spark.createDataFrame(rows, LINES).repartition(4)


def rows(df, cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("batch", [1, 1000])
def test_documents_of_one_or_many_packed_rows_give_the_grouped_postings(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        lines = corpus(spark)
        got, want = materialize_index(spark, lines), build_index(lines)
        for name in ("postings", "doc_len", "term_stats"):
            cols = getattr(want, name).columns
            assert rows(getattr(got, name), cols) == rows(getattr(want, name), cols)
        assert got.summed is not None       # lines of a document lie in several tasks
        cols = ["show_key", "episode", "term", "tf_body", "term_rank"]
        best = top_k(want.postings.select(*cols[:-1]), cols[:2], [F.col("tf_body").desc(), "term"], 2, "term_rank")
        assert rows(top_terms(got, cols[:2], 2), cols) == rows(best, cols)
        impacts = build_impacts(spark, got)
        cols = want.postings.columns
        assert rows(impacts.postings, cols) == rows(want.postings, cols)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_postings_and_impacts_are_made_without_an_exchange(spark):
    lines = spark.range(300).select(F.col("id").alias("k"), F.array(F.lit("b"), F.col("id").cast("string"), F.lit("b")).alias("w"))
    packed = counted_terms(lines, ["k"], ["w"])
    runs = unpacked_runs(packed, ["k"], ["w"], ["term"], run_rows=100)
    for df in (packed, runs, sorted_runs(unpacked(packed, ["k"], ["w"]), ["term", "k"], run_rows=64)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, runs.collect())) == sorted(
        r for k in range(300) for r in ((k, "b", 2, 3), (k, str(k), 1, 3)))


def test_runs_are_sorted(spark):
    df = spark.range(100, numPartitions=1).select((F.col("id") * 37 % 10).cast("string").alias("t"), "id")
    got = [r["t"] for r in sorted_runs(df, ["t"], run_rows=1000).collect()]
    assert got == sorted(got) and len(got) == 100


def test_rows_without_tokens_keep_their_key(spark):
    df = spark.createDataFrame([(1, []), (2, ["x"]), (1, None)], "k int, w array<string>").coalesce(1)
    got = sorted(map(tuple, counted_terms(df, ["k"], ["w"]).collect()))
    assert got == [(1, [], [], 0), (2, ["x"], [1], 1)]


def test_trigram_postings_that_come_twice_count_once(spark):
    index = build_trigrams(spark, searchable_lines(corpus(spark)))
    twice = TrigramIndex(index.texts, index.postings.unionByName(index.postings), index.grams)
    prepared = prepare_queries(query_table(spark, ["coffee&table", "window"]))
    cols = ["query_id", "show_key", "episode"]
    got = rows(matched_by_trigrams(twice, prepared), cols)
    assert got and got == rows(matched_by_trigrams(index, prepared), cols)


def test_trigrams_of_blocks_by_runs():
    texts = ["abcab", "", "ab", "x\U0001f600\x00\x00 é\uffff", "cab"]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0, 1, 1, 2]), pa.array(texts)], names=["block", "text"])
    got = [(r["gram"], r["block"]) for b in gram_runs(iter([batch])) for r in b.to_pylist()]
    want = sorted({(t[k:k + 3], b) for t, b in zip(texts, [0, 0, 1, 1, 2]) for k in range(len(t) - 2)})
    assert sorted(got) == want and [g for g, _ in got] == [g for g, _ in want]
