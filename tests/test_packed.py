"""Packed counts and weights against the joined rows that they stand for."""

import pytest
from pyspark.sql import functions as F

from scriptlens.operators import classify as C
from scriptlens.operators import heads as H
from scriptlens.operators import profiles as P
from scriptlens.operators.sparse import packed_terms, packed_weights

TEXTS = ["alpha beta beta", "", None, "gamma alpha delta Alpha", "beta !!", "omega omega psi", "!", "delta gamma"]


@pytest.fixture(scope="module")
def texts(spark):
    """Ids that repeat in several partitions, an id that is null, texts without a token."""
    rows = [(None if i % 13 == 12 else i % 10, TEXTS[i % len(TEXTS)]) for i in range(40)]
    return spark.createDataFrame(rows, "row_id long, text string").repartition(5)


def rows(df, *cols):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()), key=repr)


def test_packed_counts_are_the_term_counts(texts):
    packed = C.packed_counts(texts, "row_id", "text")
    assert packed.count() == packed.select("row_id").distinct().count()
    want = C.term_counts(texts, "row_id", "text").where("row_id is not null")
    assert rows(C.unpacked_counts(packed, "row_id"), "row_id", "term", "cnt") == rows(want, "row_id", "term", "cnt")


def test_packed_weights_and_naive_bayes_equal_the_joined_ones(spark, texts):
    texts = texts.dropna(subset=["row_id"])
    counts = C.term_counts(texts, "row_id", "text").localCheckpoint()
    vocab = C.numbered(C.fit_tfidf(counts, 10, 4)).localCheckpoint()
    x = C.tfidf_weights(counts, vocab, "row_id")
    packed = packed_weights(C.packed_counts(texts, "row_id", "text"), vocab, "term", "n_w")
    entries = F.explode(F.arrays_zip("idx", "val")).alias("e")
    assert rows(packed.select("row_id", entries).select("row_id", "e.*"), "row_id", "idx", "val") == rows(
        packed_terms(x, vocab, "row_id").select("row_id", entries).select("row_id", "e.*"), "row_id", "idx", "val") != []
    # rows whose labels repeat count as often; JP has one class, SN none
    labels = spark.createDataFrame([(i % 7, d, y) for i in range(12) for d, y in (("EI", i % 2), ("TF", i % 7 // 4), ("JP", 1))],
                                   "row_id long, dim string, label int")
    (a, pa), (b, pb) = C.fit_nb(x, labels, vocab), C.fit_nb(packed, labels, vocab)
    assert rows(a, "dim", "label", "term", "logp") == rows(b, "dim", "label", "term", "logp")
    model = P.TraitModel(vocab.drop("term_index"), a, pa)
    lines = texts.select(F.monotonically_increasing_id().alias("lid"), F.coalesce("text", F.lit("")).alias("text")).localCheckpoint()
    out = ["lid", *[f"p_{d}" for d in C.DIM_NAMES], "mbti"]
    got = rows(P.score_rows(model, lines, "text"), *out)
    assert got == rows(P.score_texts(model, lines, "lid", "text"), *out) and len(got) == lines.count()


def test_lines_are_scored_without_a_shuffle(spark, texts):
    posts = spark.createDataFrame([(i, "ESTJ" if i % 2 else "INFP", "alpha beta" if i % 2 else "gamma delta") for i in range(20)],
                                  "row_id long, type string, posts string")
    split = posts.select("row_id", "type", F.lit("train").alias("split"))
    lines = texts.select(F.monotonically_increasing_id().alias("lid"), F.coalesce("text", F.lit("")).alias("text")).localCheckpoint()
    for model in (P.train_trait_model(posts, split)[0], H.train_heads(posts, split, epochs=2)):
        scored = P.score_rows(model, lines, "text")
        assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
        out = ["lid", *[f"p_{d}" for d in C.DIM_NAMES], "mbti"]
        want = P.score_counts(model, C.term_counts(lines, "lid", "text"), lines.select("lid"), "lid")
        assert rows(scored, *out) == rows(want, *out)


def test_equal_lines_are_ranked_one_by_one(spark):
    """Lines that are equal, or meet in their number only, keep their own scores."""
    posts = spark.createDataFrame([(i, "ESTJ" if i % 2 else "INFP", "alpha beta" if i % 2 else "gamma delta") for i in range(20)],
                                  "row_id long, type string, posts string")
    model, _ = P.train_trait_model(posts, posts.select("row_id", "type", F.lit("train").alias("split")))
    said = ["alpha beta", "alpha beta", "gamma delta", None]
    lines = spark.createDataFrame([("s", 1, 1, "T", 7 if k < 3 else 8, "Ann", t) for k, t in enumerate(said)],
                                  "show_key string, season int, episode long, episode_title string, line_no long, "
                                  "character string, dialogue string")
    got = P.quote_scores(lines, model, k=3).orderBy("quote_rank").collect()
    assert [r["dialogue_raw"] for r in got][:2] == ["alpha beta"] * 2 and got[0]["score"] == got[1]["score"] > got[2]["score"]
