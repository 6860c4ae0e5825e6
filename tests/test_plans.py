"""Plan-shape checks: the physical plans keep the properties the design relies on."""

from conftest import SF001
from scriptlens.plans import catalog


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_uses_window_group_limit(spark):
    df = catalog.q_top_characters(spark, SF001)
    p = df._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in p


def test_no_cartesian_products(spark):
    for name in ["search_episodes", "character_types", "nb_cv_accuracy", "cosine_topk", "line_context"]:
        p = plan(catalog.QUERIES[name](spark, SF001))
        assert "CartesianProduct" not in p, name


def test_literal_match_is_a_filter_without_a_join(spark):
    p = plan(catalog.q_match_and(spark, SF001))
    assert "Join" not in p


def test_batch_match_has_no_nested_loop_and_no_python(spark):
    p = plan(catalog.q_match_batch(spark, SF001))
    assert "NestedLoop" not in p and "Cartesian" not in p and "MapInPandas" not in p


def test_postings_of_a_frequent_term_are_in_several_files(spark):
    from pyspark.sql import functions as F

    from scriptlens.operators.index import materialize_index
    rows = spark.range(4_000).select(
        F.lit("s").alias("show_key"), F.lit(1).alias("season"), F.col("id").alias("episode"),
        F.concat(F.lit("t"), F.col("id")).alias("episode_title"), F.col("id").alias("line_no"),
        F.lit("c").alias("character"), F.lit("everywhere alike").alias("dialogue"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        postings = materialize_index(spark, rows).postings
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hit = postings.where("term = 'everywhere'").select("*", F.col("_metadata.file_path").alias("f"))
    assert hit.count() == 4_000 and hit.select("f").distinct().count() > 1


def test_scan_prunes_columns(spark):
    df = catalog.q_character_line_counts(spark, SF001)
    p = plan(df)
    # the conversation text is only read for titles, never whole rows twice
    assert "ReadSchema" in p
    assert "FileScan parquet" in p


def test_index_lookup_pushes_term_filter(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    try:
        idx = catalog.corpus_index(spark, SF001, "documents")
        df = idx.postings.where("term IN ('ertion', 'ouen')")
        assert "In(term, [ertion,ouen])" in plan(df)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_bm25_pushes_query_terms_into_postings_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    try:
        df = catalog.q_bm25_scores(spark, SF001)
        p = plan(df)
        assert "In(term, [" in p
        assert "BroadcastHashJoin" in p or "BroadcastExchange" in p
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
