"""Registered queries of the training-data operators.

Each ``opN_<name>`` applies its operator with production parameters to its
whole table and derives the contract's columns from the operator's output.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptlens.llm import (alignment, decontam, hamming_index, html, langid, ngram_join, oracle, packing, periodic_runs,
                            pii, quality, shuffle, toxicity, training_order)
from scriptlens.llm.common import read_table


def fold(n: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op1_pii_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_*`` and ``base_sha256`` count and digest the base spans; ``spans``
    has all, and ``n_added`` says how many the tagger adds."""
    found = pii.find_spans(read_table(spark, sf_dir, "documents"), keep=["doc_id"])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of_kind(spans: Column, kind: str) -> Column:
        return F.filter(spans, lambda s: s["kind"] == kind)

    base = F.filter("pii", lambda s: s["base"])
    return found.select(
        "doc_id",
        *[F.size(of_kind(base, kind)).cast("long").alias(f"n_{kind}")
          for kind in pii.KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"),
        (F.size("pii") - F.size(base)).cast("long").alias("n_added"))


def op2_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.main_text(read_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shuffle.external_shuffle(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "bucket")


def op4_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.train(docs, fold(4) != 2)
    out = langid.label_languages(docs, model)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["lang"], s["start"], s["end"])), ",")
    return out.select("doc_id", (F.coalesce(fold(4), F.lit(0)) == 2).alias("held_out"), "lang_pred",
                      "score", "n_spans", spans.alias("lang_spans"))


def op5_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept")


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise(read_table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.similar_classes(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), fold(5) != 0)
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (F.coalesce(fold(5), F.lit(1)) == 0).alias("held_out"),
                      F.col("toxic_score").alias("score"),
                      (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def planted_repeats(doc_id: int | None, words: list[str]) -> list[str]:
    """The contract's change of a tenth of the documents: from word a on, the
    words go on with period p. Documents without an id stay as they are."""
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a:a + p]
    return words[:a] + (cycle * (-(-(n - a) // p)))[:n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(read_table(spark, sf_dir, "documents"), keep=["doc_id"], change=planted_repeats)
    # all runs of a row: lengths and periods are below 2^31, so products are exact
    best = F.aggregate("runs", F.element_at("runs", 1), lambda top, r: F.when(
        r["length"] * top["period"] > top["length"] * r["period"], r).otherwise(top))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]),
                                                                F.lit("\n"))), "")
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.alignment_counts(read_table(spark, sf_dir, "documents"), keep=["doc_id"], links=alignment.END)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_hamming_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_index.nearest_neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_bilstm_crf": op1_pii_bilstm_crf,
    "op2_host_suffix_array": op2_host_suffix_array,
    "op3_external_shuffle": op3_external_shuffle,
    "op4_language_spans": op4_language_spans,
    "op5_positional_index": op5_positional_index,
    "op6_quality_rules": op6_quality_rules,
    "op7_training_order": op7_training_order,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_toxicity": op9_toxicity,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_alignment": op12_token_alignment,
    "op13_hamming_neighbours": op13_hamming_neighbours,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = oracle.sql()
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
