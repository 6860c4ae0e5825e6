"""Stored sketches of distinct counts, united over shows.

A sketch per show and season holds the distinct characters, episodes and words of its
lines; sketches are written, read back and united per show or over all shows without
another look at the lines. ``LG_K`` fixes their size and error: a sketch of 2^k
registers has a relative standard error of 1.04 / sqrt(2^k), and ``ERRORS`` of them are
the stated bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import search_tokens
from ..session import new_table_path

LG_K = 12
ERRORS = 4.0
BOUND = ERRORS * 1.04 / 2 ** (LG_K / 2)
THINGS = ("characters", "episodes", "words")


def distinct_things(lines: DataFrame) -> DataFrame:
    """(show_key, season, thing, value) of every line, one row per value."""
    words = F.transform(search_tokens("dialogue"), lambda w: F.struct(F.lit("words").alias("thing"), w.alias("value")))
    named = F.array(
        F.struct(F.lit("characters").alias("thing"), F.col("character").alias("value")),
        F.struct(F.lit("episodes").alias("thing"), F.concat_ws("/", "season", "episode", "episode_title").alias("value")))
    return (lines.select("show_key", "season", F.explode(F.concat(named, words)).alias("t"))
            .select("show_key", "season", "t.thing", "t.value").where(F.col("value").isNotNull()))


def write_sketches(spark: SparkSession, lines: DataFrame, path: str | None = None) -> str:
    """One sketch per (show, season, thing), partial ones merged map-side."""
    path = path or new_table_path(spark, "sketches")
    distinct_things(lines).groupBy("show_key", "season", "thing").agg(
        F.hll_sketch_agg("value", LG_K).alias("sketch")).write.mode("overwrite").parquet(path)
    return path


def united_counts(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, thing, estimate) from stored sketches."""
    return sketches.groupBy(*keys, "thing").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).cast("bigint").alias("estimate"))


def checked_counts(spark: SparkSession, lines: DataFrame, path: str) -> DataFrame:
    """Per show and thing: estimate, exact count, and whether the estimate lies in
    the bound (or within one of a small count)."""
    exact = distinct_things(lines).groupBy("show_key", "thing").agg(F.countDistinct("value").alias("exact"))
    near = F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.lit(1.0), F.lit(BOUND) * F.col("exact"))
    return united_counts(spark.read.parquet(path), ["show_key"]).join(exact, ["show_key", "thing"]).select(
        "show_key", "thing", "estimate", "exact", near.alias("in_bound"))
