"""Grouped views of the line table.

Group sizes are not bounded (a show, an episode or a character may own a large
share of all lines), so everything here is a grouped aggregate with map-side
partial aggregation, an equi-join, or a per-group limit planned as
``WindowGroupLimit``. The one exception is ``episode_documents``: its output
row *is* the concatenated episode, which must fit in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_words, normalize_classifier, py_strip, vectorizer_tokens
from ..functions.wordlists import (
    DEFAULT_PERSONALITY_LIMIT,
    MIN_STYLE_LINES,
    SHOW_ALIASES,
    SHOW_NAMES,
)
from ..session import materialize
from .classify import ordered_rank
from .index import DOC_KEYS
from .search import top_k

# Line numbers of one run when lines get their position in their episode.
CONTEXT_SPAN = 4096


def _map_literal(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def display_name(key) -> Column:
    """Display name of a show key, falling back to the key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.try_element_at(_map_literal(SHOW_NAMES), key), key)


def resolve_alias(typed) -> Column:
    """Canonical show key of a typed name (lower-cased, stripped), or null."""
    typed = F.col(typed) if isinstance(typed, str) else typed
    return F.try_element_at(_map_literal(SHOW_ALIASES), F.lower(py_strip(typed)))


def episode_documents(lines: DataFrame, sep: str = "\n") -> DataFrame:
    """A1 + P1: one row per episode, lines joined in file order; null keys dropped."""
    body = F.expr(f"listagg(coalesce(dialogue, ''), '{sep.encode('unicode_escape').decode()}') "
                  "WITHIN GROUP (ORDER BY line_no)")
    return (
        lines.dropna(subset=["season", "episode", "episode_title"])
        .groupBy(*DOC_KEYS)
        .agg(body.alias("dialogue"), F.count(F.lit(1)).cast("bigint").alias("n_lines"))
        .withColumn("dialogue_raw", F.col("dialogue"))
    )


def show_registry(lines: DataFrame) -> DataFrame:
    """S7 + A21: shows with display name and sizes."""
    return lines.groupBy("show_key").agg(
        F.countDistinct("season", "episode", "episode_title").cast("bigint").alias("n_episodes"),
        F.count(F.lit(1)).cast("bigint").alias("n_lines"),
        F.countDistinct("character").cast("bigint").alias("n_characters"),
    ).select("show_key", display_name("show_key").alias("show_name"), "n_episodes", "n_lines", "n_characters")


def line_counts(lines: DataFrame) -> DataFrame:
    """A3 / A4: lines per (show, character spelling); null names excluded."""
    return (
        lines.where(F.col("character").isNotNull())
        .groupBy("show_key", "character")
        .agg(F.count(F.lit(1)).cast("bigint").alias("n_lines"))
    )


def top_characters(lines: DataFrame, limit: int = DEFAULT_PERSONALITY_LIMIT) -> DataFrame:
    """The ``limit`` characters with most lines per show (ties by name)."""
    return top_k(line_counts(lines), ["show_key"],
                 [F.col("n_lines").desc(), "character"], limit, "count_rank")


def first_characters(lines: DataFrame, limit: int = DEFAULT_PERSONALITY_LIMIT) -> DataFrame:
    """A6 + W4: the first ``limit`` characters of each show by first appearance."""
    first = (
        lines.where(F.col("character").isNotNull())
        .groupBy("show_key", "character")
        .agg(F.min("line_no").alias("first_line_no"))
    )
    return top_k(first, ["show_key"], ["first_line_no", "character"], limit, "appearance_rank")


def line_context(lines: DataFrame) -> DataFrame:
    """W2 over the line table: previous and next line of every line.

    Line numbers may have gaps within an episode (other episodes in between,
    lines left out), so every line first gets its dense position in its episode
    (counts per run of ``CONTEXT_SPAN`` line numbers, then a row number inside a
    run; lines of one number follow each other by character and text); the
    neighbours are equi-joins on position - 1 / + 1. No window spans a whole
    episode; rows with null keys are one episode per combination.
    """
    keys = ["show_key", "season", "episode", "episode_title"]
    base = lines.select(*keys, "line_no", "character", "dialogue",
                        F.to_json(F.struct(*keys)).alias("_doc"))
    numbered = materialize(
        ordered_rank(base, ["_doc"], ["line_no", "character", "dialogue"],
                     F.floor(F.col("line_no") / F.lit(CONTEXT_SPAN)), "_at").select(*base.columns, "_at"))
    prev = numbered.select("_doc", (F.col("_at") + 1).alias("_at"),
                           F.col("character").alias("prev_character"), F.col("dialogue").alias("prev_dialogue"))
    nxt = numbered.select("_doc", (F.col("_at") - 1).alias("_at"),
                          F.col("character").alias("next_character"), F.col("dialogue").alias("next_dialogue"))
    joined = numbered.join(prev, ["_doc", "_at"], "left").join(nxt, ["_doc", "_at"], "left")
    return joined.drop("_doc", "_at")


def eligible_characters(lines: DataFrame, min_lines: int = MIN_STYLE_LINES) -> DataFrame:
    """P11 + A5 + M19: names of >= 3 characters with >= ``min_lines`` lines longer
    than 5 characters (all shows merged by spelling); ordered by name when shown."""
    return (
        lines.dropna(subset=["character", "dialogue"])
        .where((F.length("character") >= 3) & (F.length("dialogue") > 5))
        .groupBy("character")
        .agg(F.count(F.lit(1)).cast("bigint").alias("n_lines"))
        .where(F.col("n_lines") >= min_lines)
    )


def character_key(c="character") -> Column:
    return F.lower(F.col(c) if isinstance(c, str) else c)


def character_lines(lines: DataFrame) -> DataFrame:
    """(show_key, character_key, line_no, clean): every line of a named character,
    normalised for the classifier."""
    return lines.where(F.col("character").isNotNull()).select(
        "show_key", character_key().alias("character_key"), "line_no",
        normalize_classifier("dialogue").alias("clean"))


def character_terms(lines: DataFrame) -> DataFrame:
    """A2 as counts: how often each vectoriser term occurs in a character's whole
    text. Lines are counted where they are (partial aggregation); no character's
    text is ever put together."""
    return (
        character_lines(lines)
        .select("show_key", "character_key", F.explode(vectorizer_tokens(F.col("clean"))).alias("term"))
        .groupBy("show_key", "character_key", "term").agg(F.count(F.lit(1)).cast("bigint").alias("cnt"))
    )


def character_texts(lines: DataFrame, max_words: int | None = None) -> DataFrame:
    """A2 + M11: per (show, lower(character)) the classifier-normalised lines
    joined by a blank, trimmed; with ``max_words`` cut to that many words. The
    output row *is* the character's whole text; scoring uses ``character_terms``.

    With a limit only the first ``max_words`` lines with any word can
    contribute, so a per-group limit (partial top-k before the shuffle) bounds
    every group before the ordered concatenation; ``n_lines`` counts all lines (A4).
    """
    norm = character_lines(lines)
    counts = norm.groupBy("show_key", "character_key").agg(F.count(F.lit(1)).cast("bigint").alias("n_lines"))
    worded = norm.where(F.col("clean") != "")
    head = worded if max_words is None else top_k(
        worded, ["show_key", "character_key"], ["line_no"], max_words, "_r")
    joined = head.groupBy("show_key", "character_key").agg(
        F.expr("listagg(clean, ' ') WITHIN GROUP (ORDER BY line_no)").alias("_all")
    )
    return counts.join(joined, ["show_key", "character_key"], "left").select(
        "show_key", "character_key", "n_lines",
        F.coalesce(py_strip(F.col("_all")) if max_words is None
                   else first_words(py_strip(F.col("_all")), max_words), F.lit("")).alias("text"),
    )
