"""Op 6, quality rules: a threshold table compiled into one Spark projection.

Every metric is a built-in expression over one row (no user functions, no
shuffle). A rule is ``(name, metric, low, high)``; a document passes when every
metric lies in its closed interval. The contract's base rule (``n_words`` at
least 10, repeated-window words at most 20 percent) is checked first.

Defined results: null or blank text has all counts 0, ``base_failed`` true and
``kept`` false; repeated rows give repeated results; an empty table gives no
rows; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: function words of the four corpus languages
STOP_WORDS = {
    "en": "the of and to a in is that it for on with as was are be by this at from or an have not",
    "de": "der die das und in zu den mit von für auf ist im dem nicht ein eine als auch es an sich",
    "fr": "le la les de des et un une est en que qui dans pour sur pas au avec ce il elle du",
    "es": "el la los las de que y en un una por con para se del lo no su es al como más",
}
WHITE = " \t\n\x0b\f\r"
WHITE_RUN = r"[ \t\n\x0B\f\r]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


class Rule(NamedTuple):
    name: str
    metric: str
    low: float | None
    high: float | None


# the default threshold table; metrics are columns of ``metrics``
RULES = (
    Rule("length", "n_words", 10, 200_000),
    Rule("mean_word_length", "mean_word", 2.0, 15.0),
    Rule("symbol_ratio", "symbol_ratio", None, 0.1),
    Rule("stop_word_ratio", "stop_ratio", 0.02, None),
    Rule("duplicate_line_ratio", "dup_line_ratio", None, 0.3),
    Rule("upper_case_ratio", "upper_ratio", None, 0.5),
)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_RUN))


def repeated_window_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside some window of ``window`` words found at least twice.

    Windows are 64-bit hashes; only texts with a repeated window pay for the
    sort that locates them: neighbours with equal hash after sorting (hash,
    start) pairs, then the union length of the intervals [start, start+window).
    """
    def located(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            n = F.size(p)
            hit = F.filter(p, lambda x, k: (
                ((k > 0) & (F.get(p, k - 1)["h"] == x["h"]))
                | ((k < n - 1) & (F.get(p, k + 1)["h"] == x["h"]))))
            return F.sort_array(F.transform(hit, lambda x: x["i"]))

        def covered(s: Column) -> Column:
            return F.aggregate(
                F.transform(s, lambda v, k: F.when(
                    k + 1 < F.size(s), F.least(F.get(s, k + 1) - v, F.lit(window))).otherwise(window)),
                F.lit(0).cast("long"), lambda acc, v: acc + v)

        return bind(pairs, lambda p: bind(starts(p), covered))

    def counted(w: Column) -> Column:
        # hash every word once, then combine five word hashes per window
        hashes = bind(
            F.transform(w, lambda x: F.xxhash64(x)),
            lambda h: F.transform(
                F.sequence(F.lit(0), F.size(h) - window),
                lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])))
        return bind(hashes, lambda h: F.when(
            F.size(F.array_distinct(h)) < F.size(h), located(h)).otherwise(F.lit(0).cast("long")))

    return F.when(F.size(words) >= window, bind(words, counted)).otherwise(F.lit(0).cast("long"))


def metrics(text: Column) -> Column:
    """All counts of one text as a struct."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda x: F.trim(x, F.lit(WHITE)) != "")
    stops = sorted({v for s in STOP_WORDS.values() for w in s.split() for v in (w, w.capitalize())})

    def counts(w: Column) -> Column:
        n = F.size(w).cast("long")
        return F.struct(
            n.alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_window_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(stops))).cast("long").alias("n_stop"),
        )

    return F.struct(
        bind(words_of(text), counts).alias("w"),
        F.char_length(F.regexp_replace(full, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace(full, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        bind(lines, lambda a: F.struct(
            F.size(a).cast("long").alias("n_lines"),
            (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"))).alias("l"),
    )


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def passes(rules: tuple[Rule, ...]) -> Column:
    """The conjunction of the threshold table."""
    verdict = F.lit(True)
    for r in rules:
        if r.low is not None:
            verdict = verdict & (F.col(r.metric) >= r.low)
        if r.high is not None:
            verdict = verdict & (F.col(r.metric) <= r.high)
    return verdict


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the counts, the ratios and the verdict."""
    m = docs.select(F.col(id_col).alias("doc_id"), metrics(F.col(text_col)).alias("m"))
    flat = m.select("doc_id", "m.w.*", "m.n_symbols", "m.n_upper", "m.l.*")
    ratios = flat.select(
        "*",
        ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word"),
        ratio(F.col("n_symbols"), F.col("n_words")).alias("symbol_ratio"),
        ratio(F.col("n_stop"), F.col("n_words")).alias("stop_ratio"),
        ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        ratio(F.col("n_upper"), F.col("word_chars")).alias("upper_ratio"),
        ((F.col("n_words") < MIN_WORDS)
         | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
    )
    return ratios.withColumn("kept", ~F.col("base_failed") & passes(rules))
