"""Text normalisation and tokenisation as Spark Column expressions.

Every function takes and returns a ``Column`` so the work stays inside
whole-stage code generation; there is no Python UDF in this module.
Regexes use the explicit classes from ``wordlists`` (Python's whitespace and
word-character sets) so results agree with Python semantics and with RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .wordlists import (
    CLASSIFIER_NAMES,
    NOT_WS,
    SEARCH_NAMES,
    SENTENCE_MARKS,
    STOP_WORDS,
    TYPE_WORDS,
    WORD,
    WS,
    lower_distinct,
)

URL_PATTERN = "https?://" + NOT_WS + "+"
LONG_WORD_SEARCH = r"\b[a-z]{30,}\b"
REPEATED_LETTERS = r"([a-z])\1{2,}"
# TYPE_WORDS: a letter of either side on every axis
TYPE_LETTERS = "".join("[" + "".join(sorted({w[i] for w in TYPE_WORDS})) + "]" for i in range(4))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_col(c), "^" + WS + "+|" + WS + "+$", "")


def py_split(c) -> Column:
    """Python ``str.split()`` without arguments: whitespace runs, no empties."""
    return F.filter(F.split(_col(c), WS + "+"), lambda t: t != "")


def word_bounded(alternatives: str, min_max: str | None = None) -> str:
    """A pattern for whole words (Python ``\\b...\\b`` over Unicode ``\\w``)."""
    body = WORD + min_max if min_max else "(?:" + alternatives + ")"
    return "(?<!" + WORD + ")" + body + "(?!" + WORD + ")"


def truncate_chars(c, n: int) -> Column:
    """First ``n`` characters plus ``...`` when longer than ``n``."""
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


# ---------------------------------------------------------------------------
# Search flavour (T1-T8) and tokens
# ---------------------------------------------------------------------------
def normalize_search(c) -> Column:
    t = F.coalesce(_col(c).cast("string"), F.lit(""))
    t = F.regexp_replace(t, URL_PATTERN, "")                 # T1
    t = F.lower(t)                                           # T3
    # T2 + T4 + T5 + T6 in one pass: "|", punctuation and every other
    # character outside a-z become blanks and whitespace runs collapse, so each
    # maximal run of characters outside a-z ends up as one blank.
    t = F.trim(F.regexp_replace(t, "[^a-z]+", " "))
    t = F.regexp_replace(t, REPEATED_LETTERS, "$1$1")        # T7
    t = F.regexp_replace(t, LONG_WORD_SEARCH, " ")           # T8
    return t


def search_excluded_words() -> list[str]:
    return lower_distinct(STOP_WORDS + SEARCH_NAMES)


def tokens_of_normalized(t) -> Column:
    """T9 + T11 on already normalised text (identity lemma)."""
    excluded = search_excluded_words()
    return F.filter(F.split(_col(t), " "), lambda x: (x != "") & ~x.isin(excluded))


def search_tokens(c) -> Column:
    """Normalise, split, drop stop words and names."""
    return tokens_of_normalized(normalize_search(c))


def lemma_tokens(df, id_col: str, tokens_col: str, lexicon):
    """T10 with a lexicon: (id, tokens) with every token replaced by its lemma in
    ``lexicon`` (term, lemma), if it has one; the order stays. The lexicon joins
    on the term, so Spark broadcasts it only while it is small."""
    exploded = df.select(id_col, F.posexplode_outer(tokens_col).alias("_at", "term"))
    found = exploded.join(lexicon.select("term", "lemma"), "term", "left").select(
        id_col, "_at", F.coalesce("lemma", "term").alias("token"))
    grouped = found.groupBy(id_col).agg(F.sort_array(F.collect_list(
        F.when(F.col("token").isNotNull(), F.struct("_at", "token")))).alias("_t"))
    return grouped.select(id_col, F.transform("_t", lambda t: t["token"]).alias("tokens"))


def query_tokens(q) -> Column:
    """Query terms for ranking, with the T14 fallback to raw lower-case words."""
    toks = search_tokens(q)
    raw = py_split(F.lower(F.coalesce(_col(q), F.lit(""))))
    return F.when(F.size(toks) > 0, toks).otherwise(raw)


def title_boosted(dialogue, title, weight: float) -> Column:
    """Dialogue followed by `` title`` repeated ``int(weight)`` times."""
    reps = max(int(weight), 0)
    d = F.coalesce(_col(dialogue).cast("string"), F.lit(""))
    t = F.coalesce(_col(title).cast("string"), F.lit(""))
    return F.concat(d, F.repeat(F.concat(F.lit(" "), t), F.lit(reps)))


# ---------------------------------------------------------------------------
# Classifier flavour
# ---------------------------------------------------------------------------
def require_columns(df, columns) -> None:
    """Raise ``ValueError`` naming the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Column(s) {missing} not found in DataFrame.")


def _drop_tokens(t: Column, words: list[str]) -> Column:
    return F.array_join(F.filter(py_split(t), lambda w: ~w.isin(words)), " ")


def normalize_classifier(c, remove_type_words: bool = False) -> Column:
    t = F.coalesce(_col(c).cast("string"), F.lit(""))
    t = F.regexp_replace(F.translate(t, "|", " "), URL_PATTERN, "")       # T16
    t = F.lower(t)                                                        # T17
    t = F.regexp_replace(t, word_bounded("", "{30,1000}"), " ")          # T18
    if remove_type_words:                                                 # T19
        # looked for by its letters, its left edge only once they are found
        t = F.regexp_replace(t, TYPE_LETTERS + "(?!" + WORD + ")(?<!" + WORD + "[a-z]{4})", " ")
    return _drop_tokens(t, lower_distinct(CLASSIFIER_NAMES))              # T20 + T21


# ---------------------------------------------------------------------------
# Baseline flavour
# ---------------------------------------------------------------------------
def normalize_baseline(c, remove_type_words: bool = False) -> Column:
    t = F.coalesce(_col(c).cast("string"), F.lit(""))
    t = F.regexp_replace(F.translate(t, "|", " "), URL_PATTERN, "")       # T16
    for mark, word in SENTENCE_MARKS:                                     # T22
        t = F.replace(F.concat(t, F.lit(" ")), F.lit(mark), F.lit(f" {word} "))
    t = F.lower(t)
    # punctuation and non-letters to blanks; from here on only a-z and blanks
    # remain, so word boundaries are plain ASCII ones and tokens split on " "
    t = F.regexp_replace(t, "[^a-z]+", " ")
    t = F.regexp_replace(t, REPEATED_LETTERS, "$1$1")
    t = F.regexp_replace(t, r"\b[a-z]{30,1000}\b", " ")
    if remove_type_words:
        t = F.regexp_replace(t, r"\b" + TYPE_LETTERS + r"\b", " ")
    words = lower_distinct(STOP_WORDS + CLASSIFIER_NAMES)                 # T24 + T25
    return F.array_join(F.filter(F.split(t, " "), lambda w: (w != "") & ~w.isin(words)), " ")


# ---------------------------------------------------------------------------
# Vectoriser tokens and labels
# ---------------------------------------------------------------------------
def vectorizer_tokens(c) -> Column:
    """Default vectoriser tokens: runs of two or more word characters, lower-cased."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD + "{2,}"), 0)


def first_words(c, n: int) -> Column:
    """The first ``n`` whitespace words of a text, joined by one blank."""
    return F.array_join(F.slice(py_split(c), 1, n), " ")
