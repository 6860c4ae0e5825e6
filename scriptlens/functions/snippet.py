"""Snippet extraction and highlighting as Column expressions.

These work on one text value per row. The search operator applies the same
rules to a document stored as many line rows (see ``operators.search``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, py_strip, truncate_chars
from .wordlists import DEFAULT_SNIPPET_CHARS, HIGHLIGHT_CLOSE, HIGHLIGHT_OPEN, WS

LINE_BREAKS = "[\\r\\n]+"
SENTENCE_END = "(?<=[.!?])" + WS + "+"


def physical_lines(text) -> Column:
    """Split on line breaks, strip, drop blank lines."""
    pieces = F.transform(F.split(F.coalesce(_col(text), F.lit("")), LINE_BREAKS), py_strip)
    return F.filter(pieces, lambda ln: ln != "")


def hits_any(text, parts) -> Column:
    low = F.lower(_col(text))
    return F.exists(_col(parts), lambda p: F.contains(low, p))


def snippet(text, parts, max_len: int = DEFAULT_SNIPPET_CHARS) -> Column:
    """Context around the first hit line, else the shortest hit sentence,
    else the first line; each cut to ``max_len`` characters plus ``...``."""
    text = _col(text)
    parts = _col(parts)
    lines = physical_lines(text)
    # Index (0-based) of the first line holding a part.
    hit = F.array_min(F.transform(lines, lambda ln, i: F.when(hits_any(ln, parts), i)))
    context = F.concat_ws(
        " ",
        F.when(hit > 0, F.get(lines, hit - 1)),   # W2: previous line
        F.get(lines, hit),
        F.get(lines, hit + 1),                    # W2: next line
    )
    line_branch = F.when(hit.isNotNull(), truncate_chars(py_strip(context), max_len))

    # T31 + A12: shortest sentence holding a part, first one on ties.
    sentences = F.filter(
        F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), py_strip),
        lambda s: s != "",
    )
    best = F.array_min(
        F.transform(
            F.filter(sentences, lambda s: hits_any(s, parts)),
            lambda s, i: F.struct(F.length(s).alias("n"), i.alias("i"), s.alias("s")),
        )
    )
    sentence_branch = F.when(best.isNotNull(), truncate_chars(best.getField("s"), max_len))

    first = F.when(F.size(lines) > 0, F.get(lines, 0)).otherwise(text)
    return F.when(text.isNull(), F.lit("")).otherwise(
        F.coalesce(line_branch, sentence_branch, truncate_chars(first, max_len))
    )


def _quoted(p: Column) -> Column:
    """A regex matching ``p`` literally (``\\Q..\\E`` with embedded ``\\E`` split)."""
    return F.concat(F.lit("\\Q"), F.replace(p, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def highlight(text, parts, open_mark: str = HIGHLIGHT_OPEN,
              close_mark: str = HIGHLIGHT_CLOSE) -> Column:
    """Wrap every case-insensitive occurrence of each distinct part,
    parts applied one after the other."""
    replacement = open_mark.replace("\\", "\\\\").replace("$", "\\$") + "$1" + \
        close_mark.replace("\\", "\\\\").replace("$", "\\$")
    return F.when(_col(text).isNull(), F.lit("")).otherwise(
        F.aggregate(
            F.array_distinct(_col(parts)),
            _col(text),
            lambda acc, p: F.regexp_replace(
                acc, F.concat(F.lit("(?iu)("), _quoted(p), F.lit(")")), F.lit(replacement)
            ),
        )
    )
