"""Query parsing and boolean substring predicates as Column expressions.

A query is a string; ``&`` makes it an AND of parts, otherwise ``/`` makes it
an OR of parts, otherwise the whole (trimmed, lower-cased) string is one
phrase. Matching is literal, case-insensitive substring containment.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, py_strip


def query_type(q) -> Column:
    """``and`` if the query holds ``&``, else ``or`` if it holds ``/``, else ``phrase``."""
    s = py_strip(F.coalesce(_col(q), F.lit("")))
    return (
        F.when(F.instr(s, "&") > 0, F.lit("and"))
        .when(F.instr(s, "/") > 0, F.lit("or"))
        .otherwise(F.lit("phrase"))
    )


def query_parts(q) -> Column:
    """The parts the boolean filter tests (trimmed, lower-cased, no blanks)."""
    s = py_strip(F.coalesce(_col(q), F.lit("")))

    def parts(sep: str) -> Column:
        pieces = F.transform(F.split(s, sep), lambda p: F.lower(py_strip(p)))
        return F.filter(pieces, lambda p: p != "")

    return (
        F.when(F.instr(s, "&") > 0, parts("&"))
        .when(F.instr(s, "/") > 0, parts("/"))
        .otherwise(F.array(F.lower(s)))
    )


def display_parts(q) -> Column:
    """Parts for snippets, highlights and title hits (split on both ``&`` and ``/``)."""
    pieces = F.transform(F.split(F.lower(F.coalesce(_col(q), F.lit(""))), "[&/]"), py_strip)
    return F.filter(pieces, lambda p: p != "")


def parse_query(q) -> Column:
    """``STRUCT<type STRING, terms ARRAY<STRING>>`` for a query column."""
    return F.struct(query_type(q).alias("type"), query_parts(q).alias("terms"))


def title_hits(title, parts) -> Column:
    """Number of display parts found in the lower-cased title (repeats count)."""
    t = F.lower(F.coalesce(_col(title), F.lit("")))
    return F.size(F.filter(_col(parts), lambda p: (t != "") & F.contains(t, p)))
