"""SQL fragments (DuckDB dialect) for the oracle queries.

Each helper returns SQL text for an expression over other SQL text. The
oracle re-states the operators independently: documents are assembled with
``string_agg`` and tokenised with the title repeated, as the original
single-process code did, rather than using the engine's additive line index.
DuckDB's RE2 has no look-around and no back-references, so word boundaries
and repeated letters are written without them.
"""

from __future__ import annotations

import itertools

from ..functions.wordlists import (
    CLASSIFIER_NAMES,
    HIGHLIGHT_CLOSE,
    HIGHLIGHT_OPEN,
    NOT_WORD,
    NOT_WS,
    SEARCH_NAMES,
    STOP_WORDS,
    TYPE_WORDS,
    WORD,
    WS,
    WS_CHARS,
    lower_distinct,
)

_ids = itertools.count()


def v() -> str:
    """A fresh lambda parameter name."""
    return f"v{next(_ids)}"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


def chars(s: str) -> str:
    """A SQL string for text holding control characters."""
    out = []
    for ch in s:
        out.append(f"chr({ord(ch)})" if ord(ch) < 32 else lit(ch))
    return " || ".join(out) if out else "''"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def py_split(x: str) -> str:
    p = v()
    return f"list_filter(regexp_split_to_array({x}, {lit(WS + '+')}), lambda {p}: {p} <> '')"


def truncate(x: str, n: int) -> str:
    return f"(CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END)"


def _repeated_letters(t: str) -> str:
    for c in "abcdefghijklmnopqrstuvwxyz":
        t = f"regexp_replace({t}, '{c}{{3,}}', '{c}{c}', 'g')"
    return t


def _blank_words(t: str, long_words: bool, type_words: bool) -> str:
    """Replace whole words (maximal word-character runs) by a blank: runs of
    30-1000 characters and/or the type words. Equivalent to the bounded
    ``\\b...\\b`` patterns without look-around."""
    r = v()
    conds = []
    if long_words:
        conds.append(f"(regexp_full_match({r}, {lit(WORD + '+')}) AND length({r}) BETWEEN 30 AND 1000)")
    if type_words:
        conds.append(f"list_contains({str_list(TYPE_WORDS)}, {r})")
    runs = f"regexp_extract_all({t}, {lit(WORD + '+|' + NOT_WORD + '+')})"
    return (f"array_to_string(list_transform({runs}, lambda {r}: "
            f"CASE WHEN {' OR '.join(conds)} THEN ' ' ELSE {r} END), '')")


def _drop_tokens(t: str, words) -> str:
    p = v()
    return f"array_to_string(list_filter({py_split(t)}, lambda {p}: NOT list_contains({str_list(words)}, {p})), ' ')"


URL = lit("https?://" + NOT_WS + "+")


def normalize_search(x: str) -> str:
    t = f"coalesce(CAST({x} AS VARCHAR), '')"
    t = f"regexp_replace({t}, {URL}, '', 'g')"
    t = f"replace({t}, '|', ' ')"
    t = f"lower({t})"
    t = f"regexp_replace({t}, {lit('[^a-z' + WS_CHARS + ']')}, ' ', 'g')"
    t = f"trim(regexp_replace({t}, {lit(WS + '+')}, ' ', 'g'))"
    t = _repeated_letters(t)
    t = f"regexp_replace({t}, '\\b[a-z]{{30,}}\\b', ' ', 'g')"
    return t


def search_tokens(x: str) -> str:
    p = v()
    excluded = str_list(lower_distinct(STOP_WORDS + SEARCH_NAMES))
    return (f"list_filter(string_split({normalize_search(x)}, ' '), "
            f"lambda {p}: {p} <> '' AND NOT list_contains({excluded}, {p}))")


def query_tokens(q: str) -> str:
    toks = search_tokens(q)
    raw = py_split(f"lower(coalesce({q}, ''))")
    return f"(CASE WHEN len({toks}) > 0 THEN {toks} ELSE {raw} END)"


def normalize_classifier(x: str, remove_type_words: bool = False) -> str:
    t = f"coalesce(CAST({x} AS VARCHAR), '')"
    t = f"regexp_replace(replace({t}, '|', ' '), {URL}, '', 'g')"
    t = f"lower({t})"
    t = _blank_words(t, True, remove_type_words)
    return _drop_tokens(t, lower_distinct(CLASSIFIER_NAMES))


def normalize_baseline(x: str, remove_type_words: bool = False) -> str:
    t = f"coalesce(CAST({x} AS VARCHAR), '')"
    t = f"regexp_replace(replace({t}, '|', ' '), {URL}, '', 'g')"
    t = f"replace({t} || ' ', '.', ' EOSTokenDot ')"
    t = f"replace({t} || ' ', '?', ' EOSTokenQuest ')"
    t = f"replace({t} || ' ', '!', ' EOSTokenExs ')"
    t = f"lower({t})"
    t = f"regexp_replace({t}, {lit('[^a-z' + WS_CHARS + ']')}, ' ', 'g')"
    t = _repeated_letters(t)
    t = _blank_words(t, True, remove_type_words)
    return _drop_tokens(t, lower_distinct(STOP_WORDS + CLASSIFIER_NAMES))


def vectorizer_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {lit(WORD + '{2,}')})"


def first_words(x: str, n: int) -> str:
    return f"array_to_string(list_slice({py_split(x)}, 1, {n}), ' ')"


# ---------------------------------------------------------------------------
# Queries, snippets, highlights
# ---------------------------------------------------------------------------
def _split_parts(s: str, sep: str) -> str:
    a, b = v(), v()
    pieces = f"list_transform(string_split({s}, {lit(sep)}), lambda {a}: lower({strip(a)}))"
    return f"list_filter({pieces}, lambda {b}: {b} <> '')"


def query_type(q: str) -> str:
    s = strip(f"coalesce({q}, '')")
    return f"(CASE WHEN contains({s}, '&') THEN 'and' WHEN contains({s}, '/') THEN 'or' ELSE 'phrase' END)"


def query_parts(q: str) -> str:
    s = strip(f"coalesce({q}, '')")
    return (f"(CASE WHEN contains({s}, '&') THEN {_split_parts(s, '&')} "
            f"WHEN contains({s}, '/') THEN {_split_parts(s, '/')} ELSE [lower({s})] END)")


def display_parts(q: str) -> str:
    a, b = v(), v()
    pieces = f"list_transform(regexp_split_to_array(lower(coalesce({q}, '')), '[&/]'), lambda {a}: {strip(a)})"
    return f"list_filter({pieces}, lambda {b}: {b} <> '')"


def any_in(text_lower: str, parts: str) -> str:
    p = v()
    return f"(len(list_filter({parts}, lambda {p}: contains({text_lower}, {p}))) > 0)"


def all_in(text_lower: str, parts: str) -> str:
    p = v()
    return f"(len(list_filter({parts}, lambda {p}: NOT contains({text_lower}, {p}))) = 0)"


def title_hits(title: str, parts: str) -> str:
    p = v()
    t = f"lower(coalesce({title}, ''))"
    return f"len(list_filter({parts}, lambda {p}: {t} <> '' AND contains({t}, {p})))"


def physical_lines(x: str) -> str:
    a, b = v(), v()
    pieces = f"list_transform(regexp_split_to_array(coalesce({x}, ''), '[\\r\\n]+'), lambda {a}: {strip(a)})"
    return f"list_filter({pieces}, lambda {b}: {b} <> '')"


def snippet(text: str, parts: str, n: int = 240) -> str:
    lines = physical_lines(text)
    ln, i = v(), v()
    hit = f"list_min(list_transform({lines}, lambda {ln}, {i}: CASE WHEN {any_in(f'lower({ln})', parts)} THEN {i} END))"
    context = (f"concat_ws(' ', CASE WHEN {hit} > 1 THEN ({lines})[{hit} - 1] END, "
               f"({lines})[{hit}], ({lines})[{hit} + 1])")
    line_branch = f"CASE WHEN {hit} IS NOT NULL THEN {truncate(strip(context), n)} END"
    a, b = v(), v()
    marked = f"regexp_replace(coalesce({text}, ''), {lit('([.!?])' + WS + '+')}, '\\1' || chr(1), 'g')"
    sentences = f"list_filter(list_transform(string_split({marked}, chr(1)), lambda {a}: {strip(a)}), lambda {b}: {b} <> '')"
    s, j, c = v(), v(), v()
    best = (f"list_min(list_transform(list_filter({sentences}, lambda {s}: {any_in(f'lower({s})', parts)}), "
            f"lambda {c}, {j}: {{'n': length({c}), 'i': {j}, 's': {c}}}))")
    sentence_branch = f"CASE WHEN {best} IS NOT NULL THEN {truncate(f'({best}).s', n)} END"
    first = f"(CASE WHEN len({lines}) > 0 THEN ({lines})[1] ELSE {text} END)"
    return f"(CASE WHEN {text} IS NULL THEN '' ELSE coalesce({line_branch}, {sentence_branch}, {truncate(first, n)}) END)"


def distinct_in_order(lst: str) -> str:
    p, i = v(), v()
    return f"list_filter({lst}, lambda {p}, {i}: list_position({lst}, {p}) = {i})"


def highlight(text: str, parts: str) -> str:
    acc, p = v(), v()
    quoted = f"'\\Q' || replace({p}, '\\E', '\\E\\\\E\\Q') || '\\E'"
    repl = f"{chars(HIGHLIGHT_OPEN)} || '\\1' || {chars(HIGHLIGHT_CLOSE)}"
    step = f"regexp_replace({acc}, '(?i)(' || {quoted} || ')', {repl}, 'g')"
    return (f"(CASE WHEN {text} IS NULL THEN '' ELSE "
            f"list_reduce({distinct_in_order(parts)}, lambda {acc}, {p}: {step}, {text}) END)")


# ---------------------------------------------------------------------------
# Adapters (same definitions as scriptlens.sources.adapters)
# ---------------------------------------------------------------------------
def dialogue_lines_cte() -> str:
    return f"""
    first_turn AS (SELECT conv_id, arg_min(text, turn) AS first_text FROM conversations GROUP BY conv_id),
    lines AS (
      SELECT 'show' || CAST(c.conv_id % 5 AS VARCHAR) AS show_key,
             CAST((c.conv_id // 5) % 4 AS INTEGER) AS season,
             CAST(c.conv_id AS BIGINT) AS episode,
             coalesce({first_words('f.first_text', 3)}, '') AS episode_title,
             CAST(c.conv_id * 1000000 + c.turn AS BIGINT) AS line_no,
             c.role AS character,
             c.text AS dialogue
      FROM conversations c JOIN first_turn f ON f.conv_id = c.conv_id)"""


def document_lines_cte() -> str:
    return f"""
    lines AS (
      SELECT lang AS show_key, CAST(0 AS INTEGER) AS season, CAST(doc_id AS BIGINT) AS episode,
             coalesce(substr(({physical_lines('text')})[1], 1, 40), '') AS episode_title,
             CAST(doc_id AS BIGINT) AS line_no, source AS character, text AS dialogue
      FROM documents)"""


def posts_cte() -> str:
    return """
    posts AS (
      SELECT CAST(d.doc_id AS BIGINT) AS row_id,
             (CASE WHEN l.quality = 1 THEN 'E' ELSE 'I' END) ||
             (CASE WHEN l.toxic = 1 THEN 'S' ELSE 'N' END) ||
             (CASE WHEN d.n_chars >= 600 THEN 'T' ELSE 'F' END) ||
             (CASE WHEN d.lang = 'en' THEN 'J' ELSE 'P' END) AS type,
             d.text AS posts
      FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def line_vectors_cte() -> str:
    return """
    line_vecs AS (
      SELECT 'speaker_' || CAST(e.label AS VARCHAR) AS character, CAST(e.vec_id AS BIGINT) AS line_id,
             coalesce(d.text, 'line ' || CAST(e.vec_id AS VARCHAR)) AS dialogue, e.embedding
      FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id)"""


def values_queries(queries) -> str:
    rows = ", ".join(f"({i}, {lit(q)})" for i, q in enumerate(queries))
    return f"q AS (SELECT CAST(query_id AS BIGINT) AS query_id, query FROM (VALUES {rows}) t(query_id, query))"
