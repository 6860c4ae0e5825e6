"""DuckDB SQL of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

from scriptlens.llm import quality


def _quality() -> str:
    stops = ", ".join("'" + w + "'" for w in sorted(
        {v for s in quality.STOP_WORDS.values() for w in s.split() for v in (w, w.capitalize())}))
    bounds = " AND ".join(
        cond for r in quality.RULES for cond in (
            ([f"{r.metric} >= {r.low}"] if r.low is not None else [])
            + ([f"{r.metric} <= {r.high}"] if r.high is not None else [])))
    return rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT doc_id, t,
         regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM base),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM (
    SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g
    FROM words, unnest(range(1, len(w) - 3)) AS r(i))),
repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM windows, unnest(range(0, 5)) AS o(k) WHERE times > 1 GROUP BY doc_id),
counts AS (
  SELECT words.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
         len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM words LEFT JOIN repeated ON words.doc_id = repeated.doc_id),
ratios AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word,
         CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
         CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_ratio,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
         CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END AS upper_ratio,
         n_words < {quality.MIN_WORDS}
           OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM counts)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND {bounds} AS kept
FROM ratios"""


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _decontamination() -> str:
    def words(text: str) -> str:
        return f"regexp_extract_all({FOLD.format(f"coalesce({text}, '')")}, '{WORD}')"

    return f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {words("text")} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(list_slice(w, a, a + least(10, len(w)) - 1), ' ') AS g
  FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(a) WHERE len(w) > 0),
doc AS (SELECT doc_id, {words("text")} AS w FROM documents),
grams AS (
  SELECT doc_id, a, size, array_to_string(list_slice(w, a, a + size - 1), ' ') AS g
  FROM doc, (SELECT DISTINCT size FROM wins) s, unnest(range(1, len(w) - size + 2)) AS r(a)),
found AS (SELECT doc_id, a, grams.size AS size, item FROM grams JOIN wins ON grams.size = wins.size AND grams.g = wins.g),
hit AS (
  SELECT doc_id, count(DISTINCT a + k) AS n_hit
  FROM (SELECT DISTINCT doc_id, a, size FROM found), unnest(range(0, size)) AS o(k) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit ON doc.doc_id = hit.doc_id LEFT JOIN listed ON doc.doc_id = listed.doc_id"""


def sql() -> dict[str, str]:
    return {"op5_positional_index": _decontamination(), "op6_quality_rules": _quality()}
