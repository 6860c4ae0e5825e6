"""Ranked boolean search over a line table.

Plan shape for a query table ``Q`` (query_id, query):

1. ``prepare_queries``: parse type / parts / display parts / ranking tokens as
   column expressions (P7, T12, T14, T26); checkpointed once (tiny, read by
   every later step). ``query_bounds`` gives the sizes that decide broadcasts
   (from the strings themselves for literal queries).
2. ``matched_documents``: parts of a few literal queries are literal filters on
   the scan; per (query, document) the distinct hit parts are counted with partial
   aggregation, so a document with very many lines is spread over tasks. Parts of a
   query batch are held by the tasks (``held``): a text answers with the numbers of
   the parts it holds, and only those move. A ranked batch (``batch``) brings them
   together with the document's term weights, and only the first rows of every query
   leave a task.
3. ``bm25_scores``: postings ⋈ broadcast(query terms) with ``term IN (...)``
   pushed into the scans for small query sets, per-show statistics ⋈
   broadcast, grouped sum (M1). The index is independent of the title weight.
4. Title boost (A11, T32), top-k per query / per show with ``row_number``
   (planned as ``WindowGroupLimit``: a partial top-k before the shuffle);
   the top-k rows are checkpointed (bounded by k x queries x shows).
5. Snippets and highlights for the top-k documents only: their lines are
   fetched with a broadcast join on the bounded top-k keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.query import display_parts, query_parts, query_type, title_hits
from ..functions.snippet import LINE_BREAKS, SENTENCE_END, highlight
from ..functions.text import py_strip, query_tokens, truncate_chars
from ..functions.wordlists import (
    BM25_B,
    BM25_EPSILON,
    BM25_K1,
    DEFAULT_SNIPPET_CHARS,
    DEFAULT_TITLE_WEIGHT,
    DEFAULT_TOP_K,
)
from ..session import bounded_broadcast, checked_broadcast, materialize
from .batch import BatchTable, first_matches
from .held import ANCHOR_CHARS, PartTable, held_parts, queries_of
from .index import DOC_KEYS, CorpusIndex

RESULT_COLUMNS = ["season", "episode", "episode_title", "relevance_score", "snippet_highlight"]


def query_table(spark: SparkSession, queries) -> DataFrame:
    """A (query_id, query) table from a string, a list of strings or a DataFrame."""
    if isinstance(queries, DataFrame):
        return queries.select(F.col("query_id").cast("bigint"), F.col("query").cast("string"))
    if isinstance(queries, str):
        queries = [queries]
    return spark.createDataFrame(
        [(i, q) for i, q in enumerate(queries)], "query_id bigint, query string"
    )


def prepare_queries(queries: DataFrame) -> DataFrame:
    """Parsed queries, computed once (checkpointed): several consumers read
    them and the expressions are large to compile."""
    return materialize(_prepare(queries))


def _prepare(queries: DataFrame) -> DataFrame:
    return queries.select(
        "query_id",
        "query",
        query_type("query").alias("qtype"),
        query_parts("query").alias("parts"),
        display_parts("query").alias("dparts"),
        query_tokens("query").alias("qtokens"),
    )


@dataclass
class QueryBounds:
    """Upper bounds on the query-side tables (they decide broadcasts)."""
    queries: int
    parts: int
    tokens: int


def query_bounds(prepared: DataFrame, literal: list[str] | None = None) -> QueryBounds:
    """From the strings themselves for literal queries (parts <= separators + 1,
    tokens <= characters + 1), else one aggregate job over the query table."""
    if literal is not None:
        per_query = [max(q.count("&"), q.count("/")) + 1 for q in literal]
        return QueryBounds(len(literal), sum(per_query), sum(len(q) + 1 for q in literal))
    r = prepared.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.size("parts") + 1).alias("p"),
        F.sum(F.size("qtokens")).alias("t"),
    ).first()
    return QueryBounds(int(r["n"] or 0), int(r["p"] or 0), int(r["t"] or 0))


def _literal(queries) -> list[str] | None:
    if isinstance(queries, str):
        return [queries]
    if isinstance(queries, (list, tuple)):
        return list(queries)
    return None


def searchable_text(lines: DataFrame) -> Column:
    """Lower-cased line text; the last line of a document carries `` title``."""
    tail = F.when(F.col("is_last"), F.concat(F.lit(" "), F.coalesce(F.col("episode_title"), F.lit(""))))
    return F.lower(F.concat(F.coalesce(F.col("dialogue"), F.lit("")), F.coalesce(tail, F.lit(""))))


# Query sets with at most this many tokens push their terms into the index scans.
PUSHDOWN_MAX_TERMS = 1000
# Parts of a handful of literal queries: tested as literals on the scan.
FEW_PARTS = 16
# Parts up to which the tasks hold a batch's parts. Beyond it the parts are joined
# as a table.
PARTS_PER_PASS = 100_000


def trigrams(text: Column) -> Column:
    """Distinct overlapping three-character pieces of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def match_parts(prepared: DataFrame) -> DataFrame:
    """One row per (query, part). An AND without parts matches everything: its
    part is the empty string, which is in every text."""
    parts = F.when((F.col("qtype") == "and") & (F.size("parts") == 0), F.array(F.lit(""))).otherwise(F.col("parts"))
    return prepared.select("query_id", "qtype", F.size(parts).alias("n_parts"),
                           F.posexplode(parts).alias("part_idx", "part"))


def literal_hits(text: DataFrame, key_cols: list[str], rows: list) -> DataFrame:
    """Hits of a few parts known on the driver: literal filters on the scan, no
    join and no exchange."""
    found = F.array(*[
        F.when(F.contains(F.col("_text"), F.lit(r["part"])), F.struct(
            F.lit(r["query_id"]).cast("bigint").alias("query_id"), F.lit(r["qtype"]).alias("qtype"),
            F.lit(r["n_parts"]).alias("n_parts"), F.lit(r["part_idx"]).alias("part_idx"))) for r in rows])
    return (text.select(*key_cols, F.explode(F.filter(found, lambda h: h.isNotNull())).alias("h"))
            .select(*key_cols, "h.query_id", "h.qtype", "h.n_parts", "h.part_idx"))


def shuffled_hits(text: DataFrame, key_cols: list[str], qp: DataFrame) -> DataFrame:
    """Hits of any number of parts without bringing them to the driver: the distinct
    pieces of a text (its trigrams; for parts under three characters its characters
    and pairs) join the parts' anchors, and ``contains`` decides."""
    part = F.col("part")
    anchor = F.when(F.length(part) < ANCHOR_CHARS, part).otherwise(
        F.array_min(F.transform(trigrams(part), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))["g"])
    anchored = qp.withColumn("anchor", anchor)
    sizes = {r[0] for r in anchored.select(F.least(F.length("part"), F.lit(ANCHOR_CHARS))).distinct().collect()}
    kinds = [F.regexp_extract_all("_text", F.lit("(?s)(?=(.{%d}))" % n), F.lit(1)) for n in sorted(sizes - {0})]
    pieces = F.array_distinct(F.concat(F.array(F.lit("")) if 0 in sizes else F.array().cast("array<string>"), *kinds))
    held = text.select(*key_cols, "_text", F.explode(pieces).alias("anchor"))
    anchors = anchored.select("anchor").distinct()
    held = held.join(anchors, "anchor", "left_semi")        # broadcast by Spark while it is small
    return held.join(anchored, "anchor").where(F.contains("_text", part)).select(
        *key_cols, "query_id", "qtype", "n_parts", "part_idx")


def part_hits(text: DataFrame, key_cols: list[str], qp: DataFrame, n_parts: int) -> DataFrame:
    """(key_cols..., query_id, qtype, n_parts, part_idx) for every text holding a part.

    ``qp`` has one row per (query, part). A few parts become literals of one scan;
    otherwise they stay a table and are joined.
    """
    if n_parts > FEW_PARTS:
        return shuffled_hits(text, key_cols, qp)
    rows = qp.orderBy("part", "query_id", "part_idx").collect()     # at most FEW_PARTS
    if rows:
        return literal_hits(text, key_cols, rows)
    return text.where("false").select(*key_cols, *[F.lit(None).cast(t).alias(c) for c, t in (
        ("query_id", "bigint"), ("qtype", "string"), ("n_parts", "int"), ("part_idx", "int"))])


def matched_documents(lines: DataFrame, prepared: DataFrame) -> DataFrame:
    """(query_id, document keys) of documents matching each query."""
    text = lines.select(*DOC_KEYS, searchable_text(lines).alias("_text"))
    qp = materialize(match_parts(prepared))
    n_parts = qp.count()
    if FEW_PARTS < n_parts <= PARTS_PER_PASS:
        table = PartTable(qp.collect())
        return queries_of(held_parts(text, DOC_KEYS, table, "_text"), DOC_KEYS, table, qp.schema["query_id"].dataType)
    hits = part_hits(text, DOC_KEYS, qp, n_parts)
    keys = ["query_id", "qtype", "n_parts", *DOC_KEYS]
    # distinct parts per (query, document): partial aggregation, a document with
    # very many lines is spread over tasks
    per_doc = hits.select(*keys, "part_idx").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hit"))
    ok = F.when(F.col("qtype") == "and", F.col("n_hit") == F.col("n_parts")).otherwise(F.col("n_hit") >= 1)
    return per_doc.where(ok).select("query_id", *DOC_KEYS)


def query_terms(prepared: DataFrame) -> DataFrame:
    """Ranking terms per query with multiplicity (a repeated token counts twice)."""
    return (
        prepared.select("query_id", F.explode("qtokens").alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).cast("bigint").alias("qtf"))
    )


def bm25_scores(index: CorpusIndex, prepared: DataFrame, title_weight: float = DEFAULT_TITLE_WEIGHT,
                k1: float = BM25_K1, b: float = BM25_B, epsilon: float = BM25_EPSILON,
                bounds: QueryBounds | None = None) -> DataFrame:
    """Okapi BM25 of every document holding a query term.

    Returns (query_id, document keys, bm25). Documents without any query term
    are absent (their score is 0; J2 fills it in with a left join).
    """
    w = max(int(title_weight), 0)
    qterms = query_terms(prepared)
    bounds = bounds or query_bounds(prepared)
    n_shows = index.shows()
    postings, term_stats = index.postings, index.term_stats
    if bounds.tokens <= PUSHDOWN_MAX_TERMS:
        # few distinct terms: read them from the (checkpointed, tiny) query
        # table and push ``term IN (...)`` into both scans; the term-sorted
        # index files then skip every row group without a query term
        terms = sorted({r[0] for r in qterms.select("term").distinct().collect()})
        postings = postings.where(F.col("term").isin(terms))
        term_stats = term_stats.where(F.col("term").isin(terms))
    # query terms: at most ``tokens`` rows; their statistics at most one per show
    qterms_b, _ = bounded_broadcast(qterms, bounds.tokens)
    tf, dl = posting_size(w)
    hits = (
        postings.join(qterms_b, "term")
        .select("query_id", *DOC_KEYS, "term", "qtf", tf.alias("tf"), dl.alias("dl"))
        .where(F.col("tf") > 0)
    )
    terms_b, _ = bounded_broadcast(qterms.select("term").distinct(), bounds.tokens)
    stats = term_weights(term_stats.join(terms_b, "term"), index.show_stats, w, epsilon)
    stats_b, _ = bounded_broadcast(stats, bounds.tokens * n_shows)
    return (
        hits.join(stats_b, ["show_key", "term"])
        .groupBy("query_id", *DOC_KEYS)
        .agg(F.sum(F.col("qtf") * posting_weight(k1, b)).alias("bm25"))
    )


def posting_size(w: int) -> tuple[Column, Column]:
    """Frequency of the term and length of the document under a title weight."""
    return F.col("tf_body") + F.lit(w) * F.col("tf_title"), F.col("len_body") + F.lit(w) * F.col("len_title")


def posting_weight(k1: float = BM25_K1, b: float = BM25_B) -> Column:
    """What a posting (tf, dl, idf, avgdl) adds to a score for each time its term is asked for."""
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avgdl"))
    return F.col("idf") * (F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + norm))


def document_weights(index: CorpusIndex, terms: dict[str, int], title_weight: float) -> DataFrame:
    """M1 for many queries: (document keys, term numbers, weights), one row per document
    that holds any of the numbered terms."""
    w = max(int(title_weight), 0)
    numbers = index.postings.sparkSession.createDataFrame(list(terms.items()), "term string, number int")
    numbers_b, _ = bounded_broadcast(numbers, len(terms))
    postings, term_stats = index.postings, index.term_stats
    if len(terms) <= PUSHDOWN_MAX_TERMS:
        postings, term_stats = (t.where(F.col("term").isin(list(terms))) for t in (postings, term_stats))
    stats = term_weights(term_stats, index.show_stats, w).join(numbers_b, "term")
    stats_b, _ = bounded_broadcast(stats, len(terms) * index.shows())
    tf, dl = posting_size(w)
    weights = postings.join(stats_b, ["show_key", "term"]).select(
        *DOC_KEYS, "number", "idf", "avgdl", tf.alias("tf"), dl.alias("dl")).where(F.col("tf") > 0)
    return (weights.select(*DOC_KEYS, "number", posting_weight().alias("weight")).where(F.col("weight").isNotNull())
            .groupBy(*DOC_KEYS).agg(F.collect_list(F.struct("number", "weight")).alias("t"))
            .select(*DOC_KEYS, F.col("t.number").alias("term"), F.col("t.weight").alias("weight")))


def term_weights(term_stats: DataFrame, show_stats: DataFrame, w: int, epsilon: float = BM25_EPSILON) -> DataFrame:
    """(show_key, term, idf, avgdl): floored idf and average length per show."""
    df_col = F.col("df_any") if w > 0 else F.col("df_body")
    mean_col = F.col("mean_idf_any") if w > 0 else F.col("mean_idf_body")
    n = F.col("n_docs")
    idf_raw = F.log(n - F.col("df") + F.lit(0.5)) - F.log(F.col("df") + F.lit(0.5))
    return (
        term_stats.select("show_key", "term", df_col.alias("df"))
        .where(F.col("df") > 0)
        .join(show_stats, "show_key")
        .select(
            "show_key",
            "term",
            F.when(idf_raw < 0, F.lit(epsilon) * mean_col).otherwise(idf_raw).alias("idf"),
            ((F.col("sum_len_body") + F.lit(w) * F.col("sum_len_title")) / n).alias("avgdl"),
        )
    )


def query_term_stats(index: CorpusIndex, prepared: DataFrame, w: int, bounds: QueryBounds) -> DataFrame:
    """(query_id, show_key, term, qtf, idf, avgdl) of the queries' terms."""
    qterms = materialize(query_terms(prepared))
    term_stats = index.term_stats
    if bounds.tokens <= PUSHDOWN_MAX_TERMS:
        term_stats = term_stats.where(F.col("term").isin(sorted({r["term"] for r in qterms.collect()})))
    qterms_b, _ = bounded_broadcast(qterms, bounds.tokens)
    return term_weights(term_stats, index.show_stats, w).join(qterms_b, "term")


def matches_of(index: CorpusIndex, prepared: DataFrame) -> DataFrame:
    """(query_id, document keys), through the trigram postings if there are any."""
    if index.grams is None:
        return matched_documents(index.lines, prepared)
    from .trigrams import matched_by_trigrams
    return matched_by_trigrams(index.grams, prepared)


def batch_matches(index: CorpusIndex, prepared: DataFrame, title_weight: float, k: int,
                  per_show: bool) -> DataFrame | None:
    """The rows of ``ranked_matches`` that can be among the first ``k`` of their query
    (and show), for a batch whose parts the tasks hold (else None)."""
    qp = materialize(match_parts(prepared))
    display = prepared.select("query_id", F.lit("or").alias("qtype"), F.lit(1).alias("n_parts"),
                              F.posexplode("dparts").alias("part_idx", "part"))
    n_parts, n_queries = qp.count(), prepared.agg(F.count("query_id"), F.countDistinct("query_id"), F.count(F.lit(1))).first()
    if not FEW_PARTS < n_parts <= PARTS_PER_PASS or len(set(n_queries)) > 1:     # ids are null or meet
        return None
    asked = query_terms(prepared).collect()
    terms = {t: i for i, t in enumerate(sorted({r["term"] for r in asked}))}
    if not terms:
        return None
    rows = qp.collect()
    known = {r["query_id"] for r in rows}       # a query without parts matches nothing
    table = BatchTable(rows, [r for r in display.collect() if r["query_id"] in known], terms, asked)
    if index.grams is None:
        text = index.lines.select(*DOC_KEYS, searchable_text(index.lines).alias("_text"))
        held = held_parts(text, DOC_KEYS, table.parts, "_text")
    else:
        from .trigrams import held_by_blocks
        held = held_by_blocks(index.grams, qp, table.parts)
    docs = held.join(document_weights(index, terms, title_weight), DOC_KEYS, "left")
    return first_matches(docs.withColumn("title", F.lower("episode_title")), table, k, 2.0 * float(title_weight),
                         per_show, qp.schema["query_id"].dataType)


def ranked_matches(index: CorpusIndex, prepared: DataFrame, title_weight: float = DEFAULT_TITLE_WEIGHT,
                   bounds: QueryBounds | None = None, first: tuple[int, bool] | None = None) -> DataFrame:
    """Every matched document with its BM25, title boost and relevance (M2 before top-k).
    With ``first`` (k, per show) a batch may leave out rows that aren't among the first k."""
    bounds = bounds or query_bounds(prepared)
    if first is not None and bounds.parts > FEW_PARTS:
        if (found := batch_matches(index, prepared, title_weight, *first)) is not None:
            return found
    matched = matches_of(index, prepared)
    scores = bm25_scores(index, prepared, title_weight, bounds=bounds)
    dparts_b, _ = bounded_broadcast(prepared.select("query_id", "dparts"), bounds.queries)
    boost = title_hits("episode_title", "dparts") * F.lit(2.0 * float(title_weight))
    return (
        matched.join(scores, ["query_id", *DOC_KEYS], "left")
        .join(dparts_b, "query_id")
        .select(
            "query_id",
            *DOC_KEYS,
            F.round(F.coalesce("bm25", F.lit(0.0)), 6).alias("bm25_score"),
            title_hits("episode_title", "dparts").cast("bigint").alias("title_hit_count"),
            F.round(F.coalesce("bm25", F.lit(0.0)) + boost, 6).alias("relevance_score"),
        )
    )


def top_k(df: DataFrame, partition_cols, order_cols, k: int, rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows per group; ``row_number() <= k`` is planned as a
    partial WindowGroupLimit before the shuffle, so a hot group stays bounded."""
    w = Window.partitionBy(*partition_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def top_terms(index: CorpusIndex, groups: list[str], k: int) -> DataFrame:
    """(groups..., term, tf_body, term_rank): the ``k`` most frequent terms of the
    text per group of document keys. A packed document gives its own ``k`` first
    (the last of equal counts goes), so the ranks see few rows per document."""
    if index.packed is None:
        rows = index.postings.select(*groups, "term", "tf_body")
    else:
        entries = F.transform(F.arrays_zip("term", "n_tb"), lambda e: F.struct((-e["n_tb"]).alias("n"), e["term"].alias("term")))
        rows = index.packed.select(*groups, F.explode(F.slice(F.array_sort(entries), 1, k)).alias("e")).select(
            *groups, F.col("e.term").alias("term"), (-F.col("e.n")).alias("tf_body"))
        if index.summed is not None:
            rows = rows.unionByName(index.summed.select(*groups, "term", "tf_body"))
    return top_k(rows, groups, [F.col("tf_body").desc(), "term"], k, "term_rank")


def search_order() -> list:
    return [F.col("relevance_score").desc(), "season", "episode", "episode_title"]


def document_snippets(lines: DataFrame, docs: DataFrame,
                      max_len: int = DEFAULT_SNIPPET_CHARS, docs_bound: int | None = None) -> DataFrame:
    """T28 over documents stored as lines, for a bounded set of documents.

    ``docs``: (query_id, document keys, dparts). Physical lines of a row are
    its text split on line breaks, stripped, blanks dropped. Per document:
    the first physical line holding a part with its neighbours (the previous
    or next non-blank line may sit in another row), else the shortest hit
    sentence, else the first line. Two grouped passes, no window over a
    document, so a document with many lines does not land in one task.
    """
    if docs_bound is None:
        docs_b, _ = checked_broadcast(docs)
    else:
        docs_b, _ = bounded_broadcast(docs, docs_bound)
    rows = lines.join(docs_b, DOC_KEYS).select(
        "query_id", *DOC_KEYS, "line_no", "dialogue", "dparts",
        F.filter(F.transform(F.split(F.coalesce("dialogue", F.lit("")), LINE_BREAKS), py_strip),
                 lambda s: s != "").alias("pl"),
    )
    # lines of the selected documents only; both passes below read them
    rows = materialize(rows)
    low_hit = lambda s: F.exists("dparts", lambda p: F.contains(F.lower(s), p))
    sentences = F.filter(F.transform(F.split(F.coalesce("dialogue", F.lit("")), SENTENCE_END), py_strip),
                         lambda s: s != "")
    best_in_row = F.array_min(F.transform(
        F.filter(sentences, low_hit),
        lambda s, i: F.struct(F.length(s).alias("n"), i.alias("i"), s.alias("s")),
    ))
    rows = rows.select(
        "*",
        F.array_min(F.transform("pl", lambda s, i: F.when(low_hit(s), i))).alias("hit_pos"),
        best_in_row.alias("best"),
    )
    doc_cols = ["query_id", *DOC_KEYS]
    first = rows.groupBy(*doc_cols).agg(
        F.min(F.when(F.col("hit_pos").isNotNull(), F.struct(F.col("line_no").alias("l"), F.col("hit_pos").alias("p"))))
        .alias("h"),
        F.min(F.when(F.size("pl") > 0, F.struct(F.col("line_no").alias("l"), F.get("pl", 0).alias("s"))))
        .alias("first_line"),
        F.min(F.when(F.col("best").isNotNull(), F.struct(
            F.col("best.n").alias("n"), F.col("line_no").alias("l"), F.col("best.i").alias("i"),
            F.col("best.s").alias("s")))).alias("best_sentence"),
        F.min(F.struct(F.col("line_no").alias("l"), F.coalesce("dialogue", F.lit("")).alias("s")))
        .alias("first_raw"),
    )
    h_l = F.col("h.l")
    h_p = F.col("h.p")
    last_of = F.get("pl", F.size("pl") - 1)
    around = rows.join(first.select(*doc_cols, "h"), doc_cols).where(F.col("h").isNotNull()).groupBy(*doc_cols).agg(
        F.max(F.when((F.col("line_no") == h_l) & (h_p > 0), F.get("pl", h_p - 1))).alias("prev_in"),
        F.max(F.when(F.col("line_no") == h_l, F.get("pl", h_p))).alias("hit_line"),
        F.max(F.when(F.col("line_no") == h_l, F.get("pl", h_p + 1))).alias("next_in"),
        F.max(F.when((F.col("line_no") < h_l) & (F.size("pl") > 0),
                     F.struct(F.col("line_no").alias("l"), last_of.alias("s")))).alias("prev_row"),
        F.min(F.when((F.col("line_no") > h_l) & (F.size("pl") > 0),
                     F.struct(F.col("line_no").alias("l"), F.get("pl", 0).alias("s")))).alias("next_row"),
    )
    context = F.concat_ws(
        " ",
        F.coalesce("prev_in", F.col("prev_row.s")),
        F.col("hit_line"),
        F.coalesce("next_in", F.col("next_row.s")),
    )
    snippet = F.coalesce(
        F.when(F.col("h").isNotNull(), truncate_chars(py_strip(context), max_len)),
        F.when(F.col("best_sentence").isNotNull(), truncate_chars(F.col("best_sentence.s"), max_len)),
        truncate_chars(F.coalesce(F.col("first_line.s"), F.col("first_raw.s")), max_len),
    )
    return first.join(around, doc_cols, "left").select(*doc_cols, snippet.alias("snippet"))


def for_shows(index: CorpusIndex, show_keys) -> CorpusIndex:
    """The index restricted to some shows. ``show_key`` is the partition
    column of the written line table, so the scans prune whole folders."""
    keys = [show_keys] if isinstance(show_keys, str) else list(show_keys)
    known = {r["show_key"] for r in index.show_stats.where(F.col("show_key").isin(keys)).select("show_key").collect()}
    if unknown := sorted(set(keys) - known):
        raise ValueError(f"unknown show: {', '.join(unknown)}")
    cond = F.col("show_key").isin(keys)
    return CorpusIndex(index.postings.where(cond), index.doc_len.where(cond), index.term_stats.where(cond),
                       index.show_stats.where(cond), index.lines.where(cond), len(keys))


def search(spark: SparkSession, index: CorpusIndex, queries, top_k_n: int = DEFAULT_TOP_K,
           title_weight: float = DEFAULT_TITLE_WEIGHT, per_show: bool = True,
           max_len: int = DEFAULT_SNIPPET_CHARS, show_keys=None) -> DataFrame:
    """M2 (per show, every show in one job) over a query table.

    Result: query_id, query, show_key, season, episode, episode_title,
    relevance_score, snippet_highlight, rank (1-based within the group).
    """
    if show_keys is not None:
        index = for_shows(index, show_keys)
    qtable = query_table(spark, queries)
    prepared = prepare_queries(qtable)
    bounds = query_bounds(prepared, _literal(queries))
    n_queries = bounds.queries
    n_shows = index.shows()
    groups = ["query_id", "show_key"] if per_show else ["query_id"]
    if index.impacts is None:
        ranked = ranked_matches(index, prepared, title_weight, bounds, (top_k_n, per_show))
    else:
        from .topk import pruned_matches
        ranked, _ = pruned_matches(index, index.impacts, prepared, top_k_n, title_weight, per_show, bounds)
    # at most k rows per (query, show); computed once, read by every consumer
    top = materialize(top_k(ranked, groups, search_order(), top_k_n))
    dparts_b, _ = bounded_broadcast(prepared.select("query_id", "query", "dparts"), n_queries)
    with_parts = top.join(dparts_b, "query_id")
    # top-k rows: at most k per (query, show)
    bound = top_k_n * n_queries * (n_shows if per_show else 1)
    snippets = document_snippets(index.lines, with_parts.select("query_id", *DOC_KEYS, "dparts"), max_len, bound)
    return with_parts.join(snippets, ["query_id", *DOC_KEYS], "left").select(
        "query_id",
        "query",
        "show_key",
        "season",
        "episode",
        "episode_title",
        "relevance_score",
        highlight("snippet", "dparts").alias("snippet_highlight"),
        F.col("rank").cast("bigint").alias("rank"),
    )


def search_all_shows(spark: SparkSession, index: CorpusIndex, queries, top_k_n: int = DEFAULT_TOP_K,
                     title_weight: float = DEFAULT_TITLE_WEIGHT,
                     max_len: int = DEFAULT_SNIPPET_CHARS) -> DataFrame:
    """M3 + L2: per-show top-k, then one ranking over all shows' results
    (``overall_rank``; ties by show, season, episode, title)."""
    per_show = search(spark, index, queries, top_k_n, title_weight, True, max_len)
    w = Window.partitionBy("query_id").orderBy(
        F.col("relevance_score").desc(), "show_key", "season", "episode", "episode_title"
    )
    return per_show.withColumn("overall_rank", F.row_number().over(w).cast("bigint"))
