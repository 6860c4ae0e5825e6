"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus oracle SQL.

Every query reads the driver's tables (through ``sources.adapters``) in full.
Search indexes and the trait model are built once per (session, table
folder) and written under the shared checkpoint folder; later queries read
them back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.query import display_parts, parse_query
from ..functions.snippet import highlight
from ..functions.text import lemma_tokens, normalize_baseline, normalize_classifier, normalize_search, search_tokens, tokens_of_normalized
from ..functions.wordlists import DEFAULT_TITLE_WEIGHT, DEFAULT_TOP_K, MAX_INPUT_TOKENS, SHOW_ALIASES
from ..operators import classify as C
from ..operators import documents as D
from ..operators import heads as H
from ..operators import profiles as P
from ..operators import embedding as E
from ..operators import sketches as K
from ..operators import lemmas as L
from ..operators import similar as V
from ..operators import trigrams as G
from ..operators import vector_index as I
from ..operators.frequent import frequent_vocabulary
from ..operators.topk import build_impacts
from ..operators.versions import open_index
from ..operators.index import DOC_KEYS, CorpusIndex, materialize_index, searchable_lines
from ..operators.search import (
    bm25_scores,
    document_snippets,
    matched_documents,
    prepare_queries,
    query_bounds,
    query_table,
    search,
    search_all_shows,
    top_terms,
)
from ..session import materialize, new_table_path
from ..streaming.ingest import ingest_line_files, read_line_table
from ..sources import adapters
from ..sources.dialogue import ingest_csv_sources, ingest_with_quarantine, write_csv_sources

# Literal queries of the registered searches: terms that occur in the
# generated prose; "the" exercises the stop-word fallback.
DOC_QUERIES = ["ertion", "erth&ouen", "thth/ouen", "the", "Ertion tien"]
DIALOGUE_QUERIES = ["ouen", "thth/ouen", "erth&ouen", "the"]
SNIPPET_QUERY = "ouen/thth"
MOMENT_QUERY = "ouen"
MARKED_HEAD = "See https://example.org/a?b=1 INTJ enfp Sheldon "
MARKED_TAIL = " Leonard www.example.com/x istj. Sheldon said http://t.co/z"
STYLE_SENTENCE = "This is illogical."
STYLE_MIN_LINES = 45

_CACHE: dict[tuple, object] = {}


def _key(spark: SparkSession, sf_dir: str, what: str, *tables: str) -> tuple:
    """Key of a table kept in the session; ``tables`` are those it is made of."""
    return (spark.sparkContext.applicationId, sf_dir.rstrip("/"), what, adapters.table_version(spark, sf_dir, tables))


CORPUS_TABLES = {"documents": "documents", "dialogue": "conversations"}


def corpus_index(spark: SparkSession, sf_dir: str, corpus: str) -> CorpusIndex:
    key = _key(spark, sf_dir, "index:" + corpus, CORPUS_TABLES[corpus])
    if key not in _CACHE:
        lines = (adapters.document_lines if corpus == "documents" else adapters.dialogue_lines)(spark, sf_dir)
        _CACHE[key] = materialize_index(spark, lines)
    return _CACHE[key]


def trigram_index(spark: SparkSession, sf_dir: str, corpus: str) -> G.TrigramIndex:
    key = _key(spark, sf_dir, "trigrams:" + corpus, CORPUS_TABLES[corpus])
    if key not in _CACHE:
        lines = (adapters.document_lines if corpus == "documents" else adapters.dialogue_lines)(spark, sf_dir)
        _CACHE[key] = G.build_trigrams(spark, searchable_lines(lines))
    return _CACHE[key]


def trait_model(spark: SparkSession, sf_dir: str) -> P.TraitModel:
    key = _key(spark, sf_dir, "model", "documents", "labels")
    if key not in _CACHE:
        model, _split = P.train_trait_model(adapters.posts(spark, sf_dir))
        _CACHE[key] = P.load_model(spark, P.save_model(spark, model))
    return _CACHE[key]


def head_model(spark: SparkSession, sf_dir: str) -> H.HeadModel:
    key = _key(spark, sf_dir, "heads", "documents", "labels")
    if key not in _CACHE:
        model = H.train_heads(adapters.posts(spark, sf_dir))
        _CACHE[key] = H.load_heads(spark, H.save_heads(spark, model))
    return _CACHE[key]


def dialogue(spark, sf_dir) -> DataFrame:
    return adapters.dialogue_lines(spark, sf_dir)


def documents(spark, sf_dir) -> DataFrame:
    return adapters.document_lines(spark, sf_dir)


# ---------------------------------------------------------------------------
# Sources, registry, documents
# ---------------------------------------------------------------------------
def q_show_registry(spark, sf_dir):
    return D.show_registry(dialogue(spark, sf_dir))


def q_show_extremes(spark, sf_dir):
    """How many shows there are and the one with most lines."""
    shows = D.show_registry(dialogue(spark, sf_dir))
    return shows.agg(F.count(F.lit(1)).cast("bigint").alias("n_shows"),
                     F.min_by("show_key", F.struct(-F.col("n_lines"), "show_key")).alias("largest_show"))


def q_distinct_counts(spark, sf_dir):
    """Distinct counts per show from stored sketches, with the exact ones."""
    lines = dialogue(spark, sf_dir)
    return K.checked_counts(spark, lines, K.write_sketches(spark, lines)).drop("estimate")


def q_distinct_estimates(spark, sf_dir):
    """The estimates over all shows, united from the sketches alone."""
    path = K.write_sketches(spark, dialogue(spark, sf_dir))
    return K.united_counts(spark.read.parquet(path), [])


def q_alias_resolution(spark, sf_dir):
    # typed names derived from the data: padded, upper-cased show keys and
    # the display names of the registry, resolved back to keys
    # every known spelling is dealt to a conversation by its number; the data's
    # own keys are names that no alias knows
    spelled = F.element_at(F.array(*[F.lit(a) for a in SHOW_ALIASES]),
                           (F.col("episode") % len(SHOW_ALIASES) + 1).cast("int"))
    name = F.explode(F.array(spelled, F.col("show_key")))
    typed = dialogue(spark, sf_dir).select(name.alias("name")).distinct().select(
        F.concat(F.lit("  "), F.upper("name"), F.lit(" ")).alias("typed"))
    res = D.resolve_alias("typed")
    return typed.select("typed", res.alias("resolved_key"),
                        D.display_name(F.coalesce(res, F.lower(F.trim("typed")))).alias("show_name"))


def q_episode_documents(spark, sf_dir):
    return D.episode_documents(dialogue(spark, sf_dir))


def q_union_sources(spark, sf_dir):
    path = write_csv_sources(spark, dialogue(spark, sf_dir))
    lines, skipped = ingest_csv_sources(spark, path)
    return lines


def q_quarantined_lines(spark, sf_dir):
    """CSV sources in which some rows are damaged (a season that is no
    number) through the ingest that puts such rows aside; all rows, good and bad."""
    damaged = F.col("episode") % 3 == 1
    lines = dialogue(spark, sf_dir).withColumn(
        "season", F.when(damaged, F.concat(F.lit("no "), F.col("season"))).otherwise(F.col("season").cast("string")))
    good, bad, _ = ingest_with_quarantine(spark, write_csv_sources(spark, lines))
    return good.select("show_key", "line_no", "season", "episode", "dialogue").withColumn("parsed", F.lit(True)).unionByName(
        bad.select("show_key", "line_no").withColumn("parsed", F.lit(False)), allowMissingColumns=True)


def q_streamed_lines(spark, sf_dir):
    """The dialogue lines written as files and ingested by the file stream
    twice (the second run finds nothing new)."""
    src = new_table_path(spark, "line-files")
    dialogue(spark, sf_dir).write.parquet(src)
    table, ckpt = new_table_path(spark, "line-table"), new_table_path(spark, "line-ingest")
    ingest_line_files(spark, src, table, ckpt)
    ingest_line_files(spark, src, table, ckpt)
    return read_line_table(spark, table).select(*adapters.LINE_COLUMNS)


def q_index_roundtrip(spark, sf_dir):
    idx = corpus_index(spark, sf_dir, "documents")
    return idx.postings.groupBy("show_key").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_postings"),
        F.sum("tf_body").cast("bigint").alias("sum_tf_body"),
        F.sum("tf_title").cast("bigint").alias("sum_tf_title"),
        F.countDistinct("term").cast("bigint").alias("n_terms"),
    )


def q_line_context(spark, sf_dir):
    # numbered with gaps: neighbours are the next lines, not the next numbers
    return D.line_context(dialogue(spark, sf_dir).withColumn("line_no", F.col("line_no") * 3))


def q_character_line_counts(spark, sf_dir):
    return D.line_counts(dialogue(spark, sf_dir))


def q_top_characters(spark, sf_dir):
    return D.top_characters(dialogue(spark, sf_dir), 2)


def q_first_characters(spark, sf_dir):
    return D.first_characters(dialogue(spark, sf_dir), 2)


def q_eligible_characters(spark, sf_dir):
    return D.eligible_characters(line_vectors(spark, sf_dir), STYLE_MIN_LINES)


def q_character_documents(spark, sf_dir):
    return D.character_texts(dialogue(spark, sf_dir))


def q_character_terms(spark, sf_dir):
    return D.character_terms(dialogue(spark, sf_dir))


# ---------------------------------------------------------------------------
# Text (T1-T25) and queries
# ---------------------------------------------------------------------------
def q_normalize_search(spark, sf_dir):
    return adapters.table(spark, sf_dir, "documents").select("doc_id", normalize_search("text").alias("text"))


def q_tokenize_lemmas(spark, sf_dir):
    """Search tokens through a lexicon made from the corpus: the words in
    -ing that have a stem of three letters or more."""
    tokens = adapters.table(spark, sf_dir, "documents").select("doc_id", search_tokens("text").alias("tokens"))
    terms = tokens.select(F.explode("tokens").alias("term")).distinct()
    lexicon = terms.where(F.col("term").rlike("^.{3,}ing$")).withColumn("lemma", F.regexp_replace("term", "ing$", ""))
    return lemma_tokens(tokens, "doc_id", "tokens", lexicon)


def _corpus_terms(spark, sf_dir) -> DataFrame:
    """Distinct search tokens of all documents, written once for its readers."""
    tokens = adapters.table(spark, sf_dir, "documents").select(F.explode(search_tokens("text")).alias("term"))
    return materialize(tokens.distinct())


def q_suffix_rules(spark, sf_dir):
    """The suffix rules learned from the vocabulary."""
    return L.suffix_rules(_corpus_terms(spark, sf_dir))


def q_learned_lemmas(spark, sf_dir):
    """Search tokens through the lexicon of the learned rules."""
    terms = _corpus_terms(spark, sf_dir)
    lexicon = L.learned_lexicon(terms, materialize(L.suffix_rules(terms)))
    tokens = adapters.table(spark, sf_dir, "documents").select("doc_id", search_tokens("text").alias("tokens"))
    return lemma_tokens(tokens, "doc_id", "tokens", lexicon)


def q_normalize_marked(spark, sf_dir):
    """Every document's own text with a URL, type words
    and names put in, through the three normalisers."""
    marked = F.concat(F.lit(MARKED_HEAD), F.coalesce("text", F.lit("")), F.lit(MARKED_TAIL))
    docs = adapters.table(spark, sf_dir, "documents").select("doc_id", marked.alias("text"))
    # the tokens are split from the normalised text, which is made once
    docs = docs.withColumn("search", normalize_search("text"))
    return docs.select("doc_id", "search", tokens_of_normalized("search").alias("tokens"),
                       normalize_classifier("text", True).alias("classifier"),
                       normalize_baseline("text", True).alias("baseline"))


def q_tokenize_search(spark, sf_dir):
    return adapters.table(spark, sf_dir, "documents").select("doc_id", search_tokens("text").alias("tokens"))


def q_normalize_classifier(spark, sf_dir):
    return adapters.posts(spark, sf_dir).select("row_id", normalize_classifier("posts", True).alias("text"))


def q_normalize_baseline(spark, sf_dir):
    return adapters.posts(spark, sf_dir).select("row_id", normalize_baseline("posts", True).alias("text"))


def _title_queries(spark, sf_dir) -> DataFrame:
    """Queries derived from the data: each conversation title as a phrase, an
    AND of its words and an OR of its words."""
    titles = dialogue(spark, sf_dir).select("episode", "episode_title").distinct()
    return titles.select(
        "episode",
        F.explode(F.array(
            F.struct(F.lit(0).alias("form"), F.col("episode_title").alias("query")),
            F.struct(F.lit(1).alias("form"), F.regexp_replace("episode_title", " ", " & ").alias("query")),
            F.struct(F.lit(2).alias("form"), F.regexp_replace("episode_title", " ", "/").alias("query")),
        )).alias("q"),
    ).select((F.col("episode") * 3 + F.col("q.form")).alias("query_id"), F.col("q.query").alias("query"))


def _batch_queries(spark, sf_dir) -> DataFrame:
    """The query batch of the batch searches: the titles of every conversation
    whose id is divisible by 100 (the stated query set), against all documents."""
    return _title_queries(spark, sf_dir).where(F.col("query_id") % 300 < 3)


def q_query_parse(spark, sf_dir):
    q = _title_queries(spark, sf_dir)
    p = parse_query("query")
    return q.select("query_id", "query", p["type"].alias("qtype"), p["terms"].alias("parts"),
                    display_parts("query").alias("display_parts"))


def _match(spark, sf_dir, query):
    prepared = prepare_queries(query_table(spark, [query]))
    return matched_documents(documents(spark, sf_dir), prepared).select("query_id", "show_key", "episode")


def q_match_phrase(spark, sf_dir):
    return _match(spark, sf_dir, "Ertion")


def q_match_and(spark, sf_dir):
    return _match(spark, sf_dir, "erth&ouen")


def q_match_or(spark, sf_dir):
    return _match(spark, sf_dir, "thth/ouen")


def q_match_batch(spark, sf_dir):
    prepared = prepare_queries(_batch_queries(spark, sf_dir))
    return matched_documents(documents(spark, sf_dir), prepared).select("query_id", "show_key", "episode")


def q_match_indexed(spark, sf_dir):
    """P4-P6, J8 through the trigram postings: the rows of ``match_batch``."""
    prepared = prepare_queries(_batch_queries(spark, sf_dir))
    found = G.matched_by_trigrams(trigram_index(spark, sf_dir, "documents"), prepared)
    return found.select("query_id", "show_key", "episode")


def q_match_indexed_and(spark, sf_dir):
    prepared = prepare_queries(query_table(spark, ["erth&ouen"]))
    found = G.matched_by_trigrams(trigram_index(spark, sf_dir, "documents"), prepared)
    return found.select("query_id", "show_key", "episode")


# ---------------------------------------------------------------------------
# Index and ranking
# ---------------------------------------------------------------------------
def q_term_stats(spark, sf_dir):
    return corpus_index(spark, sf_dir, "documents").term_stats


def q_doc_lengths(spark, sf_dir):
    return corpus_index(spark, sf_dir, "documents").doc_len.select("show_key", "episode", "len_body", "len_title")


def q_postings_top(spark, sf_dir):
    return top_terms(corpus_index(spark, sf_dir, "documents"), ["show_key", "episode"], 3)


def q_bm25_scores(spark, sf_dir):
    idx = corpus_index(spark, sf_dir, "documents")
    prepared = prepare_queries(query_table(spark, DOC_QUERIES))
    bounds = query_bounds(prepared, DOC_QUERIES)
    return bm25_scores(idx, prepared, DEFAULT_TITLE_WEIGHT, bounds=bounds).select(
        "query_id", "show_key", "episode", F.round("bm25", 6).alias("bm25"))


def q_search_episodes(spark, sf_dir):
    idx = corpus_index(spark, sf_dir, "documents")
    return search(spark, idx, DOC_QUERIES, DEFAULT_TOP_K, DEFAULT_TITLE_WEIGHT)


def q_search_all_shows(spark, sf_dir):
    idx = corpus_index(spark, sf_dir, "dialogue")
    return search_all_shows(spark, idx, DIALOGUE_QUERIES, DEFAULT_TOP_K, DEFAULT_TITLE_WEIGHT)


def q_search_title_weight0(spark, sf_dir):
    idx = corpus_index(spark, sf_dir, "dialogue")
    return search(spark, idx, DIALOGUE_QUERIES, 3, 0)


def q_search_one_show(spark, sf_dir):
    """One show only; the scans prune to its folder."""
    idx = corpus_index(spark, sf_dir, "dialogue")
    return search(spark, idx, DIALOGUE_QUERIES, 3, DEFAULT_TITLE_WEIGHT, show_keys="show1")


def q_search_batch(spark, sf_dir):
    idx = corpus_index(spark, sf_dir, "dialogue")
    return search(spark, idx, _batch_queries(spark, sf_dir), 3, DEFAULT_TITLE_WEIGHT)


def q_search_indexed(spark, sf_dir):
    """M2 with the boolean match read from the trigram postings."""
    idx = replace(corpus_index(spark, sf_dir, "dialogue"), grams=trigram_index(spark, sf_dir, "dialogue"))
    return search(spark, idx, _batch_queries(spark, sf_dir), 3, DEFAULT_TITLE_WEIGHT)


def q_search_pruned(spark, sf_dir):
    """M2, L1: the top-k search that skips postings blocks below the threshold."""
    idx = corpus_index(spark, sf_dir, "documents")
    key = _key(spark, sf_dir, "impacts:documents", "documents")
    if key not in _CACHE:
        _CACHE[key] = build_impacts(spark, idx)
    return search(spark, replace(idx, impacts=_CACHE[key]), DOC_QUERIES, DEFAULT_TOP_K, DEFAULT_TITLE_WEIGHT)


def updated_index(spark: SparkSession, sf_dir: str) -> tuple[CorpusIndex, dict]:
    """An index first opened on an earlier state of the documents (some missing,
    some with another text, one more), then brought up to date with all of them."""
    now = documents(spark, sf_dir)
    number = F.col("episode")
    before = now.where(number % 7 != 3).withColumn(
        "dialogue", F.when(number % 5 == 2, F.reverse("dialogue")).otherwise(F.col("dialogue")))
    extra = now.where(number % 9 == 4).withColumn("episode", -number - 1)
    path = new_table_path(spark, "versioned-index")
    open_index(spark, path, before.unionByName(extra))
    return open_index(spark, path, now)


def q_versioned_term_stats(spark, sf_dir):
    """Statistics of the index that was brought up to date by a segment."""
    return updated_index(spark, sf_dir)[0].term_stats


def q_versioned_search(spark, sf_dir):
    """A search of the index that was brought up to date."""
    return search(spark, updated_index(spark, sf_dir)[0], DOC_QUERIES, DEFAULT_TOP_K, DEFAULT_TITLE_WEIGHT)


def q_snippets(spark, sf_dir):
    idx = corpus_index(spark, sf_dir, "dialogue")
    docs = idx.lines.select(*DOC_KEYS).distinct().select(
        F.lit(0).cast("bigint").alias("query_id"), *DOC_KEYS, display_parts(F.lit(SNIPPET_QUERY)).alias("dparts"))
    snip = document_snippets(idx.lines, docs)
    return snip.select("show_key", "season", "episode", "episode_title", "snippet",
                       highlight("snippet", display_parts(F.lit(SNIPPET_QUERY))).alias("highlighted"))


# ---------------------------------------------------------------------------
# Classification
# ---------------------------------------------------------------------------
def q_label_encode(spark, sf_dir):
    return C.label_columns(adapters.posts(spark, sf_dir).select("row_id", "type"))


def q_stratified_split(spark, sf_dir):
    return C.stratified_split(adapters.posts(spark, sf_dir).select("row_id", "type"))


def q_stratified_folds(spark, sf_dir):
    return C.stratified_folds(C.long_labels(adapters.posts(spark, sf_dir)))


def _baseline_features(spark, sf_dir):
    posts = adapters.posts(spark, sf_dir)
    texts = posts.select("row_id", normalize_baseline("posts", True).alias("text"))
    counts = materialize(C.term_counts(texts, "row_id", "text"))
    vocab = C.fit_tfidf(counts, posts.count())
    return posts, vocab, C.tfidf_weights(counts, vocab, "row_id")


def q_tfidf_vocab(spark, sf_dir):
    _, vocab, _ = _baseline_features(spark, sf_dir)
    return vocab.select("term", F.round("idf", 6).alias("idf"))


def q_tfidf_vocab_frequent(spark, sf_dir):
    """The vocabulary through bounded summaries of frequent terms."""
    posts = adapters.posts(spark, sf_dir)
    texts = posts.select("row_id", normalize_baseline("posts", True).alias("text"))
    counts = materialize(C.term_counts(texts, "row_id", "text"))
    return frequent_vocabulary(counts, posts.count()).select("term", F.round("idf", 6).alias("idf"))


def q_tfidf_weights(spark, sf_dir):
    _, _, x = _baseline_features(spark, sf_dir)
    return x.select("row_id", "term", F.round("x", 6).alias("x"))


def q_nb_model(spark, sf_dir):
    posts, vocab, x = _baseline_features(spark, sf_dir)
    logp, priors = C.fit_nb(x, C.long_labels(posts), vocab)
    return logp.join(priors, ["dim", "label"]).select(
        "dim", "label", "term", F.round("logp", 6).alias("logp"), F.round("prior", 6).alias("prior"))


def q_nb_cv_accuracy(spark, sf_dir):
    posts, vocab, x = _baseline_features(spark, sf_dir)
    folds = C.stratified_folds(C.long_labels(posts))
    return C.cv_accuracy(x, folds, vocab)


def q_eval_metrics(spark, sf_dir):
    posts = adapters.posts(spark, sf_dir)
    model = trait_model(spark, sf_dir)
    split = model.split
    texts = posts.select("row_id", normalize_classifier("posts", True).alias("text"))
    counts = C.term_counts(texts, "row_id", "text")
    x = C.tfidf_weights(counts, model.vocab, "row_id")
    jll = C.nb_joint(x, posts.select("row_id"), model.logp, model.priors)
    return C.split_metrics(C.nb_predict(jll), C.long_labels(posts), split)


def q_head_training(spark, sf_dir):
    """M7: losses of every epoch and head, and the epoch whose weights are kept."""
    return head_model(spark, sf_dir).history.select(
        F.col("epoch").cast("bigint"), "dim", F.round("train_loss", 6).alias("train_loss"),
        F.round("val_loss", 6).alias("val_loss"), "chosen")


def q_head_weights(spark, sf_dir):
    """The kept weights, read back; the bias has an empty term."""
    w = head_model(spark, sf_dir).weights
    return w.select(F.coalesce("term", F.lit("")).alias("term"),
                    *[F.round(f"w_{d}", 6).alias(f"w_{d}") for d in C.DIM_NAMES])


def q_head_metrics(spark, sf_dir):
    """M8, A15, A16 of the trained heads on all three splits."""
    posts = adapters.posts(spark, sf_dir)
    model = head_model(spark, sf_dir)
    return C.split_metrics(H.head_predictions(model, posts), C.long_labels(posts), model.split)


def q_head_character_types(spark, sf_dir):
    """M10 with the trained heads in place of naive Bayes."""
    return P.character_types(dialogue(spark, sf_dir), head_model(spark, sf_dir))


def q_limited_character_types(spark, sf_dir):
    """Every character scored on the first words of its text only."""
    return P.character_types(dialogue(spark, sf_dir), trait_model(spark, sf_dir), MAX_INPUT_TOKENS)


# ---------------------------------------------------------------------------
# Profiles (M10-M16) and style retrieval
# ---------------------------------------------------------------------------
def q_character_types(spark, sf_dir):
    return P.character_types(dialogue(spark, sf_dir), trait_model(spark, sf_dir))


def q_character_lookup(spark, sf_dir):
    """Every character of every show asked for by its upper-cased
    name, and a name that no show has."""
    lines = dialogue(spark, sf_dir)
    types = P.character_types(lines, trait_model(spark, sf_dir))
    names = lines.where(F.col("character").isNotNull()).select("show_key", F.upper("character").alias("character"))
    asked = names.unionByName(names.select("show_key", F.lit("Nobody").alias("character"))).distinct()
    asked = asked.withColumn("request_id", F.concat_ws("/", "show_key", "character"))
    return P.character_lookup(asked, types).select("request_id", "success", "error", "mbti", "n_lines")


def q_probability_map(spark, sf_dir):
    """Each axis's letters with their probabilities, likeliest first."""
    types = P.probability_map(P.character_types(dialogue(spark, sf_dir), trait_model(spark, sf_dir)))
    return types.select("show_key", "character_key", F.explode("probabilities").alias("axis", "letters"),
                        F.array_join("letters_by_probability", ",").alias("order")).select(
        "show_key", "character_key", "axis", F.explode("letters").alias("letter", "p"), "order").withColumn(
        "p", F.round("p", 6))


def q_show_personalities(spark, sf_dir):
    return P.show_personalities(dialogue(spark, sf_dir), trait_model(spark, sf_dir), 2)


def q_quote_scores(spark, sf_dir):
    return P.quote_scores(dialogue(spark, sf_dir), trait_model(spark, sf_dir))


def q_character_moments(spark, sf_dir):
    lines = dialogue(spark, sf_dir)
    types = materialize(P.character_types(lines, trait_model(spark, sf_dir)))
    return P.character_moments(lines, MOMENT_QUERY, DEFAULT_TOP_K, types)


def q_search_with_characters(spark, sf_dir):
    idx = corpus_index(spark, sf_dir, "dialogue")
    results = search(spark, idx, DIALOGUE_QUERIES, DEFAULT_TOP_K, DEFAULT_TITLE_WEIGHT)
    return P.characters_in_results(dialogue(spark, sf_dir), trait_model(spark, sf_dir), results, 2)


def line_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line vectors written once per session, partitioned by character."""
    key = _key(spark, sf_dir, "vectors", "documents", "embeddings")
    if key not in _CACHE:
        _CACHE[key] = V.materialize_vectors(spark, adapters.line_vectors(spark, sf_dir))
    return _CACHE[key]


def _style_inputs(spark, sf_dir):
    vecs = line_vectors(spark, sf_dir)
    eligible = D.eligible_characters(vecs, STYLE_MIN_LINES).select("character")
    corpus = vecs.dropna(subset=["character", "dialogue"]).where(F.length("dialogue") > 5) \
        .join(eligible, "character", "left_semi")
    return corpus, V.centroid_requests(corpus)


def q_cosine_topk(spark, sf_dir):
    corpus, requests = _style_inputs(spark, sf_dir)
    return V.nearest_lines(corpus, requests).select(
        "request_id", "character", F.col("example_rank").cast("bigint"), "line_id", "cosine")


def q_style_prompts(spark, sf_dir):
    corpus, requests = _style_inputs(spark, sf_dir)
    return V.style_prompts(V.nearest_lines(corpus, requests), STYLE_SENTENCE)


def vector_index(spark: SparkSession, sf_dir: str) -> I.VectorIndex:
    key = _key(spark, sf_dir, "vector-index", "documents", "embeddings")
    if key not in _CACHE:
        corpus, _ = _style_inputs(spark, sf_dir)
        _CACHE[key] = I.build_vector_index(spark, corpus.select("character", "line_id", "dialogue", "embedding"))
    return _CACHE[key]


def q_cosine_topk_index(spark, sf_dir):
    """The exact search of the vector index, the rows of ``cosine_topk``."""
    _, requests = _style_inputs(spark, sf_dir)
    return I.exact_lines(vector_index(spark, sf_dir), requests).select(
        "request_id", "character", F.col("example_rank").cast("bigint"), "line_id", "cosine")


def text_embedding(spark: SparkSession, sf_dir: str) -> tuple[E.TextEmbedding, DataFrame, DataFrame]:
    """The embedding learned from all lines, their packed rows and the lines."""
    key = _key(spark, sf_dir, "text-embedding", "documents", "embeddings")
    if key not in _CACHE:
        lines = materialize(line_vectors(spark, sf_dir).select("character", "line_id", "dialogue"))
        model, rows = E.fit_embedding(lines)
        _CACHE[key] = (E.load_embedding(spark, E.save_embedding(spark, model)), rows, lines)
    return _CACHE[key]


def q_embedding_axes(spark, sf_dir):
    """The singular values of the axes, in order."""
    model, _, _ = text_embedding(spark, sf_dir)
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(model.singular_values)],
                                 "axis bigint, singular_value double")


def q_style_prompts_text(spark, sf_dir):
    """Prompts from text alone. Every eligible character is asked for the
    sentence of the first line; lines and sentence are embedded here."""
    model, rows, lines = text_embedding(spark, sf_dir)
    corpus = lines.dropna(subset=["character", "dialogue"]).where(F.length("dialogue") > 5)
    corpus = corpus.join(D.eligible_characters(lines, STYLE_MIN_LINES).select("character"), "character", "left_semi")
    vectors = E.embed_lines(corpus, model, rows)
    sentence = corpus.agg(F.min_by("dialogue", "line_id").alias("sentence"))
    asked = E.embed_texts(sentence.select(F.lit(0).alias("line_id"), "sentence"), model, "line_id", "sentence").first()
    if asked is None:           # no vocabulary word in the sentence
        return V.style_prompts(V.nearest_lines(vectors.where("false"), V.centroid_requests(vectors.where("false"))), "")
    requests = corpus.select("character").distinct().select(
        F.col("character").alias("request_id"), "character", F.lit(list(asked["embedding"])).alias("request_vec"))
    index = I.build_vector_index(spark, vectors)
    return V.style_prompts(I.exact_lines(index, requests), sentence.first()["sentence"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "show_registry": q_show_registry,
    "show_extremes": q_show_extremes,
    "distinct_counts": q_distinct_counts,
    "distinct_estimates": q_distinct_estimates,
    "alias_resolution": q_alias_resolution,
    "episode_documents": q_episode_documents,
    "union_sources": q_union_sources,
    "quarantined_lines": q_quarantined_lines,
    "streamed_lines": q_streamed_lines,
    "index_roundtrip": q_index_roundtrip,
    "line_context": q_line_context,
    "character_line_counts": q_character_line_counts,
    "top_characters": q_top_characters,
    "first_characters": q_first_characters,
    "eligible_characters": q_eligible_characters,
    "character_documents": q_character_documents,
    "character_terms": q_character_terms,
    "normalize_search": q_normalize_search,
    "tokenize_search": q_tokenize_search,
    "normalize_marked": q_normalize_marked,
    "tokenize_lemmas": q_tokenize_lemmas,
    "suffix_rules": q_suffix_rules,
    "learned_lemmas": q_learned_lemmas,
    "normalize_classifier": q_normalize_classifier,
    "normalize_baseline": q_normalize_baseline,
    "query_parse": q_query_parse,
    "match_phrase": q_match_phrase,
    "match_and": q_match_and,
    "match_or": q_match_or,
    "match_batch": q_match_batch,
    "match_indexed": q_match_indexed,
    "match_indexed_and": q_match_indexed_and,
    "term_stats": q_term_stats,
    "doc_lengths": q_doc_lengths,
    "postings_top": q_postings_top,
    "bm25_scores": q_bm25_scores,
    "search_episodes": q_search_episodes,
    "search_all_shows": q_search_all_shows,
    "search_title_weight0": q_search_title_weight0,
    "search_one_show": q_search_one_show,
    "search_batch": q_search_batch,
    "search_indexed": q_search_indexed,
    "search_pruned": q_search_pruned,
    "versioned_term_stats": q_versioned_term_stats,
    "versioned_search": q_versioned_search,
    "snippets": q_snippets,
    "label_encode": q_label_encode,
    "stratified_split": q_stratified_split,
    "stratified_folds": q_stratified_folds,
    "tfidf_vocab": q_tfidf_vocab,
    "tfidf_vocab_frequent": q_tfidf_vocab_frequent,
    "tfidf_weights": q_tfidf_weights,
    "nb_model": q_nb_model,
    "nb_cv_accuracy": q_nb_cv_accuracy,
    "eval_metrics": q_eval_metrics,
    "head_training": q_head_training,
    "head_weights": q_head_weights,
    "head_metrics": q_head_metrics,
    "head_character_types": q_head_character_types,
    "limited_character_types": q_limited_character_types,
    "character_types": q_character_types,
    "character_lookup": q_character_lookup,
    "probability_map": q_probability_map,
    "show_personalities": q_show_personalities,
    "quote_scores": q_quote_scores,
    "character_moments": q_character_moments,
    "search_with_characters": q_search_with_characters,
    "cosine_topk": q_cosine_topk,
    "style_prompts": q_style_prompts,
    "cosine_topk_index": q_cosine_topk_index,
    "embedding_axes": q_embedding_axes,
    "style_prompts_text": q_style_prompts_text,
}


def oracle_sql() -> dict[str, str]:
    from . import oracle
    return oracle.all_sql()
