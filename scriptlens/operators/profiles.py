"""Character profiles.

The trait model is the relational naive Bayes of ``classify`` on TF-IDF
features of classifier-normalised text (type words removed), fitted on the
training rows of the stratified split. It is a handful of bounded tables
(vocabulary, log probabilities, priors) that can be written and read back.
Every operator handles all characters of all shows in one plan; a single
show or character is a filter on the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.query import display_parts
from ..functions.snippet import highlight, snippet
from ..functions.text import first_words, normalize_classifier, vectorizer_tokens
from ..functions.wordlists import (
    DEFAULT_PERSONALITY_LIMIT,
    DEFAULT_TOP_K,
    DIMENSIONS,
)
from ..session import checked_broadcast, materialize, new_table_path
from ..sources.adapters import LINE_COLUMNS
from . import classify as C
from .documents import (
    character_key,
    character_lines,
    character_terms,
    character_texts,
    first_characters,
    top_characters,
)
from .heads import HeadModel, head_probs, head_rows
from .search import top_k
from .sparse import packed_weights


@dataclass
class TraitModel:
    vocab: DataFrame    # term, idf
    logp: DataFrame     # dim, label, term, logp
    priors: DataFrame   # dim, label, prior
    split: DataFrame | None = None  # row_id, type, split (training rows used)


def train_trait_model(posts: DataFrame, split: DataFrame | None = None) -> tuple[TraitModel, DataFrame]:
    """M7 (re-aimed): NB heads on the training rows. Returns (model, split)."""
    split = materialize(split if split is not None else C.stratified_split(posts))
    texts = posts.select("row_id", normalize_classifier("posts", True).alias("text"))
    # token counts feed the vocabulary and the weights: normalise once
    counts = C.packed_counts(texts, "row_id", "text")
    train_ids = split.where(F.col("split") == "train").select("row_id")
    n_train = train_ids.count()
    # vocabulary (<= 1500 rows) and weights feed the grid, the sums and the sink
    train_counts = C.unpacked_counts(counts.join(train_ids, "row_id"), "row_id")
    vocab = materialize(C.numbered(C.fit_tfidf(train_counts, n_train)))
    x = packed_weights(counts, vocab, "term", "n_w")
    labels = C.long_labels(posts)
    logp, priors = C.fit_nb(x, labels.join(train_ids, "row_id"), vocab)
    return TraitModel(vocab.drop("term_index"), logp, priors, split), split


def save_model(spark: SparkSession, model: TraitModel, path: str | None = None) -> str:
    """S10 sink: the model tables as Parquet."""
    path = path or new_table_path(spark, "trait-model")
    model.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    model.logp.write.mode("overwrite").parquet(f"{path}/logp")
    model.priors.write.mode("overwrite").parquet(f"{path}/priors")
    if model.split is not None:
        model.split.write.mode("overwrite").parquet(f"{path}/split")
    return path


def load_model(spark: SparkSession, path: str) -> TraitModel:
    """S10 source."""
    r = spark.read
    try:
        split = r.parquet(f"{path}/split")
    except AnalysisException:   # a model saved without its split
        split = None
    return TraitModel(r.parquet(f"{path}/vocab"), r.parquet(f"{path}/logp"), r.parquet(f"{path}/priors"), split)


def score_texts(model: TraitModel, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """M9: (id, p_EI, p_SN, p_TF, p_JP, mbti) for every text."""
    return score_counts(model, C.term_counts(texts, id_col, text_col), texts.select(id_col), id_col)


def score_counts(model: TraitModel | HeadModel, counts: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """M9 from (id, term, cnt): the same columns for every row of ``rows``, by naive
    Bayes or by the trained heads."""
    if isinstance(model, HeadModel):
        return head_probs(model, counts, rows, id_col)
    x = C.tfidf_weights(counts, model.vocab, id_col)
    jll = C.nb_joint(x, rows, model.logp, model.priors, id_col)
    return C.wide_probs(C.nb_predict(jll, id_col), [id_col])


def score_rows(model: TraitModel | HeadModel, df: DataFrame, text_col: str) -> DataFrame:
    """M9 row by row: ``df`` with p_EI, p_SN, p_TF, p_JP and mbti in place of the text.
    Every row is scored by itself where it lies."""
    tokens = df.withColumn("_w", vectorizer_tokens(F.col(text_col))).drop(text_col)
    if isinstance(model, HeadModel):
        return head_rows(model, packed_weights(tokens, model.vocab, "_w"))
    vocab = materialize(C.numbered(model.vocab))
    return C.nb_probs(packed_weights(tokens, vocab, "_w"), vocab, model.logp, model.priors)


def _cid():
    return F.concat_ws("\u0001", F.col("show_key"), F.col("character_key"))


def character_types(lines: DataFrame, model: TraitModel, max_words: int | None = None) -> DataFrame:
    """M10 / M13 for every (show, character): type, per-axis P(label 1), line count.

    A character is scored from the term counts of its whole text; ``max_words``
    cuts the text first (M11). Characters without a word after normalisation get
    no prediction.
    """
    if max_words is None:
        # one row per character, read by the scorer and by the output join
        texts = materialize(
            character_lines(lines).groupBy("show_key", "character_key")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_lines"), F.max(F.col("clean") != "").alias("worded"))
            .where("worded").drop("worded").withColumn("cid", _cid()))
        counts = character_terms(lines).select(_cid().alias("cid"), "term", "cnt")
        scored = score_counts(model, counts, texts.select("cid"), "cid")
    else:
        texts = materialize(character_texts(lines, max_words).where(F.col("text") != "").withColumn("cid", _cid()))
        scored = score_texts(model, texts.select("cid", "text"), "cid", "text")
    return texts.join(scored, "cid").select(
        "show_key", "character_key", "n_lines",
        *[F.round(f"p_{d}", 6).alias(f"p_{d}") for d, _, _ in DIMENSIONS], "mbti",
    )


def quote_scores(lines: DataFrame, model: TraitModel, types: DataFrame | None = None,
                 k: int = DEFAULT_TOP_K, max_words: int | None = None) -> DataFrame:
    """M12 + A13 + W7: every line of a predicted character scored by the mean
    over axes of P(the character's letter); the top ``k`` per character
    (ties by file order). A line is scored where it lies, so only the first ``k`` of a
    task are shuffled. Lines are known by an id made of their whole row, since line numbers
    may meet: rows share an id only if they are equal, and equal rows are ranked one by
    one. The text joins the ``k`` winners only."""
    types = types if types is not None else character_types(lines, model, max_words)
    text = normalize_classifier("dialogue")
    lid = F.md5(F.to_json(F.struct(*LINE_COLUMNS)))
    keyed = lines.where(F.col("character").isNotNull()).select(
        "show_key", character_key().alias("character_key"), "line_no", "season", "episode", "episode_title",
        (text if max_words is None else first_words(text, max_words)).alias("text"), lid.alias("lid"))
    # one row per character: broadcast while there are few
    kinds, _ = checked_broadcast(materialize(types.select("show_key", "character_key", F.col("mbti").alias("type"))))
    ln = score_rows(model, keyed.join(kinds, ["show_key", "character_key"]), "text")
    match = None
    for i, (dim, pos, _neg) in enumerate(DIMENSIONS):
        p = F.col(f"p_{dim}")
        term = F.when(F.substring("type", i + 1, 1) == pos, p).otherwise(F.lit(1.0) - p)
        match = term if match is None else match + term
    scored = ln.withColumn("score", F.round(match / F.lit(4.0), 6))
    best = materialize(top_k(scored, ["show_key", "character_key"],
                             [F.col("score").desc(), "line_no", "season", "episode", "episode_title", "lid"],
                             k, "quote_rank"))
    raw = lines.select("show_key", "line_no", F.col("dialogue").alias("dialogue_raw"), lid.alias("lid"))
    # the numbers cut the scan's rows to the winners' before ids are compared
    raw = raw.join(best.select("show_key", "line_no").distinct(), ["show_key", "line_no"], "left_semi") \
        .select("lid", "dialogue_raw").dropDuplicates(["lid"])
    return best.join(raw, "lid").select("show_key", "character_key", F.col("quote_rank").cast("bigint"), "line_no", "season",
                       "episode", "episode_title", "dialogue_raw", "score")


def character_moments(lines: DataFrame, query: str, k: int = DEFAULT_TOP_K,
                      types: DataFrame | None = None) -> DataFrame:
    """M15 (P10, T28, T27, L6, A14): per character, lines whose raw text holds
    the raw lower-cased query; snippet and highlight of the line; the first
    ``k`` in file order and the total count."""
    q = F.lit(query)
    parts = display_parts(q)
    hits = lines.where(F.col("character").isNotNull()).select(
        "show_key", character_key().alias("character_key"), "season", "episode", "episode_title",
        "line_no", F.coalesce("dialogue", F.lit("")).alias("full_dialogue"),
    ).where(F.contains(F.lower("full_dialogue"), F.lower(q)))
    if types is not None:
        hits = hits.join(types.select("show_key", "character_key"), ["show_key", "character_key"], "left_semi")
    totals = hits.groupBy("show_key", "character_key").agg(F.count(F.lit(1)).cast("bigint").alias("total_matches"))
    first = top_k(hits, ["show_key", "character_key"], ["line_no"], k, "moment_rank")
    return first.join(totals, ["show_key", "character_key"]).select(
        "show_key", "character_key", F.col("moment_rank").cast("bigint"), "line_no", "season", "episode",
        "episode_title", highlight(snippet("full_dialogue", parts), parts).alias("snippet"),
        "full_dialogue", "total_matches",
    )


def show_personalities(lines: DataFrame, model: TraitModel, limit: int = DEFAULT_PERSONALITY_LIMIT,
                       types: DataFrame | None = None) -> DataFrame:
    """Types of the ``limit`` characters with most lines per show."""
    types = types if types is not None else character_types(lines, model)
    top = top_characters(lines, limit).withColumn("character_key", character_key())
    return top.join(types.select("show_key", "character_key", "mbti"), ["show_key", "character_key"]).select(
        "show_key", "character", "n_lines", F.col("count_rank").cast("bigint"), "mbti"
    )


def characters_in_results(lines: DataFrame, model: TraitModel, results: DataFrame,
                          limit: int = DEFAULT_PERSONALITY_LIMIT, types: DataFrame | None = None) -> DataFrame:
    """M14 second output: for each (query, show) with search results, the
    first ``limit`` characters of the show by appearance with their type."""
    types = types if types is not None else character_types(lines, model)
    shows = results.select("query_id", "show_key").distinct()
    firsts = first_characters(lines, limit).withColumn("character_key", character_key())
    typed = firsts.join(types.select("show_key", "character_key", "mbti"), ["show_key", "character_key"])
    return shows.join(typed, "show_key").select(
        "query_id", "show_key", "character", F.col("appearance_rank").cast("bigint"), "mbti"
    )


def character_lookup(requests: DataFrame, types: DataFrame) -> DataFrame:
    """P16 + P17: (request_id, show_key, character) requests joined to the
    predicted types; ``success`` and an ``error`` text for unknown names."""
    req = requests.withColumn("character_key", character_key())
    out = req.join(types, ["show_key", "character_key"], "left")
    ok = F.col("mbti").isNotNull()
    return out.select(
        "request_id", "show_key", "character", ok.alias("success"),
        F.when(~ok, F.concat(F.lit("No dialogue found for "), F.col("character"), F.lit(" in "),
                             F.col("show_key"))).alias("error"),
        "mbti", *[f"p_{d}" for d, _, _ in DIMENSIONS], "n_lines",
    )


def probability_map(types: DataFrame) -> DataFrame:
    """T36 + L8: per-axis probabilities as MAP<axis, MAP<letter, p>> and the
    letters of each axis ordered by probability (ties keep label 1 first)."""
    entries = []
    order = []
    for dim, pos, neg in DIMENSIONS:
        p1 = F.col(f"p_{dim}")
        entries += [F.lit(dim), F.create_map(F.lit(neg), F.lit(1.0) - p1, F.lit(pos), p1)]
        order.append(F.when(p1 >= 0.5, F.lit(pos + neg)).otherwise(F.lit(neg + pos)))
    return types.withColumn("probabilities", F.create_map(*entries)) \
        .withColumn("letters_by_probability", F.array(*order))
