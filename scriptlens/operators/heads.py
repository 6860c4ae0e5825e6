"""Four logistic heads trained by gradient steps with the best epoch kept (M7).

The features are the sparse TF-IDF rows of ``classify``. A text is one packed row
(term numbers, weights, its four labels), written once; the term numbered 1 is the
bias. An epoch is one pass over these rows: margins from the current weights (an
array literal per head, bounded by the vocabulary), then sums of weight x error per
term and of the log loss per split, with partial aggregation, so every task sends
at most vocabulary + 1 rows. The driver holds the weights only (heads x vocabulary
numbers).

After every epoch the mean validation loss over the heads decides: the weights of
the best epoch are kept, and ``patience`` epochs without a better one end the
training. Without validation rows the last epoch is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_classifier
from ..functions.wordlists import HEAD_EPOCHS, HEAD_PATIENCE, TFIDF_MAX_FEATURES
from ..session import bounded_broadcast, materialize, new_table_path
from . import classify as C
from .sparse import packed_terms, packed_weights, sparse_dot

LEARNING_RATE = 4.0     # unit rows: the loss of every epoch's step can't rise
BIAS = 1                # number of the bias term
HEADS = C.DIM_NAMES


@dataclass
class HeadModel:
    vocab: DataFrame        # term, idf, term_index (from 2)
    weights: DataFrame      # term, w_EI, w_SN, w_TF, w_JP; the bias has a null term
    history: DataFrame      # epoch, dim, train_loss, val_loss, chosen
    split: DataFrame | None = None


def packed_rows(features: DataFrame, labels: DataFrame, split: DataFrame, vocab: DataFrame,
                id_col: str = "row_id") -> DataFrame:
    """(id, split, idx, val, y_<head>...) with the bias first; texts without a
    vocabulary term have the bias only. Written once, read by every epoch. ``features``:
    (id, term, x), or already packed (id, idx, val)."""
    packed = features if "idx" in features.columns else packed_terms(features, vocab, id_col)
    wide = labels.groupBy(id_col).agg(*[
        F.max(F.when(F.col("dim") == d, F.col("label"))).cast("double").alias(f"y_{d}") for d in HEADS])
    joined = split.select(id_col, "split").join(wide, id_col).join(packed, id_col, "left")
    rows = joined.select(
        id_col, "split",
        F.concat(F.array(F.lit(BIAS)), F.coalesce("idx", F.array().cast("array<int>"))).alias("idx"),
        F.concat(F.array(F.lit(1.0)), F.coalesce("val", F.array().cast("array<double>"))).alias("val"),
        *[f"y_{d}" for d in HEADS])
    path = new_table_path(split.sparkSession, "packed-rows")
    rows.write.parquet(path)
    return split.sparkSession.read.parquet(path)


def epoch_sums(rows: DataFrame, weights: dict[str, list[float]]) -> tuple[dict, dict]:
    """One pass: gradient sums {head: {term: sum}} over the training rows and
    losses {(split, head): (sum, rows)} of the training and validation rows."""
    z = rows.where(F.col("split").isin("train", "val")).select(
        "split", "idx", "val", *[f"y_{d}" for d in HEADS], *[sparse_dot(weights[d]).alias(f"z_{d}") for d in HEADS])
    errors = [(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(f"z_{d}"))) - F.col(f"y_{d}")).alias(f"e_{d}") for d in HEADS]
    # ln(1 + exp(z)) - y z, written so that neither side overflows
    losses = [(F.greatest(f"z_{d}", F.lit(0.0)) + F.log1p(F.exp(-F.abs(f"z_{d}"))) - F.col(f"y_{d}") * F.col(f"z_{d}"))
              .alias(f"l_{d}") for d in HEADS]
    entries = F.when(F.col("split") == "train", F.arrays_zip("idx", "val")).otherwise(
        F.slice(F.arrays_zip("idx", "val"), 1, 1))      # validation rows: the bias entry, which carries the loss
    sums = (z.select("split", entries.alias("t"), *errors, *losses)
            .select("split", F.explode("t").alias("t"), *[f"e_{d}" for d in HEADS], *[f"l_{d}" for d in HEADS])
            .groupBy("split", F.col("t.idx").alias("idx")).agg(
                *[F.sum(F.col("t.val") * F.col(f"e_{d}")).alias(f"g_{d}") for d in HEADS],
                *[F.sum(F.when(F.col("t.idx") == BIAS, F.col(f"l_{d}"))).alias(f"l_{d}") for d in HEADS],
                *[F.count(F.when(F.col("t.idx") == BIAS, F.col(f"l_{d}"))).alias(f"n_{d}") for d in HEADS]))
    gradient: dict[str, dict[int, float]] = {d: {} for d in HEADS}
    loss: dict[tuple[str, str], tuple[float, int]] = {}
    for r in sums.collect():            # vocabulary + 2 rows at most
        for d in HEADS:
            if r["split"] == "train" and r[f"g_{d}"] is not None:
                gradient[d][r["idx"]] = r[f"g_{d}"]
            if r["idx"] == BIAS:
                loss[r["split"], d] = (r[f"l_{d}"] or 0.0, r[f"n_{d}"])
    return gradient, loss


def fit_heads(rows: DataFrame, n_terms: int, epochs: int = HEAD_EPOCHS, patience: int = HEAD_PATIENCE,
              rate: float = LEARNING_RATE) -> tuple[dict[str, list[float]], list[tuple]]:
    """Weights of the best epoch and (epoch, head, train loss, validation loss,
    chosen) of all epochs run. ``n_terms`` counts the bias."""
    weights = {d: [0.0] * n_terms for d in HEADS}
    best, best_loss, best_epoch, waited = weights, float("inf"), 0, 0
    history: list[tuple[int, str, float | None, float | None]] = []
    gradient, loss = epoch_sums(rows, weights)
    for epoch in range(1, epochs + 1):
        step = {d: rate / max(1, loss.get(("train", d), (0.0, 0))[1]) for d in HEADS}
        weights = {d: [w - step[d] * gradient[d].get(i, 0.0) for i, w in enumerate(weights[d], BIAS)] for d in HEADS}
        gradient, loss = epoch_sums(rows, weights)
        mean = {k: s / n for k, (s, n) in loss.items() if n}
        history += [(epoch, d, mean.get(("train", d)), mean.get(("val", d))) for d in HEADS]
        seen = [mean["val", d] for d in HEADS if ("val", d) in mean]
        total = sum(seen) / len(seen) if seen else None
        if total is None or total < best_loss:
            best, best_loss, best_epoch, waited = weights, total if seen else best_loss, epoch, 0
        else:
            waited += 1
            if waited >= patience:
                break
    return best, [(*h, h[0] == best_epoch) for h in history]


def train_heads(posts: DataFrame, split: DataFrame | None = None, epochs: int = HEAD_EPOCHS,
                patience: int = HEAD_PATIENCE, rate: float = LEARNING_RATE) -> HeadModel:
    """M7: heads fitted on the training rows of the split, the epoch chosen on its
    validation rows; the vocabulary is that of the training rows."""
    spark = posts.sparkSession
    split = materialize(split if split is not None else C.stratified_split(posts))
    texts = posts.select("row_id", normalize_classifier("posts", True).alias("text"))
    counts = C.packed_counts(texts, "row_id", "text")
    train_ids = split.where(F.col("split") == "train").select("row_id")
    train_counts = C.unpacked_counts(counts.join(train_ids, "row_id"), "row_id")
    vocab = materialize(C.numbered(C.fit_tfidf(train_counts, train_ids.count()), BIAS + 1))
    rows = packed_rows(packed_weights(counts, vocab, "term", "n_w"), C.long_labels(posts), split, vocab)
    terms = [None, *(r["term"] for r in vocab.orderBy("term_index").collect())]
    weights, history = fit_heads(rows, len(terms), epochs, patience, rate)
    table = spark.createDataFrame(
        list(zip(terms, *(weights[d] for d in HEADS))), "term string, " + ", ".join(f"w_{d} double" for d in HEADS))
    log = spark.createDataFrame(history, "epoch int, dim string, train_loss double, val_loss double, chosen boolean")
    return HeadModel(vocab, table, log, split)


def save_heads(spark: SparkSession, model: HeadModel, path: str | None = None) -> str:
    """S10 sink: the best epoch's weights and the history as Parquet."""
    path = path or new_table_path(spark, "trait-heads")
    for name in ("vocab", "weights", "history", "split"):
        if getattr(model, name) is not None:
            getattr(model, name).write.mode("overwrite").parquet(f"{path}/{name}")
    return path


def load_heads(spark: SparkSession, path: str, with_split: bool = True) -> HeadModel:
    r = spark.read
    return HeadModel(r.parquet(f"{path}/vocab"), r.parquet(f"{path}/weights"), r.parquet(f"{path}/history"),
                     r.parquet(f"{path}/split") if with_split else None)


def head_probs(model: HeadModel, counts: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """(id, p_<head>..., mbti) for every row of ``rows`` from (id, term, cnt), or from
    ``classify.packed_counts``, whose rows are scored where they lie."""
    if "n_w" in counts.columns:
        dot = head_sums(model, packed_weights(counts, model.vocab, "term", "n_w"))
        return _probs(model, rows.select(id_col).join(dot, id_col, "left"), [id_col])
    x = C.tfidf_weights(counts, model.vocab, id_col)
    terms_b, _ = bounded_broadcast(model.weights.where(F.col("term").isNotNull()), TFIDF_MAX_FEATURES)
    dot = x.join(terms_b, "term").groupBy(id_col).agg(
        *[F.sum(F.col("x") * F.col(f"w_{d}")).alias(f"z_{d}") for d in HEADS])
    wide = rows.select(id_col).join(dot, id_col, "left")
    return _probs(model, wide, [id_col])


def _probs(model: HeadModel, sums: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., p_<head>..., mbti) from the sums z_<head> (null: none) and the bias."""
    bias = model.weights.where(F.col("term").isNull()).first()
    p = {d: F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.coalesce(f"z_{d}", F.lit(0.0)) + F.lit(bias[f"w_{d}"])))) for d in HEADS}
    wide = sums.select(*keep, *[p[d].alias(f"p_{d}") for d in HEADS])
    return wide.withColumn("mbti", C.letters({d: F.col(f"p_{d}") for d in HEADS}))


def head_sums(model: HeadModel, packed: DataFrame) -> DataFrame:
    """Packed rows (..., idx, val) with z_<head> in place of idx and val."""
    held = {r["term"]: r for r in model.weights.collect()}          # vocabulary + 1 rows
    terms = [r["term"] for r in model.vocab.orderBy("term_index").collect()]
    z = {d: sparse_dot([0.0] * BIAS + [held[t][f"w_{d}"] for t in terms]) for d in HEADS}
    return packed.select(*[c for c in packed.columns if c not in ("idx", "val")], *[z[d].alias(f"z_{d}") for d in HEADS])


def head_rows(model: HeadModel, packed: DataFrame) -> DataFrame:
    """Packed rows (..., idx, val) with p_<head> and mbti in place of idx and val."""
    return _probs(model, head_sums(model, packed), [c for c in packed.columns if c not in ("idx", "val")])


def head_predictions(model: HeadModel, posts: DataFrame) -> DataFrame:
    """(row_id, dim, p1) for ``classify.split_metrics``."""
    texts = posts.select("row_id", normalize_classifier("posts", True).alias("text"))
    probs = head_probs(model, C.packed_counts(texts, "row_id", "text"), posts, "row_id")
    return probs.select("row_id", F.explode(F.create_map(*[
        c for d in HEADS for c in (F.lit(d), F.col(f"p_{d}"))])).alias("dim", "p1"))
