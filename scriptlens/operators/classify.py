"""Trait classification on four binary axes.

All of it is relational: the TF-IDF vocabulary is capped (1500 terms by
default), so every model table is bounded by ``4 axes x folds x 2 classes x
vocabulary`` rows and is broadcast with a proven bound. Row-level work (token
counts, scores) is grouped per row or per (row, axis), never per class, so a
class holding most rows does not land in one task. Ranks inside a class
(split, folds) are computed from bucket counts plus a row number inside a
bucket (``ordered_rank``), not from a window over the whole class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import vectorizer_tokens
from ..functions.wordlists import CV_FOLDS, DIMENSIONS, NB_ALPHA, TFIDF_MAX_FEATURES
from ..session import bounded_broadcast, checked_broadcast, materialize, new_table_path
from .counted import counted_terms, split_parts, unpacked
from .sparse import sparse_dot

DIM_NAMES = [d for d, _, _ in DIMENSIONS]
RANK_BUCKETS = 4096


# ---------------------------------------------------------------------------
# Labels (T33) and long form
# ---------------------------------------------------------------------------
def label_columns(df: DataFrame, type_col: str = "type") -> DataFrame:
    """EI, SN, TF, JP as 1 / 0 (null for any other letter)."""
    up = F.upper(F.col(type_col).cast("string"))
    cols = {}
    for i, (dim, pos, neg) in enumerate(DIMENSIONS):
        ch = F.substring(up, i + 1, 1)
        cols[dim] = F.when(ch == pos, 1).when(ch == neg, 0).cast("int")
    return df.withColumns(cols)


def long_labels(df: DataFrame, id_col: str = "row_id", type_col: str = "type") -> DataFrame:
    """(row_id, dim, label) for every axis with a known letter."""
    lab = label_columns(df.select(id_col, type_col), type_col)
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("label")) for d in DIM_NAMES])
    return (
        lab.select(id_col, F.explode(pairs).alias("p"))
        .select(id_col, F.col("p.dim").alias("dim"), F.col("p.label").alias("label"))
        .where(F.col("label").isNotNull())
    )


# ---------------------------------------------------------------------------
# Exact ranks inside large groups
# ---------------------------------------------------------------------------
def ordered_rank(df: DataFrame, group_cols: list[str], order_cols: list, bucket: Column,
                 rank_col: str = "rank0", size_col: str = "group_size",
                 n_buckets: int = RANK_BUCKETS, n_groups_bound: int | None = None) -> DataFrame:
    """0-based rank of each row inside its group by ``order_cols``.

    ``bucket`` must be non-decreasing in the order (a prefix of a hash, a range
    of an id). Rows are counted per (group, bucket) with partial aggregation;
    a running sum over that small table gives each bucket's offset; the rank
    is the offset plus a row number inside (group, bucket). A whole group is
    never sorted in one task.
    """
    d = df.withColumn("_bucket", bucket)
    counts = d.groupBy(*group_cols, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group_cols).orderBy("_bucket")
    offsets = counts.select(
        *group_cols, "_bucket",
        (F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*group_cols)).alias(size_col),
    )
    if n_groups_bound is not None:
        offsets_side, _ = bounded_broadcast(offsets, n_groups_bound * n_buckets)
    else:
        # groups x buckets rows: written once, then counted cheaply
        offsets_side, _ = checked_broadcast(materialize(offsets))
    inner = Window.partitionBy(*group_cols, "_bucket").orderBy(*order_cols)
    return (
        d.join(offsets_side, [*group_cols, "_bucket"])
        .withColumn(rank_col, (F.col("_before") + F.row_number().over(inner) - 1).cast("bigint"))
        .drop("_bucket", "_before")
    )


def hash_key(seed: int, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(id_col).cast("string")))


def _round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("bigint")


def stratified_split(df: DataFrame, id_col: str = "row_id", strat_col: str = "type", seed: int = 42,
                     test_frac: float = 0.2, val_frac: float = 0.125) -> DataFrame:
    """Deterministic stratified train / val / test labels.

    Per stratum of ``n`` rows ordered by ``md5(seed:id)``: the first
    ``round(test_frac n)`` rows are test, the next ``round(val_frac (n - n_test))``
    validation, the rest train (half rounded up).
    """
    h = hash_key(seed, id_col)
    # hash prefixes of as many digits as keep a bucket at about RANK_BUCKETS rows
    digits, n_rows = 3, df.count()
    while 16 ** digits * RANK_BUCKETS < n_rows:
        digits += 1
    ranked = ordered_rank(
        df.withColumn("_h", h), [strat_col], ["_h", id_col],
        F.conv(F.substring("_h", 1, digits), 16, 10).cast("bigint"),
    )
    n = F.col("group_size")
    n_test = _round_half_up(n * F.lit(test_frac))
    n_val = _round_half_up((n - n_test) * F.lit(val_frac))
    r = F.col("rank0")
    split = F.when(r < n_test, "test").when(r < n_test + n_val, "val").otherwise("train")
    return ranked.withColumn("split", split).drop("_h", "rank0", "group_size")


def _below(x: Column, i: int) -> Column:
    """Number of integers j in [0, x) with j % folds == i (for folds = CV_FOLDS)."""
    return F.greatest(F.lit(0), F.floor((x - F.lit(i) + F.lit(CV_FOLDS - 1)) / F.lit(CV_FOLDS))).cast("bigint")


def stratified_folds(labels: DataFrame, id_col: str = "row_id", folds: int = CV_FOLDS) -> DataFrame:
    """Unshuffled stratified k-fold ids per axis (rows in data order = ``id_col``).

    Classes are numbered by first appearance; the sorted encoded labels are
    dealt round-robin to folds, which fixes how many rows of each class a fold
    gets; rows of a class then fill folds 0, 1, ... in contiguous blocks.
    """
    assert folds == CV_FOLDS
    # buckets are the ranges of a range partitioning, so they follow the ids
    # wherever those cluster; written once, since both the counts and the rows
    # must see the same ranges
    ranged = materialize(labels.repartitionByRange("dim", "label", id_col)
                         .withColumn("_range", F.spark_partition_id()))
    ranked = ordered_rank(ranged, ["dim", "label"], [id_col], F.col("_range"), "rank0", "class_size").drop("_range")
    # class order by first appearance, per axis (2 rows per axis: bounded)
    first = labels.groupBy("dim", "label").agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("_n"))
    wd = Window.partitionBy("dim").orderBy("_first")
    starts = first.select(
        "dim", "label",
        (F.sum("_n").over(wd.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_start"),
    )
    starts_b, _ = bounded_broadcast(starts, 2 * len(DIM_NAMES))
    r = ranked.join(starts_b, ["dim", "label"])
    s = F.col("_start")
    e = s + F.col("class_size")
    fold = F.lit(folds - 1)
    cum = None
    bounds = []
    for i in range(folds):
        a_i = _below(e, i) - _below(s, i)
        cum = a_i if cum is None else cum + a_i
        bounds.append(cum)
    for i in reversed(range(folds - 1)):
        fold = F.when(F.col("rank0") < bounds[i], F.lit(i)).otherwise(fold)
    return r.select(id_col, "dim", "label", fold.cast("int").alias("fold"))


# ---------------------------------------------------------------------------
# TF-IDF (M4)
# ---------------------------------------------------------------------------
def term_counts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, cnt) for the vectoriser tokens of each text."""
    return (
        texts.select(id_col, F.explode(vectorizer_tokens(F.col(text_col))).alias("term"))
        .groupBy(id_col, "term")
        .agg(F.count(F.lit(1)).cast("bigint").alias("cnt"))
    )


def packed_counts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``term_counts`` as (id, term array, n_term array), a row per id, written
    once. Texts are counted where they lie; only ids whose texts were counted in several
    places are grouped by term. Null ids are left out."""
    spark, path = texts.sparkSession, new_table_path(texts.sparkSession, "counts")
    tokens = texts.where(F.col(id_col).isNotNull()).select(id_col, vectorizer_tokens(F.col(text_col)).alias("term"))
    counted_terms(tokens.withColumnRenamed("term", "w"), [id_col], ["w"]).drop("len_w").write.parquet(f"{path}/parts")
    parts = spark.read.parquet(f"{path}/parts")
    several = materialize(parts.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    if several.isEmpty():
        return parts
    single, summed = split_parts(parts, several, [id_col], ["w"])
    entries = summed.groupBy(id_col).agg(F.collect_list(F.struct("term", "n_w")).alias("e"))
    single.unionByName(entries.select(id_col, F.col("e.term").alias("term"), F.col("e.n_w").alias("n_w"))) \
        .write.parquet(f"{path}/whole")
    return spark.read.parquet(f"{path}/whole")


def unpacked_counts(packed: DataFrame, id_col: str) -> DataFrame:
    """(id, term, cnt) of packed counts."""
    return unpacked(packed, [id_col], ["w"]).withColumnRenamed("n_w", "cnt")


def numbered(vocab: DataFrame, first: int = 1) -> DataFrame:
    """The vocabulary with ``term_index`` in the order of its terms (an unpartitioned
    window over the bounded vocabulary)."""
    return vocab.withColumn("term_index", (F.row_number().over(Window.orderBy("term")) + F.lit(first - 1)).cast("int"))


def fit_tfidf(counts: DataFrame, n_docs: Column | int, max_features: int = TFIDF_MAX_FEATURES) -> DataFrame:
    """Vocabulary of the ``max_features`` most frequent terms (ties by term) and
    smoothed idf ln((1 + n) / (1 + df)) + 1. Returns (term, idf, term_index)."""
    stats = counts.groupBy("term").agg(
        F.sum("cnt").alias("cf"), F.count(F.lit(1)).alias("df")
    )
    top = stats.orderBy(F.col("cf").desc(), "term").limit(max_features)
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return top.select(
        "term",
        (F.log((F.lit(1) + n) / (F.lit(1) + F.col("df"))) + F.lit(1.0)).alias("idf"),
    )


def tfidf_weights(counts: DataFrame, vocab: DataFrame, id_col: str,
                  max_features: int = TFIDF_MAX_FEATURES) -> DataFrame:
    """(id, term, x): count x idf, L2-normalised per text. The per-text window
    holds at most ``max_features`` rows (vocabulary bound)."""
    vocab_b, _ = bounded_broadcast(vocab.select("term", "idf"), max_features)
    raw = counts.join(vocab_b, "term").select(id_col, "term", (F.col("cnt") * F.col("idf")).alias("_x"))
    norm = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "term", (F.col("_x") / norm).alias("x"))


# ---------------------------------------------------------------------------
# Multinomial naive Bayes (M5, A18) and scoring (M9)
# ---------------------------------------------------------------------------
def _class_grid(model_values: dict[str, list[int]] | None = None) -> Column:
    """Literal array of every (model keys..., dim, label) combination."""
    combos = [{}]
    for col, values in (model_values or {}).items():
        combos = [{**c, col: v} for c in combos for v in values]
    items = []
    for c in combos:
        for d in DIM_NAMES:
            for label in (0, 1):
                fields = [F.lit(v).alias(k) for k, v in c.items()]
                items.append(F.struct(*fields, F.lit(d).alias("dim"), F.lit(label).alias("label")))
    return F.array(*items)


def _with_classes(df: DataFrame, keep: list[str], model_values: dict[str, list[int]] | None) -> DataFrame:
    """Each row repeated for every class combination (a generator, no join)."""
    mc = list((model_values or {}).keys())
    g = df.select(*keep, F.explode(_class_grid(model_values)).alias("_c"))
    return g.select(*keep, *[F.col(f"_c.{k}").alias(k) for k in mc],
                    F.col("_c.dim").alias("dim"), F.col("_c.label").alias("label"))


def fit_nb(features: DataFrame, labels: DataFrame, vocab: DataFrame, id_col: str = "row_id",
           model_values: dict[str, list[int]] | None = None,
           alpha: float = NB_ALPHA) -> tuple[DataFrame, DataFrame]:
    """Multinomial NB per axis (and per extra model key, e.g. ``model_fold``).

    ``labels``: (id, dim, label, *model keys) training rows. Returns
    ``(log_prob, log_prior)``: (model..., dim, label, term, logp) over the full
    vocabulary for every class present in training, and (model..., dim,
    label, prior). Priors are not smoothed; likelihoods are
    ln((sum x + alpha) / (sum all + alpha V)). ``features``: (id, term, x), or packed
    rows (id, idx, val) of a numbered vocabulary, which join the labels whole.
    """
    mc = list((model_values or {}).keys())
    keys = [*mc, "dim", "label"]
    counts = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_c"))
    w_model = Window.partitionBy(*mc, "dim")
    priors = counts.select(*keys, F.log(F.col("n_c") / F.sum("n_c").over(w_model)).alias("prior"))
    if "idx" in features.columns:
        entries = features.join(labels, id_col).select(*keys, F.explode(F.arrays_zip("idx", "val")).alias("e"))
        by_number = entries.groupBy(*keys, F.col("e.idx").alias("term_index")).agg(F.sum("e.val").alias("fs"))
        sums = by_number.join(vocab.select("term", "term_index"), "term_index").drop("term_index")
    else:
        sums = (
            features.join(labels, id_col)
            .groupBy(*keys, "term")
            .agg(F.sum("x").alias("fs"))
        )
    n_classes = len(DIM_NAMES) * 2 * _n_models(model_values)
    present_b, _ = bounded_broadcast(counts.select(*keys), n_classes)
    # every present class x every vocabulary term: bounded by classes x V
    # V: an unpartitioned window over at most max_features rows (no extra job)
    sized = vocab.select("term", F.count(F.lit(1)).over(Window.partitionBy()).alias("v_size"))
    grid = _with_classes(sized, ["term", "v_size"], model_values).join(present_b, keys)
    filled = grid.join(sums, [*keys, "term"], "left").withColumn("fs", F.coalesce("fs", F.lit(0.0)))
    totals = filled.groupBy(*keys).agg(F.sum("fs").alias("tot"))
    logp = filled.join(totals, keys).select(
        *keys, "term",
        (F.log(F.col("fs") + F.lit(alpha)) - F.log(F.col("tot") + F.lit(alpha) * F.col("v_size"))).alias("logp"),
    )
    return logp, priors


def _n_models(model_values: dict[str, list[int]] | None) -> int:
    n = 1
    for values in (model_values or {}).values():
        n *= len(values)
    return n


def nb_joint(features: DataFrame, rows: DataFrame, logp: DataFrame, priors: DataFrame,
             id_col: str = "row_id", model_values: dict[str, list[int]] | None = None,
             max_features: int = TFIDF_MAX_FEATURES) -> DataFrame:
    """Joint log likelihood per (row, model, dim, label) for the classes in ``priors``.

    ``rows``: (id, *model keys) — which model scores which row.
    """
    mc = list((model_values or {}).keys())
    n_classes = len(DIM_NAMES) * 2 * _n_models(model_values)
    logp_b, _ = bounded_broadcast(logp, n_classes * max_features)
    priors_b, _ = bounded_broadcast(priors, n_classes)
    dot = (
        features.join(rows, id_col)
        .join(logp_b, [*mc, "term"])
        .groupBy(id_col, *mc, "dim", "label")
        .agg(F.sum(F.col("x") * F.col("logp")).alias("dot"))
    )
    # rows x classes: the row's own model keys must match the generated ones
    gen = {k: v for k, v in (model_values or {}).items()}
    base = _with_classes(rows.withColumnsRenamed({k: f"_own_{k}" for k in mc}),
                         [id_col, *[f"_own_{k}" for k in mc]], gen)
    for k in mc:
        base = base.where(F.col(k) == F.col(f"_own_{k}")).drop(f"_own_{k}")
    base = base.join(priors_b, [*mc, "dim", "label"])
    return base.join(dot, [id_col, *mc, "dim", "label"], "left").select(
        id_col, *mc, "dim", "label", (F.col("prior") + F.coalesce("dot", F.lit(0.0))).alias("jll")
    )


def nb_predict(jll: DataFrame, id_col: str = "row_id", model_cols: list[str] | None = None) -> DataFrame:
    """Per (row, model, dim): p1 = P(label 1), pred (first class wins ties)."""
    mc = list(model_cols or [])
    g = jll.groupBy(id_col, *mc, "dim").agg(
        F.max(F.when(F.col("label") == 0, F.col("jll"))).alias("j0"),
        F.max(F.when(F.col("label") == 1, F.col("jll"))).alias("j1"),
    )
    p1 = (F.when(F.col("j0").isNull(), F.lit(1.0))
          .when(F.col("j1").isNull(), F.lit(0.0))
          .otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("j0") - F.col("j1")))))
    pred = F.when(F.col("j0").isNull(), 1).when(F.col("j1").isNull(), 0) \
        .when(F.col("j1") > F.col("j0"), 1).otherwise(0)
    return g.select(id_col, *mc, "dim", p1.alias("p1"), pred.cast("int").alias("pred"))


def nb_probs(packed: DataFrame, vocab: DataFrame, logp: DataFrame, priors: DataFrame) -> DataFrame:
    """Packed rows (..., idx, val) with p_<axis> and mbti in place of idx and val: the
    scores of ``nb_joint`` and ``nb_predict`` without a join. The model is bounded by the
    vocabulary and travels as array literals."""
    terms = [r["term"] for r in vocab.orderBy("term_index").collect()]
    weights: dict[tuple, dict] = {}
    for r in logp.collect():            # axes x 2 x vocabulary rows
        weights.setdefault((r["dim"], r["label"]), {})[r["term"]] = r["logp"]
    prior = {(r["dim"], r["label"]): r["prior"] for r in priors.collect()}
    keep = [c for c in packed.columns if c not in ("idx", "val")]
    joint = {k: F.lit(p) + sparse_dot([weights.get(k, {}).get(t, 0.0) for t in terms]) for k, p in prior.items()}
    scored = packed.where(F.lit(bool(prior))).select(*keep, *[j.alias(f"_j_{d}_{y}") for (d, y), j in joint.items()])
    p1 = {}
    for d in DIM_NAMES:
        if (d, 0) in prior and (d, 1) in prior:
            p1[d] = F.lit(1.0) / (F.lit(1.0) + F.exp(F.col(f"_j_{d}_0") - F.col(f"_j_{d}_1")))
        else:                           # one class only, or none
            p1[d] = F.lit(1.0 if (d, 1) in prior else 0.0 if (d, 0) in prior else None).cast("double")
    scored = scored.select(*keep, *[p1[d].alias(f"p_{d}") for d in DIM_NAMES])
    return scored.withColumn("mbti", letters({d: F.col(f"p_{d}") for d in DIM_NAMES}))


def letters(p1_cols: dict[str, Column]) -> Column:
    """Letter per axis (label 1 when p >= 0.5), concatenated."""
    parts = []
    for dim, pos, neg in DIMENSIONS:
        parts.append(F.when(p1_cols[dim] >= 0.5, F.lit(pos)).otherwise(F.lit(neg)))
    return F.concat(*parts)


def wide_probs(pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., p_EI, p_SN, p_TF, p_JP, mbti) from long per-axis predictions."""
    g = pred.groupBy(*keys).agg(*[F.max(F.when(F.col("dim") == d, F.col("p1"))).alias(f"p_{d}") for d in DIM_NAMES])
    return g.withColumn("mbti", letters({d: F.col(f"p_{d}") for d in DIM_NAMES}))


# ---------------------------------------------------------------------------
# Cross-validation (M6, A17) and split evaluation
# ---------------------------------------------------------------------------
def cv_accuracy(features: DataFrame, folds: DataFrame, vocab: DataFrame, id_col: str = "row_id",
                k: int = CV_FOLDS, alpha: float = NB_ALPHA) -> DataFrame:
    """Per axis: accuracy of each of ``k`` folds, their mean and population std.

    One job for all axes and folds: each training row is exploded into the
    fold models it trains (every fold but its own); models are keyed by
    (fold, dim).
    """
    # features and folds feed both the fit and the scoring: compute them once
    features = materialize(features)
    folds = materialize(folds)
    train = folds.select(
        id_col, "dim", "label",
        F.explode(F.filter(F.array(*[F.lit(i) for i in range(k)]), lambda f: f != F.col("fold"))).alias("model_fold"),
    )
    mv = {"model_fold": list(range(k))}
    logp, priors = fit_nb(features, train, vocab, id_col, mv, alpha)
    # a test row is scored by the model of its own fold, on its own axis only
    test = folds.select(id_col, "dim", F.col("label").alias("y"), F.col("fold").alias("model_fold"))
    n_classes = len(DIM_NAMES) * 2 * k
    logp_b, _ = bounded_broadcast(logp, n_classes * TFIDF_MAX_FEATURES)
    priors_b, _ = bounded_broadcast(priors, n_classes)
    dot = (
        features.join(test, id_col)
        .join(logp_b, ["model_fold", "dim", "term"])
        .groupBy(id_col, "model_fold", "dim", "label")
        .agg(F.sum(F.col("x") * F.col("logp")).alias("dot"))
    )
    jll = (
        test.join(priors_b, ["model_fold", "dim"])          # the classes of that model
        .join(dot, [id_col, "model_fold", "dim", "label"], "left")
        .select(id_col, "model_fold", "dim", "y", "label",
                (F.col("prior") + F.coalesce("dot", F.lit(0.0))).alias("jll"))
    )
    pred = nb_predict(jll, id_col, ["model_fold"])
    scored = pred.join(test, [id_col, "model_fold", "dim"]).withColumnRenamed("y", "label")
    per_fold = scored.groupBy("dim", "model_fold").agg(
        F.avg((F.col("pred") == F.col("label")).cast("double")).alias("acc")
    )
    return per_fold.groupBy("dim").agg(
        F.round(F.avg("acc"), 6).alias("accuracy_mean"),
        F.round(F.stddev_pop("acc"), 6).alias("accuracy_std"),
        F.count(F.lit(1)).cast("bigint").alias("n_folds"),
    )


def split_metrics(pred: DataFrame, labels: DataFrame, split: DataFrame, id_col: str = "row_id") -> DataFrame:
    """A15 + A16 per (split, dim): rows, accuracy (p > 0.5), mean binary cross-entropy."""
    eps = 1e-12
    j = pred.join(labels, [id_col, "dim"]).join(split.select(id_col, "split"), id_col)
    p = F.least(F.greatest(F.col("p1"), F.lit(eps)), F.lit(1 - eps))
    y = F.col("label").cast("double")
    bce = -(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))
    return j.groupBy("split", "dim").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.round(F.avg(((F.col("p1") > 0.5).cast("int") == F.col("label")).cast("double")), 6).alias("accuracy"),
        F.round(F.avg(bce), 6).alias("bce_loss"),
    )
