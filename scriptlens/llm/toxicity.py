"""Op 9, toxicity: counterfactual-regularised linear classifier.

Features of a text are the presence of its lower-cased words, their prefixes of
4 to 6 letters (inflected forms share a stem) and the text's log length. A
logistic model is trained in numpy on a bounded, hash-chosen sample of labelled
documents. Sentences of those documents that name a group are paired with the same
sentence naming another one; the squared change of the whole sentence's score over
these swaps is part of the loss, so a neutral mention of a group cannot carry
weight of its own.

Groups are the fixed lists below, in four languages, and groups found in the sample:
words that occur at like rates in toxic and other documents and whose neighbouring
words agree (cosine of the counts of frequent words beside them), paired when each
is the other's nearest. The pairs are made in Spark from grouped counts.

Bounds of the fitted sample and model, all parameters: ``TRAIN_ROWS`` labelled
documents, ``SWAPS`` swapped sentences (both of least hash), ``TERM_CANDIDATES`` words
compared for groups, and features that occur in ``MIN_DOCS`` sample documents and
differ between the classes by a z statistic over ``MIN_Z``, the ``MAX_FEATURES`` of
greatest z among them (a group term's features always belong). Scoring reads whole
texts of all documents.

Defined results: null or empty text is scored as the empty feature set;
repeated rows get equal scores; without labelled rows (or with one class only)
every score is the smoothed base rate; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptlens.llm.common import add_columns, stored

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
PREFIXES = (4, 5, 6)
TRAIN_ROWS = 16_000         # bound of the labelled sample the model is fitted on
MAX_FEATURES = 6_000
MIN_DOCS = 5
MIN_Z = 2.0
SWAPS = 20_000              # bound of the swapped sentences
TERM_CANDIDATES = 300       # words compared for groups of the sample's own
TERM_CONTEXTS = 200         # frequent words that describe a candidate's neighbourhood
TERM_LIKENESS = 0.5
NEUTRAL_Z = 1.0
L2 = 2e-3
COUNTERFACTUAL = 1.0
EPOCHS = 250
CACHE_WORDS = 400_000       # memory bound of a task's word cache

# fixed values: terms that may replace one another in a counterfactual sentence,
# in English, German, French and Spanish
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys", "people"),
    ("woman", "man", "girl", "boy", "person"),
    ("black", "white", "asian", "latino", "local"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "religious"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "believers"),
    ("gay", "lesbian", "straight", "transgender", "young"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "blind", "deaf", "elderly", "adult"),
    ("frauen", "männer", "mädchen", "jungen", "menschen"),
    ("frau", "mann", "mensch"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "gläubige"),
    ("ausländer", "flüchtlinge", "einwanderer", "einheimische", "bürger"),
    ("femmes", "hommes", "filles", "garçons", "gens"),
    ("femme", "homme", "personne"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "croyants"),
    ("étrangers", "réfugiés", "immigrés", "habitants", "citoyens"),
    ("mujeres", "hombres", "niñas", "niños", "personas"),
    ("mujer", "hombre", "persona"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "creyentes"),
    ("extranjeros", "refugiados", "inmigrantes", "vecinos", "ciudadanos"),
)


def feature_ids(word: str) -> tuple[int, ...]:
    """The word itself and its prefixes, as 32-bit hashes."""
    ids = [zlib.crc32(word.encode("utf-8", "replace"))]
    ids += [zlib.crc32(b"^" + word[:k].encode("utf-8", "replace")) for k in PREFIXES if len(word) >= k]
    return tuple(ids)


class WordFeatures:
    """Cached features of words; with ``keep`` only the kept ones."""

    def __init__(self, keep: dict[int, int] | None = None):
        self.keep, self.cache = keep, {}

    def __call__(self, words: set[str]) -> set[int]:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        found: set[int] = set()
        cache, keep = self.cache, self.keep
        for w in words:
            ids = cache.get(w)
            if ids is None:
                ids = feature_ids(w)
                if keep is not None:
                    ids = tuple(keep[i] for i in ids if i in keep)
                cache[w] = ids
            if ids:
                found.update(ids)
        return found


def log_length(n_words: int) -> float:
    return float(np.log1p(n_words)) / 10.0


def sample_table(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str,
                 label_col: str, max_rows: int) -> DataFrame:
    """Label, text, feature ids and length of the ``max_rows`` usable labelled ids of
    smallest hash."""
    chosen = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & usable)
              .groupBy(id_col).agg(F.max(label_col).alias("label"))
              .orderBy(F.xxhash64(F.lit(1), F.col(id_col)), id_col).limit(max_rows))
    sample = (docs.select(id_col, F.col(text_col).alias("body"))
              .join(F.broadcast(chosen), id_col).select("body", "label"))     # bounded by max_rows

    def make():
        features = WordFeatures()

        def run(texts: list) -> list:
            out: tuple[list, list] = ([], [])
            for body in texts:
                words = WORD.findall((body or "").lower())
                out[0].append(sorted(features(set(words))))
                out[1].append(log_length(len(words)))
            return list(out)

        return run

    return stored(add_columns(sample, "body", make, [
        ("ids", "array<bigint>", pa.list_(pa.int64())), ("length", "double", pa.float64())]), "toxicity-sample")


def class_z(pos: Column, n: Column, n_pos: int, n_neg: int) -> Column:
    """z statistic of the difference between the classes' rates."""
    p1, p0, rate = pos / n_pos, (n - pos) / n_neg, n / (n_pos + n_neg)
    return F.abs(p1 - p0) / F.sqrt(rate * (1 - rate) * (1 / n_pos + 1 / n_neg) + 1e-9)


def telling_features(table: DataFrame, n_pos: int, n_neg: int, max_features: int, terms: set[str]) -> list[int]:
    """Features of the greatest z statistic between the classes' rates, counted
    in Spark; the terms' own always belong to them."""
    top = (table.select("label", F.explode("ids").alias("id")).groupBy("id")
           .agg(F.count("*").alias("n"), F.sum("label").alias("pos")).where(F.col("n") >= MIN_DOCS)
           .withColumn("z", class_z(F.col("pos"), F.col("n"), n_pos, n_neg)).where(F.col("z") > MIN_Z)
           .orderBy(F.desc("z"), "id").limit(max_features).toArrow())
    return sorted(set(top.column("id").to_pylist()) | {i for t in terms for i in feature_ids(t)})


def corpus_groups(table: DataFrame, n_pos: int, n_neg: int, candidates: int = TERM_CANDIDATES,
                  contexts: int = TERM_CONTEXTS, likeness: float = TERM_LIKENESS) -> list[tuple[str, str]]:
    """Pairs of words of the sample that stand in for one another: both occur in
    both classes at like rates, and each one's neighbours are the nearest to the
    other's."""
    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                # (word, neighbour) -> times, (word, nothing) -> documents, toxic ones
                times: Counter = Counter()
                docs: Counter = Counter()
                toxic: Counter = Counter()
                for body, label in zip(part.column("body").to_pylist(), part.column("label").to_pylist()):
                    low = (body or "").lower()
                    own = set(WORD.findall(low))
                    docs.update(own)
                    if label:
                        toxic.update(own)
                    for sentence in SENTENCE.split(low):
                        found = WORD.findall(sentence)
                        times.update(zip(found[1:], ["<" + w for w in found]))
                        times.update(zip(found, [">" + w for w in found[1:]]))
                word = [w for w, _ in times] + list(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word, pa.string()), pa.array([c for _, c in times] + [None] * len(docs), pa.string()),
                     pa.array([*times.values(), *docs.values()], pa.int64()),
                     pa.array([0] * len(times) + [toxic[w] for w in docs], pa.int64())],
                    names=["word", "beside", "n", "pos"])

    pairs = stored(table.select("body", "label").mapInArrow(neighbours, "word string, beside string, n long, pos long")
                   .groupBy("word", "beside").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")), "toxicity-neighbours")
    neutral = pairs.where(F.col("beside").isNull() & (F.col("pos") >= MIN_DOCS) & (F.col("n") - F.col("pos") >= MIN_DOCS)
                          & (class_z(F.col("pos"), F.col("n"), n_pos, n_neg) < NEUTRAL_Z)
                          & (F.char_length("word") > 3))
    words = [r["word"] for r in neutral.orderBy(F.desc("n"), "word").limit(candidates).collect()]
    common = [r["beside"] for r in pairs.where("beside is not null").groupBy("beside").agg(F.sum("n").alias("n"))
              .orderBy(F.desc("n"), "beside").limit(contexts).collect()]
    counts = (pairs.where(F.col("word").isin(words) & F.col("beside").isin(common))
              .select("word", "beside", "n").collect()) if words else []      # candidates x contexts at most
    row, column = {w: k for k, w in enumerate(words)}, {c: k for k, c in enumerate(common)}
    grid = np.zeros((len(words), len(common)))
    for r in counts:
        grid[row[r["word"]], column[r["beside"]]] = r["n"]
    grid /= np.maximum(np.sqrt((grid ** 2).sum(axis=1, keepdims=True)), 1e-12)
    like = grid @ grid.T
    np.fill_diagonal(like, -1)
    nearest = like.argmax(axis=1) if len(words) > 1 else np.zeros(0, dtype=np.int64)
    return [(words[a], words[b]) for a, b in enumerate(nearest.tolist())
            if a < b and nearest[b] == a and like[a, b] >= likeness]


def swap_table(table: DataFrame, others: dict[str, tuple[str, ...]], max_swaps: int) -> list[tuple[list, list]]:
    """(features lost, features gained) of sentences with a group term replaced by
    each of its others; whole sentences are compared, at most ``max_swaps`` kept."""
    shared = table.sparkSession.sparkContext.broadcast(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, stand_ins = WordFeatures(), shared.value
        held: list[tuple[int, str, str, str]] = []
        most = 1 << 32
        for batch in batches:
            for body in batch.column("body").to_pylist():
                for sentence in SENTENCE.split((body or "").lower()):
                    for term in sorted(stand_ins.keys() & set(WORD.findall(sentence))):
                        for other in stand_ins[term]:
                            place = zlib.crc32(f"{term}>{other}:{sentence}".encode("utf-8", "replace"))
                            if place <= most:
                                held.append((place, term, other, sentence))
                if len(held) > 2 * max_swaps:       # the task's own least are enough
                    held = sorted(held)[:max_swaps]
                    most = held[-1][0]
        held = sorted(held)[:max_swaps]
        for lo in range(0, len(held), 1000):
            lost, gained = [], []
            for _, term, other, sentence in held[lo:lo + 1000]:
                words = set(WORD.findall(sentence))
                before, after = features(words), features(words - {term} | {other})
                lost.append(sorted(before - after))
                gained.append(sorted(after - before))
            yield pa.RecordBatch.from_arrays(
                [pa.array(lost, pa.list_(pa.int64())), pa.array(gained, pa.list_(pa.int64())),
                 pa.array([h[0] for h in held[lo:lo + 1000]], pa.int64())], names=["lost", "gained", "place"])

    found = table.select("body").mapInArrow(run, "lost array<bigint>, gained array<bigint>, place bigint")
    rows = found.orderBy("place", "lost", "gained").limit(max_swaps).collect()
    return [(r["lost"], r["gained"]) for r in rows]


def loss_gradient(w: np.ndarray, wl: float, bias: float, y: np.ndarray, length: np.ndarray, rows_in: np.ndarray,
                  cols_in: np.ndarray, swaps: tuple[np.ndarray, np.ndarray, np.ndarray, int], l2: float,
                  counterfactual: float) -> tuple[float, np.ndarray]:
    """Loss and its gradient for (w, wl, bias): mean log loss, half the squared
    weights, and the mean squared score change of the swaps, given as (swap,
    feature, +1 or -1) entries and their number."""
    s = np.bincount(rows_in, weights=w[cols_in], minlength=len(y)) + wl * length + bias
    p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
    loss = float(np.mean(np.logaddexp(0, s) - y * s) + l2 / 2 * ((w ** 2).sum() + wl ** 2))
    err = (p - y) / len(y)
    g = np.bincount(cols_in, weights=err[rows_in], minlength=len(w)) + l2 * w
    at, feature, sign, n = swaps
    if n:
        change = np.bincount(at, weights=sign * w[feature], minlength=n)
        loss += counterfactual * float((change ** 2).mean())
        g += counterfactual * 2 / n * np.bincount(feature, weights=sign * change[at], minlength=len(w))
    return loss, np.concatenate([g, [(err * length).sum() + l2 * wl, err.sum()]])


def fit(table: DataFrame, max_features: int = MAX_FEATURES, l2: float = L2,
        counterfactual: float = COUNTERFACTUAL, epochs: int = EPOCHS, max_swaps: int = SWAPS) -> dict:
    """Train on a ``sample_table``; returns the model as a plain dictionary."""
    sizes = {r["label"]: r["count"] for r in table.groupBy("label").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    base = (n_pos + 1.0) / (n_pos + n_neg + 2.0)
    if not n_pos or not n_neg:
        return {"keep": {}, "w": np.zeros(0), "length": 0.0, "bias": float(np.log(base / (1 - base))), "swaps": 0}
    groups = [*IDENTITY_GROUPS, *corpus_groups(table, n_pos, n_neg)]
    others: dict[str, tuple[str, ...]] = {}
    for group in groups:
        for t in group:
            others[t] = tuple(dict.fromkeys([*others.get(t, ()), *(o for o in group if o != t)]))
    kept = telling_features(table, n_pos, n_neg, max_features, set(others))
    column = {i: k for k, i in enumerate(kept)}

    def pick(texts: list) -> list:
        return [[[column[i] for i in ids if i in column] for ids in texts]]

    rows = add_columns(table, "ids", lambda: pick, [("cols", "array<int>", pa.list_(pa.int32()))],
                       ["label", "length"]).toArrow()
    y = rows.column("label").to_numpy().astype(np.float64)
    length = rows.column("length").to_numpy()
    cols = rows.column("cols").combine_chunks()
    cols_in = cols.flatten().to_numpy()
    rows_in = np.repeat(np.arange(len(y)), cols.value_lengths().to_numpy(zero_copy_only=False))

    found = swap_table(table, others, max_swaps)
    entries = [(k, column[i], sign) for k, (lost, gained) in enumerate(found)
               for sign, ids in ((-1.0, lost), (1.0, gained)) for i in ids if i in column]
    at = np.array(entries, dtype=np.float64).reshape(-1, 3)
    swaps = (at[:, 0].astype(np.int64), at[:, 1].astype(np.int64), at[:, 2], len(found))

    w, bias, wl = np.zeros(len(kept)), float(np.log(base / (1 - base))), 0.0
    m, v = np.zeros(len(kept) + 2), np.zeros(len(kept) + 2)
    for step in range(1, epochs + 1):
        _, grad = loss_gradient(w, wl, bias, y, length, rows_in, cols_in, swaps, l2, counterfactual)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        move = 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, wl, bias = w - move[:-2], wl - move[-2], bias - move[-1]
    s = np.bincount(rows_in, weights=w[cols_in], minlength=len(y)) + wl * length + bias
    return {"keep": column, "w": w, "length": float(wl), "bias": float(bias - best_cut(s, y)), "swaps": len(found)}


def best_cut(s: np.ndarray, y: np.ndarray) -> float:
    """Log-odds at which the training rows split with the best F1, in the middle
    of the widest gap that has it; the bias moves there, so 0.5 is that cut."""
    order = np.argsort(-s, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    gap = s[order] - np.append(s[order][1:], s.min() - 1)
    open_cuts = np.flatnonzero(gap > 0)
    best = open_cuts[f1[open_cuts] >= f1[open_cuts].max() - 1e-12]
    k = best[gap[best].argmax()]
    return float(s[order][k] - gap[k] / 2)


def score_text(text: str | None, model: dict, features: WordFeatures) -> float:
    words = WORD.findall((text or "").lower())
    s = model["bias"] + model["length"] * log_length(len(words))
    s += sum(model["w"][i] for i in sorted(features(set(words))))
    return float(1 / (1 + np.exp(-np.clip(s, -30, 30))))


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``toxic_score`` added; whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        features = WordFeatures(shared.value["keep"])
        return lambda texts: [[score_text(t, shared.value, features) for t in texts]]

    return add_columns(docs, text_col, make, [("toxic_score", "double", pa.float64())])


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic", max_rows: int = TRAIN_ROWS) -> dict:
    return fit(sample_table(docs, labels, usable, id_col, text_col, label_col, max_rows))
