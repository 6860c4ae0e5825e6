"""Line embeddings by a distributed low-rank factorisation.

The TF-IDF rows of all lines are a sparse matrix X (lines x vocabulary, at most 1500
terms). A random projection of the vocabulary is improved by subspace iterations:
one pass computes X'(XQ) as sums per term with partial aggregation, so a task sends
at most vocabulary x axes numbers and no line meets another. The driver
orthonormalises a vocabulary x axes matrix. A last pass gives the projected matrix
whose eigenvectors turn the basis to the leading singular directions; the sign of an
axis is set so that its largest component is positive. A line's vector is its row
times the axes.

The same axes embed requests, so a line and a sentence are compared in one space.
Lines without a vocabulary word have no vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_classifier
from ..session import materialize, new_table_path
from . import classify as C
from .sparse import packed_terms, sparse_dot

AXES = 16
OVERSAMPLE = 8          # further directions carried through the iterations
ITERATIONS = 5
SEED = 17


@dataclass
class TextEmbedding:
    vocab: DataFrame            # term, idf, term_index (from 1), axes (its row of the basis)
    basis: np.ndarray           # vocabulary x axes
    singular_values: np.ndarray


def gram_product(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """X'(Xq) of the packed rows in one pass."""
    k = q.shape[1]
    projected = rows.select("idx", "val", *[sparse_dot(q[:, j]).alias(f"y{j}") for j in range(k)])
    sums = (projected.select(F.explode(F.arrays_zip("idx", "val")).alias("t"), *[f"y{j}" for j in range(k)])
            .groupBy(F.col("t.idx").alias("i"))
            .agg(*[F.sum(F.col("t.val") * F.col(f"y{j}")).alias(f"s{j}") for j in range(k)]))
    out = np.zeros_like(q)
    for r in sums.collect():            # one row per vocabulary term
        out[r["i"] - 1] = [r[f"s{j}"] for j in range(k)]
    return out


def leading_axes(rows: DataFrame, n_terms: int, axes: int = AXES, iterations: int = ITERATIONS,
                 oversample: int = OVERSAMPLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Basis (terms x axes) of the leading right singular vectors of the packed
    rows, and the singular values; fewer axes if the vocabulary is smaller."""
    width = min(n_terms, axes + oversample)
    if not width:
        return np.zeros((0, 0)), np.zeros(0)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_terms, width)))
    for _ in range(iterations):
        q, _ = np.linalg.qr(gram_product(rows, q))
    small = q.T @ gram_product(rows, q)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:axes]
    basis = q @ turn[:, order]
    basis *= np.where(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])] < 0, -1.0, 1.0)
    return basis, np.sqrt(np.maximum(values[order], 0.0))


def line_terms(lines: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return C.term_counts(lines.select(id_col, normalize_classifier(text_col).alias("clean")), id_col, "clean")


def fit_embedding(lines: DataFrame, id_col: str = "line_id", text_col: str = "dialogue", axes: int = AXES,
                  iterations: int = ITERATIONS) -> tuple[TextEmbedding, DataFrame]:
    """The embedding of a line table and its packed rows (written once)."""
    spark = lines.sparkSession
    counts = materialize(line_terms(lines, id_col, text_col))
    vocab = materialize(C.fit_tfidf(counts, lines.count()).withColumn(
        "term_index", F.row_number().over(Window.orderBy("term")).cast("int")))
    path = new_table_path(spark, "packed-lines")
    packed_terms(C.tfidf_weights(counts, vocab, id_col), vocab, id_col).write.parquet(path)
    rows = spark.read.parquet(path)
    terms = vocab.orderBy("term_index").collect()
    basis, values = leading_axes(rows, len(terms), axes, iterations)
    table = spark.createDataFrame(
        [(r["term"], r["idf"], r["term_index"], basis[r["term_index"] - 1].tolist()) for r in terms],
        "term string, idf double, term_index int, axes array<double>")
    return TextEmbedding(table, basis, values), rows


def vector_of(model: TextEmbedding) -> Column:
    """Embedding of a packed row."""
    return F.array(*[sparse_dot(model.basis[:, j]) for j in range(model.basis.shape[1])])


def embed_lines(lines: DataFrame, model: TextEmbedding, rows: DataFrame, id_col: str = "line_id") -> DataFrame:
    """The lines that have a vocabulary word, with ``embedding``."""
    return lines.join(rows.select(id_col, vector_of(model).alias("embedding")), id_col)


def embed_texts(texts: DataFrame, model: TextEmbedding, id_col: str, text_col: str) -> DataFrame:
    """(id, embedding) of further texts, such as requests."""
    features = C.tfidf_weights(line_terms(texts, id_col, text_col), model.vocab, id_col)
    packed = packed_terms(features, model.vocab, id_col)
    return packed.select(id_col, vector_of(model).alias("embedding"))


def save_embedding(spark: SparkSession, model: TextEmbedding, path: str | None = None) -> str:
    path = path or new_table_path(spark, "embedding")
    model.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    spark.createDataFrame([(k, float(v)) for k, v in enumerate(model.singular_values)], "axis int, value double") \
        .write.mode("overwrite").parquet(f"{path}/values")
    return path


def load_embedding(spark: SparkSession, path: str) -> TextEmbedding:
    vocab = spark.read.parquet(f"{path}/vocab")
    rows = vocab.orderBy("term_index").select("axes").collect()
    values = spark.read.parquet(f"{path}/values").orderBy("axis").collect()
    return TextEmbedding(vocab, np.array([r["axes"] for r in rows]), np.array([r["value"] for r in values]))
