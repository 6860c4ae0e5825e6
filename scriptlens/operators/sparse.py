"""Packed sparse rows and dense weights as array literals.

A packed row holds the term numbers and weights of one text (bounded by the
vocabulary). Weights of a model (heads, axes) are numbers of the vocabulary's size,
so they travel as constants of the plan and need no join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions.wordlists import TFIDF_MAX_FEATURES
from ..session import bounded_broadcast


def packed_terms(features: DataFrame, vocab: DataFrame, id_col: str) -> DataFrame:
    """(id, idx, val): the (id, term, x) features of a text as two arrays in the
    order of ``term_index``; texts without a vocabulary term are absent."""
    numbered_b, _ = bounded_broadcast(vocab.select("term", "term_index"), TFIDF_MAX_FEATURES)
    packed = features.join(numbered_b, "term").groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct("term_index", "x"))).alias("entries"))
    return packed.select(id_col, F.transform("entries", lambda e: e["term_index"]).alias("idx"),
                         F.transform("entries", lambda e: e["x"]).alias("val"))


def packed_weights(df: DataFrame, vocab: DataFrame, terms: str, counts: str | None = None) -> DataFrame:
    """The rows of ``df`` with the list ``terms`` (and the list of its ``counts``; without
    one every place counts) replaced by (idx, val): count x idf of the vocabulary
    terms, L2-normalised per row, in the order of ``term_index``. Nothing is shuffled;
    the tasks hold the bounded vocabulary."""
    known = sorted((r["term_index"], r["term"], r["idf"]) for r in vocab.select("term_index", "term", "idf").collect())
    keep = [c for c in df.columns if c not in (terms, counts)]
    schema = StructType([df.schema[c] for c in keep] + [StructField("idx", ArrayType(IntegerType())),
                                                        StructField("val", ArrayType(DoubleType()))])
    listed = [terms] if counts is None else [terms, counts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.array([k[0] for k in known], dtype=np.int64)
        words, idf = pa.array([k[1] for k in known], pa.string()), np.array([k[2] for k in known], dtype=np.float64)
        n = max(1, len(known))
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(terms)), 0).to_numpy(zero_copy_only=False)
            at = pc.fill_null(pc.index_in(batch.column(terms).flatten(), words), -1).to_numpy(zero_copy_only=False)
            times = np.ones(len(at)) if counts is None else batch.column(counts).flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            held = at >= 0
            cells, place = np.unique((row * n + at)[held], return_inverse=True)
            row, at = cells // n, cells % n
            x = np.bincount(place, times[held], len(cells)) * idf[at]
            x /= np.sqrt(np.bincount(row, x * x, batch.num_rows))[row]
            stops = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(stops, pa.array(v)) for v in (numbers[at].astype(np.int32), x)]
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, *lists], names=[*keep, "idx", "val"])

    return df.select(*keep, *listed).mapInArrow(run, schema)


def number_array(values) -> Column:
    """An array literal of doubles (shortest exact decimals, one constant)."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def sparse_dot(weights) -> Column:
    """Dot product of a packed row (idx, val) with dense weights numbered from 1."""
    w = number_array(weights)
    return F.aggregate(F.zip_with("idx", "val", lambda i, v: v * F.element_at(w, i)), F.lit(0.0), lambda a, v: a + v)
