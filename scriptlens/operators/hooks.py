"""User model hooks (M9 scorer, M17 embedder) as Arrow batch functions.

No model is shipped. A user passes a ``make_predict_fn`` returning a function
from a numpy batch of strings to a numpy array (probabilities per axis for a
scorer, a vector per text for an embedder); Spark calls it on Arrow batches of
``batch_size`` rows in every task, loading the model once per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from ..functions.wordlists import DIMENSIONS


def scorer_udf(make_predict_fn: Callable, batch_size: int = 16):
    """M9: text -> ARRAY<DOUBLE> (P(label 1) per axis, in EI, SN, TF, JP order)."""
    from pyspark.ml.functions import predict_batch_udf

    return predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()),
                             batch_size=batch_size, input_tensor_shapes=None)


def embedder_udf(make_predict_fn: Callable, batch_size: int = 64):
    """Text -> ARRAY<FLOAT> embedding."""
    from pyspark.ml.functions import predict_batch_udf

    return predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()),
                             batch_size=batch_size)


def scores_to_columns(df: DataFrame, probs: Column) -> DataFrame:
    """Wide per-axis probabilities from a scorer's array output."""
    return df.withColumns({f"p_{d}": probs.getItem(i) for i, (d, _, _) in enumerate(DIMENSIONS)})
