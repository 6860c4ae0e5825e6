"""The most frequent terms without shuffling every term.

Each task keeps a bounded summary of its terms: batches are summed, and whenever the
summary outgrows twice its ``capacity`` the capacity-th largest count is taken off
every term and the terms that reach zero go. A kept count is at most the true one and
falls short of it by at most what the task took off. The merged summaries bound every
term of the corpus: a term's true count lies between its sum and that sum plus all
that was taken off, and a term in no summary has at most the latter.

If the k-th largest lower bound exceeds what was taken off, no missing term can belong
to the top k. The candidates (terms whose upper bound reaches the k-th lower one) are
then counted exactly. Otherwise the counts don't stand out enough, and all terms are
counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.wordlists import TFIDF_MAX_FEATURES
from ..session import checked_broadcast, materialize

CAPACITY = 20_000


@dataclass
class FrequentTerms:
    stats: DataFrame        # term, cf, df: exact, of the candidates or of all terms
    proven: bool            # whether the candidates suffice
    candidates: int | None


def pruned(held: pd.Series, capacity: int) -> tuple[pd.Series, int]:
    """The summary cut to its capacity, and what was taken off every count."""
    if len(held) <= 2 * capacity:
        return held, 0
    off = int(np.partition(held.to_numpy(), -capacity - 1)[-capacity - 1])
    held = held - off
    return held[held > 0], off


def summaries(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(term, low, off): every task's kept terms, and one row with a null term for
    what the task took off."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, off = pd.Series(dtype="int64"), 0
        for pdf in batches:
            more = pdf.groupby("term")["cnt"].sum()
            held = held.add(more, fill_value=0).astype("int64")
            held, cut = pruned(held, capacity)
            off += cut
        yield pd.DataFrame({"term": held.index.astype(object), "low": held.to_numpy(dtype="int64"),
                            "off": np.zeros(len(held), dtype="int64")})
        yield pd.DataFrame({"term": [None], "low": [0], "off": [off]})

    return counts.select("term", F.col("cnt").cast("bigint").alias("cnt")).mapInPandas(run, "term string, low long, off long")


def frequent_terms(counts: DataFrame, k: int = TFIDF_MAX_FEATURES, capacity: int = CAPACITY) -> FrequentTerms:
    """Exact (term, cf, df) of (id, term, cnt) rows for terms that hold the top k."""
    kept = materialize(summaries(counts, capacity))
    off = kept.agg(F.sum("off")).first()[0] or 0
    lows = materialize(kept.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("low").alias("low")))
    top = [r["low"] for r in lows.orderBy(F.desc("low")).limit(k).select("low").collect()]
    # all terms of the corpus were kept, or the k-th is above whatever is missing
    proven = off == 0 or len(top) == k and top[-1] > off
    if not proven:
        return FrequentTerms(exact_stats(counts), False, None)
    candidates = materialize(lows.where(F.col("low") + off >= (top[-1] if len(top) == k else 0)).select("term"))
    side, _ = checked_broadcast(candidates)
    return FrequentTerms(exact_stats(counts.join(side, "term")), True, candidates.count())


def exact_stats(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.sum("cnt").alias("cf"), F.count(F.lit(1)).alias("df"))


def frequent_vocabulary(counts: DataFrame, n_docs: int, max_features: int = TFIDF_MAX_FEATURES,
                        capacity: int = CAPACITY) -> DataFrame:
    """(term, idf): the vocabulary of ``classify.fit_tfidf``."""
    stats = frequent_terms(counts, max_features, capacity).stats
    top = stats.orderBy(F.desc("cf"), "term").limit(max_features)
    return top.select("term", (F.log((F.lit(1) + F.lit(n_docs)) / (F.lit(1) + F.col("df"))) + F.lit(1.0)).alias("idf"))
