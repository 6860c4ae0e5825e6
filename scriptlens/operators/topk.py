"""Top-k search that reads only the postings blocks that can matter (M2, L1).

``build_impacts`` writes the postings once more in runs sorted by (show, term, impact class):
a class holds postings of like frequency per length, and a block is one class of one
term of one show. A small table keeps what bounds a block: its greatest frequencies and
least lengths.

A search takes two passes. The first reads each term's best block only and gives every
matched document a relevance that is at most its own; the k-th of these per query and
show is the threshold. The second reads a block only if its own bound, the best bounds
of the query's other terms and the greatest title boost together reach the threshold.
A document that belongs to the top k has all its postings in such blocks, so its score
is complete and the result is that of the full search. Where a term has a negative
weight the bounds don't hold, and all blocks of its query are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.query import title_hits
from ..functions.wordlists import BM25_B, BM25_K1, DEFAULT_TITLE_WEIGHT, DEFAULT_TOP_K
from ..session import bounded_broadcast, checked_broadcast, materialize, new_table_path
from .counted import sorted_runs
from .index import DOC_KEYS, CorpusIndex
from .search import QueryBounds, matches_of, query_bounds, query_term_stats, query_terms, top_k

CLASSES_PER_DOUBLING = 2
SLACK = 1e-5                # relevances are rounded to six digits


@dataclass
class ImpactIndex:
    postings: DataFrame     # the index's postings with their block
    blocks: DataFrame       # show_key, term, block, n, greatest tf_body / tf_title, least lengths


def impact_class() -> Column:
    """Grows with the share of the text that the term is."""
    share = (F.col("tf_body") + F.col("tf_title")) / (F.lit(1.0) + F.col("len_body") + F.col("len_title"))
    return F.floor(F.log2(share) * CLASSES_PER_DOUBLING).cast("int")


def build_impacts(spark: SparkSession, index: CorpusIndex, path: str | None = None) -> ImpactIndex:
    path = path or new_table_path(spark, "impacts")
    sorted_runs(index.postings.withColumn("block", impact_class()), ["show_key", "term", "block"]) \
        .write.mode("overwrite").parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    postings.groupBy("show_key", "term", "block").agg(
        F.count(F.lit(1)).alias("n"), F.max("tf_body").alias("tf_body"), F.max("tf_title").alias("tf_title"),
        F.min("len_body").alias("len_body"), F.min("len_title").alias("len_title")) \
        .sortWithinPartitions("show_key", "term").write.mode("overwrite").parquet(f"{path}/blocks")
    return load_impacts(spark, path)


def load_impacts(spark: SparkSession, path: str) -> ImpactIndex:
    return ImpactIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/blocks"))


def term_score(w: int) -> Column:
    """A posting's part of the score; with a block's extremes, its bound."""
    tf = F.col("tf_body") + F.lit(w) * F.col("tf_title")
    dl = F.col("len_body") + F.lit(w) * F.col("len_title")
    norm = F.lit(BM25_K1) * (F.lit(1 - BM25_B) + F.lit(BM25_B) * dl / F.col("avgdl"))
    return F.col("qtf") * F.col("idf") * (tf * F.lit(BM25_K1 + 1) / (tf + norm))


def bounded_blocks(impacts: ImpactIndex, index: CorpusIndex, prepared: DataFrame, w: int,
                   bounds: QueryBounds) -> DataFrame:
    """(query_id, show_key, term, block, n, qtf, idf, avgdl, bound, rank, others, negative):
    ``bound`` of any posting in the block, ``others`` of the query's other terms."""
    stats = query_term_stats(index, prepared, w, bounds)
    # query terms x shows x classes
    joined = impacts.blocks.join(stats, ["show_key", "term"]).withColumn(
        "bound", F.greatest(F.lit(0.0), F.coalesce(term_score(w), F.lit(0.0))))
    by_term = Window.partitionBy("query_id", "show_key", "term")
    ranked = (joined.withColumn("rank", F.row_number().over(by_term.orderBy(F.desc("bound"), "block")))
              .withColumn("best", F.max("bound").over(by_term)))
    sums = ranked.where("rank = 1").groupBy("query_id", "show_key").agg(
        F.sum("best").alias("all_best"), F.max(F.col("idf") < 0).alias("negative"))
    sums = sums.withColumn("negative", F.max("negative").over(Window.partitionBy("query_id")))
    return materialize(ranked.join(sums, ["query_id", "show_key"]).select(
        "query_id", "show_key", "term", "block", "n", "qtf", "idf", "avgdl", "bound", "rank",
        (F.col("all_best") - F.col("best")).alias("others"), "negative"))


def block_scores(impacts: ImpactIndex, blocks: DataFrame, w: int) -> DataFrame:
    """(query_id, document keys, bm25) from the postings of the given blocks."""
    picked, _ = checked_broadcast(blocks.select("query_id", "show_key", "term", "block", "qtf", "idf", "avgdl"))
    rows = impacts.postings
    terms = [r["term"] for r in blocks.select("term").distinct().limit(1_001).collect()]
    if len(terms) <= 1_000:             # the sorted files skip row groups without a query term
        rows = rows.where(F.col("term").isin(terms))
    hits = rows.join(picked, ["show_key", "term", "block"]).where(F.col("tf_body") + F.lit(w) * F.col("tf_title") > 0)
    return hits.groupBy("query_id", *DOC_KEYS).agg(F.sum(term_score(w)).alias("bm25"))


def pruned_matches(index: CorpusIndex, impacts: ImpactIndex, prepared: DataFrame, k: int = DEFAULT_TOP_K,
                   title_weight: float = DEFAULT_TITLE_WEIGHT, per_show: bool = True,
                   bounds: QueryBounds | None = None) -> tuple[DataFrame, DataFrame]:
    """The columns of ``search.ranked_matches``, complete for the top ``k`` per query
    and show (or per query), and the blocks that were read for them."""
    w = max(int(title_weight), 0)
    bounds = bounds or query_bounds(prepared)
    blocks = bounded_blocks(impacts, index, prepared, w, bounds)
    dparts_b, _ = bounded_broadcast(prepared.select("query_id", "dparts"), bounds.queries)
    matched = materialize(matches_of(index, prepared).join(dparts_b, "query_id").select(
        "query_id", *DOC_KEYS, title_hits("episode_title", "dparts").cast("bigint").alias("title_hit_count")))
    boost = F.col("title_hit_count") * F.lit(2.0 * float(title_weight))

    def relevance(scores: DataFrame) -> DataFrame:
        score = F.coalesce("bm25", F.lit(0.0))
        return matched.join(scores, ["query_id", *DOC_KEYS], "left").select(
            "query_id", *DOC_KEYS, F.round(score, 6).alias("bm25_score"), "title_hit_count",
            F.round(score + boost, 6).alias("relevance_score"))

    groups = ["query_id", "show_key"] if per_show else ["query_id"]
    first = relevance(block_scores(impacts, blocks.where("rank = 1"), w))
    least = (top_k(first, groups, [F.desc("relevance_score"), *DOC_KEYS], k).groupBy(*groups)
             .agg(F.count(F.lit(1)).alias("n_found"), F.min("relevance_score").alias("kth")))
    # the greatest boost that a matched document has; without one nothing is read
    most_boost = matched.groupBy(*groups).agg(F.max(boost).alias("most_boost"))
    reach = F.col("bound") + F.col("others") + F.col("most_boost") + F.lit(SLACK) >= F.col("kth")
    needed = materialize(blocks.join(most_boost, groups).join(least, groups).where(
        F.col("negative") | (F.col("n_found") < k) | reach).select(*blocks.columns))
    return relevance(block_scores(impacts, needed, w)), needed
