"""Vector retrieval for style requests.

Requests are matched only against lines of their own character (an equi-join
on ``character``), so the work is requests x that character's lines, never
all pairs of lines. Line norms are computed once per line; the top five per
request use a per-group limit planned as ``WindowGroupLimit``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wordlists import STYLE_EXAMPLES
from .search import top_k


def dot(a, b) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b, norm_a=None, norm_b=None) -> Column:
    """Cosine similarity of two equal-length float arrays."""
    na = norm_a if norm_a is not None else norm(a)
    nb = norm_b if norm_b is not None else norm(b)
    return dot(a, b) / (na * nb)


def materialize_vectors(spark, vectors: DataFrame, path: str | None = None) -> DataFrame:
    """Line vectors with their norms, written once partitioned by character."""
    from ..session import new_table_path

    path = path or new_table_path(spark, "line-vectors")
    vectors.withColumn("norm", norm("embedding")).write.mode("overwrite").partitionBy("character").parquet(path)
    return spark.read.parquet(path)


def centroid_requests(vectors: DataFrame) -> DataFrame:
    """One request per character: the mean of its line vectors.

    Component means are a grouped average over (character, position) with
    partial aggregation; the vector is reassembled from at most ``d``
    components per character.
    """
    comps = (
        vectors.select("character", F.posexplode("embedding").alias("pos", "v"))
        .groupBy("character", "pos")
        .agg(F.avg(F.col("v").cast("double")).alias("m"))
    )
    return comps.groupBy("character").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("request_vec")
    ).withColumn("request_id", F.col("character"))


def nearest_lines(vectors: DataFrame, requests: DataFrame, k: int = STYLE_EXAMPLES) -> DataFrame:
    """For each request (request_id, character, request_vec) the ``k`` lines
    of that character with the highest cosine (ties by line_id)."""
    req = requests.select("request_id", "character", "request_vec", norm("request_vec").alias("rnorm"))
    # one request row per character here; AQE broadcasts it at run time when
    # it is below the broadcast threshold, else a shuffle join on character
    req_side = req
    stored = F.col("norm") if "norm" in vectors.columns else norm("embedding")
    lines = vectors.select("character", "line_id", "dialogue", "embedding", stored.alias("lnorm"))
    pairs = lines.join(req_side, "character").select(
        "request_id", "character", "line_id", "dialogue",
        F.round(cosine("embedding", "request_vec", F.col("lnorm"), F.col("rnorm")), 6).alias("cosine"),
    )
    return top_k(pairs, ["request_id"], [F.col("cosine").desc(), "line_id"], k, "example_rank")


def style_prompts(nearest: DataFrame, sentence: str) -> DataFrame:
    """T38 + M18: the rewrite prompt per request from its ranked examples."""
    numbered = F.concat(F.col("example_rank").cast("string"), F.lit(". "), F.col("dialogue"))
    g = nearest.withColumn("_numbered", numbered).groupBy("request_id", "character").agg(
        F.expr("listagg(_numbered, '\\n') WITHIN GROUP (ORDER BY example_rank)").alias("examples"),
        F.count(F.lit(1)).cast("bigint").alias("n_examples"),
    )
    # fixed values: the wording of the prompt
    head = F.concat(F.lit("\nRewrite the following sentence in the style of **"), F.col("character"),
                    F.lit("**.\n\nExamples:\n"))
    tail = F.lit('\n\nSentence: "' + sentence + '"\nOutput:\n')
    return g.select("request_id", "character", "n_examples",
                    F.concat(head, F.col("examples"), tail).alias("prompt"))
