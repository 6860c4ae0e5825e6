"""An inverted file of line vectors: cells, probed search, exact search by bounds.

Spherical k-means on a bounded sample gives the cells: an iteration assigns each
sample vector to the centroid of greatest cosine and takes grouped averages of the
components. Every vector is then put into its cell and written partitioned by cell;
a small table holds, per character and cell, how many rows there are and the widest
angle to the centroid.

A request reads only rows of its own character. The fast search reads its ``probes``
nearest cells and reranks their rows by the exact cosine. The exact search takes the
k-th cosine found there and then reads every further cell that could hold a better
row: the angle between request and row is at least the request's angle to the centroid
less the cell's widest angle. Both join on (character, cell), so Spark prunes the
folders of cells that no request needs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wordlists import STYLE_EXAMPLES
from ..session import materialize, new_table_path
from .search import top_k
from .similar import cosine, norm
from .sparse import number_array

CELLS = 16
SAMPLE_ROWS = 20_000        # vectors the centroids are fitted on, by hash
ROUNDS = 6
PROBES = 8
SLACK = 1e-6                # cosines are compared rounded to six digits


@dataclass
class VectorIndex:
    vectors: DataFrame      # character, line_id, dialogue, embedding, norm, cell
    cells: DataFrame        # character, cell, n_rows, widest
    centroids: list[list[float]]


def unit_vector(embedding: Column, length: Column) -> Column:
    return F.transform(embedding, lambda v: v.cast("double") / length)


def centroid_cosines(unit: Column, centroids: list[list[float]]) -> Column:
    """Cosines of a unit vector with the (unit) centroids, in order."""
    return F.array(*[
        F.aggregate(F.zip_with(unit, number_array(c), lambda x, y: x * y), F.lit(0.0), lambda a, v: a + v)
        for c in centroids])


def nearest_cell(cosines: Column) -> Column:
    """Number of the greatest cosine; the first of equal ones."""
    return (F.array_position(cosines, F.array_max(cosines)) - 1).cast("int")


def fit_centroids(vectors: DataFrame, cells: int = CELLS, rounds: int = ROUNDS,
                  sample_rows: int = SAMPLE_ROWS) -> list[list[float]]:
    """Unit centroids from the ``sample_rows`` vectors of smallest hash."""
    sample = materialize(
        vectors.orderBy(F.xxhash64("line_id", "embedding"), "line_id").limit(sample_rows)
        .select("line_id", unit_vector(F.col("embedding"), F.col("norm")).alias("unit")))
    first = sample.orderBy(F.xxhash64(F.lit(7), "line_id", "unit"), "line_id").limit(cells).collect()
    centroids = [list(r["unit"]) for r in first]
    for _ in range(rounds if centroids else 0):
        dealt = sample.select("unit", nearest_cell(centroid_cosines(F.col("unit"), centroids)).alias("cell"))
        sums = (dealt.select("cell", F.posexplode("unit").alias("at", "v")).groupBy("cell", "at")
                .agg(F.avg("v").alias("m")).collect())          # cells x components
        for cell in range(len(centroids)):
            mean = np.array([m for _, m in sorted((r["at"], r["m"]) for r in sums if r["cell"] == cell)])
            length = float(np.sqrt((mean ** 2).sum())) if len(mean) else 0.0
            if length > 0:              # an empty cell keeps its centroid
                centroids[cell] = (mean / length).tolist()
    return centroids


def build_vector_index(spark: SparkSession, vectors: DataFrame, cells: int = CELLS,
                       path: str | None = None) -> VectorIndex:
    """Index all (character, line_id, dialogue, embedding) rows with a direction;
    zero and null vectors have none."""
    path = path or new_table_path(spark, "vector-index")
    sound = vectors.where(F.col("embedding").isNotNull()).withColumn("norm", norm("embedding")).where("norm > 0")
    centroids = fit_centroids(sound, cells)
    cosines = centroid_cosines(unit_vector(F.col("embedding"), F.col("norm")), centroids)
    placed = (sound.withColumn("_cosines", cosines)
              .withColumn("cell", nearest_cell(F.col("_cosines")) if centroids else F.lit(0))
              .withColumn("angle", F.acos(F.least(F.lit(1.0), F.array_max("_cosines"))) if centroids else F.lit(0.0))
              .drop("_cosines"))
    placed.limit(0).write.mode("overwrite").parquet(f"{path}/schema")      # a partitioned write of no rows has none
    placed.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    spark.createDataFrame([(k, c) for k, c in enumerate(centroids)], "cell int, centroid array<double>") \
        .write.mode("overwrite").parquet(f"{path}/centroids")
    rows = spark.read.schema(placed.schema).parquet(f"{path}/vectors")
    rows.groupBy("character", "cell").agg(F.count(F.lit(1)).alias("n_rows"), F.max("angle").alias("widest")) \
        .write.mode("overwrite").parquet(f"{path}/cells")
    return load_vector_index(spark, path)


def load_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    centroids = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    schema = spark.read.parquet(f"{path}/schema").schema
    return VectorIndex(spark.read.schema(schema).parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/cells"),
                       [list(r["centroid"]) for r in centroids])


def cell_angles(index: VectorIndex, requests: DataFrame) -> DataFrame:
    """(request..., cell, n_rows, widest, gap) for the cells that hold rows of the
    request's character; ``gap`` is the angle to the centroid."""
    cosines = centroid_cosines(unit_vector(F.col("request_vec"), F.col("rnorm")), index.centroids)
    sized = requests.withColumn("rnorm", norm("request_vec")).where("rnorm > 0")
    spread = sized.select("request_id", "character", "request_vec", "rnorm",
                          F.posexplode(cosines).alias("cell", "near"))
    return spread.join(index.cells, ["character", "cell"]).withColumn(
        "gap", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("near")))))


def reranked(index: VectorIndex, picked: DataFrame) -> DataFrame:
    """Exact cosines of the rows of the picked (request, cell) pairs."""
    asked = picked.select("request_id", "character", "cell", "request_vec", "rnorm")
    return index.vectors.join(asked, ["character", "cell"]).select(
        "request_id", "character", "line_id", "dialogue",
        F.round(cosine("embedding", "request_vec", F.col("norm"), F.col("rnorm")), 6).alias("cosine"))


def probed_lines(index: VectorIndex, requests: DataFrame, k: int = STYLE_EXAMPLES, probes: int = PROBES) -> DataFrame:
    """W8, fast: the ``k`` best rows of each request's ``probes`` nearest cells."""
    near = top_k(cell_angles(index, requests), ["request_id"], ["gap", "cell"], probes, "probe")
    return top_k(reranked(index, near), ["request_id"], [F.col("cosine").desc(), "line_id"], k, "example_rank")


def exact_lines(index: VectorIndex, requests: DataFrame, k: int = STYLE_EXAMPLES, probes: int = PROBES) -> DataFrame:
    """W8, exact: the same rows as a scan of the character's lines."""
    ranked = materialize(cell_angles(index, requests).withColumn(
        "probe", F.row_number().over(_by_gap())))
    found = materialize(top_k(reranked(index, ranked.where(F.col("probe") <= probes)), ["request_id"],
                              [F.col("cosine").desc(), "line_id"], k, "example_rank"))
    least = found.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_found"), F.min("cosine").alias("kth"))
    bound = F.cos(F.greatest(F.lit(0.0), F.col("gap") - F.col("widest")))
    open_cells = (ranked.where(F.col("probe") > probes).join(least, "request_id", "left")
                  .where(F.col("n_found").isNull() | (F.col("n_found") < k) | (bound + SLACK >= F.col("kth"))))
    every = found.drop("example_rank").unionByName(reranked(index, open_cells))
    return top_k(every, ["request_id"], [F.col("cosine").desc(), "line_id"], k, "example_rank")


def _by_gap():
    from pyspark.sql import Window

    return Window.partitionBy("request_id").orderBy("gap", "cell")
