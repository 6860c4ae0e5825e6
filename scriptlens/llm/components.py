"""Connected components of a link table by alternating large-star and small-star
steps; every step joins and aggregates, no neighbourhood is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptlens.llm.common import stored

MAX_STEPS = 60


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on (u, v), u > v: neighbours of a node are linked to the
    least node of its neighbourhood instead."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("low")).select(
        "u", F.least("u", "low").alias("low"))
    moved = around.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = (moved.select(F.col("v").alias("u"), F.col("low").alias("v"))
               .unionByName(least.select("u", F.col("low").alias("v"))))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, label) of all nodes with a link; the label is the component's
    least node."""
    spark = edges.sparkSession
    current = stored(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
                     .where("u <> v").distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())

    before = state(current)
    for _ in range(MAX_STEPS):
        if not before[0]:
            break
        current = stored(star(star(current, True), False), "edges")
        after = state(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not stable after {MAX_STEPS} steps")
    out = current.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return out.unionByName(out.select(F.col("label").alias("node"), "label").distinct())
