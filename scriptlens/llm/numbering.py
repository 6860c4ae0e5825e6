"""Exact gapless numbering of rows without ordering a hot group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 5_000


def numbered(df: DataFrame, groups: list[str], key: Column, order: list[str], n_rows: int,
             name: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``name``: 0, 1, ... within each group. Rows of a group are dealt into
    hash buckets of ``key``; a bucket's start is the sum of the counts before
    it, and only rows of one bucket are ever ordered together."""
    buckets = max(1, -(-n_rows // rows_per_bucket))
    dealt = df.withColumn("num_bucket", F.pmod(key, F.lit(buckets)))
    counts = dealt.groupBy(*groups, "num_bucket").agg(F.count("*").alias("num_n"))
    before = Window.partitionBy(*groups).orderBy("num_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*groups, "num_bucket",
                           F.coalesce(F.sum("num_n").over(before), F.lit(0)).alias("num_start"))
    inside = Window.partitionBy(*groups, "num_bucket").orderBy(*order)
    return (dealt.withColumn("num_at", F.row_number().over(inside) - 1)
            .join(starts, [*groups, "num_bucket"])
            .withColumn(name, F.col("num_start") + F.col("num_at"))
            .drop("num_bucket", "num_at", "num_start"))
