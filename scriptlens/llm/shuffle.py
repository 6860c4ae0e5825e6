"""Op 3, sharding: two-pass external shuffle.

Pass one scatters every record into one of many memory-sized buckets by a
seeded hash, so bucket sizes are near equal whatever the sources or copies. Buckets
that a much repeated key makes too large are dealt by row number instead.
Pass two loads one bucket per group, shuffles it with Fisher-Yates (seeded by
the bucket number) and gives every record its place in the global order:
bucket offset + place in the bucket. Shards are consecutive, equally long runs
of that order (law ``rows``: counts differ by at most one), so a shard is
written as the runs of its buckets.

Both passes are deterministic: a bucket is put into (doc_id, checksum) order
before it is shuffled, so a recomputed task after a lost executor yields the
same places.

Defined results: null text has size 1 and checksum 0; a null ``doc_id`` is
dealt by its text; rows that agree in id and text are interchangeable; an empty
table gives no rows; further columns of the input travel with their record.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from scriptlens.llm.common import stored
from scriptlens.session import new_table_path

SHARDS = 8
BUCKET_BYTES = 16 << 20
MIN_BUCKETS = 256       # enough tasks on small inputs
SEED = 20_240_607
HOT_BUCKET = 4          # times the bucket size from which a bucket's rows are dealt one by one
START = "bucket_start"
ROW = "shuffle_row"


def bucket_of(id_col: Column, text_col: Column, buckets: int, seed: int) -> Column:
    key = F.when(id_col.isNull(), F.xxhash64(F.lit(seed), text_col)).otherwise(
        F.xxhash64(F.lit(seed), id_col))
    return F.pmod(key, F.lit(buckets)).cast("long")


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A seeded Fisher-Yates permutation of ``range(n)``."""
    rng = np.random.default_rng([seed, bucket])
    order = np.arange(n, dtype=np.int64)
    picks = rng.integers(0, np.arange(n, 0, -1), dtype=np.int64) if n else order
    for i in range(n - 1):
        j = i + int(picks[i])
        order[i], order[j] = order[j], order[i]
    return order


def external_shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED,
                     bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Write the shuffled records and return them with ``size``,
    ``text_crc32``, ``bucket``, ``shard`` and ``slot``.

    The returned frame reads the written table: Parquet files partitioned by
    ``shard``, rows inside a file in slot order.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1
    total = docs.agg(F.sum(size).alias("b")).first()["b"] or 0
    buckets = max(MIN_BUCKETS, -(-total // bucket_bytes))
    own = ("size", "text_crc32", "bucket", "shard", "slot", START, ROW)
    keyed = docs.select(
        *[F.col(c) for c in docs.columns if c not in own],
        size.alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        bucket_of(F.col(id_col), F.col(text_col), buckets, seed).alias("bucket"),
        F.monotonically_increasing_id().alias(ROW))

    # bucket offsets: one row per bucket, from a pass that shuffles only counts
    def counted(rows: DataFrame) -> DataFrame:
        return stored(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("b")), "shuffle-counts")

    counts = counted(keyed)
    # a key repeated so often that its bucket outgrows a task is dealt by row instead
    hot = stored(counts.where((F.col("b") > HOT_BUCKET * bucket_bytes) & (F.col("n") > 1)).select("bucket"), "hot-buckets")
    if not hot.isEmpty():       # a fourth of the buckets at most, 8 bytes each
        by_row = F.pmod(F.xxhash64(F.lit(seed), id_col, "text_crc32", ROW), F.lit(buckets)).cast("long")
        keyed = (keyed.join(F.broadcast(hot.withColumnRenamed("bucket", "hot_bucket")), F.col("bucket") == F.col("hot_bucket"), "left")
                 .withColumn("bucket", F.when(F.col("hot_bucket").isNotNull(), by_row).otherwise(F.col("bucket")))
                 .drop("hot_bucket"))
        counts = counted(keyed)
    keyed = keyed.drop(ROW)
    n_rows = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    offsets = bucket_offsets(counts)
    quota, extra = divmod(n_rows, shards)

    def shuffled(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(
            table, [(id_col, "ascending"), ("text_crc32", "ascending"), ("size", "ascending")]))
        start, bucket = table[START][0].as_py(), table["bucket"][0].as_py()
        table = table.drop_columns([START]).take(pa.array(fisher_yates(len(table), seed, bucket)))
        place = start + np.arange(len(table), dtype=np.int64)
        # the first ``extra`` shards hold quota + 1 records
        head = extra * (quota + 1)
        shard = np.where(place < head, place // (quota + 1),
                         extra + (place - head) // max(quota, 1))
        begin = np.where(shard <= extra, shard * (quota + 1), head + (shard - extra) * quota)
        return (table.append_column("shard", pa.array(shard, pa.int32()))
                .append_column("slot", pa.array(place - begin, pa.int64())))

    placed = keyed.join(offsets, "bucket").select(*keyed.columns, START)
    schema = StructType([*keyed.schema.fields, StructField("shard", IntegerType()),
                         StructField("slot", LongType())])
    out = placed.groupBy("bucket").applyInArrow(shuffled, schema)
    path = new_table_path(spark, "shards")
    (out.sortWithinPartitions("shard", "slot").write.option("compression", "zstd")
     .partitionBy("shard").parquet(path))
    return spark.read.schema(schema).parquet(path)


def bucket_offsets(counts: DataFrame) -> DataFrame:
    """Running start of every bucket: exact prefix sums in two levels, so no
    task ever orders more than the square root of the number of buckets."""
    n = counts.count()
    span = max(1, int(n ** 0.5))
    grouped = counts.withColumn("chunk", F.floor(F.col("bucket") / span))
    chunks = grouped.groupBy("chunk").agg(F.sum("n").alias("cn"))
    base = chunks.select("chunk", (F.sum("cn").over(
        Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))).alias("base"))
    inner = Window.partitionBy("chunk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (grouped.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0)))
            .join(base, "chunk")
            .select("bucket", (F.coalesce("base", F.lit(0)) + F.col("inner")).alias(START)))
