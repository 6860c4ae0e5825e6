"""Incremental ingest of dialogue line files (S1/S3 as a file stream).

New files of lines (Parquet or CSV with the line schema, ``line_no``
included) dropped into a source folder are appended to the line table,
partitioned by ``show_key``. The file sink keeps a metadata log next to the
data and the query keeps its offsets in a checkpoint, so a restarted or
retried run never adds a file twice. ``availableNow`` processes what is there
and stops, which suits scheduled runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import new_table_path

LINE_FILE_SCHEMA = T.StructType([
    T.StructField("show_key", T.StringType()),
    T.StructField("season", T.IntegerType()),
    T.StructField("episode", T.LongType()),
    T.StructField("episode_title", T.StringType()),
    T.StructField("line_no", T.LongType()),
    T.StructField("character", T.StringType()),
    T.StructField("dialogue", T.StringType()),
])


def ingest_line_files(spark: SparkSession, source_dir: str, table_path: str,
                      checkpoint_path: str | None = None, fmt: str = "parquet",
                      max_files_per_trigger: int = 1000) -> None:
    """Append every not-yet-ingested file under ``source_dir`` to ``table_path``."""
    checkpoint_path = checkpoint_path or new_table_path(spark, "ingest-checkpoint")
    reader = spark.readStream.schema(LINE_FILE_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        reader = reader.options(header="true", multiLine="true", escape='"')
    lines = reader.format(fmt).load(source_dir)
    query = (
        lines.writeStream.format("parquet")
        .option("path", table_path)
        .option("checkpointLocation", checkpoint_path)
        .partitionBy("show_key")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_line_table(spark: SparkSession, table_path: str) -> DataFrame:
    """The ingested line table (only files committed by the sink's log)."""
    return spark.read.parquet(table_path)
