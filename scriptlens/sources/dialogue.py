"""Dialogue CSV sources.

One CSV file per show with the columns ``season, episode, episode_title,
character, dialogue`` in any order. Ingest reads every source with a fixed
schema (no inference), checks the header for the required columns, skips and
reports sources that are missing or malformed, numbers lines in file order
and unions everything into one line table partitioned by ``show_key``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.wordlists import SHOW_NAMES
from ..session import new_table_path

REQUIRED_COLUMNS = ["episode_title", "season", "episode", "character", "dialogue"]
CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"'}
LINE_SCHEMA = T.StructType([
    T.StructField("season", T.IntegerType()),
    T.StructField("episode", T.LongType()),
    T.StructField("episode_title", T.StringType()),
    T.StructField("character", T.StringType()),
    T.StructField("dialogue", T.StringType()),
])


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV source (reads the first line only)."""
    return spark.read.options(**CSV_OPTIONS).csv(path).columns


CORRUPT = "_corrupt_record"


def read_show_csv(spark: SparkSession, path: str, show_key: str) -> DataFrame:
    """S1 + S2: one show's CSV with a fixed schema; ``ValueError`` on missing columns.

    Lines are numbered by (file name, place in the file): ``multiLine`` reads a
    file as one split, so ``monotonically_increasing_id`` rises within a file, and
    one row per file gives the number its lines start from. Rows that don't parse
    are kept with nulls; ``checked_show_csv`` tells them apart.
    """
    return checked_show_csv(spark, path, show_key).drop("file", CORRUPT)


def checked_show_csv(spark: SparkSession, path: str, show_key: str) -> DataFrame:
    """The rows of ``read_show_csv`` with their ``file`` and, for a row that does not
    fit the schema (a wrong type, too few or too many fields), its raw text."""
    header = csv_header(spark, path)
    missing = sorted(set(REQUIRED_COLUMNS) - set(header))
    if missing:
        raise ValueError(f"{show_key}: missing columns {missing}")
    schema = T.StructType([LINE_SCHEMA[c] if c in LINE_SCHEMA.names else T.StructField(c, T.StringType())
                           for c in header] + [T.StructField(CORRUPT, T.StringType())])
    df = spark.read.schema(schema).options(**CSV_OPTIONS, columnNameOfCorruptRecord=CORRUPT).csv(path).select(
        *REQUIRED_COLUMNS, CORRUPT, F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    files = df.groupBy("_file").agg(F.min("_at").alias("low"), F.count(F.lit(1)).alias("n")).orderBy("_file").collect()
    shifts, before = {}, 0
    for f in files:
        shifts[f["_file"]] = before - f["low"]
        before += f["n"]
    starts = spark.createDataFrame(list(shifts.items()), "_file string, _shift bigint")
    return df.join(starts, "_file").select(
        F.lit(show_key).alias("show_key"),
        "season", "episode", "episode_title",
        (F.col("_at") + F.col("_shift")).alias("line_no"),
        "character", "dialogue", F.col("_file").alias("file"), CORRUPT,
    )


def ingest_with_quarantine(spark: SparkSession, sources: dict[str, str] | str,
                           out_path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S3 + S11: like ``ingest_csv_sources``, with the rows that don't parse put
    aside. Returns ``(lines, quarantined, skipped)``; ``quarantined`` has show, file,
    line number and raw text. Good lines keep the numbers they have in the file.
    """
    frames, skipped_df = readable_sources(spark, sources, checked_show_csv)
    out_path = out_path or new_table_path(spark, "lines")
    # read once: both tables are written from one copy
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    rows.write.mode("overwrite").partitionBy("show_key").parquet(f"{out_path}/all")
    kept = spark.read.schema(rows.schema).parquet(f"{out_path}/all")
    kept.where(F.col(CORRUPT).isNull()).drop("file", CORRUPT).write.mode("overwrite") \
        .partitionBy("show_key").parquet(f"{out_path}/lines")
    kept.where(F.col(CORRUPT).isNotNull()).select("show_key", "file", "line_no", F.col(CORRUPT).alias("record")) \
        .write.mode("overwrite").parquet(f"{out_path}/quarantined")
    lines_schema = rows.drop("file", CORRUPT).schema
    return (spark.read.schema(lines_schema).parquet(f"{out_path}/lines"),
            spark.read.parquet(f"{out_path}/quarantined"), skipped_df)


def readable_sources(spark: SparkSession, sources: dict[str, str] | str, read) -> tuple[list[DataFrame], DataFrame]:
    """The frames of all sources that ``read`` can open, and (source, reason) of the
    others; a bad source is reported, not fatal (S11)."""
    if isinstance(sources, str):
        sources = discover_sources(spark, sources)
    frames, skipped = [], []
    for key, path in sorted(sources.items()):
        try:
            frames.append(read(spark, path, key))
        except (ValueError, AnalysisException) as e:
            skipped.append((key, str(e).splitlines()[0]))
    if not frames:
        raise ValueError("every dialogue source was skipped: " + "; ".join(f"{k} ({r})" for k, r in skipped))
    return frames, spark.createDataFrame(skipped, "source string, reason string")


def ingest_csv_sources(spark: SparkSession, sources: dict[str, str] | str,
                       out_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """S3 + S4 + U1: union of all readable sources, written partitioned by show.

    Returns ``(lines, skipped)`` where ``skipped`` lists (source, reason).
    """
    frames, skipped_df = readable_sources(spark, sources, read_show_csv)
    lines = frames[0]
    for f in frames[1:]:
        lines = lines.unionByName(f, allowMissingColumns=True)
    out_path = out_path or new_table_path(spark, "lines")
    lines.write.mode("overwrite").partitionBy("show_key").parquet(out_path)
    return spark.read.parquet(out_path), skipped_df


def discover_sources(spark: SparkSession, root: str) -> dict[str, str]:
    """``show_key=<key>`` folders under ``root`` (as written by ``write_csv_sources``)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(conf)
    out = {}
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("show_key="):
            out[name.split("=", 1)[1]] = st.getPath().toString()
    return out


def write_csv_sources(spark: SparkSession, lines: DataFrame, out_path: str | None = None) -> str:
    """CSV files per show, named in file order (the source layout ingest expects): a
    range of (show, line number) is one file, so a large show is written and read by
    many tasks."""
    out_path = out_path or new_table_path(spark, "csv-sources")
    (lines.select("show_key", "line_no", *REQUIRED_COLUMNS)
     .repartitionByRange("show_key", "line_no").sortWithinPartitions("show_key", "line_no").drop("line_no")
     .write.mode("overwrite").partitionBy("show_key").options(**CSV_OPTIONS).csv(out_path))
    return out_path


def registry(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """Source registry as a small dimension table (key, display name, path)."""
    rows = [(k, SHOW_NAMES.get(k, k), p) for k, p in sorted(sources.items())]
    return spark.createDataFrame(rows, "show_key string, show_name string, path string")
