"""Views of the driver's test tables in the engine's data model.

* ``dialogue_lines``: ``conversations`` as dialogue lines (one episode per
  conversation, five shows, file order = (conv_id, turn)).
* ``document_lines``: ``documents`` as one-line episodes, one show per language.
* ``posts``: ``documents`` joined with ``labels``; a four-letter type per row.
* ``line_vectors``: ``embeddings`` with the text of their document, if there is one.

All are plain DataFrame plans over the Parquet scans, so Catalyst prunes
columns and pushes filters into the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_words, py_strip
from ..functions.wordlists import WS
from ..session import spread

LINE_COLUMNS = ["show_key", "season", "episode", "episode_title", "line_no", "character", "dialogue"]
# A show's conversations are five ids apart: the line numbers of one with more than
# five strides of turns meet the next one's. Line numbers order lines, they don't
# identify them.
TURN_STRIDE = 1_000_000
TITLE_CHARS = 40
DOC_TITLE_WORDS = 3


TEXT_TABLES = {"documents", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def table_version(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> int:
    """A number that changes with the tables' files (names, sizes, write times), so
    that nothing kept in a session answers for files that were replaced."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        fs = path.getFileSystem(conf)
        for f in fs.listStatus(path):       # the file itself, or the files of the folder
            seen.append((name, f.getPath().getName(), f.getLen(), f.getModificationTime()))
    return hash(tuple(sorted(seen)))


def first_line(c) -> Column:
    """First non-blank line, stripped (same as the first of ``physical_lines``):
    drop leading blanks and line breaks, keep up to the next line break."""
    head = F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "^" + WS + "+", "")
    return py_strip(F.regexp_extract(head, "^[^\\r\\n]*", 0))


def dialogue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    # Title of a conversation: first three words of its first turn. A grouped
    # min_by (partial aggregation) instead of a window keeps a hot
    # conversation from landing in one task.
    titles = conv.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_text")).select(
        "conv_id",
        F.coalesce(first_words("first_text", DOC_TITLE_WORDS), F.lit("")).alias("episode_title"),
    )
    return conv.join(titles, "conv_id").select(
        F.concat(F.lit("show"), (F.col("conv_id") % 5).cast("string")).alias("show_key"),
        ((F.col("conv_id") / 5).cast("bigint") % 4).cast("int").alias("season"),
        F.col("conv_id").alias("episode"),
        "episode_title",
        (F.col("conv_id") * TURN_STRIDE + F.col("turn")).alias("line_no"),
        F.col("role").alias("character"),
        F.col("text").alias("dialogue"),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("lang").alias("show_key"),
        F.lit(0).cast("int").alias("season"),
        F.col("doc_id").alias("episode"),
        F.substring(first_line("text"), 1, TITLE_CHARS).alias("episode_title"),
        F.col("doc_id").alias("line_no"),
        F.col("source").alias("character"),
        F.col("text").alias("dialogue"),
        F.lit(True).alias("is_last"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    t = F.concat(
        F.when(F.col("quality") == 1, "E").otherwise("I"),
        F.when(F.col("toxic") == 1, "S").otherwise("N"),
        F.when(F.col("n_chars") >= 600, "T").otherwise("F"),
        F.when(F.col("lang") == "en", "J").otherwise("P"),
    )
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("row_id"), t.alias("type"), F.col("text").alias("posts")
    )


def line_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    # every vector is a line; one without a document is named by its number
    return emb.join(docs, "vec_id", "left").select(
        F.concat(F.lit("speaker_"), F.col("label").cast("string")).alias("character"),
        F.col("vec_id").alias("line_id"),
        F.coalesce("text", F.concat(F.lit("line "), F.col("vec_id").cast("string"))).alias("dialogue"),
        "embedding",
    )
