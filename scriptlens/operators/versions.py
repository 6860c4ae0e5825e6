"""A versioned index: reuse only while the lines agree, else a segment per change.

``document_versions`` gives every document a digest of its lines (a sum of row hashes
by partial aggregation, so a document with very many lines is spread over tasks).
``open_index`` compares it with the digests of the stored version. If they agree, and
so do the title weight and the number of episodes, the stored tables are read. If some
documents are new, changed or gone, only their lines are tokenised: they become a
segment, the version's ``gone`` table hides their older rows, and document
frequencies, lengths and show statistics are merged by adding the segment's sums and
taking the hidden rows' sums away. ``MAX_SEGMENTS`` segments are written as one again.

Layout under the index path (a version is readable only once its manifest is
written, so a broken run leaves the one before):

* ``v<N>/lines, doc_len, postings, digests`` the segment's rows (``schema``: the lines' columns),
  with ``packed`` and ``summed`` of ``index.write_postings``
* ``v<N>/gone``                              document keys whose older rows it hides
* ``v<N>/term_stats, show_stats``            statistics of the whole version
* ``v<N>/manifest``                          version, segments, title weight, number of episodes
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wordlists import DEFAULT_TITLE_WEIGHT
from ..session import checked_broadcast, materialize
from .counted import unpacked
from .index import (
    COUNTED,
    DOC_KEYS,
    CorpusIndex,
    _term_stats,
    _write_sorted,
    searchable_lines,
    single_parts,
    write_postings,
)

MAX_SEGMENTS = 8
SEGMENT_TABLES = ("lines", "doc_len", "postings", "digests")
STORED_LINES = ["show_key", "season", "episode", "episode_title", "line_no", "character", "dialogue", "is_last"]


def line_hash() -> Column:
    return F.xxhash64("line_no", "character", "dialogue", F.col("character").isNull(), F.col("dialogue").isNull())


def document_versions(lines: DataFrame) -> DataFrame:
    """(document keys, n_lines, digest): equal for equal sets of lines."""
    return lines.groupBy(*DOC_KEYS).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_lines"),
        F.sum(line_hash().cast("decimal(20,0)")).cast("string").alias("digest"))


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The newest version's manifest, or None without a stored index."""
    version, found = 0, None
    while True:
        try:
            row = spark.read.parquet(f"{path}/v{version}/manifest").first()
        except AnalysisException:
            return found
        found, version = row.asDict(), version + 1


def write_version(spark: SparkSession, path: str, version: int, segments: list[int], lines: DataFrame,
                  gone: DataFrame | None, title_weight: float, before: CorpusIndex | None) -> None:
    """Write the segment of ``lines`` and the merged statistics; the manifest last."""
    at = f"{path}/v{version}"
    lines = lines.select(*STORED_LINES)
    lines.limit(0).write.mode("overwrite").parquet(f"{at}/schema")      # a partitioned write of no rows has none
    lines.write.mode("overwrite").partitionBy("show_key").parquet(f"{at}/lines")
    lines = stored_lines(spark, at)
    write_postings(spark, lines, at)
    doc_len = spark.read.parquet(f"{at}/doc_len")
    document_versions(lines).write.mode("overwrite").parquet(f"{at}/digests")
    if gone is not None:
        gone.write.mode("overwrite").parquet(f"{at}/gone")
    # statistics of the version: the ones before, plus this segment's, less what it hides
    stats = _term_stats(spark.read.parquet(f"{at}/postings"))
    sizes = doc_len.groupBy("show_key").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("len_body").alias("sum_len_body"),
                                            F.sum("len_title").alias("sum_len_title"))
    if before is not None:
        # a packed row per document meets ``gone``; only the hidden ones become postings
        side, _ = checked_broadcast(spark.read.parquet(f"{at}/gone"))
        hidden = hidden_postings(before, side)
        stats = merged(["show_key", "term"], ["df_body", "df_any"], [before.term_stats, stats], _term_stats(hidden))
        stats = stats.where("df_any > 0")
        hidden_len = before.doc_len.join(side, DOC_KEYS, "left_semi").groupBy("show_key").agg(
            F.count(F.lit(1)).alias("n_docs"), F.sum("len_body").alias("sum_len_body"), F.sum("len_title").alias("sum_len_title"))
        sizes = merged(["show_key"], ["n_docs", "sum_len_body", "sum_len_title"], [before.show_stats, sizes], hidden_len)
        sizes = sizes.where("n_docs > 0")
    _write_sorted(stats, f"{at}/term_stats")
    sizes.write.mode("overwrite").parquet(f"{at}/sizes")
    show_stats_of(spark.read.parquet(f"{at}/sizes"), spark.read.parquet(f"{at}/term_stats")).write.mode(
        "overwrite").parquet(f"{at}/show_stats")
    n_episodes = spark.read.parquet(f"{at}/sizes").agg(F.sum("n_docs")).first()[0] or 0
    spark.createDataFrame([(version, segments, float(title_weight), int(n_episodes))],
                          "version int, segments array<int>, title_weight double, n_episodes bigint") \
        .write.mode("overwrite").parquet(f"{at}/manifest")


def hidden_postings(index: CorpusIndex, gone: DataFrame) -> DataFrame:
    """(show_key, term, tf_body) of the documents in ``gone``."""
    hidden = unpacked(index.packed.join(gone, DOC_KEYS, "left_semi"), ["show_key"], COUNTED).select(
        "show_key", "term", F.col("n_tb").alias("tf_body"))
    if index.summed is None:
        return hidden
    return hidden.unionByName(index.summed.join(gone, DOC_KEYS, "left_semi").select("show_key", "term", "tf_body"))


def stored_lines(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{at}/schema").schema).parquet(f"{at}/lines")


def merged(keys: list[str], sums: list[str], added: list[DataFrame], taken: DataFrame) -> DataFrame:
    """Sums per key of the added tables less those of the taken one."""
    rows = [d.select(*keys, *sums) for d in added]
    rows.append(taken.select(*keys, *[(-F.col(c)).alias(c) for c in sums]))
    return reduce(DataFrame.unionByName, rows).groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in sums])


def show_stats_of(sizes: DataFrame, term_stats: DataFrame) -> DataFrame:
    """Show statistics from merged sums: mean raw idf over the terms in use."""
    # the lengths are sums already; one row per show stands for its documents
    raw = lambda df: F.log(F.col("n_docs") - F.col(df) + F.lit(0.5)) - F.log(F.col(df) + F.lit(0.5))
    means = term_stats.join(sizes.select("show_key", "n_docs"), "show_key").groupBy("show_key").agg(
        F.avg(F.when(F.col("df_body") > 0, raw("df_body"))).alias("mean_idf_body"), F.avg(raw("df_any")).alias("mean_idf_any"))
    return sizes.join(means, "show_key", "left")


def load_version(spark: SparkSession, path: str, manifest: dict) -> tuple[CorpusIndex, DataFrame]:
    """The tables of a version, and its documents' digests."""
    segments = list(manifest["segments"])

    def kept(rows: DataFrame, k: int) -> DataFrame:
        for later in segments[k + 1:]:
            rows = rows.join(spark.read.parquet(f"{path}/v{later}/gone"), DOC_KEYS, "left_anti")
        return rows

    def table(name: str) -> DataFrame:
        rows = [stored_lines(spark, f"{path}/v{seg}") if name == "lines" else spark.read.parquet(f"{path}/v{seg}/{name}")
                for seg in segments]
        return reduce(DataFrame.unionByName, [kept(r, k) for k, r in enumerate(rows)])

    parts = [single_parts(spark, f"{path}/v{seg}") for seg in segments]
    packed = reduce(DataFrame.unionByName, [kept(p, k) for k, (p, _) in enumerate(parts)])
    several = [kept(s, k) for k, (_, s) in enumerate(parts) if s is not None]
    newest = f"{path}/v{manifest['version']}"
    index = CorpusIndex(table("postings"), table("doc_len").drop("n_parts"), spark.read.parquet(f"{newest}/term_stats"),
                        spark.read.parquet(f"{newest}/show_stats"), table("lines"), packed=packed,
                        summed=reduce(DataFrame.unionByName, several) if several else None)
    return index, table("digests")


def open_index(spark: SparkSession, path: str, lines: DataFrame,
               title_weight: float = DEFAULT_TITLE_WEIGHT) -> tuple[CorpusIndex, dict]:
    """The index of ``lines`` at ``path``: read if it agrees, else brought up to date.

    Returns the index and a report: ``version``, ``reused``, and the numbers of
    documents ``added``, ``changed`` and ``removed``. Another title weight starts a
    full version, as the reuse check asks for it.
    """
    lines = searchable_lines(lines)
    manifest = read_manifest(spark, path)
    if manifest is None or manifest["title_weight"] != float(title_weight):
        version = 0 if manifest is None else manifest["version"] + 1
        write_version(spark, path, version, [version], lines, None, title_weight, None)
        fresh = read_manifest(spark, path)
        return load_version(spark, path, fresh)[0], {
            "version": version, "reused": False, "added": fresh["n_episodes"], "changed": 0, "removed": 0}
    index, digests = load_version(spark, path, manifest)
    now = document_versions(lines)
    both = now.select(*DOC_KEYS, F.col("digest").alias("new"), F.col("n_lines").alias("new_n")).join(
        digests.select(*DOC_KEYS, F.col("digest").alias("old"), F.col("n_lines").alias("old_n")), DOC_KEYS, "full")
    differs = ~(F.col("new").eqNullSafe(F.col("old")) & F.col("new_n").eqNullSafe(F.col("old_n")))
    changes = materialize(both.where(differs).select(
        *DOC_KEYS, F.col("old_n").isNull().alias("added"), F.col("new_n").isNull().alias("removed")))
    n = changes.agg(F.count(F.lit(1)), F.count(F.when(F.col("added"), 1)), F.count(F.when(F.col("removed"), 1))).first()
    if not n[0]:
        return index, {"version": manifest["version"], "reused": True, "added": 0, "changed": 0, "removed": 0}
    version, segments = manifest["version"] + 1, [*manifest["segments"], manifest["version"] + 1]
    if len(segments) > MAX_SEGMENTS:
        write_version(spark, path, version, [version], lines, None, title_weight, None)
    else:
        gone = changes.where("not added").select(*DOC_KEYS)
        fresh = lines.join(changes.where("not removed").select(*DOC_KEYS), DOC_KEYS, "left_semi")
        write_version(spark, path, version, segments, fresh, gone, title_weight, index)
    return load_version(spark, path, read_manifest(spark, path))[0], {
        "version": version, "reused": False, "added": n[1], "changed": n[0] - n[1] - n[2], "removed": n[2]}
