"""Spark session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows above which a side is never broadcast, whatever its estimated bytes.
MAX_BROADCAST_ROWS = 200_000


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "scriptlens") -> SparkSession:
    """Session with AQE (coalescing, skew join) on and the web UI off."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    local = (master or "").startswith("local")
    if shuffle_partitions or local:
        # local runs: a few partitions per core; on a cluster the cluster's
        # setting stays and AQE coalesces small partitions after each shuffle
        parts = shuffle_partitions or int(os.environ.get("SCRIPTLENS_SHUFFLE_PARTITIONS", "16"))
        builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    else:
        # cluster: coalesce post-shuffle partitions towards 128 MB each
        builder = (builder.config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
                   .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false"))
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SCRIPTLENS_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Read from the session; only when unset (local tests) a folder of our own is
    created and registered as the checkpoint directory.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if not current:
        current = sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="scriptlens-ckpt-")
        sc.setCheckpointDir(local)
        current = sc.getCheckpointDir() or local
    return current.rstrip("/")


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh location for a written table under the shared folder."""
    return f"{shared_dir(spark)}/scriptlens/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint in
    the shared checkpoint folder (survives executor loss; never a local
    checkpoint). Used where one intermediate feeds several consumers."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition when a scan yields fewer partitions than the
    cluster's parallelism (e.g. a file with one row group), so CPU-heavy text
    expressions use every core. A scan that is already wide is left alone, so
    at scale this adds no shuffle."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def bounded_broadcast(df: DataFrame, bound_rows: int, max_rows: int = MAX_BROADCAST_ROWS):
    """Broadcast ``df`` when a bound known by construction allows it.

    ``bound_rows`` is a proven upper bound on the rows of ``df`` (a capped
    vocabulary times a fixed number of classes, ``k`` times the number of
    queries...). No job is run to decide. Returns ``(frame, broadcast_used)``.
    """
    from pyspark.sql import functions as F

    if bound_rows <= max_rows:
        return F.broadcast(df), True
    return df, False


def checked_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS):
    """Broadcast ``df`` only if it has at most ``max_rows`` rows.

    Returns ``(frame, broadcast_used)``. The count is one small job over a side
    that callers only pass when it is expected to be small (query tables, top-k
    results, per-show statistics); above the bound the caller takes its
    shuffle-based path.
    """
    from pyspark.sql import functions as F

    n = df.limit(max_rows + 1).count()
    if n <= max_rows:
        return F.broadcast(df), True
    return df, False
