"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptlens.session import new_table_path

# word patterns of the contracts: white-space words, and letter/digit words of a
# text whose A-Z are lower-cased after the match instead of before it
WS_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


# what this Python worker keeps between tasks (an encoder's cache, say): the things
# of one operator at a time, since Spark gives a worker tasks of any stage
_KEPT: dict[str, object] = {}


def kept_in_worker(name: str | None, make: Callable[[], object] | None = None) -> object | None:
    """The worker's ``name``, made if it isn't there; everything else it keeps goes."""
    others = [k for k in _KEPT if k != name]
    for k in others:
        del _KEPT[k]
    if others:
        release_memory()
    if name is not None and name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT.get(name)


def drop_others(name: str | None) -> None:
    """Drop what the worker keeps, but for ``name``."""
    if any(k != name for k in _KEPT):
        kept_in_worker(name if name in _KEPT else None)


def release_memory() -> None:
    """Give memory that a task has freed back to the system, for the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):   # a C library without it
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
         keeps: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a task that starts without other operators' leftovers (but for
    what it ``keeps``) and frees its own memory at its end."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(keeps)
        try:
            yield from run(batches)
        finally:
            release_memory()

    return work


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: computed
    once, lineage cut, survives lost executors."""
    path = new_table_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def wide(df: DataFrame) -> DataFrame:
    """Deal rows out evenly when a scan has fewer partitions than cores (small
    inputs only: a scan of many files or row groups is left alone)."""
    target = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def add_columns(df: DataFrame, text_col: str, make: Callable[[], Callable[[list], list]],
                added: list[tuple[str, str, pa.DataType]], keep: list[str] | None = None,
                step: int = 512, keeps: str | None = None) -> DataFrame:
    """The kept columns of ``df`` (all by default) and columns computed from its
    texts. ``make`` builds the per-task function: texts -> one list per added
    column. Kept columns stay Arrow data, so null ids and large integers are
    untouched; texts are decoded ``step`` rows at a time. ``keeps`` names what
    ``make`` leaves in the worker for its next tasks (``kept_in_worker``)."""
    names = [n for n, _, _ in added]
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    picked = list(dict.fromkeys([*keep, text_col]))
    schema = StructType([df.schema[c] for c in keep]
                        + list(StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t, _ in added)).fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                new = work(part.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [pa.array(v, t) for v, (_, _, t) in zip(new, added)],
                    names=[*keep, *names])

    return df.select(*[F.col(f"`{c}`") for c in picked]).mapInArrow(tidy(run, keeps), schema)
