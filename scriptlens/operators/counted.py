"""Term counts of texts where they lie, and postings in sorted runs.

``counted_terms`` turns rows of (keys, token lists) into one packed row per key and
Arrow batch: the distinct tokens, how often each list holds them and the lists'
lengths. Nothing is shuffled for that. A key whose rows lie in one batch (a document
that is one line) is complete; ``split_parts`` tells apart the few keys that came in
several packed rows, and only those are exploded and summed by key and term, so a key
with very many rows is still spread over tasks.

``sorted_runs`` orders a task's rows in runs of ``RUN_ROWS``: a written file is a few
runs, each sorted by the given columns, so the pages without a looked-up term are
skipped by their statistics. No rows are exchanged for it and a task holds one run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..session import checked_broadcast

BATCH_ROWS = 1_000          # texts counted at a time
RUN_ROWS = 1_000_000        # postings sorted at a time
OUT_ROWS = 50_000           # rows handed over at a time


def counted_terms(df: DataFrame, keys: list[str], lists: list[str]) -> DataFrame:
    """(keys..., term array, n_<list> arrays, len_<list>): a packed row per key and batch.

    Rows without a token keep a packed row (with empty arrays), for their key's length.
    """
    schema = StructType(
        [df.schema[k] for k in keys] + [StructField("term", ArrayType(StringType()))]
        + [StructField(f"n_{c}", ArrayType(LongType())) for c in lists] + [StructField(f"len_{c}", LongType()) for c in lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_ROWS):
                yield packed_counts(batch.slice(lo, BATCH_ROWS), keys, lists)

    return df.select(*keys, *lists).mapInArrow(run, schema)


def packed_counts(batch: pa.RecordBatch, keys: list[str], lists: list[str]) -> pa.RecordBatch:
    """One row per distinct key of the batch."""
    numbers: dict[tuple, int] = {}
    number = np.fromiter((numbers.setdefault(k, len(numbers)) for k in zip(*[batch.column(k).to_pylist() for k in keys])),
                         dtype=np.int64, count=batch.num_rows)
    first = np.unique(number, return_index=True)[1]
    values = [batch.column(c).flatten() for c in lists]
    terms = pa.chunked_array(values, pa.string()).combine_chunks()
    terms = (terms if isinstance(terms, pa.Array) else terms.chunk(0)).dictionary_encode()
    code, at = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), 0
    n_terms = max(1, len(terms.dictionary))
    seen, lengths = [], []
    for c, v in zip(lists, values):
        sizes = pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
        lengths.append(np.bincount(number, weights=sizes, minlength=len(numbers)).astype(np.int64))
        seen.append(np.unique(np.repeat(number, sizes) * n_terms + code[at:at + len(v)], return_counts=True))
        at += len(v)
    pairs = np.unique(np.concatenate([s[0] for s in seen]))          # by key, each term once
    counts = []
    for codes, n in seen:
        all_counts = np.zeros(len(pairs), dtype=np.int64)
        all_counts[np.searchsorted(pairs, codes)] = n
        counts.append(all_counts)
    stops = np.searchsorted(pairs // n_terms, np.arange(len(numbers) + 1)).astype(np.int32)
    packed = [pa.ListArray.from_arrays(stops, terms.dictionary.take(pa.array(pairs % n_terms)))]
    packed += [pa.ListArray.from_arrays(stops, pa.array(n)) for n in counts]
    rows = batch.select(keys).take(pa.array(first))
    return pa.RecordBatch.from_arrays(
        [*rows.columns, *packed, *map(pa.array, lengths)],
        names=[*keys, "term", *[f"n_{c}" for c in lists], *[f"len_{c}" for c in lists]])


def unpacked(parts: DataFrame, keys: list[str], lists: list[str]) -> DataFrame:
    """(keys..., term, n_<list>...): a row per term of a packed row."""
    entries = F.arrays_zip("term", *[f"n_{c}" for c in lists])
    return parts.select(*keys, F.explode(entries).alias("e")).select(
        *keys, F.col("e.term").alias("term"), *[F.col(f"e.n_{c}").alias(f"n_{c}") for c in lists])


def split_parts(parts: DataFrame, several: DataFrame, keys: list[str], lists: list[str]) -> tuple[DataFrame, DataFrame]:
    """The packed rows of complete keys, and (keys..., term, n_<list>...) of the keys
    in ``several`` (those with more than one packed row), summed."""
    side, _ = checked_broadcast(several.select(*keys))
    summed = unpacked(parts.join(side, keys, "left_semi"), keys, lists).groupBy(*keys, "term").agg(
        *[F.sum(f"n_{c}").cast("bigint").alias(f"n_{c}") for c in lists])
    return parts.join(side, keys, "left_anti"), summed


def run_order(table: pa.Table, by: list[str]) -> np.ndarray:
    """Stable order of the rows by a few columns, through the ranks of their values."""
    code = np.zeros(table.num_rows, dtype=np.int64)
    for c in by:
        column = table.column(c).combine_chunks()
        column = (column if isinstance(column, pa.Array) else column.chunk(0)).dictionary_encode(null_encoding="encode")
        rank = np.empty(len(column.dictionary), dtype=np.int64)
        rank[pc.sort_indices(column.dictionary).to_numpy()] = np.arange(len(rank))
        code = code * max(1, len(rank)) + rank[column.indices.to_numpy(zero_copy_only=False)]
    return np.argsort(code, kind="stable")


def sorted_runs(df: DataFrame, by: list[str], run_rows: int = RUN_ROWS) -> DataFrame:
    """The rows of ``df``; a task's rows follow each other in sorted runs."""
    return df.mapInArrow(lambda batches: run_batches(batches, by, run_rows), df.schema)


def run_batches(batches: Iterator[pa.RecordBatch], by: list[str], run_rows: int = RUN_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in sorted runs."""
    for table in gathered(batches, lambda b: b.num_rows, run_rows):
        order = run_order(table, by)
        for lo in range(0, len(order), OUT_ROWS):
            yield from table.take(pa.array(order[lo:lo + OUT_ROWS])).combine_chunks().to_batches()


def gathered(batches: Iterator[pa.RecordBatch], rows_of, run_rows: int) -> Iterator[pa.Table]:
    """Batches put together until they make up a run."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += rows_of(batch)
        if n >= run_rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def unpacked_runs(parts: DataFrame, keys: list[str], lists: list[str], by: list[str], run_rows: int = RUN_ROWS) -> DataFrame:
    """(keys..., term, n_<list>..., len_<list>...) of packed rows in sorted runs."""
    single = [*keys, *[f"len_{c}" for c in lists]]
    many = ["term", *[f"n_{c}" for c in lists]]
    out = [*keys, *many, *[f"len_{c}" for c in lists]]
    types = {f.name: f.dataType.elementType if f.name in many else f.dataType for f in parts.schema}
    schema = StructType([StructField(c, types[c]) for c in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smaller = (b.slice(lo, BATCH_ROWS) for b in batches for lo in range(0, b.num_rows, BATCH_ROWS))
        for table in gathered(smaller, lambda b: len(b.column("term").flatten()), run_rows):
            table = table.combine_chunks()
            packed = table.to_batches()[0]
            row = np.repeat(np.arange(packed.num_rows), packed.column("term").value_lengths().to_numpy(zero_copy_only=False))
            flat = {c: packed.column(c).flatten() for c in many}
            repeated = pa.array(row)
            keyed = {c: flat[c] if c in flat else packed.column(c).take(repeated) for c in by}
            order = run_order(pa.table(keyed), by)
            for lo in range(0, len(order), OUT_ROWS):
                at = order[lo:lo + OUT_ROWS]
                entries, rows = pa.array(at), pa.array(row[at])
                yield pa.RecordBatch.from_arrays(
                    [(flat[c].take(entries) if c in flat else packed.column(c).take(rows)) for c in out], names=out)

    return parts.select(*single, *many).mapInArrow(run, schema)
