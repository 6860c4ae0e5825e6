"""Ranked matches of a query batch, document by document (M1, M2).

A batch's matches are documents times queries, so none of them becomes a row that is
shuffled. A document arrives as one row: the numbers of the parts that it holds
(``held``) and the weights of the query terms that it has. Its task tells from these
which queries it matches, adds up their scores and title hits, and keeps the first
``k`` documents of every query (and show). Only those rows leave the task; ranks among
the tasks' rows are the caller's window.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .held import PartTable
from .index import DOC_KEYS

CELLS = 500_000             # (document, query) cells scored at a time
KEPT_ROWS = 200_000         # rows that a task collects before it cuts them to the first of each group
DIGITS = Decimal("0.000001")


def half_up(x: np.ndarray) -> np.ndarray:
    """Rounded to six digits, halves away from zero, by the shortest decimals."""
    scaled = np.abs(x) * 1e6
    out = np.copysign(np.floor(scaled + 0.5) / 1e6, x) + 0.0
    for i in np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3)[0]:
        out[i] = float(Decimal(repr(float(x[i]))).quantize(DIGITS, ROUND_HALF_UP)) + 0.0
    return out


class BatchTable:
    """The parts, display parts and terms of a batch's queries, numbered alike."""

    def __init__(self, parts: list, display: list, terms: dict[str, int], asked: list):
        """``parts`` and ``display``: rows of (query_id, qtype, n_parts, part_idx, part);
        ``asked``: rows of (query_id, term, qtf)."""
        self.parts, self.titles = PartTable(parts), PartTable(display)
        number = {q: i for i, q in enumerate(self.parts.query_ids)}
        self.title_query = np.array([number[q] for q in self.titles.query_ids], dtype=np.int64)
        of_term: list[list[tuple]] = [[] for _ in terms]
        for r in asked:
            if r["query_id"] in number:
                of_term[terms[r["term"]]].append((number[r["query_id"]], r["qtf"]))
        self.sizes = np.array([len(a) for a in of_term], dtype=np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.query = np.array([q for a in of_term for q, _ in a], dtype=np.int64)
        self.qtf = np.array([n for a in of_term for _, n in a], dtype=np.float64)

    def scores(self, sizes: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Documents x queries: the sum of the weights of each query's terms."""
        n = len(self.parts.query_ids)
        times = self.sizes[term]
        stops = np.cumsum(times)
        at = np.repeat(self.first[term] - (stops - times), times) + np.arange(int(times.sum()))
        cells = np.repeat(np.repeat(np.arange(len(sizes)), sizes), times) * n + self.query[at]
        return np.bincount(cells, np.repeat(weight, times) * self.qtf[at], len(sizes) * n).reshape(len(sizes), n)

    def title_hits(self, titles: list[str], find) -> np.ndarray:
        """Documents x queries: how many display parts the lower-cased title holds."""
        out = np.zeros((len(titles), len(self.parts.query_ids)), dtype=np.int64)
        found = [find(t) for t in titles]
        held = np.array([i for f in found for i in f], dtype=np.int64)
        out[:, self.title_query] = self.titles.hits(np.array([len(f) for f in found], dtype=np.int64), held)
        return out


class FirstRows:
    """The first ``k`` rows of every group so far, and the scores to reach."""

    def __init__(self, k: int, n_queries: int, per_show: bool):
        self.k, self.n, self.per_show = k, n_queries, per_show
        self.shows: dict = {}
        self.least = np.zeros(0)
        self.held: list[pa.Table] = []
        self.limit = KEPT_ROWS

    def show_numbers(self, column: pa.Array) -> np.ndarray:
        if not self.per_show:
            column = pa.nulls(len(column))
        numbers = np.array([self.shows.setdefault(s, len(self.shows)) for s in column.to_pylist()], dtype=np.int64)
        more = len(self.shows) * self.n - len(self.least)
        self.least = np.concatenate([self.least, np.full(more, -np.inf)])
        return numbers

    def add(self, rows: pa.Table) -> None:
        self.held.append(rows)
        if sum(t.num_rows for t in self.held) > self.limit:
            self.cut()
            self.limit = max(KEPT_ROWS, 2 * self.held[0].num_rows)

    def cut(self) -> None:
        rows = pa.concat_tables(self.held).combine_chunks()
        group, score = rows.column("group").to_numpy(), rows.column("relevance_score").to_numpy()
        ranks = []
        for c in ("episode_title", "episode", "season"):
            values = rows.column(c).combine_chunks()
            values = (values if isinstance(values, pa.Array) else values.chunk(0)).dictionary_encode()
            rank = np.empty(len(values.dictionary), dtype=np.int64)
            rank[pc.sort_indices(values.dictionary).to_numpy()] = np.arange(len(rank))
            ranks.append(rank[values.indices.to_numpy()])
        order = np.lexsort((*ranks, -score, group))
        sorted_group = group[order]
        starts = np.searchsorted(sorted_group, sorted_group)
        place = np.arange(len(order)) - starts
        last = order[place == self.k - 1]
        self.least[group[last]] = score[last]
        self.held = [rows.take(pa.array(order[place < self.k]))]


def first_matches(docs: DataFrame, table: BatchTable, k: int, boost: float, per_show: bool, query_id_type) -> DataFrame:
    """(query_id, document keys, bm25_score, title_hit_count, relevance_score) of the
    matches that are among their task's first ``k`` of the query (and show).

    ``docs``: document keys, ``title`` (lower-cased), ``held``, ``term``, ``weight``."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    schema = StructType([StructField("query_id", query_id_type), *[docs.schema[c] for c in DOC_KEYS],
                         StructField("bm25_score", DoubleType()), StructField("title_hit_count", LongType()),
                         StructField("relevance_score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        find, n = table.titles.finder(), len(table.parts.query_ids)
        ids, first = pa.array(table.parts.query_ids, to_arrow_type(query_id_type)), FirstRows(k, n, per_show)
        step = max(1, CELLS // max(1, n))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                row, query = table.parts.matches(*lengths_and_values(part, "held"))
                sizes, term = lengths_and_values(part, "term")
                score = table.scores(sizes, term, part.column("weight").flatten().to_numpy(zero_copy_only=False))[row, query]
                hits = table.title_hits([t or "" for t in part.column("title").to_pylist()], find)[row, query]
                group = first.show_numbers(part.column("show_key"))[row] * n + query
                total = score + hits * boost
                near = total + 1e-6 >= first.least[group]           # rounded below
                row, query, score, hits, group, total = (a[near] for a in (row, query, score, hits, group, total))
                first.add(pa.table(
                    [ids.take(pa.array(query)), *part.select(DOC_KEYS).take(pa.array(row)).columns, pa.array(half_up(score)),
                     pa.array(hits), pa.array(half_up(total)), pa.array(group)], names=[*schema.names, "group"]))
        if first.held:
            first.cut()
            yield from first.held[0].drop_columns("group").combine_chunks().to_batches()

    return docs.select(*DOC_KEYS, "title", "held", "term", "weight").mapInArrow(run, schema)


def lengths_and_values(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A list column's lengths (null: 0) and its values one after the other."""
    column = batch.column(name)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return sizes.astype(np.int64), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
