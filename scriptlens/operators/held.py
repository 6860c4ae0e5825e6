"""Documents of a batch of queries, from the parts that their texts hold.

The parts of a batch (bounded by ``search.PARTS_PER_PASS``) are numbered and held by
the tasks. Every text is read once and answers with the numbers of its parts; only
these numbers are shuffled, one short list per document, merged before that for the
rows of a task. A document's queries are then told from its list, so no row is made
for a (text, part) or (document, part) pair.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

ANCHOR_CHARS = 3
ANCHOR_SIZES = (5, ANCHOR_CHARS)    # a part's anchor is a piece of the greatest size that it has
ROWS = 512                  # texts or documents worked on at a time
CELLS = 2_000_000           # (document, query) cells counted at a time


MARK_BITS = 20              # of the marks that tell the anchors in a text


def hash_text(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def piece_marks(points: np.ndarray, size: int) -> np.ndarray:
    """A mark of ``MARK_BITS`` bits for every piece of ``size`` characters."""
    n = len(points) - size + 1
    out = points[:n].copy()
    for k in range(1, size):
        out *= np.uint32(0x01000193)
        out += points[k:n + k]
    out *= np.uint32(0x9E3779B1)
    out >>= np.uint32(32 - MARK_BITS)
    return out


class PartTable:
    """The distinct parts, and the queries that ask for them. A query is one
    (query_id, qtype, n_parts); a slot is one place in its list of parts."""

    def __init__(self, rows: list):
        self.parts = sorted({r["part"] for r in rows})
        number = {p: i for i, p in enumerate(self.parts)}
        queries: dict[tuple, int] = {}
        slots: dict[tuple, int] = {}
        asked: list[set[int]] = [set() for _ in self.parts]
        for r in rows:
            query = queries.setdefault((r["query_id"], r["qtype"], r["n_parts"]), len(queries))
            asked[number[r["part"]]].add(slots.setdefault((query, r["part_idx"]), len(slots)))
        self.query_ids = [q[0] for q in queries]
        self.needs = np.array([q[2] if q[1] == "and" else 1 for q in queries], dtype=np.int64)
        self.exact = np.array([q[1] == "and" for q in queries], dtype=bool)
        self.query_of = np.array([q for q, _ in slots], dtype=np.int64)
        self.sizes = np.array([len(a) for a in asked], dtype=np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.slots = np.array([s for a in asked for s in sorted(a)], dtype=np.int64)
        self.shared = len(self.slots) > len(slots)      # a slot that several parts fill

    def short(self) -> list[int]:
        """Parts without a trigram."""
        return [i for i, p in enumerate(self.parts) if len(p) < ANCHOR_CHARS]

    def finder(self) -> Callable[[str], list[int]]:
        """Text -> numbers of the parts in it: a part is looked for where the text
        holds the mark of its anchor, of its pieces of a size one that fewest parts have."""
        parts, short = self.parts, self.short()
        pieces: list[tuple[int, int, set[str]]] = []
        for i, p in enumerate(parts):
            size = next((n for n in ANCHOR_SIZES if n <= len(p)), None)
            if size:
                pieces.append((i, size, {p[k:k + size] for k in range(len(p) - size + 1)}))
        shared = Counter(x for _, _, held in pieces for x in held)
        anchored: dict[int, dict[int, list[int]]] = {}
        for i, size, held in pieces:
            anchor = min(held, key=lambda x: (shared[x], hash_text(x), x))
            anchored.setdefault(size, {}).setdefault(int(piece_marks(code_points(anchor), size)[0]), []).append(i)
        kinds = []
        for size, parts_of in anchored.items():
            marked = np.zeros(1 << MARK_BITS, dtype=bool)
            marked[list(parts_of)] = True
            kinds.append((size, marked, parts_of))

        def find(text: str) -> list[int]:
            found = [i for i in short if parts[i] in text]
            points = code_points(text)
            for size, marked, parts_of in kinds:
                if len(points) >= size:
                    marks = piece_marks(points, size)
                    held = set(marks[marked[marks]].tolist())
                    found += [i for a in held for i in parts_of[a] if parts[i] in text]
            return found

        return find

    def hits(self, sizes: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Documents x queries: the slots that these part numbers (distinct in each) fill."""
        n = len(self.needs)
        row = np.repeat(np.arange(len(sizes)), sizes)
        times = self.sizes[held]
        stops = np.cumsum(times)
        at = np.repeat(self.first[held] - (stops - times), times) + np.arange(int(times.sum()))
        code = np.repeat(row, times) * len(self.query_of) + self.slots[at]
        if self.shared:
            code = np.unique(code)
        cells = code // len(self.query_of) * n + self.query_of[code % len(self.query_of)]
        return np.bincount(cells, minlength=len(sizes) * n).reshape(len(sizes), n)

    def matches(self, sizes: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, query) of documents with these part numbers."""
        hit = self.hits(sizes, held)
        return np.nonzero(np.where(self.exact, hit == self.needs, hit >= 1))


def held_parts(texts: DataFrame, keys: list[str], table: PartTable, text_col: str,
               asked_col: str | None = None, grouped: bool = True) -> DataFrame:
    """(keys..., held): the numbers of the parts that a document's texts hold, for
    documents that hold any. With ``asked_col`` only those parts and the short ones
    are looked for in a text, all parts where it is null. Documents of one row each
    need not be ``grouped``: then nothing is shuffled."""
    shared = texts.sparkSession.sparkContext.broadcast(table)
    schema = StructType([texts.schema[k] for k in keys] + [StructField("held", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, short, find = shared.value.parts, shared.value.short(), shared.value.finder()
        for batch in batches:
            merged: dict[tuple, list] = {}      # document -> (its row here, its parts)
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                names = zip(*[part.column(k).to_pylist() for k in keys])
                texts_here = part.column(text_col).to_pylist()
                if asked_col is None:
                    found = map(find, texts_here)
                else:
                    found = (find(text) if asked is None else [i for i in asked + short if parts[i] in text]
                             for asked, text in zip(part.column(asked_col).to_pylist(), texts_here))
                for row, (name, numbers) in enumerate(zip(names, found), lo):
                    if numbers:
                        merged.setdefault(name, [row, set()])[1].update(numbers)
            kept = batch.select(keys).take(pa.array([row for row, _ in merged.values()], pa.int64()))
            held = pa.array([list(numbers) for _, numbers in merged.values()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*kept.columns, held], names=[*keys, "held"])

    columns = [*keys, text_col, *([asked_col] if asked_col else [])]
    found = texts.select(*columns).mapInArrow(run, schema)
    if not grouped:
        return found
    return found.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"))


def queries_of(held: DataFrame, keys: list[str], table: PartTable, query_id_type) -> DataFrame:
    """(query_id, keys...) of the documents that match each query."""
    shared = held.sparkSession.sparkContext.broadcast(table)
    schema = StructType([held.schema[k] for k in keys] + [StructField("query_ids", ArrayType(query_id_type))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        ids = pa.array(table.query_ids, to_arrow_type(query_id_type))
        step = max(1, min(ROWS, CELLS // max(1, len(ids))))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                numbers = part.column("held")
                row, query = table.matches(numbers.value_lengths().to_numpy(zero_copy_only=False),
                                           numbers.flatten().to_numpy(zero_copy_only=False))
                stops = np.cumsum(np.bincount(row, minlength=part.num_rows))
                lists = pa.ListArray.from_arrays(np.concatenate([[0], stops]).astype(np.int32), ids.take(pa.array(query)))
                yield pa.RecordBatch.from_arrays([*part.select(keys).columns, lists], names=[*keys, "query_ids"])

    found = held.mapInArrow(run, schema)
    return found.select(F.explode("query_ids").alias("query_id"), *keys)
