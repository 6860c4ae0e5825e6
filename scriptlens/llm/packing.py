"""Op 10, best-fit packing by linear grouping.

Documents are tokenised, closed with an end id and cut into pieces of at most
``CAPACITY`` tokens. What has to be packed is then only a histogram of at most
``CAPACITY`` lengths, whatever the corpus size:

1. large lengths are put, longest first, into groups of equal cardinality and
   rounded up to the group's maximum;
2. the few rounded sizes form a cutting-stock programme; column generation with
   a knapsack over the capacity finds its optimal configurations, whose whole
   parts are used;
3. every configuration slot takes actual pieces of its group, so bins keep the
   room that rounding had reserved;
4. the rest and the small pieces go, longest first, into the tightest bin that
   holds them, new bins only when none does.

The plan is a list of runs (length, first rank, count, first bin, offset): pieces
of one length with consecutive ranks in consecutive bins at one offset. Pieces
are ranked within their length in Spark and join their run.

Defined results: null text is one piece holding the end id; repeated rows are
packed each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptlens.llm.common import add_columns, stored
from scriptlens.llm.numbering import numbered
from scriptlens.llm.tokens import ENCODER, shared_encoder, tokenizer_path

CAPACITY = 4096
# (rounded sizes of the programme, large means over capacity / that): each is
# planned and the one with the fewest bins taken
CHOICES = ((8, 4), (16, 4), (6, 3), (8, 2))
PRICING_ROUNDS = 600
BROADCAST_RUNS = 200_000


def pieces_of(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
              id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and the ids)."""
    path = path or tokenizer_path()
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    ddl = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint" + (
        ",ids:binary>>" if with_ids else ">>")
    if with_ids:
        fields.append(("ids", pa.binary()))

    def make():
        encoder = shared_encoder(path)

        def run(texts: list) -> list:
            ids, ends = encoder.encode(texts)
            out, begin = [], 0
            for end in ends.tolist():
                cut = []
                for piece, at in enumerate(range(begin, end, capacity)):
                    raw = ids[at:min(at + capacity, end)].astype("<u4").tobytes()
                    row = {"piece": piece, "start": at - begin, "length": len(raw) // 4,
                           "ids_crc32": zlib.crc32(raw)}
                    cut.append(row | {"ids": raw} if with_ids else row)
                out.append(cut)
                begin = end
            return [out]

        return run

    cut = add_columns(docs, text_col, make, [("cut_pieces", ddl, pa.list_(pa.struct(fields)))], [id_col], keeps=ENCODER)
    return cut.select(id_col, F.inline("cut_pieces"))


# --- the plan, from the histogram of lengths ---------------------------------

def equal_groups(counts: np.ndarray, smallest: int, groups: int) -> list[list[tuple[int, int]]]:
    """Lengths of at least ``smallest``, longest first, in groups of equal
    cardinality; a group is a list of (length, count)."""
    total = int(counts[smallest:].sum())
    quota, out, current, room = -(-total // groups) if total else 0, [], [], 0
    for length in range(len(counts) - 1, smallest - 1, -1):
        left = int(counts[length])
        while left:
            if not room:
                current, room = [], quota
                out.append(current)
            take = min(left, room)
            current.append((length, take))
            left, room = left - take, room - take
    return out


def best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the configuration of greatest price."""
    value = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        fits = np.flatnonzero(sizes <= room)
        if len(fits):
            tried = value[room - sizes[fits]] + prices[fits]
            k = int(tried.argmax())
            if tried[k] > value[room] + 1e-12:
                value[room], pick[room] = tried[k], fits[k]
    pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            pattern[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return float(value[capacity]), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole parts of an optimal fractional solution of the cutting-stock
    programme, by column generation with an explicit basis."""
    n = len(sizes)
    basis = [np.where(np.arange(n) == k, capacity // sizes[k], 0) for k in range(n)]
    matrix = np.array(basis, dtype=float).T
    for _ in range(PRICING_ROUNDS):
        inverse = np.linalg.inv(matrix)
        amount = inverse @ demand
        prices = np.ones(n) @ inverse
        value, pattern = best_pattern(sizes, prices, capacity)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ pattern
        ratios = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(ratios.argmin())
        basis[leave] = pattern
        matrix[:, leave] = pattern
    amount = np.linalg.inv(matrix) @ demand
    return [(pattern, int(np.floor(x + 1e-9))) for pattern, x in zip(basis, amount) if x >= 1]


class Bins:
    """Ranges of bins by the room they have left."""

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, 0
        self.rooms: list[int] = []
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def put(self, room: int, first: int, n: int) -> None:
        if n and room:
            if room not in self.ranges:
                insort(self.rooms, room)
                self.ranges[room] = []
            self.ranges[room].append((first, n))

    def new(self, n: int) -> int:
        first, self.count = self.count, self.count + n
        return first

    def tightest(self, length: int) -> tuple[int, int, int] | None:
        k = bisect_left(self.rooms, length)
        if k == len(self.rooms):
            return None
        room = self.rooms[k]
        first, n = self.ranges[room].pop()
        if not self.ranges[room]:
            del self.ranges[room], self.rooms[k]
        return room, first, n


def plan(counts: np.ndarray, capacity: int = CAPACITY,
         choices: tuple[tuple[int, int], ...] = CHOICES) -> tuple[list[tuple], int]:
    """Runs (length, first rank, count, first bin, offset) and the number of bins."""
    return min((grouped_plan(counts, capacity, g, share) for g, share in choices), key=lambda p: p[1])


def grouped_plan(counts: np.ndarray, capacity: int, groups: int, share: int) -> tuple[list[tuple], int]:
    counts = counts.astype(np.int64).copy()
    runs: list[tuple[int, int, int, int, int]] = []
    bins = Bins(capacity)
    rank = np.zeros(capacity + 1, dtype=np.int64)

    def take(length: int, n: int, first_bin: int, offset: int) -> None:
        runs.append((length, int(rank[length]), n, first_bin, offset))
        rank[length] += n
        counts[length] -= n

    if counts[capacity]:
        take(capacity, int(counts[capacity]), bins.new(int(counts[capacity])), 0)
    members = equal_groups(counts, capacity // share + 1, groups)
    # equal maxima of neighbouring groups are one size of the programme
    merged: dict[int, list[tuple[int, int]]] = {}
    for group in members:
        merged.setdefault(group[0][0], []).extend(group)
    if merged:
        sizes = np.array(list(merged), dtype=np.int64)
        queues = [list(merged[s]) for s in merged]
        demand = np.array([sum(n for _, n in q) for q in queues], dtype=float)
        for pattern, times in configurations(sizes, demand, capacity):
            times = min([times] + [sum(n for _, n in queues[k]) // int(c) for k, c in enumerate(pattern) if c])
            if times <= 0:
                continue
            first = bins.new(times)
            parts = [(first, times, 0)]     # (first bin, bins, used)
            for k, copies in enumerate(pattern):
                for _ in range(int(copies)):
                    fresh = []
                    for begin, n, used in parts:
                        while n:
                            length, have = queues[k].pop(0)
                            m = min(n, have)
                            if have > m:
                                queues[k].insert(0, (length, have - m))
                            take(length, m, begin, used)
                            fresh.append((begin, m, used + length))
                            begin, n = begin + m, n - m
                    parts = fresh
            for begin, n, used in parts:
                bins.put(capacity - used, begin, n)
    for length in range(capacity, 0, -1):
        while counts[length]:
            left = int(counts[length])
            found = bins.tightest(length)
            if found is None:
                n = -(-left // (capacity // length))
                found = (capacity, bins.new(n), n)
            room, first, n = found
            m = min(n, left)
            take(length, m, first, capacity - room)
            bins.put(room - length, first, m)
            bins.put(room, first + m, n - m)
    return runs, bins.count


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    pieces = stored(pieces_of(docs, path, capacity, id_col, text_col), "pieces")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():    # at most ``capacity`` rows
        histogram[r["length"]] = r["count"]
    runs, _ = plan(histogram, capacity)
    schema = "length long, run_rank long, run_n long, run_bin long, run_offset long"
    table = spark.createDataFrame(
        pd.DataFrame(runs, columns=["length", "run_rank", "run_n", "run_bin", "run_offset"], dtype="int64"), schema)
    # the written rows' own numbers tell repeated rows apart, so none of them meet
    rows = pieces.withColumn("piece_row", F.monotonically_increasing_id())
    ranked = numbered(rows, ["length"], F.xxhash64(id_col, "piece", "ids_crc32", "piece_row"),
                      [id_col, "piece", "ids_crc32", "piece_row"], int(histogram.sum()), "length_rank")
    if len(runs) <= BROADCAST_RUNS:     # 40 bytes a run
        table = F.broadcast(table)
    inside = ((F.col("length_rank") >= F.col("run_rank"))
              & (F.col("length_rank") < F.col("run_rank") + F.col("run_n")))
    joined = ranked.join(table.withColumnRenamed("length", "run_length"),
                         (F.col("length") == F.col("run_length")) & inside)
    return joined.select(id_col, "piece", "start", "length", "ids_crc32",
                         (F.col("run_bin") + F.col("length_rank") - F.col("run_rank")).alias("sequence_id"),
                         F.col("run_offset").alias("offset"))
