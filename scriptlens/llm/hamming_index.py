"""Op 13, nearest neighbours by multi-index hashing of learned binary codes.

Unit vectors are centred, turned by rotations learned by iterative quantisation
(alternating the sign codes and the orthogonal map that fits them best) on a
bounded sample, and cut to ``BITS`` signs. A code is split into substrings of 16
bits, each with its own index. Of two codes within Hamming radius r, some substring
differs in at most r // m bits (the pigeonhole bound), so probing the buckets
around each substring of the query finds every code within r; these are reranked
by the cosine of the original vectors in double precision. Up to 64 queries probe
together: a bucket then holds the queries that it is near to as bits of one word.

The radius is learned too: ``CALIBRATION`` queries are compared with every row, and
the radius holds the share ``TARGET`` of their true neighbours. A query that
finds fewer than ``k`` rows goes on with a wider radius, at last with one that holds
every code, so nobody's candidates are capped.

Every row is indexed, in blocks of bounded memory dealt by a hash of the row;
queries are sent to every block and stream through it in Arrow batches, and the
best ``k`` of all blocks meet in one grouped top-k. Rows with one id are spread.

Defined results: rows without id and vectors that are null, empty, zero or hold
null or non-finite components take no part; shorter vectors count as padded with
zeros; an id that occurs with several vectors is as near as the nearest of them
and never its own neighbour; an empty table gives no rows; further columns are
ignored. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, IntegralType, StructField, StructType

from scriptlens.llm.common import stored

BITS = 256
SUB = 16                    # bits of a substring: one 65,536-bucket index each
SAMPLE_ROWS = 10_000        # bound of the sample the rotations are fitted on
SAMPLE_VALUES = 4_000_000   # and of its components
ITERATIONS = 25
CALIBRATION = 200           # queries whose true neighbours set the radius
TARGET = 0.97
WIDER = 1.25                # growth of the radius for queries that found too few
BLOCK_ROWS = 100_000        # rows of an index block
BLOCK_VALUES = 8_000_000    # and its components
LEAST_ROWS = 1_500          # blocks are not cut finer than this for more tasks
LISTED = 40                 # keys in use for each bucket that is listed instead
SEED = 13


# --- codes ---------------------------------------------------------------------

def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles, padded with zeros, scaled by a power of
    two so that squares neither vanish nor overflow."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - starts[row]] = flat
    if len(sizes):
        _, exponent = np.frexp(np.abs(out).max(axis=1))
        out = np.ldexp(out, -exponent[:, None])
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def fit_codes(sample: np.ndarray, bits: int = BITS, seed: int = SEED) -> dict:
    """Mean and map (components x bits) learned from unit vectors. Wide vectors are
    first cut to their leading principal axes; each rotation gives as many bits
    as axes, and as many rotations are learned as the code needs."""
    rng = np.random.default_rng(seed)
    width = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(width)
    rows = sample - mean
    _, axes = np.linalg.eigh(rows.T @ rows if len(rows) else np.eye(width))
    axes = axes[:, ::-1][:, :min(width, bits)]
    low = rows @ axes
    parts = []
    for _ in range(-(-bits // axes.shape[1])):
        turn, _ = np.linalg.qr(rng.standard_normal((axes.shape[1],) * 2))
        for _ in range(ITERATIONS if len(low) else 0):
            u, _, v = np.linalg.svd(low.T @ np.where(low @ turn >= 0, 1.0, -1.0))
            turn = u @ v
        parts.append(axes @ turn)
    return {"mean": mean, "map": np.concatenate(parts, axis=1)[:, :bits]}


def codes_of(rows: np.ndarray, model: dict) -> np.ndarray:
    """Sign codes as bytes, one row each."""
    return np.packbits((unit(rows) - model["mean"]) @ model["map"] >= 0, axis=1)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Hamming distances of codes (rows of 64-bit words)."""
    return np.bitwise_count(codes ^ code).sum(axis=-1, dtype=np.int64)


# --- one block -------------------------------------------------------------------

POPULATION = np.bitwise_count(np.arange(1 << SUB, dtype=np.uint32)).astype(np.uint8)
BY_POPULATION = np.argsort(POPULATION, kind="stable").astype(np.int64)
WITHIN = np.cumsum(np.bincount(POPULATION, minlength=SUB + 1))


def substring_radii(radius: int, parts: int) -> list[int]:
    """Radii of the substrings by the pigeonhole bound: a code within ``radius``
    is within one of them; -1 where a substring needs no probing."""
    each, more = divmod(radius, parts)
    return [each if k <= more else each - 1 for k in range(parts)]


QUERIES = 64                # probed together: one bit of a word each
BYTES = np.arange(256, dtype=np.uint8)


def ball_queries(subs: np.ndarray, near: int) -> np.ndarray:
    """For every bucket of a substring, a word whose bits are the queries within the
    radius. A key's distance is that of its two bytes, so the buckets are the pairs of
    a high byte at a distance and a low byte at what is left of the radius at most."""
    high, low = ((subs >> np.uint16(shift)).astype(np.uint8) for shift in (8, 0))
    steps = np.arange(min(near, 8) + 1, dtype=np.uint8)[:, None, None]
    exact = bit_words(np.bitwise_count(BYTES[:, None] ^ high) == steps)
    least = bit_words(np.bitwise_count(BYTES[:, None] ^ low) <= np.arange(near + 1, dtype=np.uint8)[:, None, None])
    out, part = np.zeros((256, 256), dtype=np.uint64), np.empty((256, 256), dtype=np.uint64)
    for a, words in enumerate(exact):
        np.bitwise_and(words[:, None], least[near - a], out=part)
        out |= part
    return out.reshape(-1)


def bit_words(held: np.ndarray) -> np.ndarray:
    """The last axis (up to 64 truth values) as a word, the first value its lowest bit."""
    wide = np.zeros((*held.shape[:-1], QUERIES), dtype=bool)
    wide[..., :held.shape[-1]] = held
    return np.packbits(wide, axis=-1, bitorder="little").view("<u8")[..., 0]


class Block:
    """Substring indexes over the codes of some rows."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        codes = np.ascontiguousarray(codes)
        self.words = np.ascontiguousarray(codes.view(np.uint64).T)      # a word of all codes lies together
        self.norm = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
        self.unique = len(np.unique(ids)) == len(ids)
        self.subs = np.ascontiguousarray(codes.view(np.uint16).T)
        self.parts = len(self.subs)
        self.keys, self.order, self.start = [], [], []
        for subs in self.subs:
            sizes = np.bincount(subs, minlength=1 << SUB)
            self.keys.append(np.flatnonzero(sizes))
            self.order.append(np.argsort(subs, kind="stable").astype(np.int32))
            self.start.append(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))

    def probed(self, subs: np.ndarray, radius: int) -> np.ndarray:
        """For every row a word whose bits are the queries (up to ``QUERIES``) with a
        probed bucket that holds the row. A substring's buckets are listed for each
        query if they are few against the keys in use, else told for all queries at once."""
        hit = np.zeros(len(self.ids), dtype=np.uint64)
        for k, near in enumerate(substring_radii(radius, self.parts)):
            if near < 0:
                continue
            if near >= SUB:
                hit[:] = ~np.uint64(0)
                break
            if WITHIN[near] * LISTED < len(self.keys[k]):
                for j, sub in enumerate(subs[:, k].tolist()):
                    hit[self.listed(k, BY_POPULATION[:WITHIN[near]] ^ sub)] |= np.uint64(1 << j)
            else:
                hit |= ball_queries(subs[:, k], near)[self.subs[k]]
        return hit

    def listed(self, k: int, probe: np.ndarray) -> np.ndarray:
        """Places of the rows in these buckets of a substring."""
        first = self.start[k][probe].astype(np.int64)
        sizes = self.start[k][probe + 1] - first
        stops = np.cumsum(sizes)
        return self.order[k][np.repeat(first - (stops - sizes), sizes) + np.arange(int(stops[-1]))]

    def all_within(self, codes: np.ndarray, radius: int) -> Iterator[np.ndarray]:
        """For every code the places of all codes within the radius."""
        codes = np.ascontiguousarray(codes)
        for lo in range(0, len(codes), QUERIES):
            part = codes[lo:lo + QUERIES]
            hit = self.probed(part.view(np.uint16), radius)
            for j, code in enumerate(part.view(np.uint64)):
                held = (hit & np.uint64(1 << j)) != 0
                if np.count_nonzero(held) * 4 > len(held):
                    yield np.flatnonzero(held & (self.apart(self.words, code) <= radius))
                else:
                    places = np.flatnonzero(held)
                    yield places[self.apart(self.words[:, places], code) <= radius]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of all codes within the radius."""
        return next(self.all_within(code[None], radius))

    @staticmethod
    def apart(words: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Hamming distances of codes (a column each) from a code."""
        out = np.zeros(words.shape[1], dtype=np.uint16)
        for column, word in zip(words, code):
            out += np.bitwise_count(column ^ word)
        return out

    def nearest(self, query: int, row: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the ``k`` best other ids at these places."""
        places = places[self.ids[places] != query]
        # sums by row: a vector's cosine does not depend on its neighbours
        score = (self.rows[places] * row).sum(axis=1) / (self.norm[places] * np.sqrt((row * row).sum()))
        if self.unique and len(places) > 4 * k:
            best = score >= np.partition(score, -k)[-k]
            places, score = places[best], score[best]
        ids = self.ids[places]
        order = np.lexsort((ids, -score))
        if not self.unique:
            order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
        return ids[order[:k]], score[order[:k]]


# --- the Spark side ----------------------------------------------------------------

def usable_vectors(table: DataFrame, queries: Column, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector, asks) of the rows that take part; components keep their values."""
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"),
                         F.coalesce(queries, F.lit(False)).alias("asks"))
            .where(F.col("id").isNotNull() & F.col("vector").isNotNull() & sound & F.exists("vector", lambda x: x != 0)))


def coded(vectors: DataFrame, model: dict, width: int) -> DataFrame:
    """Add the code; vectors become packed doubles, scaled by a power of two."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    schema = StructType([vectors.schema["id"]] + list(StructType.fromDDL(
        "asks boolean, code binary, packed binary").fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                rows = matrix(part.column("vector"), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("asks"),
                     pa.array([c.tobytes() for c in codes_of(rows, shared.value)], pa.binary()),
                     pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "asks", "code", "packed"])

    return vectors.mapInArrow(run, schema)


def unpacked(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def learned_radius(index: DataFrame, width: int, k: int, target: float) -> int:
    """Hamming radius that holds the share ``target`` of the true neighbours of
    ``CALIBRATION`` queries (chosen by hash), which are compared with every row."""
    asked = (index.where("asks").orderBy(F.xxhash64("id", "code"), "id", "code").limit(CALIBRATION)
             .select("id", "code", "packed").toArrow().combine_chunks())
    if not asked.num_rows:
        return 0
    shared = index.sparkSession.sparkContext.broadcast((
        asked.column("id").to_numpy(), unpacked(asked.column("code"), np.uint64, BITS // 64),
        unit(unpacked(asked.column("packed"), np.float64, width))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, codes, rows = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                score = unit(unpacked(part.column("packed"), np.float64, width)) @ rows.T
                score[part.column("id").to_numpy()[:, None] == ids] = -np.inf
                own = unpacked(part.column("code"), np.uint64, BITS // 64)
                n = min(k, part.num_rows)
                best = np.argpartition(-score, n - 1, axis=0)[:n]
                at, query = best.T.reshape(-1), np.repeat(np.arange(len(ids)), n)
                value = score[at, query]
                at, query, value = at[value > -np.inf], query[value > -np.inf], value[value > -np.inf]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query), pa.array(value), pa.array(distances(own[at], codes[query]))],
                    names=["query", "score", "distance"])

    top = Window.partitionBy("query").orderBy(F.desc("score"), "distance")
    near = (index.mapInArrow(run, "query bigint, score double, distance bigint")
            .withColumn("place", F.row_number().over(top)).where(F.col("place") <= k)
            .select("distance").toArrow().column("distance").to_numpy())    # CALIBRATION * k rows at most
    if not len(near):
        return 0
    return int(np.sort(near)[min(len(near) - 1, int(np.ceil(target * len(near))) - 1)])


def probe(index: DataFrame, asking: DataFrame, blocks: int, width: int, radius: int, k: int) -> DataFrame:
    """(query_id, id, score): the best ``k`` of every block within the radius."""
    rows = index.select(F.pmod(F.xxhash64("id", "code", "packed"), F.lit(blocks)).cast("int").alias("block"),
                        F.lit(False).alias("asks"), "id", "code", "packed")
    sent = asking.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                         F.lit(True).alias("asks"), "id", "code", "packed")
    dealt = rows.unionByName(sent).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number = block = None
        for batch in batches:
            kind = batch.column("block").to_numpy().astype(np.int64) * 2 + batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(kind, prepend=-1)).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                if kind[lo] // 2 != number:
                    number, block, held = kind[lo] // 2, None, []
                if kind[lo] % 2 == 0:
                    held.append(part)
                    continue
                if not held and block is None:
                    continue        # a block without rows
                if block is None:
                    block = Block(*(np.concatenate(c) for c in zip(*[
                        (p.column("id").to_numpy(), unpacked(p.column("code"), np.uint8, BITS // 8),
                         unpacked(p.column("packed"), np.float64, width)) for p in held])))
                    held = []
                yield from answers(block, part)

    def answers(block: Block, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codes = unpacked(part.column("code"), np.uint8, BITS // 8)
        rows = unpacked(part.column("packed"), np.float64, width)
        asked = part.column("id").to_numpy()
        found = [block.nearest(q, r, places, k) for q, r, places in zip(asked, rows, block.all_within(codes, radius))]
        sizes = [len(ids) for ids, _ in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(asked, sizes)), pa.array(np.concatenate([i for i, _ in found])),
             pa.array(np.concatenate([s for _, s in found]))], names=["query_id", "id", "score"])

    schema = StructType([StructField("query_id", index.schema["id"].dataType), index.schema["id"],
                         StructField("score", DoubleType())])
    return dealt.mapInArrow(run, schema)


def nearest_neighbours(table: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id",
                       vector_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """``query_id, rank, <id_col>, score``: the ``k`` nearest other ids found for
    every row that meets the condition ``queries``."""
    spark = table.sparkSession
    kind = table.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise ValueError(f"ids must be integers, not {kind.simpleString()}")
    vectors = usable_vectors(table, queries, id_col, vector_col)
    n, width = vectors.agg(F.count("*"), F.max(F.size("vector"))).first()
    schema = StructType([StructField("query_id", kind), StructField("rank", IntegerType()),
                         StructField(id_col, kind), StructField("score", DoubleType())])
    if not n:
        return spark.createDataFrame([], schema)
    bound = max(2, min(SAMPLE_ROWS, SAMPLE_VALUES // width))
    sample = (vectors.orderBy(F.xxhash64(F.lit(SEED), "id", "vector"), "id").limit(bound)
              .select("vector").toArrow().combine_chunks().column("vector").combine_chunks())
    model = fit_codes(unit(matrix(sample, width)))
    index = stored(coded(vectors, model, width), "codes")
    radius = learned_radius(index, width, k, target)
    cores = spark.sparkContext.defaultParallelism
    blocks = max(-(-n // max(1, min(BLOCK_ROWS, BLOCK_VALUES // width))), min(2 * cores, -(-n // LEAST_ROWS)))
    asking, done = stored(index.where("asks").dropDuplicates(), "asking"), None
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    while True:
        found = (probe(index, asking, blocks, width, radius, k)
                 .groupBy("query_id", "id").agg(F.max("score").alias("score"))
                 .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        found = stored(found, "neighbours")
        full = found.groupBy("query_id").agg(F.count("*").alias("n_found")).where(F.col("n_found") >= k)
        if radius >= BITS:
            kept = found
        else:
            kept = found.join(full, "query_id", "left_semi")
            asking = stored(asking.join(full, F.col("id") == F.col("query_id"), "left_anti"), "asking")
        done = kept if done is None else done.unionByName(kept)
        if radius >= BITS or asking.isEmpty():
            break
        radius = min(BITS, int(radius * WIDER) + 1)
    return done.select("query_id", "rank", F.col("id").alias(id_col), "score")
