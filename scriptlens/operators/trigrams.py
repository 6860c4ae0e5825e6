"""Substring matching through persisted trigram postings.

``build_trigrams`` writes the searchable texts once more in blocks of about
``BLOCK_CHARS`` characters (consecutive rows of a scan partition, so a block is one
stretch of a file), the postings (trigram, block) and the number of blocks of every
trigram. A match then works on tables only:

1. a part of three or more characters is cut to its trigrams, which are ranked by
   their number of blocks; a trigram that no block has rules the part out;
2. the postings of its ``RAREST`` rarest trigrams are intersected: blocks that hold
   all of them are candidates. A batch's postings come together as a list of trigram
   numbers per block, and the task that has the list intersects (``block_parts``), so
   there is no row for a (part, block) pair;
3. only candidate blocks are read (pushed down as ``block IN`` while they are few,
   else joined), each text once with the numbers of its block's parts (a block of
   more than ``LISTED_PARTS`` without them), and the text decides (``held``).

A document that is one row answers where it lies; only those of several rows
(``TrigramIndex.several``) are grouped. Above ``PARTS_PER_PASS`` query parts stay a
table from beginning to end. Parts under three characters have no trigram: they are
tested on every block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checked_broadcast, materialize, new_table_path
from . import search
from .counted import BATCH_ROWS, OUT_ROWS, RUN_ROWS
from .held import ANCHOR_CHARS, PartTable, held_parts, queries_of
from .index import DOC_KEYS
from .search import match_parts, searchable_text, trigrams

BLOCK_CHARS = 65_536
PIECE_CHARS = 1 << 20       # characters of a text cut into trigrams at a time
CHAR_BITS = 21              # of a code point
RAREST = 4
PUSHDOWN_GRAMS = 1_000      # and trigrams into the scan of the postings
LISTED_PARTS = 64           # parts up to which a block's texts are asked for each of them
PUSHDOWN_BLOCKS = 1_000     # candidate blocks up to which their numbers are pushed into the scan


@dataclass
class TrigramIndex:
    texts: DataFrame        # document keys, block, text
    postings: DataFrame     # gram, block, in sorted runs
    grams: DataFrame        # gram, n_blocks (one shared by two scan tasks may count twice)
    several: DataFrame | None = None    # keys of the documents that have several rows


def build_trigrams(spark: SparkSession, lines: DataFrame, path: str | None = None,
                   block_chars: int = BLOCK_CHARS) -> TrigramIndex:
    """Write the tables for ``lines`` (searchable ones, with ``is_last``)."""
    path = path or new_table_path(spark, "trigrams")
    text = lines.select(*DOC_KEYS, searchable_text(lines).alias("text"))
    mean = text.agg(F.avg(F.length("text"))).first()[0] or 1.0
    rows_per_block = max(1, int(block_chars / max(1.0, mean)))
    # numbers rise within a scan partition and never meet those of another one
    blocked = text.withColumn("block", F.floor(F.monotonically_increasing_id() / rows_per_block).cast("bigint"))
    blocked.write.mode("overwrite").parquet(f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts")
    # sorted runs of every task; a block that two scan tasks share gives some pairs twice
    texts.select("block", "text").mapInArrow(gram_runs, "gram string, block bigint") \
        .write.mode("overwrite").parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n_blocks")) \
        .sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/grams")
    texts.groupBy(*DOC_KEYS).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1").select(*DOC_KEYS) \
        .write.mode("overwrite").parquet(f"{path}/several")
    return load_trigrams(spark, path)


def gram_keys(text: str) -> np.ndarray:
    """The trigrams of a text as numbers in the order of their characters."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    return c[:-2] << np.uint64(2 * CHAR_BITS) | c[1:-1] << np.uint64(CHAR_BITS) | c[2:]


def block_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(block, its distinct trigrams) of each stretch of rows of one block."""
    current, pieces, n = None, [], 0
    for batch in batches:
        for block, text in zip(batch.column("block").to_pylist(), batch.column("text").to_pylist()):
            if block != current:
                if pieces:
                    yield current, np.unique(np.concatenate(pieces))
                current, pieces, n = block, [], 0
            for lo in range(0, len(text) - 2, PIECE_CHARS):
                pieces.append(gram_keys(text[lo:lo + PIECE_CHARS + 2]))
                n += len(pieces[-1])
                if n > PIECE_CHARS:             # a long block holds its distinct trigrams only
                    pieces, n = [np.unique(np.concatenate(pieces))], 0
    if pieces:
        yield current, np.unique(np.concatenate(pieces))


def gram_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, block) of a task's texts in runs sorted by trigram."""
    held, n = [], 0
    for found in block_grams(batches):
        held.append(found)
        n += len(found[1])
        if n >= RUN_ROWS:
            yield from sorted_grams(held)
            held, n = [], 0
    if held:
        yield from sorted_grams(held)


def sorted_grams(held: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    keys = np.concatenate([k for _, k in held])
    blocks = np.repeat(np.array([b for b, _ in held], dtype=np.int64), [len(k) for _, k in held])
    order = np.argsort(keys, kind="stable")
    keys, blocks = keys[order], blocks[order]
    starts = np.concatenate([[True], keys[1:] != keys[:-1]])
    last = (1 << CHAR_BITS) - 1
    grams = pa.array([chr(k >> 2 * CHAR_BITS) + chr(k >> CHAR_BITS & last) + chr(k & last) for k in keys[starts].tolist()], pa.string())
    number = np.cumsum(starts) - 1
    for lo in range(0, len(keys), OUT_ROWS):
        yield pa.RecordBatch.from_arrays(
            [grams.take(pa.array(number[lo:lo + OUT_ROWS])), pa.array(blocks[lo:lo + OUT_ROWS])], names=["gram", "block"])


def load_trigrams(spark: SparkSession, path: str) -> TrigramIndex:
    r = spark.read
    return TrigramIndex(r.parquet(f"{path}/texts"), r.parquet(f"{path}/postings"), r.parquet(f"{path}/grams"),
                        r.parquet(f"{path}/several"))


def rarest_grams(index: TrigramIndex, parts: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(part, gram): the rarest trigrams of each part of three or more characters whose
    trigrams are all known. ``parts`` has distinct parts."""
    pieces = parts.where(F.length("part") >= ANCHOR_CHARS).select("part", F.explode(trigrams(F.col("part"))).alias("gram"))
    pieces = materialize(pieces)
    asked_b, _ = checked_broadcast(pieces.select("gram").distinct())
    stats = index.grams.join(asked_b, "gram", "left_semi")
    known = pieces.join(stats, "gram", "left")
    # per part: its trigrams by how many blocks have them; none missing
    by_part = Window.partitionBy("part")
    ranked = (known.withColumn("missing", F.max(F.col("n_blocks").isNull()).over(by_part))
              .withColumn("rank", F.row_number().over(by_part.orderBy("n_blocks", "gram")))
              .where(~F.col("missing") & (F.col("rank") <= rarest)).select("part", "gram"))
    return materialize(ranked)


def asked_postings(index: TrigramIndex, grams: list[str]) -> DataFrame:
    """The postings, without row groups that hold none of a few trigrams."""
    if len(grams) <= PUSHDOWN_GRAMS:        # the sorted postings skip row groups without them
        return index.postings.where(F.col("gram").isin(grams))
    return index.postings


def candidate_blocks(index: TrigramIndex, parts: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(part, block): blocks that hold the rarest trigrams of each part of three or
    more characters. ``parts`` has distinct parts."""
    chosen = rarest_grams(index, parts, rarest)
    chosen_b, _ = checked_broadcast(chosen)
    postings = asked_postings(index, [r["gram"] for r in chosen.select("gram").distinct().limit(PUSHDOWN_GRAMS + 1).collect()])
    counts_b, _ = checked_broadcast(chosen.groupBy("part").agg(F.count(F.lit(1)).alias("n_grams")))
    found = postings.join(chosen_b, "gram").groupBy("part", "block").agg(F.countDistinct("gram").alias("n"))
    return found.join(counts_b, "part").where("n = n_grams").select("part", "block")


class GramTable:
    """The numbered trigrams of a batch's parts, each with the parts that ask for it."""

    def __init__(self, rows: list, parts: list[str]):
        """``rows``: distinct (part, gram); ``parts``: the parts by number."""
        number = {p: i for i, p in enumerate(parts)}
        self.grams = {g: i for i, g in enumerate(sorted({r["gram"] for r in rows}))}
        pairs = np.array(sorted((self.grams[r["gram"]], number[r["part"]]) for r in rows), dtype=np.int64).reshape(-1, 2)
        self.part, self.n_parts = pairs[:, 1], len(parts)
        self.sizes = np.bincount(pairs[:, 0], minlength=len(self.grams))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.needs = np.bincount(self.part, minlength=self.n_parts)

    def parts_of(self, grams: np.ndarray) -> np.ndarray:
        """Numbers of the parts whose trigrams are all among these distinct ones."""
        times = self.sizes[grams]
        stops = np.cumsum(times)
        at = np.repeat(self.first[grams] - (stops - times), times) + np.arange(int(times.sum()))
        return np.flatnonzero((np.bincount(self.part[at], minlength=self.n_parts) == self.needs) & (self.needs > 0))


def block_parts(index: TrigramIndex, table: GramTable) -> DataFrame:
    """(block, asked): the candidate blocks with the numbers of their parts, null if
    they are more than ``LISTED_PARTS``."""
    spark = index.postings.sparkSession
    shared = spark.sparkContext.broadcast(table)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, blocks, n = [], [], 0
        number = shared.value.grams
        names = pa.array(list(number), pa.string())
        for batch in batches:
            at = pc.index_in(batch.column("gram"), names)
            known = at.is_valid().to_numpy(zero_copy_only=False)
            grams.append(at.drop_null().to_numpy().astype(np.int64))
            blocks.append(batch.column("block").to_numpy()[known])
            n += len(grams[-1])
            if n >= RUN_ROWS:
                yield from packed_grams(np.concatenate(blocks), np.concatenate(grams))
                grams, blocks, n = [], [], 0
        if n:
            yield from packed_grams(np.concatenate(blocks), np.concatenate(grams))

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(block, shared.value.parts_of(np.unique(grams.values.to_numpy())))
                     for block, grams in zip(batch.column("block").to_pylist(), batch.column("grams"))]
            found = [(block, parts) for block, parts in found if len(parts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block for block, _ in found], pa.int64()),
                 pa.array([parts if len(parts) <= LISTED_PARTS else None for _, parts in found], pa.list_(pa.int32()))],
                names=["block", "asked"])

    lists = (asked_postings(index, list(table.grams)).select("gram", "block").mapInArrow(packed, "block bigint, grams array<int>")
             .groupBy("block").agg(F.flatten(F.collect_list("grams")).alias("grams")))
    return lists.mapInArrow(intersect, "block bigint, asked array<int>")


def packed_grams(blocks: np.ndarray, grams: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(block, its trigram numbers) of some postings."""
    order = np.lexsort((grams, blocks))
    names, starts = np.unique(blocks[order], return_index=True)
    stops = np.concatenate([starts, [len(order)]]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(stops), pa.array(grams[order].astype(np.int32)))
    for lo in range(0, len(names), BATCH_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(names[lo:lo + BATCH_ROWS]), lists.slice(lo, BATCH_ROWS)], names=["block", "grams"])


def blocks_to_read(index: TrigramIndex, candidates: DataFrame) -> DataFrame:
    """The texts of the candidate blocks."""
    numbers = candidates.select("block").distinct().limit(PUSHDOWN_BLOCKS + 1).collect()
    if len(numbers) <= PUSHDOWN_BLOCKS:
        return index.texts.where(F.col("block").isin([r["block"] for r in numbers]))
    return index.texts


def part_documents(index: TrigramIndex, parts: DataFrame) -> DataFrame:
    """(part, document keys) of all rows that hold a part."""
    candidates = materialize(candidate_blocks(index, parts))
    pairs_b, _ = checked_broadcast(candidates)
    long = blocks_to_read(index, candidates).join(pairs_b, "block").where(F.contains("text", F.col("part")))
    short = parts.where(F.length("part") < ANCHOR_CHARS)
    held = long.select("part", *DOC_KEYS)
    if not short.isEmpty():
        held = held.unionByName(short_part_rows(index.texts, short))
    return held.distinct()


def short_part_rows(texts: DataFrame, short: DataFrame) -> DataFrame:
    """Rows that hold a part of up to two characters: the distinct characters and
    pairs of a text join the parts on equality; the empty part is in every text."""
    text = F.col("text")
    pairs = F.regexp_extract_all(text, F.lit("(?s)(?=(.{2}))"), F.lit(1))
    singles = F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))
    keys = F.array_distinct(F.concat(F.array(F.lit("")), singles, pairs))
    short_b, _ = checked_broadcast(short.select("part"))
    return texts.select(*DOC_KEYS, F.explode(keys).alias("part")).join(short_b, "part").select("part", *DOC_KEYS)


def held_by_blocks(index: TrigramIndex, qp: DataFrame, table: PartTable) -> DataFrame:
    """(document keys, held): the parts of a document's texts, looked for in the
    candidate blocks. A text is joined to its block's list of parts, not to each."""
    chosen = rarest_grams(index, qp.select("part").distinct())
    candidates = materialize(block_parts(index, GramTable(chosen.collect(), table.parts)).withColumn("known", F.lit(True)))
    asked, _ = checked_broadcast(candidates)
    short = bool(table.short())
    texts = (index.texts if short else blocks_to_read(index, candidates)).join(asked, "block", "left" if short else "inner")
    # null stands for all parts in a block of many, no list for a block that is no candidate
    texts = texts.withColumn("asked", F.when(F.col("known").isNull(), F.array().cast("array<int>")).otherwise(F.col("asked")))
    if index.several is not None and index.several.isEmpty():
        return held_parts(texts, DOC_KEYS, table, "text", "asked", grouped=False)
    several, few = (None, False) if index.several is None else checked_broadcast(index.several.withColumn("grouped", F.lit(True)))
    if not few:
        return held_parts(texts, DOC_KEYS, table, "text", "asked")
    texts = texts.join(several, DOC_KEYS, "left")
    return held_parts(texts.where(F.col("grouped").isNull()), DOC_KEYS, table, "text", "asked", grouped=False).unionByName(
        held_parts(texts.where("grouped"), DOC_KEYS, table, "text", "asked"))


def matched_by_trigrams(index: TrigramIndex, prepared: DataFrame) -> DataFrame:
    """(query_id, document keys), the rows of ``matched_documents``."""
    qp = materialize(match_parts(prepared))
    if 0 < qp.count() <= search.PARTS_PER_PASS:
        table = PartTable(qp.collect())
        return queries_of(held_by_blocks(index, qp, table), DOC_KEYS, table, qp.schema["query_id"].dataType)
    hits = part_documents(index, qp.select("part").distinct())
    qp_b, _ = checked_broadcast(qp)
    keys = ["query_id", "qtype", "n_parts", *DOC_KEYS]
    per_doc = (hits.join(qp_b, "part").select(*keys, "part_idx").distinct()
               .groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hit")))
    ok = F.when(F.col("qtype") == "and", F.col("n_hit") == F.col("n_parts")).otherwise(F.col("n_hit") >= 1)
    return per_doc.where(ok).select("query_id", *DOC_KEYS)
