"""Op 5, benchmark decontamination: distributed positional inverted index.

``build_index`` stores the postings of every training token: documents are
gathered into blocks of bounded token count, and a block holds, per term, the
delta-coded positions of that term in the block (documents are one position
apart, so a phrase never runs across two). Blocks are cut from the scan as it
comes, so no source, copy group or frequent word makes a hot one, and building
shuffles nothing.

``search_index`` looks up the benchmark's terms only. A window (10 consecutive
words of an item, or the whole of a shorter one) is matched by intersecting
offset-adjusted position lists, from its corpus-rarest term on; a proximity match
is a place where the item's rarest terms all lie within ``NEAR_SPAN`` words. The
benchmark is taken in chunks of bounded size, each against all blocks.

Defined results: null text has no words and no hits; an item without words
matches nothing; items with one id count once, items with a null id can hit
words but are not listed; repeated rows get equal results; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from scriptlens.llm.common import ALNUM_WORD, ASCII_LOWER, stored, tidy

WINDOW = 10
BLOCK_TOKENS = 400_000
CHUNK_BYTES = 1 << 20       # of benchmark text matched at once
NEAR_TERMS = 4
NEAR_SPAN = 20
DOC, POSTING = 0, 1


def folded(word: str) -> str:
    return word.lower() if word.isascii() else word.translate(ASCII_LOWER)


def words_of(text: str | None) -> list[str]:
    return [folded(w) for w in ALNUM_WORD.findall(text)] if text else []


class Block:
    """Tokens of consecutive documents, turned into postings."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}
        self.terms: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.starts: list[int] = []
        self.sizes: list[int] = []
        self.ids: list[pa.Array] = []
        self.end = 0

    def add(self, text: str | None) -> None:
        words = ALNUM_WORD.findall(text) if text else []
        codes, terms = self.codes, self.terms
        for w in set(words).difference(codes):
            codes[w] = terms.setdefault(folded(w), len(terms))
        self.parts.append(np.fromiter(map(codes.__getitem__, words), dtype=np.int32, count=len(words)))
        self.starts.append(self.end)
        self.sizes.append(len(words))
        self.end += len(words) + 1

    def batches(self, block: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        n = len(self.starts)
        yield record(DOC, block, n, [None] * n, self.sizes, [None] * n,
                     pa.concat_arrays(self.ids), self.starts)
        flat = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        if not len(flat):
            return
        sizes = np.array(self.sizes, dtype=np.int64)
        place = np.arange(len(flat)) + np.repeat(np.arange(n), sizes)
        # terms in text order, so that a file's row groups cover narrow term ranges
        names = pa.array(list(self.terms), pa.string())
        by_name = pc.sort_indices(names).to_numpy()
        order_of = np.empty(len(by_name), dtype=np.int32)
        order_of[by_name] = np.arange(len(by_name), dtype=np.int32)
        coded = order_of[flat]
        order = np.argsort(coded, kind="stable")
        counts = np.bincount(coded, minlength=len(by_name))
        ends = np.cumsum(counts)
        sorted_place = place[order].astype(np.int32)
        delta = np.diff(sorted_place, prepend=0).astype(np.int32)
        delta[ends - counts] = sorted_place[ends - counts]
        offsets = np.concatenate([[0], ends * 4]).astype(np.int32)
        postings = pa.Array.from_buffers(pa.binary(), len(counts), [
            None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(delta.tobytes())])
        whole = record(POSTING, block, len(counts), names.take(pa.array(by_name)), counts, postings,
                       pa.nulls(len(counts), id_type), [None] * len(counts))
        for lo in range(0, whole.num_rows, 20_000):
            yield whole.slice(lo, 20_000)


def record(kind, block, n, terms, counts, postings, ids, starts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, block, np.int64)),
         pa.array(terms, pa.string()), pa.array(counts, pa.int64()), pa.array(postings, pa.binary()),
         ids, pa.array(starts, pa.int64())],
        names=["kind", "block", "term", "n", "positions", "doc_id", "doc_start"])


def index_schema(docs: DataFrame, id_col: str) -> StructType:
    return StructType([
        StructField("kind", IntegerType()), StructField("block", LongType()),
        StructField("term", StringType()), StructField("n", LongType()),
        StructField("positions", BinaryType()), StructField("doc_id", docs.schema[id_col].dataType),
        StructField("doc_start", LongType())])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write the index table (one directory for documents, one for postings)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, block = TaskContext.get().partitionId(), 0, Block()
        id_type = None
        for batch in batches:
            ids = batch.column(0)
            id_type = ids.type
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for k, text in enumerate(part.column(1).to_pylist()):
                    block.add(text)
                    block.ids.append(part.column(0).slice(k, 1))
                    if block.end >= block_tokens:
                        yield from block.batches((task << 32) | made, id_type)
                        made, block = made + 1, Block()
        if block.starts:
            yield from block.batches((task << 32) | made, id_type)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(
        tidy(run), index_schema(docs, id_col))
    return stored(rows, "positions", ("kind",))


def item_windows(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> dict:
    """Distinct windows with the numbers of their items, and each item's terms."""
    windows: dict[tuple[str, ...], set[int]] = {}
    terms: list[list[str]] = []
    for k, (_, text) in enumerate(items):
        words = words_of(text)
        terms.append(list(dict.fromkeys(words)))
        if words:
            size = min(window, len(words))
            for a in range(len(words) - size + 1):
                windows.setdefault(tuple(words[a:a + size]), set()).add(k)
    return {"windows": [(w, sorted(s)) for w, s in windows.items()], "terms": terms}


def intersect(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Members of sorted ``a`` that are in sorted ``b``."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return a[b[at] == a]


def phrase_places(words: tuple[str, ...], lists: dict[str, np.ndarray], rarity: dict[str, int]) -> np.ndarray:
    """Starts of the phrase: offset-adjusted lists intersected, rarest first."""
    order = sorted(range(len(words)), key=lambda k: (rarity.get(words[k], 0), k))
    found: np.ndarray | None = None
    for k in order:
        places = lists.get(words[k])
        if places is None:
            return np.zeros(0, np.int64)
        found = places - k if found is None else intersect(found, places - k)
        if not len(found):
            return found
    return found


def near_places(terms: list[str], lists: dict[str, np.ndarray], rarity: dict[str, int],
                span: int = NEAR_SPAN) -> np.ndarray:
    """Places of the rarest term with the next rare ones within ``span`` words."""
    rare = sorted(terms, key=lambda t: (rarity.get(t, 0), t))[:NEAR_TERMS]
    if not rare or any(t not in lists for t in rare):
        return np.zeros(0, np.int64)
    found = lists[rare[0]]
    for t in rare[1:]:
        other = lists[t]
        at = np.searchsorted(other, found - span)
        found = found[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] <= found + span)]
    return found


def match_block(table: pa.Table, query: dict) -> pa.Table:
    """All documents of one block with their hits."""
    kind = table.column("kind").to_numpy()
    docs = table.filter(pa.array(kind == DOC)).sort_by("doc_start")
    posts = table.filter(pa.array(kind == POSTING))
    lists = {t: np.cumsum(np.frombuffer(p, dtype=np.int32).astype(np.int64))
             for t, p in zip(posts.column("term").to_pylist(), posts.column("positions").to_pylist())}
    starts = docs.column("doc_start").to_numpy()
    sizes = docs.column("n").to_numpy()
    change = np.zeros(int(starts[-1] + sizes[-1]) + 2, dtype=np.int64)
    items: list[set[int]] = [set() for _ in starts]
    near: list[set[int]] = [set() for _ in starts]
    for words, owners in query["windows"]:
        places = phrase_places(words, lists, query["rarity"])
        if len(places):
            np.add.at(change, places, 1)
            np.add.at(change, places + len(words), -1)
            for d in np.unique(np.searchsorted(starts, places, side="right") - 1).tolist():
                items[d].update(owners)
    for k, terms in enumerate(query["terms"]):
        places = near_places(terms, lists, query["rarity"])
        for d in np.unique(np.searchsorted(starts, places, side="right") - 1).tolist():
            near[d].add(k)
    # runs of hit words; a run stays inside its document
    inside = np.cumsum(change) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    begins, ends = edges[::2], edges[1::2]
    owner = np.searchsorted(starts, begins, side="right") - 1
    hits: list[list[dict]] = [[] for _ in starts]
    for d, a, z in zip(owner.tolist(), begins.tolist(), ends.tolist()):
        hits[d].append({"start": a - int(starts[d]), "end": z - int(starts[d])})
    names = query["names"]
    listed = [sorted({names[k] for k in s if names[k] is not None}) for s in items]
    close = [sorted({names[k] for k in s if names[k] is not None}) for s in near]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return pa.table({
        "block": docs.column("block"), "doc_id": docs.column("doc_id"), "doc_start": docs.column("doc_start"),
        "n_words": docs.column("n"),
        "n_hit": pa.array([sum(h["end"] - h["start"] for h in d) for d in hits], pa.int64()),
        "hits": pa.array(hits, pa.list_(span)),
        "items": pa.array(listed, pa.list_(pa.string())), "near_items": pa.array(close, pa.list_(pa.string()))})


def search_chunk(index: DataFrame, items: list[tuple[str | None, str | None]], window: int) -> DataFrame:
    spark = index.sparkSession
    query = item_windows(items, window) | {"names": [i for i, _ in items]}
    vocabulary = sorted({t for terms in query["terms"] for t in terms})
    # bounded by the chunk's size
    table = F.broadcast(spark.createDataFrame([(t,) for t in vocabulary], "term string"))
    posts = index.where(F.col("kind") == POSTING).join(table, "term").select(*index.columns)
    query["rarity"] = {r["term"]: r["n"] for r in posts.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(query)
    schema = StructType([
        StructField("block", LongType()), index.schema["doc_id"], StructField("doc_start", LongType()),
        StructField("n_words", LongType()), StructField("n_hit", LongType()),
        *StructType.fromDDL(
            "hits array<struct<start:bigint,end:bigint>>, items array<string>, near_items array<string>").fields])
    return (posts.unionByName(index.where(F.col("kind") == DOC))
            .groupBy("block").applyInArrow(lambda t: match_block(t, shared.value), schema))


def search_index(index: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                 item_col: str = "item_id", text_col: str = "text",
                 chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, hits`` (runs of hit words),
    ``items`` and ``near_items`` (ids with an exact or a proximity match)."""
    sized = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("body"))
    total = sized.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    chunks = -(-total // chunk_bytes)
    if chunks <= 1:
        rows = sized.distinct().orderBy("item", "body").collect()
        found = search_chunk(index, [(r["item"], r["body"]) for r in rows], window)
    else:
        # each chunk against all blocks, written before the next one is fetched,
        # merged per document
        chunk = F.pmod(F.xxhash64("item", "body"), F.lit(chunks))
        parts = []
        for k in range(chunks):
            rows = sized.where(chunk == k).distinct().collect()
            parts.append(stored(search_chunk(index, [(r["item"], r["body"]) for r in rows], window), "benchmark-chunk"))
        found = merged(parts)
    return found.drop("block", "doc_start")


def merged(parts: list[DataFrame]) -> DataFrame:
    """Chunk results of each document as one: a word hit twice counts once."""
    def united(name: str):
        return F.sort_array(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)

    key = ["block", "doc_start", "doc_id", "n_words"]
    rows = reduce(DataFrame.unionByName, parts).groupBy(*key).agg(
        united("hits"), united("items"), united("near_items"))
    covered = F.aggregate(
        "hits", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, h: F.struct(
            F.greatest(acc["end"], h["end"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0).cast("long"), h["end"] - F.greatest(acc["end"], h["start"]))).alias("n")))
    return rows.withColumn("n_hit", covered["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index ``docs`` and search them for the benchmark's windows."""
    found = search_index(build_index(docs, id_col, text_col), benchmark, window)
    return found.withColumnRenamed("doc_id", id_col)
