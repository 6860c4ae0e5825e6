"""Op 8, n-gram Jaccard join by multiple-global-order filtering.

A document's set holds its distinct 4-word shingles as 64-bit hashes. Documents
with equal sets are one class. If two sets are similar enough, they share a token
among the first few (the prefix) under *every* global order of the tokens, and
the number of shared prefix tokens bounds their overlap. Three orders are used:
rarest first, coarsely rarest first with another tie order, and a hash order.

1. Frequent tokens are counted in blocks and summed; the most frequent
   ``HEAVY_TOKENS`` (a fixed bound) rank last in the rare-first orders, all other
   tokens count as rare.
2. The prefixes of the first order are shuffled by token. A class is first
   checked against the pivot it shares most prefix tokens with; these links join
   most of a copy group without its pairs.
3. What remains are pairs of different parts. Short token lists are joined with
   size and position filters. Long ones are compared in bounded blocks by a
   matrix product of their prefixes, which emits only pairs between parts whose
   overlap bound holds.
4. Candidates must pass the overlap bound under all orders before their whole
   sets are fetched and intersected.

Every pair of similar classes is either joined to one part in step 2 or met in
step 3, so components are exact.

Classes are numbered; ids of any type only name them, so a text counts as its own
document even if another text has the same id.

Defined results: null or blank text has an empty set, which links with nothing
(its component is its own id); rows without an id link with nothing and have a
null component; repeated rows are one class; of an id with several texts each text
is linked for itself; the least id is the least of the ids' type; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptlens.llm.common import stored, tidy
from scriptlens.llm.components import components

SHINGLE = 4
PERCENT = 85
HEAVY_TOKENS = 800_000      # bound of the frequency table (16 bytes a token)
BLOCK_SHINGLES = 2_000_000  # shingles counted together in a task
SALT_ROWS = 20_000          # estimated list length from which a pivot list is dealt out
LONG_LIST = 64              # lists up to here are joined, longer ones compared in blocks
BLOCK_NODES = 512
CACHE_WORDS = 400_000
BROADCAST_IDS = 2_000_000   # ids (8 bytes each) up to which a list of documents is broadcast

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIXERS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93))


def mixed(x: np.ndarray, mixer: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * mixer
    return x ^ (x >> np.uint64(27))


class Shingler:
    """Sorted distinct shingle hashes of a text. Lower-casing and splitting act
    on UTF-8 bytes: only A-Z change, only ASCII white space splits."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.cache = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        cache = self.cache
        new = set(words).difference(cache)
        if new:
            if len(cache) > CACHE_WORDS:
                cache.clear()
                new = set(words)
            cache.update((w, xxhash.xxh64_intdigest(w)) for w in new)
        h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
        k = min(self.size, len(words))
        out = np.full(len(words) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            out = (out ^ h[i:i + len(out)]) * MULTIPLIER
        return np.unique(mixed(out, MIXERS[0]))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


class Orders:
    """Global token orders over the frequency table."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]

    def frequency(self, s: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(s), dtype=np.uint64)
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        return np.where(self.tokens[at] == s, self.counts[at], 0).astype(np.uint64)

    def prefix(self, s: np.ndarray, order: int, percent: int, freq: np.ndarray) -> np.ndarray:
        """First tokens of the set under the order, in order; ``s`` is sorted,
        so equal keys keep the token order."""
        tie = mixed(s, MIXERS[order]) >> np.uint64(32)
        if order == 0:
            key = (freq << np.uint64(32)) | tie
        elif order == 1:
            coarse = np.ceil(np.log2(freq.astype(np.float64) + 1)).astype(np.uint64)
            key = (coarse << np.uint64(32)) | tie
        else:
            key = tie
        return s[np.argsort(key, kind="stable")[:prefix_size(len(s), percent)]]


def lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def set_table(docs: DataFrame, size: int) -> DataFrame:
    """kind 0: (id, n_shingles, sig); kind 1: (token, n) counted in a block."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(size)
        held: list[np.ndarray] = []
        weight = 0

        def counted() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            token, n = token[n > 1].view(np.int64), n[n > 1]
            m = len(token)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ones(m, np.int32)), pa.nulls(m, id_kind), pa.array(np.zeros(m, np.int64)),
                 pa.nulls(m, pa.binary()), pa.array(token), pa.array(n.astype(np.int64))], names=names)

        names = ["kind", "id", "n_shingles", "sig", "token", "n"]
        id_kind = None
        for batch in batches:
            id_kind = batch.column(0).type
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                m = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(m, np.int32)), part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                     pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names=names)
                held += sets
                weight += sum(map(len, sets))
                if weight >= BLOCK_SHINGLES:
                    yield counted()
                    held, weight = [], 0
        if weight:
            yield counted()

    rows = docs.mapInArrow(tidy(run), f"kind int, id {id_type}, n_shingles bigint, sig binary, token bigint, n bigint")
    return stored(rows, "sets", ("kind",))


def frequent(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens and their counts, at most ``HEAVY_TOKENS``: all
    tokens from the least count on that keeps the bound. If even the tokens of the
    top counts exceed it, a hash share of them is taken."""
    sums = stored(table.where("kind = 1").groupBy("token").agg(F.sum("n").alias("n")), "token-counts")
    # counts of 10,000 or more in steps of about one percent
    grade = F.when(F.col("n") < 10_000, F.col("n")).otherwise(
        10_000 + F.floor(F.log(F.col("n") / 10_000) * 64)).cast("long")
    graded = sums.withColumn("grade", grade)

    def fitting(column: str, rows: DataFrame) -> int | None:
        """Least value such that the rows from it on keep the bound."""
        held, least = 0, None
        sizes = rows.groupBy(column).agg(F.count("*").alias("tokens")).collect()    # a bounded number of values
        for r in sorted(sizes, key=lambda r: -r[column]):
            if held + r["tokens"] > HEAVY_TOKENS:
                break
            held, least = held + r["tokens"], r[column]
        return least

    least = fitting("grade", graded)
    if least is None:
        most = graded.agg(F.max("grade")).first()[0]
        if most is None:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        graded = (graded.where(F.col("grade") == most)
                  .withColumn("grade", F.pmod(F.xxhash64("token"), F.lit(65_536))))
        least = fitting("grade", graded)
        if least is None:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = graded.where(F.col("grade") >= least).select("token", "n").toArrow()
    return (top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy())


def prefixes(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray], size: int, percent: int,
             whole: bool) -> DataFrame:
    """(id, size, p0, cuts): prefix of the first order and in how many parts a
    token's list is dealt; with ``whole`` also the other orders and the set."""
    id_type = docs.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(heavy)
    extra = ", p1 array<bigint>, p2 array<bigint>, tokens array<bigint>" if whole else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, orders = Shingler(size), Orders(*shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                freqs = [orders.frequency(s) for s in sets]
                columns = [part.column(0), pa.array([len(s) for s in sets], pa.int32())]
                first = [orders.prefix(s, 0, percent, f) if len(s) else s for s, f in zip(sets, freqs)]
                cuts = [(1 + orders.frequency(p) // np.uint64(SALT_ROWS)).astype(np.int64) for p in first]
                columns += [lists(first), lists(cuts)]
                if whole:
                    columns += [lists([orders.prefix(s, o, percent, f) if len(s) else s
                                       for s, f in zip(sets, freqs)]) for o in (1, 2)] + [lists(sets)]
                names = ["id", "size", "p0", "cuts", "p1", "p2", "tokens"][:len(columns)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(tidy(run), f"id {id_type}, size int, p0 array<bigint>, cuts array<bigint>{extra}")


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of two similar sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def need_expr(a: str, b: str, percent: int) -> Column:
    # integer arithmetic: ceil(x / y) = (x + y - 1) div y
    return F.expr(f"({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent}")


def bound_holds(p: str, percent: int) -> Column:
    """The sizes fit and the shared prefix tokens plus the larger rest reach the
    needed overlap."""
    fits = 100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")
    rest = F.greatest(F.col("size_a") - F.size(f"{p}_a"), F.col("size_b") - F.size(f"{p}_b"))
    return fits & (F.size(F.array_intersect(f"{p}_a", f"{p}_b")) + rest >= need_expr("size_a", "size_b", percent))


def side(sets: DataFrame, s: str, columns: list[str]) -> DataFrame:
    return sets.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns])


def candidates(pairs: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose bound holds under the first order; no text is read."""
    both = (pairs.join(side(firsts, "a", ["size", "p0"]), "a")
            .join(side(firsts, "b", ["size", "p0"]), "b"))
    return stored(both.where(bound_holds("p0", percent)).select("a", "b"), "candidates")


def verified(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Candidates that pass the other orders' bounds and the exact check; whole
    sets are made of their documents only."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = sets_of(stored(ids, "candidate-ids"))
    other = ["size", "p1", "p2"]
    kept = (pairs.join(side(sets, "a", other), "a").join(side(sets, "b", other), "b")
            .where(bound_holds("p1", percent) & bound_holds("p2", percent)).select("a", "b"))
    full = kept.join(side(sets, "a", ["size", "tokens"]), "a").join(side(sets, "b", ["size", "tokens"]), "b")
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return stored(full.where(common >= need_expr("size_a", "size_b", percent)).select("a", "b"), "links")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, rows["id"] == labels["node"], "left").select(
        *rows.columns, F.coalesce("label", "id").alias("part"))


def short_list_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of different parts in short lists, by size and position."""
    a, b = rows.alias("a"), rows.alias("b")
    need = need_expr("a.size", "b.size", percent)
    low, high = F.least("a.size", "b.size"), F.greatest("a.size", "b.size")
    return (a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.id") < F.col("b.id"))
                   & (F.col("a.part") != F.col("b.part")) & (100 * low >= percent * high)
                   & (F.col("a.at") <= F.col("a.size") - need) & (F.col("b.at") <= F.col("b.size") - need))
            .select(F.col("a.id").alias("a"), F.col("b.id").alias("b")))


def long_list_pairs(rows: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """Pairs of different parts in long lists, compared block by block."""
    id_type = rows.schema["id"].dataType.simpleString()
    blocks = F.ceil(F.col("n_list") / BLOCK_NODES).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    dealt = (rows.select("token", "id", "part", own.alias("own"),
                         F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
             .select("token", "id", "part", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"),
                     "own")
             .join(firsts.select("id", "size", "p0"), "id"))

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        size = table.column("size").to_numpy().astype(np.int64)
        part = table.column("part").to_numpy()
        own, bi, bj = (table.column(c).to_numpy() for c in ("own", "bi", "bj"))
        p0 = table.column("p0").combine_chunks()
        lengths = p0.value_lengths().to_numpy(zero_copy_only=False)
        token, inverse, counts = np.unique(p0.flatten().to_numpy(), return_inverse=True, return_counts=True)
        column = np.cumsum(counts > 1) - 1
        keep = (counts > 1)[inverse]
        row = np.repeat(np.arange(len(ids)), lengths)
        grid = np.zeros((len(ids), int((counts > 1).sum())), dtype=np.float32)
        grid[row[keep], column[inverse[keep]]] = 1
        left = np.flatnonzero(own == bi)
        right = left if bi[0] == bj[0] else np.flatnonzero(own == bj)
        common = grid[left] @ grid[right].T
        a, b = size[left][:, None], size[right][None, :]
        rest = np.maximum((size - lengths)[left][:, None], (size - lengths)[right][None, :])
        ok = ((common + rest >= needed(a, b, percent)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
              & (part[left][:, None] != part[right][None, :]))
        x, y = np.nonzero(ok)
        x, y = ids[left[x]], ids[right[y]]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)}).group_by(["a", "b"]).aggregate([])

    return dealt.groupBy("token", "bi", "bj").applyInArrow(compare, f"a {id_type}, b {id_type}").where("a <> b")


def similar_classes(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_hash, n_shingles, component_id, component_hash`` for every row of
    ``docs``: the component's least id and the hash of that document's text."""
    base = docs.select(F.struct(F.col(id_col).alias("id"), text_hash(text_col).alias("text_hash")).alias("id"),
                       F.col(text_col).alias("body"))
    table = set_table(base, size)
    members = table.where("kind = 0").select("id", "n_shingles", "sig")
    # a class is a set; its least (id, text) stands for it. Classes are numbered in the
    # order of these, so a list's pivot is its earliest document: later copies are edits of
    # an earlier one rather than of each other
    classes = stored(stored(
        members.where("n_shingles > 0 and id.id is not null").groupBy("sig").agg(F.min("id").alias("rep")), "class-reps")
        .orderBy("rep").withColumn("class", F.monotonically_increasing_id()), "classes")
    heavy = frequent(table)

    # prefixes of one document per class; rows that agree in id and text are one
    reps = classes.select(F.col("rep").alias("id"), "class")

    def of_class(found: DataFrame, of: DataFrame) -> DataFrame:
        return (found.join(of, "id").drop("id").withColumnRenamed("class", "id").dropDuplicates(["id"])
                .select(*found.columns))

    firsts = stored(of_class(prefixes(base, heavy, size, percent, False), reps), "prefixes")
    posted = firsts.select("id", "size", F.posexplode(F.arrays_zip("p0", "cuts")).alias("at", "z")).select(
        F.col("z.p0").alias("token"), F.pmod(F.xxhash64("id"), F.col("z.cuts")).cast("int").alias("salt"),
        (F.col("z.cuts") > 1).alias("dealt"), "id", "size", "at")
    group = Window.partitionBy("token", "salt")
    shared = stored(
        posted.withColumn("pivot", F.min("id").over(group)).withColumn("n_list", F.count("*").over(group))
        .where("n_list > 1 or dealt"), "postings")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = stored(reps.join(ids.select(F.col("id").alias("class")), "class", "left_semi"), "candidate-reps")
        if wanted.count() <= BROADCAST_IDS:
            wanted = F.broadcast(wanted)
        found = prefixes(base.join(wanted.select("id"), "id", "left_semi"), heavy, size, percent, True)
        return stored(of_class(found, wanted), "candidate-sets")

    # links to the pivot a class shares most with
    best = (shared.where("pivot <> id").groupBy("id", "pivot").agg(F.count("*").alias("n"))
            .groupBy("id").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("pivot")))
    stars = candidates(best.select(F.col("pivot").alias("a"), F.col("id").alias("b")), firsts, percent)
    star_links = verified(stars, sets_of, percent)
    parts = components(star_links, "a", "b")

    # all remaining pairs: tokens whose list holds different parts
    rows = labelled(shared.select("token", "id", "size", "at"), parts)
    mixed_lists = rows.groupBy("token").agg(
        F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n_list")).where("low <> high")
    rows = stored(rows.join(mixed_lists.select("token", "n_list"), "token"), "mixed")
    pairs = short_list_pairs(rows.where(F.col("n_list") <= LONG_LIST), percent).unionByName(
        long_list_pairs(rows.where(F.col("n_list") > LONG_LIST), firsts, percent)).distinct()
    rest = candidates(pairs, firsts, percent)
    links = star_links.unionByName(verified(rest, sets_of, percent))
    labels = stored(components(links, "a", "b"), "components")

    # a component is named by its least document
    linked = classes.join(labels, F.col("class") == F.col("node"))
    named = linked.join(linked.groupBy("label").agg(F.min("rep").alias("least")), "label").select("class", "least")
    first_of = classes.join(named, "class", "left").select("sig", F.coalesce("least", "rep").alias("first"))
    out = members.join(first_of, "sig", "left")
    first = F.when(F.col("id.id").isNotNull(), F.coalesce("first", "id"))
    return out.select("id.id", "id.text_hash", "n_shingles", first["id"].alias("component_id"),
                      first["text_hash"].alias("component_hash"))


def text_hash(text_col: str = "text") -> Column:
    """Tells texts under one id apart; null and empty text differ."""
    return F.xxhash64(F.col(text_col).isNull(), F.col(text_col))
