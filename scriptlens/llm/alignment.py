"""Op 12, alignment of two tokenizers' tokens over the same bytes.

A text is encoded by a byte-level BPE file (A) and a piece model (B); both sides
tile the bytes of a space and the text. ``pandas.merge_asof``, keyed by document,
finds the linked tokens. Links of kind ``END`` are the pairs whose byte ranges end
together: each token end meets the other side's equal one. Links of kind ``OVERLAP``
are the pairs that share a byte: each token start meets the other side's covering
token, once in either direction, and the union of both directions is the set.
Byte ends that both sides share cut the tokens into groups.

Links are counted per (A id, B id) over the corpus: each document's distinct pairs
and their numbers are written once, summed in Spark, and looked up again. The
``HEAD_PAIRS`` most frequent pairs (a documented bound, 17 bytes each) are broadcast
as arrays; the pairs beyond them are joined by shuffle, so counts are exact whatever
the number of pairs. A B id's highest count comes from a grouped maximum.

Texts are encoded whole, ``BATCH_CHARS`` characters at a time (a longer text
alone). Defined results: null and empty texts, and texts that either tokenizer
does not reproduce byte for byte (a literal U+2581, for one), have no tokens: zeros
and an empty digest. Repeated rows are counted each; an empty table gives no rows;
further columns are ignored unless kept.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptlens.llm.common import add_columns, stored
from scriptlens.llm.tokens import tokenizer_path

A_FILE = "byte_bpe_50k.json"
B_FILE = "piece_bpe_32k.model"
BATCH_CHARS = 400_000
HEAD_PAIRS = 500_000
OVERLAP, END = "overlap", "end"     # kinds of links
ROW_KEY = "alignment_row"


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for
    itself, the other bytes for the characters from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Side:
    """A tokenizer: ``encode`` texts to id lists, the bytes of every id."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        text = [str(i) for i in range(len(tokens))]
        self.inner = np.array([t + "," for t in text], dtype=object)    # a group goes on behind the id
        self.last = text

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class ByteSide(Side):
    """A byte-level BPE file. If its ids follow the order of its merges and its split
    pattern is the standard one, the merges are run by the faster library of rank
    files, on the file's own vocabulary; else by the file's library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True     # their strings are ordinary text
        alphabet, vocabulary = byte_alphabet(), self.tokenizer.get_vocab()
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            tokens[i] = (bytes(map(alphabet.__getitem__, token)) if alphabet.keys() >= set(token)
                         else token.encode("utf-8"))
        super().__init__(tokens)
        self.closed = np.array([t + "|" for t in self.last], dtype=object)
        self.ranked = ranked_encoding(json.loads(self.tokenizer.to_str()), tokens)

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is not None:
            return [self.ranked.encode_ordinary(" " + t) for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


def ranked_encoding(settings: dict, tokens: list[bytes]):
    """The same encoding as ranks, or None if the file isn't one of ranks."""
    import public_tokenizers
    import tiktoken

    model, split = settings["model"], settings["pre_tokenizer"] or {}
    special = {t["id"] for t in settings["added_tokens"]}
    merged = [model["vocab"]["".join(pair)] for pair in model["merges"]]
    plain = (model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex")
             and not split.get("add_prefix_space") and settings["normalizer"] is None
             and not model.get("dropout") and not model.get("ignore_merges") and not model.get("byte_fallback"))
    if not plain or merged != list(range(256, 256 + len(merged))) or len(tokens) != 256 + len(merged) + len(special):
        return None
    ranks = {t: i for i, t in enumerate(tokens) if i not in special}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class PieceSide(Side):
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        tokens = []
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            tokens.append(bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i)
                          else piece.replace("▁", " ").encode("utf-8"))
        super().__init__(tokens)
        self.closed = np.array([t + ";" for t in self.last], dtype=object)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@cache
def sides(a_path: str, b_path: str) -> tuple[Side, Side]:
    """Loaded once per Python worker."""
    return ByteSide(a_path), PieceSide(b_path)


@dataclass
class Aligned:
    """Tokens of the texts laid end to end. ``a_text`` / ``b_text`` say whose
    token it is, ``*_group`` its group, ``link_a`` / ``link_b`` the linked places."""
    a: np.ndarray
    b: np.ndarray
    a_text: np.ndarray
    b_text: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    a_cut: np.ndarray
    b_cut: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def flat_ids(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    ids = np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(sizes.sum()))
    return ids, np.repeat(np.arange(len(lists)), sizes)


def overlapping(a_text: np.ndarray, a_start: np.ndarray, b_text: np.ndarray,
                b_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens that share a byte."""
    left = pd.DataFrame({"text": a_text, "at": a_start, "a": np.arange(len(a_text))})
    right = pd.DataFrame({"text": b_text, "at": b_start, "b": np.arange(len(b_text))})
    by_a = pd.merge_asof(left, right, on="at", by="text")
    by_b = pd.merge_asof(right, left, on="at", by="text")
    cover = by_b["a"].to_numpy()
    new = a_start[cover] != b_start     # equal starts are found from both sides
    return (np.concatenate([by_a["a"].to_numpy(), cover[new]]),
            np.concatenate([by_a["b"].to_numpy(), by_b["b"].to_numpy()[new]]))


def ending_together(a_text: np.ndarray, a_end: np.ndarray, b_text: np.ndarray,
                    b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens whose byte ranges end together."""
    left = pd.DataFrame({"text": a_text, "at": a_end, "a": np.arange(len(a_text))})
    right = pd.DataFrame({"text": b_text, "at": b_end, "b": np.arange(len(b_text))})
    met = pd.merge_asof(left, right, on="at", by="text", tolerance=0).dropna(subset="b")
    return met["a"].to_numpy(), met["b"].to_numpy().astype(np.int64)


def align(texts: list[str | None], a_side: Side, b_side: Side, links: str = OVERLAP) -> Aligned:
    """Align the tokens of the texts; texts without tokens contribute none."""
    rows = [k for k, t in enumerate(texts) if t]
    a_lists: list[list[int]] = [[] for _ in texts]
    b_lists: list[list[int]] = [[] for _ in texts]
    if rows:
        found = zip(rows, a_side.encode([texts[k] for k in rows]), b_side.encode([texts[k] for k in rows]))
        for k, a_ids, b_ids in found:
            raw = (" " + texts[k]).encode("utf-8", "surrogatepass")
            if a_side.decode(a_ids) == raw and b_side.decode(b_ids) == raw:
                a_lists[k], b_lists[k] = a_ids, b_ids
    a, a_text = flat_ids(a_lists)
    b, b_text = flat_ids(b_lists)
    # both sides tile the same bytes, so places in the joined bytes are comparable
    a_end, b_end = np.cumsum(a_side.sizes[a]), np.cumsum(b_side.sizes[b])
    if links == END:
        link_a, link_b = ending_together(a_text, a_end, b_text, b_end)
    else:
        link_a, link_b = overlapping(a_text, a_end - a_side.sizes[a], b_text, b_end - b_side.sizes[b])
    a_cut = np.isin(a_end, b_end, assume_unique=True, kind="sort")
    b_cut = np.isin(b_end, a_end, assume_unique=True, kind="sort")
    return Aligned(
        a, b, a_text, b_text, np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut, a_cut, b_cut,
        link_a, link_b)


def group_strings(found: Aligned, n_texts: int, a_side: Side, b_side: Side) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of every text."""
    groups = int(found.a_cut.sum())
    a_sizes = np.bincount(found.a_group, minlength=groups)
    b_sizes = np.bincount(found.b_group, minlength=groups)
    a_before, b_before = np.cumsum(a_sizes), np.cumsum(b_sizes) - b_sizes
    parts = np.empty(len(found.a) + len(found.b), dtype=object)
    parts[np.arange(len(found.a)) + b_before[found.a_group]] = np.where(
        found.a_cut, a_side.closed[found.a], a_side.inner[found.a])
    parts[np.arange(len(found.b)) + a_before[found.b_group]] = np.where(
        found.b_cut, b_side.closed[found.b], b_side.inner[found.b])
    ends = np.cumsum(np.bincount(found.a_text, minlength=n_texts) + np.bincount(found.b_text, minlength=n_texts))
    cells = parts.tolist()
    return ["".join(cells[lo:hi])[:-1] for lo, hi in zip([0, *ends.tolist()], ends.tolist())]


def batches_of(texts: list[str | None], limit: int = BATCH_CHARS) -> Iterator[list[str | None]]:
    """The texts in order, in lists of at most ``limit`` characters or one text."""
    part, held = [], 0
    for t in texts:
        n = len(t or "")
        if part and held + n > limit:
            yield part
            part, held = [], 0
        part.append(t)
        held += n
    if part:
        yield part


def paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or tokenizer_path(A_FILE), b_path or tokenizer_path(B_FILE)


def aligned_tokens(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None,
                   a_path: str | None = None, b_path: str | None = None, links: str = OVERLAP) -> DataFrame:
    """The kept columns with ``a_ids``, ``b_ids``, ``links`` (token numbers a, b
    in order) and ``groups`` (tokens of either side)."""
    a_path, b_path = paths(a_path, b_path)
    ints = pa.list_(pa.int32())

    def make():
        a_side, b_side = sides(a_path, b_path)

        def work(texts: list) -> list:
            out: list[list] = [[], [], [], []]
            for part in batches_of(texts):
                found = align(part, a_side, b_side, links)
                order = np.lexsort((found.link_b, found.link_a))
                link_a, link_b = found.link_a[order], found.link_b[order]
                link_text = found.a_text[link_a]
                group_text = found.a_text[found.a_cut]
                a_sizes, b_sizes = np.bincount(found.a_group), np.bincount(found.b_group)
                a_first = np.searchsorted(found.a_text, np.arange(len(part) + 1))
                b_first = np.searchsorted(found.b_text, np.arange(len(part) + 1))
                link_first = np.searchsorted(link_text, np.arange(len(part) + 1))
                group_first = np.searchsorted(group_text, np.arange(len(part) + 1))
                for k in range(len(part)):
                    a0, b0 = a_first[k], b_first[k]
                    linked = slice(link_first[k], link_first[k + 1])
                    groups = slice(group_first[k], group_first[k + 1])
                    out[0].append(found.a[a0:a_first[k + 1]].tolist())
                    out[1].append(found.b[b0:b_first[k + 1]].tolist())
                    out[2].append([{"a": x, "b": y} for x, y in zip((link_a[linked] - a0).tolist(),
                                                                    (link_b[linked] - b0).tolist())])
                    out[3].append([{"n_a": x, "n_b": y} for x, y in zip(a_sizes[groups].tolist(),
                                                                        b_sizes[groups].tolist())])
            return out

        return work

    return add_columns(docs, text_col, make, [
        ("a_ids", "array<int>", ints), ("b_ids", "array<int>", ints),
        ("links", "array<struct<a:int,b:int>>", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
        ("groups", "array<struct<n_a:int,n_b:int>>", pa.list_(pa.struct([("n_a", pa.int32()), ("n_b", pa.int32())])))],
        keep, step=128)


# --- counts over the corpus --------------------------------------------------

def document_pairs(docs: DataFrame, text_col: str, keep: list[str], a_path: str, b_path: str,
                   links: str = OVERLAP) -> DataFrame:
    """Per document its token, group and link counts, the digest of its groups,
    and its distinct id pairs (``a * width + b``) with their numbers."""
    def make():
        a_side, b_side = sides(a_path, b_path)
        width = len(b_side.tokens)

        def work(texts: list) -> list:
            out: list[list] = [[], [], [], [], [], [], []]
            for part in batches_of(texts):
                n = len(part)
                found = align(part, a_side, b_side, links)
                codes = found.a[found.link_a] * width + found.b[found.link_b]
                link_text = found.a_text[found.link_a]
                order = np.lexsort((codes, link_text))
                codes, link_text = codes[order], link_text[order]
                first = np.flatnonzero(np.concatenate([[True], (np.diff(codes) != 0) | (np.diff(link_text) != 0)])
                                       ) if len(codes) else np.zeros(0, dtype=np.int64)
                times = np.diff(np.append(first, len(codes)))
                bounds = np.searchsorted(link_text[first], np.arange(n + 1))
                for column, of in zip(out, (found.a_text, found.b_text, found.a_text[found.a_cut], link_text)):
                    column += np.bincount(of, minlength=n).tolist()
                for k, text in enumerate(group_strings(found, n, a_side, b_side)):
                    out[4].append(hashlib.sha256(text.encode("ascii")).hexdigest() if text else "")
                    out[5].append(codes[first][bounds[k]:bounds[k + 1]])
                    out[6].append(times[bounds[k]:bounds[k + 1]])
            return out

        return work

    longs = [(c, "bigint", pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    return add_columns(docs, text_col, make, [
        *longs, ("groups_sha256", "string", pa.string()),
        ("pairs", "array<bigint>", pa.list_(pa.int64())), ("times", "array<bigint>", pa.list_(pa.int64()))],
        keep, step=128)


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """(pair, links, best): corpus-wide links of every id pair, and whether that
    is the highest count of its B id."""
    counts = (found.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair"))
              .agg(F.sum("times").alias("links")))
    counts = stored(counts, "pair-counts")
    side = F.col("pair") % width
    top = counts.groupBy(side.alias("b")).agg(F.max("links").alias("most"))
    return (counts.withColumn("b", side).join(top, "b")
            .select("pair", "links", (F.col("links") == F.col("most")).alias("best")))


def add_head_sums(found: DataFrame, head: pa.Table) -> DataFrame:
    """Add ``n_best`` and ``count_sum`` over the pairs of ``head`` and the arrays
    ``rest_pairs``, ``rest_times`` of the others."""
    pair = head.column("pair").to_numpy()
    order = np.argsort(pair)
    shared = found.sparkSession.sparkContext.broadcast(
        (pair[order], head.column("links").to_numpy()[order], head.column("best").to_numpy(zero_copy_only=False)[order]))
    keep = [c for c in found.columns if c not in ("pairs", "times")]
    schema = StructType([found.schema[c] for c in keep] + list(StructType.fromDDL(
        "n_best bigint, count_sum bigint, rest_pairs array<bigint>, rest_times array<bigint>").fields))

    def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, links, best = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                column = part.column("pairs")
                sizes = column.value_lengths().to_numpy(zero_copy_only=False)
                code, times = column.flatten().to_numpy(), part.column("times").flatten().to_numpy()
                row = np.repeat(np.arange(part.num_rows), sizes)
                at = np.minimum(np.searchsorted(pairs, code), max(len(pairs) - 1, 0))
                known = pairs[at] == code if len(pairs) else np.zeros(len(code), dtype=bool)
                place = at[known]
                count_sum = np.zeros(part.num_rows, dtype=np.int64)
                n_best = np.zeros(part.num_rows, dtype=np.int64)
                np.add.at(count_sum, row[known], times[known] * links[place])
                np.add.at(n_best, row[known], times[known] * best[place])
                left = np.bincount(row[~known], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [pa.array(n_best), pa.array(count_sum),
                                                      lists(code[~known], left), lists(times[~known], left)],
                    names=[*keep, "n_best", "count_sum", "rest_pairs", "rest_times"])

    return found.mapInArrow(run, schema)


def alignment_counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None,
                     a_path: str | None = None, b_path: str | None = None,
                     head_pairs: int = HEAD_PAIRS, links: str = OVERLAP) -> DataFrame:
    """The kept columns (all by default) with n_a, n_b, n_groups, n_links,
    groups_sha256, and n_best and count_sum from the corpus-wide counts of the
    pairs linked as ``links`` says."""
    a_path, b_path = paths(a_path, b_path)
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"kept_{k}") for k, c in enumerate(keep)],
                          F.col(text_col).alias("aligned_text"),
                          F.monotonically_increasing_id().alias(ROW_KEY))
    # written once, so the row numbers are the same for every reader
    found = stored(document_pairs(renamed, "aligned_text", [f"kept_{k}" for k in range(len(keep))] + [ROW_KEY],
                                  a_path, b_path, links), "aligned")
    width = len(sides(a_path, b_path)[1].tokens)
    counts = stored(pair_counts(found, width), "pairs")
    head = counts.orderBy(F.desc("links"), "pair").limit(head_pairs)
    near = stored(add_head_sums(found, head.toArrow()), "aligned-head")
    rest = (near.where(F.size("rest_pairs") > 0)
            .select(ROW_KEY, F.inline(F.arrays_zip("rest_pairs", "rest_times")))
            .join(counts, F.col("rest_pairs") == F.col("pair"))
            .groupBy(ROW_KEY).agg(F.sum(F.col("rest_times") * F.col("links")).alias("rest_sum"),
                                  F.sum(F.when(F.col("best"), F.col("rest_times")).otherwise(0)).alias("rest_best")))
    more = near.join(rest, ROW_KEY, "left")
    total = {"n_best": F.col("n_best") + F.coalesce("rest_best", F.lit(0)),
             "count_sum": F.col("count_sum") + F.coalesce("rest_sum", F.lit(0))}
    return more.select(*[F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)],
                       *[total.get(c, F.col(c)).alias(c) for c in names])
