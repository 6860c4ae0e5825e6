"""Op 11, periodic runs of words by Lyndon arrays (Baier grouping).

A text's words are numbers; phase one of a grouping suffix sorter is run on them
under both orders of the alphabet. It keeps suffixes in groups of equal Lyndon
prefix, takes the groups from the greatest down and lengthens the Lyndon prefix
of every suffix that lies left of a finished group, so the prefix lengths it ends
with are the Lyndon array; no suffix array is built. The longest Lyndon word at a
position is a run's root under one of the two orders, so a run of exponent 4 shows
three equal neighbouring roots there. Such roots are extended to both sides by
longest common extensions and become runs if they reach ``MIN_WORDS`` and
``MIN_EXPONENT``.

Words that occur fewer than ``MIN_EXPONENT`` times in their stretch of the text
can't be part of a run nor extend one; they cut the text into stretches, again
and again until nothing changes (counted for a whole batch at once), and phase one
reads what is left. This is exact; a text whose words all repeat is read in full.
Time grows with the words, memory with the longest text; texts never meet, so no
row is shuffled.

Defined results: null, empty and blank texts have no words: no runs, four nulls,
digests of the empty string. Repeated rows get equal results; an empty table gives
no rows; further columns are ignored unless kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scriptlens.llm.common import WS_WORD, add_columns

MIN_WORDS = 6
MIN_EXPONENT = 4


# --- phase one ---------------------------------------------------------------

def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word at every position; the end of the
    sequence is below every rank. Any integers serve as ranks."""
    n = len(ranks)
    length = [1] * n
    if not n:
        return length
    # groups of equal prefix: number -> suffixes (some moved on), order as a list
    # linked downwards, since splits put new groups right above their old one
    order = np.argsort(np.asarray(ranks), kind="stable").tolist()
    group = [0] * n
    members: list[list[int]] = []
    size: list[int] = []
    last = None
    for i in order:
        if ranks[i] != last:
            last = ranks[i]
            members.append([])
            size.append(0)
        group[i] = len(members) - 1
        members[-1].append(i)
        size[-1] += 1
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    top = len(members) - 1
    above[top] = -1
    # left[i + 1]: a place at or left of i that holds the nearest open suffix
    left = list(range(n + 1))
    while top >= 0:
        here = [i for i in members[top] if group[i] == top]
        for i in here:
            left[i + 1] = i
        copies: dict[int, int] = {}
        for i in here:
            at = i
            while left[at] != at:
                left[at] = left[left[at]]
                at = left[at]
            if at:
                copies[at - 1] = copies.get(at - 1, 0) + 1
        if copies:
            step = length[here[0]]
            touched: dict[tuple[int, int], list[int]] = {}
            for p, k in copies.items():
                length[p] += k * step
                touched.setdefault((group[p], k), []).append(p)
            # fewest copies last: each lands right above the old group
            for old, k in sorted(touched, reverse=True):
                moved = touched[old, k]
                if len(moved) == size[old]:
                    continue        # what is left of the group keeps its place
                new = len(members)
                members.append(moved)
                size.append(len(moved))
                size[old] -= len(moved)
                for p in moved:
                    group[p] = new
                over = above[old]
                below.append(old)
                above.append(over)
                above[old] = new
                if over >= 0:
                    below[over] = new
        top = below[top]
    return length


# --- longest common extensions -------------------------------------------------

def extension(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common prefix of two sequences, in growing steps."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        differs = a[at:min(at + step, n)] != b[at:min(at + step, n)]
        k = int(differs.argmax())
        if differs[k]:
            return at + k
        at, step = at + step, step * 2
    return n


def runs_of(ids: np.ndarray, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period. The exponent
    is 3 at least, where a run always shows two neighbouring equal roots."""
    n = len(ids)
    if n < min_words:
        return []
    shown = min_exponent - 1        # roots that lie whole in a shortest run
    found: set[tuple[int, int, int]] = set()
    for ranks in (ids, -ids):
        roots = np.array(lyndon_array(ranks.tolist()))
        at = np.arange(n)
        good = np.ones(n, dtype=bool)
        for k in range(1, shown):
            ahead = at + k * roots
            inside = ahead < n
            good &= inside & (roots[np.where(inside, ahead, 0)] == roots)
        places = np.flatnonzero(good)
        period = reach = 0
        for i in places[np.argsort(roots[places], kind="stable")].tolist():
            p = int(roots[i])
            if p != period:
                period, reach = p, 0
            if i + 2 * p <= reach:
                continue            # inside the stretch of the root before
            reach = right = i + p + extension(ids[i:], ids[i + p:])
            back = extension(ids[:i][::-1], ids[:i + p][::-1])
            if right - i + back >= max(min_words, min_exponent * p):
                found.add((i - back, right - i + back, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(text: np.ndarray, word: np.ndarray, min_words: int = MIN_WORDS,
              min_count: int = MIN_EXPONENT) -> list[tuple[int, int]]:
    """(first, end) of the stretches of the joined texts that can hold a run:
    each word occurs ``min_count`` times in its stretch."""
    at = np.arange(len(word))
    part = text.astype(np.int64)
    while len(at):
        _, where, counts = np.unique(part * (int(word.max()) + 1) + word[at], return_inverse=True, return_counts=True)
        keep = counts[where.reshape(-1)] >= min_count
        # stretches are broken where a place is missing or the text ends
        at, part = at[keep], part[keep]
        if not len(at):
            break
        cuts = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(part) != 0)])
        part = np.cumsum(cuts) - 1
        long = np.bincount(part)[part] >= min_words
        if keep.all() and long.all():
            firsts = np.flatnonzero(cuts)
            return list(zip(at[firsts].tolist(), (at[np.append(firsts[1:], len(at)) - 1] + 1).tolist()))
        at, part = at[long], part[long]
    return []


def batch_runs(word_lists: list[list[str]], min_words: int = MIN_WORDS,
               min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """Runs of every word list."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in word_lists]
    sizes = np.fromiter(map(len, word_lists), dtype=np.int64, count=len(word_lists))
    if not sizes.sum():
        return out
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for words in word_lists for w in words),
                      dtype=np.int64, count=int(sizes.sum()))
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    for lo, hi in stretches(text, ids, min_words, min_exponent):
        k = int(text[lo])
        first = int(ends[k] - sizes[k])
        out[k] += [(lo - first + s, length, p) for s, length, p in runs_of(ids[lo:hi], min_words, min_exponent)]
    return out


def first_period_kept(n: int, runs: Iterable[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: those in no run after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length over period, compared exactly; ties go to the
    smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def find_runs(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None,
              change: Callable[[object, list[str]], list[str]] | None = None, key_col: str = "doc_id",
              min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """The kept columns (all by default) with ``runs`` (array of start, length,
    period) and ``collapsed_text`` (each run reduced to its first period).
    ``change`` may edit a row's words first, given the row's ``key_col``."""
    if min_exponent < 3:
        raise ValueError("runs of exponent below 3 don't show two neighbouring roots")
    keep = list(docs.columns if keep is None else keep)
    from pyspark.sql import functions as F

    source = docs.select(*[F.col(f"`{c}`") for c in keep if c != "run_source"],
                         F.struct(F.col(key_col).alias("key"), F.col(text_col).alias("text")).alias("run_source"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def make():
        def work(rows: list) -> list:
            lists = []
            for r in rows:
                words = WS_WORD.findall(r["text"] or "")
                lists.append(change(r["key"], words) if change and words else words)
            runs = batch_runs(lists, min_words, min_exponent)
            texts = []
            for words, found in zip(lists, runs):
                if found:
                    words = [w for w, k in zip(words, first_period_kept(len(words), found).tolist()) if k]
                texts.append(" ".join(words))
            return [[[{"start": s, "length": n, "period": p} for s, n, p in found] for found in runs], texts]

        return work

    return add_columns(source, "run_source", make, [
        ("runs", "array<struct<start:bigint,length:bigint,period:bigint>>", kind),
        ("collapsed_text", "string", pa.string())], [c for c in keep if c != "run_source"])
