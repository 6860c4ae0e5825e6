"""Op 4, language identification of mixed texts.

Script ranges narrow the candidate languages of every word, character trigrams
and known words score it per candidate, and a Viterbi pass with a switching
penalty labels the spans of a text. The document's language is the one whose
spans hold most words; ``score`` is its share of the text's words, weighted by
the words' posteriors.

The word model is trained on a bounded, hash-chosen sample of about
``TRAIN_DOCS`` labelled documents per language; prediction reads whole texts only.

Defined results: null text and text without a letter give ``und`` with score 0;
without any labelled document every text is ``und``; repeated rows get equal
results; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptlens.llm.common import add_columns

WORD = re.compile(r"[^\W\d_]+")
UND = "und"
TRAIN_DOCS = 800            # of the sample, per language
MIN_SCRIPT_SHARE = 0.02     # of a language's training words
FLOOR = -6.0                # least log posterior of one word
SWITCH = 8.0                # penalty of changing the language between two words
CACHE_WORDS = 300_000
CELLS = 1_500_000           # words times languages of one padded Viterbi block

# fixed values: first code points of script ranges
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x1780, "khmer"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x31F0, "kana"),
    (0x3400, "han"), (0xA960, "hangul"), (0xAB00, "other"), (0xAC00, "hangul"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFF21, "latin"), (0xFF66, "kana"), (0x10000, "other"), (0x20000, "han"),
)
STARTS = [s for s, _ in SCRIPTS]


def script_of(word: str) -> str:
    """Script of the word's first letter."""
    for c in word:
        if c.isalpha():
            return SCRIPTS[bisect_right(STARTS, ord(c)) - 1][1]
    return ""


def trigram_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of the words, each set between marks, as integers (three code
    points of 21 bits), and where each word's trigrams start."""
    marked = "<" + "><".join(words) + ">"
    code = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    keys = (code[:-2] << 42) | (code[1:-1] << 21) | code[2:]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 2)
    inside = np.ones(len(code), dtype=bool)     # a word of n letters has n trigrams
    inside[ends - 1] = False
    inside[ends - 2] = False
    return keys[inside[:-2]], np.cumsum(lengths) - lengths


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", per_lang: int = TRAIN_DOCS) -> dict:
    """Trigram and word counts per language of the labelled sample; counts are
    summed in Spark, only those of two or more come to the driver. The sample
    takes the documents whose hash lies under their language's share, so it
    neither joins nor sorts."""
    labelled = docs.where(usable & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    parts = 1 << 20
    place = F.pmod(F.xxhash64(F.lit(3), F.col(id_col)), F.lit(parts))
    under = F.lit(False)
    for lang, n in sorted(sizes.items()):
        under = under | ((F.col(lang_col) == lang) & (place < max(1, int(parts * min(1.0, per_lang / n)))))
    sample = labelled.where(under).select(F.col(text_col).alias("body"), F.col(lang_col).alias("tag"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = {}
        for pdf in batches:
            for body, tag in zip(pdf["body"], pdf["tag"]):
                words = [w for w in WORD.findall((body or "").lower()) if script_of(w)]
                c = seen.setdefault(tag, Counter())
                if words:
                    c.update("#" + script_of(w) for w in words)
                    c.update("=" + w for w in words)
                    c.update(trigram_keys(words)[0].tolist())
        for tag, c in seen.items():
            yield pd.DataFrame({"tag": tag, "gram": list(map(str, c)), "n": list(c.values())})

    counts = (sample.mapInPandas(count, "tag string, gram string, n long")
              .groupBy("tag", "gram").agg(F.sum("n").alias("n"))
              .where((F.col("n") > 1) | F.col("gram").startswith("#")).toArrow())
    langs = sorted(sizes)
    column = {tag: k for k, tag in enumerate(langs)}
    scripts: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    cells = []
    for tag, gram, n in zip(*(counts.column(c).to_pylist() for c in ("tag", "gram", "n"))):
        if gram[0] == "#":
            scripts.setdefault(gram[1:], np.zeros(len(langs)))[column[tag]] = n
        else:
            cells.append((rows.setdefault(gram, len(rows)), column[tag], n))
    matrix = np.zeros((len(rows) + 1, max(1, len(langs))))      # the last row is any unknown gram
    if cells:
        at = np.array(cells, dtype=np.int64)
        matrix[at[:, 0], at[:, 1]] = at[:, 2]
    matrix = np.log((matrix + 0.5) / (matrix.sum(axis=0) + 0.5 * len(matrix)))
    keys = np.array(sorted(int(g) for g in rows if g[0] != "="), dtype=np.int64)
    total = sum(scripts.values()) if scripts else np.zeros(len(langs))
    return {
        "langs": langs, "keys": keys, "key_rows": np.array([rows[str(k)] for k in keys], dtype=np.int64),
        "words": {g[1:]: k for g, k in rows.items() if g[0] == "="}, "matrix": matrix.astype(np.float32),
        "scripts": {s: v >= MIN_SCRIPT_SHARE * np.maximum(total, 1) for s, v in scripts.items()}}


class WordScores:
    """Cached log posteriors of words; row 0 is a word without a letter."""

    def __init__(self, model: dict):
        self.model, self.n = model, len(model["langs"])
        self.reset()

    def reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((1, self.n), dtype=np.float32)

    def ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        rows = self.rows
        new = set().union(*texts).difference(rows)
        if new:
            self.add(list(new))
        return [np.fromiter(map(rows.__getitem__, words), dtype=np.int32, count=len(words)) for words in texts]

    def add(self, new: list[str]) -> None:
        scripts = list(map(script_of, new))
        self.rows.update((w, 0) for w, s in zip(new, scripts) if not s)
        kept = [w for w, s in zip(new, scripts) if s]
        if not kept:
            return
        m = self.model
        unknown = len(m["matrix"]) - 1
        keys, starts = trigram_keys(kept)
        rows = np.full(len(keys), unknown)
        if len(m["keys"]):
            at = np.minimum(np.searchsorted(m["keys"], keys), len(m["keys"]) - 1)
            rows = np.where(m["keys"][at] == keys, m["key_rows"][at], unknown)
        known = m["words"]
        raw = (np.add.reduceat(m["matrix"][rows], starts, axis=0)
               + m["matrix"][[known.get(w, unknown) for w in kept]])
        names = sorted(set(scripts) - {""})
        every = np.ones(self.n, dtype=bool)
        masks = np.array([v if (v := m["scripts"].get(s)) is not None and v.any() else every for s in names])
        number = {s: k for k, s in enumerate(names)}
        raw = np.where(masks[[number[s] for s in scripts if s]], raw, -1e9)
        raw = raw - raw.max(axis=1, keepdims=True)
        post = np.maximum(raw - np.log(np.exp(raw).sum(axis=1, keepdims=True)), FLOOR)
        base = len(self.scores)
        self.rows.update(zip(kept, range(base, base + len(kept))))
        self.scores = np.concatenate([self.scores, post.astype(np.float32)])


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label paths (words, texts) of a padded block ``(words, texts,
    languages)`` whose texts come in order of their lengths."""
    t, b, n = scores.shape
    best = scores[0].copy()
    back = np.zeros((t, b, n), dtype=np.int8 if n < 127 else np.int16)
    stay = np.arange(n, dtype=back.dtype)
    back[:] = stay
    first = np.searchsorted(lengths, np.arange(t), side="right")    # texts that still run
    for k in range(1, t):
        f = first[k]
        run = best[f:]
        top = run.argmax(axis=1)
        jump = (run.max(axis=1) - switch)[:, None]
        np.copyto(back[k, f:], top[:, None], where=jump > run, casting="unsafe")
        np.maximum(run, jump, out=run)
        run += scores[k, f:]
    path = np.zeros((t, b), dtype=np.int16)
    state, rows = best.argmax(axis=1), np.arange(b)
    for k in range(t - 1, -1, -1):
        path[k] = state
        state = back[k, rows, state]
    return path


def label_texts(texts: list[str], cache: WordScores, switch: float = SWITCH) -> list[tuple]:
    """(language, score, spans) of each text; a span is (language, first word,
    word after the last)."""
    n = cache.n
    if len(cache.rows) > CACHE_WORDS:
        cache.reset()
    coded = cache.ids([WORD.findall(t.lower()) for t in texts])
    coded = [c[c > 0] if len(c) and not c.all() else c for c in coded]
    result: list[tuple] = [(UND, 0.0, [])] * len(texts)
    order = sorted((k for k, c in enumerate(coded) if len(c)), key=lambda k: len(coded[k]))
    langs = cache.model["langs"]
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * len(coded[order[end]]) * n <= CELLS:
            end += 1
        block = order[at:end]
        at = end
        lengths = np.array([len(coded[k]) for k in block])
        ids = np.zeros((lengths[-1], len(block)), dtype=np.int32)
        for row, k in enumerate(block):
            ids[:lengths[row], row] = coded[k]
        scores = cache.scores[ids]
        path = viterbi(scores, lengths, switch)
        for row, k in enumerate(block):
            labels = path[:lengths[row], row]
            votes = np.bincount(labels, minlength=n)
            top = int(votes.argmax())
            sure = np.exp(scores[:lengths[row], row, top][labels == top]).sum()
            cuts = np.flatnonzero(np.diff(labels)) + 1
            edges = [0, *cuts.tolist(), len(labels)]
            result[k] = (langs[top], float(sure / len(labels)),
                         [(langs[labels[a]], a, b) for a, b in zip(edges, edges[1:])])
    return result


def char_spans(text: str, spans: list[tuple]) -> list[tuple]:
    """Word spans as code-point spans of the text."""
    # a word of the lower-cased text may differ in length from the text's own
    # (rare case mappings), so offsets come from the text itself
    found = [m.span() for m in WORD.finditer(text) if any(c.isalpha() for c in m.group())]
    last = len(found) - 1
    return [(lang, found[min(a, last)][0], found[min(b - 1, last)][1]) for lang, a, b in spans] if found else []


def label_languages(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
                    with_spans: bool = True, switch: float = SWITCH) -> DataFrame:
    """Per row: id, ``lang_pred``, ``score`` and the labelled spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        cache = WordScores(shared.value)

        def run(texts: list) -> list:
            texts = [t or "" for t in texts]
            found = label_texts(texts, cache, switch) if cache.n else [(UND, 0.0, [])] * len(texts)
            spans = [[{"lang": g, "start": a, "end": b} for g, a, b in char_spans(t, f[2])]
                     if with_spans else [] for t, f in zip(texts, found)]
            return [[f[0] for f in found], [f[1] for f in found], [len(f[2]) for f in found], spans]

        return run

    span = pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    return add_columns(docs, text_col, make, [
        ("lang_pred", "string", pa.string()), ("score", "double", pa.float64()),
        ("n_spans", "int", pa.int32()),
        ("spans", "array<struct<lang:string,start:int,end:int>>", pa.list_(span))], [id_col])
