"""Token ids of whole texts with a public tokenizer file, through a word cache.

The tokenizer drops white space and never merges across it, so a text's ids are
the ids of its space-separated chunks in order; every distinct chunk is encoded
once (the cache lives as long as the Python worker; it is emptied at
``CACHE_CHUNKS``, long chunks are not kept).
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from scriptlens.llm.common import kept_in_worker

EOS = 1
TOKENIZER = "word_bpe_49k.json"
CACHE_CHUNKS = 700_000
LONG_CHUNK = 64


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


ENCODER = "chunk encoder"


def shared_encoder(path: str) -> ChunkEncoder:
    """One encoder per Python worker, so tasks that share a worker share its cache;
    tasks of other operators drop it."""
    encoder = kept_in_worker(ENCODER, lambda: ChunkEncoder(path))
    if encoder.path != path:
        kept_in_worker(None)
        encoder = kept_in_worker(ENCODER, lambda: ChunkEncoder(path))
    return encoder


class ChunkEncoder:
    """``encode(texts)`` -> (ids of all texts, end offset of each text); every
    text's ids end with ``eos``."""

    def __init__(self, path: str, eos: int = EOS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.word_end[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.eos = eos
        self.reset()

    def reset(self) -> None:
        self.rows: dict[str, int] = {"": 1}
        self.pool = np.array([self.eos], dtype=np.uint32)   # row 0: the end id, row 1: nothing
        self.start = np.array([0, 1], dtype=np.int64)
        self.length = np.array([1, 0], dtype=np.int64)

    def store(self, chunks: list[str], lengths: np.ndarray, flat: np.ndarray) -> None:
        base = len(self.start)
        self.rows.update(zip(chunks, range(base, base + len(chunks))))
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.pool = np.concatenate([self.pool, flat])

    def gather(self, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a sequence of rows, and the end offset of each row."""
        lengths = self.length[coded]
        stops = np.cumsum(lengths)
        total = int(stops[-1]) if len(stops) else 0
        at = np.repeat(self.start[coded] - (stops - lengths), lengths) + np.arange(total)
        return self.pool[at], stops

    def add(self, chunks: set[str]) -> None:
        """Encode new chunks. A chunk of letters is one unit of the tokenizer,
        and so is a single mark behind it: units are encoded together and told
        apart by their word-end tokens; everything else goes one by one."""
        rows = self.rows
        units: set[str] = set()
        same, bodies = [], []           # chunk -> the unit it equals
        pairs, parts = [], []           # chunk -> unit, mark
        rest = []
        for c in chunks:
            # one-to-one case mappings only
            body = c.lower() if c.isascii() or max(c) < "\u0130" else c
            if body.isalpha():
                if body not in rows:
                    units.add(body)
                if body != c:
                    same.append(c)
                    bodies.append(body)
            elif body[-1] in ".,!?;:" and (core := body[:-1]).isalpha():
                if core not in rows:
                    units.add(core)
                pairs.append(c)
                parts.append(core)
                parts.append(body[-1])
            else:
                rest.append(c)
        units.update(m for m in ".,!?;:" if m not in rows)
        if units:
            todo = list(units)
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(todo)], add_special_tokens=False)[0].ids,
                           dtype=np.uint32)
            stops = np.flatnonzero(self.word_end[ids]) + 1
            if len(stops) == len(todo):
                self.store(todo, np.diff(stops, prepend=0), ids)
            else:   # a unit that the tokenizer splits: one by one
                self.one_by_one(todo)
        if rest:
            self.one_by_one(rest)
        rows.update(zip(same, map(rows.__getitem__, bodies)))
        if pairs:
            flat, stops = self.gather(np.fromiter(map(rows.__getitem__, parts), dtype=np.int64, count=len(parts)))
            self.store(pairs, np.diff(stops[1::2], prepend=0), flat)

    def one_by_one(self, chunks: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        self.store(chunks, lengths, np.fromiter(chain.from_iterable(found), dtype=np.uint32,
                                                count=int(lengths.sum())))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.rows) > CACHE_CHUNKS:
            self.reset()
        split = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        new = set().union(*split).difference(self.rows)
        if new:
            self.add(new)
        counts = np.fromiter((len(words) + 1 for words in split), dtype=np.int64, count=len(split))
        ends = np.cumsum(counts)
        coded = np.zeros(int(counts.sum()), dtype=np.int64)   # row 0 closes every text
        inner = np.ones(len(coded), dtype=bool)
        inner[ends - 1] = False
        coded[inner] = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(split)), dtype=np.int64,
                                   count=len(coded) - len(split))
        for c in new:
            if len(c) > LONG_CHUNK:
                self.rows.pop(c, None)
        ids, stops = self.gather(coded)
        return ids, stops[ends - 1] if len(ends) else np.zeros(0, dtype=np.int64)
