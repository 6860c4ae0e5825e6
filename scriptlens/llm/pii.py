"""Op 1, personal data: patterns plus a character BiLSTM-CRF.

Base spans are the contract's patterns with their checks. A character-level
bidirectional LSTM with CRF transitions, trained in numpy from labelled spans,
adds spans the patterns miss (phone numbers without a plus sign, addresses in
brackets and the like). Every span kind holds a digit or an at sign, so the
tagger reads the overlapping windows around those characters: a window without
one can't yield a span. Windows that overlap form a run; their tag scores are
averaged per character, weighted to the window's centre, and one Viterbi path is
decoded over the whole run, so no window border cuts a span. A run whose path ends
inside a span grows to that side until the span ends or the text does. The spans
that a window sees whole are candidates too; a weighted interval schedule over the
whole text keeps the best set that doesn't overlap. An added span must reach its
kind's least margin (chosen on generated validation lines), hold what its kind needs
and touch no base span. A long run is decoded in pieces of bounded memory that give
the path of the whole.

Labelled spans come from ``labelled_example``, a seeded generator of marked
lines in many notations with look-alikes (dates, versions, order numbers, hex
keys) between them.

Defined results: null is the empty text, which has no spans; repeated rows get
equal results; an empty table gives no rows; further columns are kept by
``find_spans`` only if asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scriptlens.llm.common import add_columns

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
EMAIL_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
AT_CORE = re.compile(r"[^\s@]+\s?[(\[]?@[)\]]?\s?[^\s@]+")
TRIGGER = re.compile(r"[0-9@]")

WINDOW = 64
STRIDE = 32
HIDDEN = 16
EMBED = 12
TAGS = 1 + 2 * len(KINDS)       # O, then begin and inside of each kind
BLOCK = 1024                    # windows scored at a time
PRECISION = 0.98                # of each kind's added spans on the validation lines
TRAIN_EXAMPLES = 9_000
VALIDATION_EXAMPLES = 1_000
SEED = 11


# --- base patterns -------------------------------------------------------------

def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the contract's patterns, by start, then kind."""
    found: list[tuple[int, int, int]] = []
    at = text.find("@")
    while at >= 0:
        # a match lies inside one run of its characters: search that run only
        lo = at
        while lo and (text[lo - 1].isascii() and (text[lo - 1].isalnum() or text[lo - 1] in "._%+-@")):
            lo -= 1
        hi = EMAIL_RUN.match(text, at).end()
        found += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text, lo, hi)]
        at = text.find("@", hi)
    if not any(d in text for d in "0123456789"):
        return sorted(found)
    for m in IP.finditer(text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        d = digits_of(m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(digits_of(m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def valid_added(kind: int, s: str) -> bool:
    """What an added span must hold."""
    d = digits_of(s)
    if kind == 0:
        left, _, right = s.partition("@")
        return bool(re.search(r"\w", left)) and bool(re.search(r"[^\W\d_]", right)) and s.count("@") == 1
    if kind == 1:
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and bool(re.search(r"[0-9][^0-9]+[0-9]", s)) and len(set(d)) > 2


# --- labelled lines ---------------------------------------------------------------

def labelled_example(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated line and its (start, end, kind) labels."""
    letters = "abcdefghijklmnopqrstuvwxyzäöüéèñó"

    def number(n: int, first: str = "0123456789") -> str:
        return rng.choice(list(first)) + "".join(rng.choice(list("0123456789"), n - 1)) if n else ""

    def word(lo: int = 2, hi: int = 9) -> str:
        w = "".join(rng.choice(list(letters), rng.integers(lo, hi)))
        return w.capitalize() if rng.random() < 0.15 else w

    def name() -> str:
        return "".join(rng.choice(list(letters[:26]), rng.integers(3, 9)))

    def email() -> str:
        user = name() + rng.choice(["", ".", "_", "-", "+"]) + rng.choice([name(), number(2), ""])
        host = name() + rng.choice(["", "-" + name(), number(1)])
        at = rng.choice(["@", "@", "@", " @ ", "(@)", "[@]", " (@) ", " [@] "])
        return (user.rstrip("._-+") or "x") + at + host + rng.choice([".com", ".org", ".net", ".example.com", ".de"])

    def ip() -> str:
        return rng.choice([".", ".", ".", " . ", "[.]"]).join(str(rng.integers(0, 256)) for _ in range(4))

    def card() -> str:
        body = number(int(rng.choice([13, 14, 15, 15, 15, 18])), "3456")
        body += next(str(c) for c in range(10) if luhn(body + str(c)))
        step, sep = 4, rng.choice(["", "", " ", "-", ".", "/"])
        return sep.join(body[k:k + step] for k in range(0, len(body), step))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return rng.choice([
            f"+{number(1, '123456789')} ({a}) {b}-{c}", f"+{number(2, '123456789')} {a} {b} {c}", f"({a}) {b}-{c}",
            f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a} {b}{c}", f"00{number(2, '1234')} {a} {b} {c}",
            f"({a}) {b} {c}", f"0{a}/{b}{c}", f"tel:{a}-{b}-{c}"[4:]])

    def lookalike() -> str:
        return rng.choice([
            f"{rng.integers(1, 29)}.{rng.integers(1, 13)}.{rng.integers(1950, 2030)}",
            f"{rng.integers(1950, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}",
            f"{rng.integers(0, 24)}:{rng.integers(10, 60)}", f"v{rng.integers(0, 9)}.{rng.integers(0, 99)}.{rng.integers(0, 9)}",
            f"{number(int(rng.integers(1, 13)))}", f"#{number(6)}", f"{number(2)},{number(3)}.{number(2)}",
            f"AKIA{''.join(rng.choice(list('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'), 16))}",
            f'token = "{"".join(rng.choice(list("0123456789abcdef"), 32))}"', f"{name()}={number(4)}",
            f"@{name()}", f"{number(16)}", f"{number(3)} {word()} {number(2)}", f"ISBN {number(3)}-{number(10)}"])

    text, labels = "", []
    makers = (email, ip, card, phone)
    bare = rng.random() < 0.2                   # a line that begins or ends with its span
    for part in range(int(rng.integers(1, 4))):
        text += "" if bare and not part else " ".join(word() + rng.choice(["", "", "", ".", ","]) for _ in range(int(rng.integers(1, 5)))) + " "
        if rng.random() < 0.62:
            kind = int(rng.integers(0, len(KINDS)))
            piece = makers[kind]()
            labels.append((len(text), len(text) + len(piece), kind))
        else:
            piece = lookalike()
        text += piece + rng.choice([" ", " ", ". ", ", ", "\n"])
    return (text[:labels[-1][1]] if bare and labels and labels[-1][1] >= len(text) - 2 else text + word()), labels


# --- BiLSTM-CRF in numpy ----------------------------------------------------------

CLASSES = 64


def char_codes(text: str) -> np.ndarray:
    """Characters as 64 classes: digits, marks, letters folded by case."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    out = np.full(len(code), 2)                                   # anything else
    out[(code >= 48) & (code <= 57)] = 3
    low = code | 32
    out[(low >= 97) & (low <= 122) & (code < 128)] = 4
    upper = (code >= 65) & (code <= 90)
    out[upper] = 5
    out[code == 10] = 6
    hexa = ((low >= 97) & (low <= 102)) & (code < 128) & ~upper
    out[hexa] = 7
    marks = (code > 31) & (code < 127) & (out == 2)
    out[marks] = 8 + (code[marks] - 32) % 56
    out[code > 191] = 1                                           # letters beyond ASCII
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def init(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def near(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    model = {"embed": near(CLASSES, EMBED) * 3, "out": near(2 * HIDDEN, TAGS),
             "out_b": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
    for side in "fb":
        model["x" + side] = near(EMBED, 4 * HIDDEN)
        model["h" + side] = near(HIDDEN, 4 * HIDDEN)
        model["c" + side] = np.concatenate(
            [np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
    return model


def allowed() -> np.ndarray:
    """0 where a tag may follow another, else a large penalty."""
    mask = np.zeros((TAGS, TAGS), np.float32)
    for b in range(TAGS):
        if b and b % 2 == 0:                    # inside follows begin or inside of its kind
            for a in range(TAGS):
                if a not in (b, b - 1):
                    mask[a, b] = -1e4
    return mask


def lstm(m: dict, side: str, x: np.ndarray, trace: list | None = None) -> np.ndarray:
    """Hidden states (time, batch, HIDDEN) of one direction."""
    t, b, _ = x.shape
    gates = x @ m["x" + side] + m["c" + side]
    h = np.zeros((b, HIDDEN), np.float32)
    c = np.zeros((b, HIDDEN), np.float32)
    out = np.zeros((t, b, HIDDEN), np.float32)
    for k in (range(t) if side == "f" else range(t - 1, -1, -1)):
        g = gates[k] + h @ m["h" + side]
        s = sigmoid(g[:, :3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:]
        u = np.tanh(g[:, 3 * HIDDEN:])
        before, hb = c, h
        c = f * c + i * u
        tc = np.tanh(c)
        h = o * tc
        out[k] = h
        if trace is not None:
            trace.append((k, i, f, o, u, before, hb, tc))
    return out


def lstm_back(m: dict, side: str, x: np.ndarray, trace: list, dout: np.ndarray, grad: dict) -> np.ndarray:
    dx = np.zeros_like(x)
    dh = np.zeros(dout.shape[1:], np.float32)
    dc = np.zeros_like(dh)
    for k, i, f, o, u, before, hb, tc in reversed(trace):
        dh = dh + dout[k]
        dc = dc + dh * o * (1 - tc ** 2)
        dg = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o),
                             dc * i * (1 - u ** 2)], axis=1)
        grad["x" + side] += x[k].T @ dg
        grad["h" + side] += hb.T @ dg
        grad["c" + side] += dg.sum(axis=0)
        dx[k] = dg @ m["x" + side].T
        dh = dg @ m["h" + side].T
        dc = dc * f
    return dx


def emissions(m: dict, codes: np.ndarray) -> np.ndarray:
    """Tag scores (time, batch, TAGS) of windows given as (batch, time) codes."""
    x = m["embed"][codes.T]
    return np.concatenate([lstm(m, "f", x), lstm(m, "b", x)], axis=2) @ m["out"] + m["out_b"]


def crf_gradient(e: np.ndarray, trans: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the negative log likelihood for emissions and transitions, by
    forward and backward sums of probabilities scaled to one at every step."""
    t, b, _ = e.shape
    emit, move = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(trans)
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    scale = np.empty((t, b, 1), emit.dtype)
    for k in range(t):
        now = emit[k] if not k else (alpha[k - 1] @ move) * emit[k]
        scale[k] = now.sum(axis=1, keepdims=True)
        alpha[k] = now / scale[k]
    for k in range(t - 2, -1, -1):
        beta[k] = (beta[k + 1] * emit[k + 1]) @ move.T / scale[k + 1]
    de = alpha * beta
    rows = np.arange(b)
    de[np.arange(t)[:, None], rows[None, :], tags.T] -= 1
    after = emit[1:] * beta[1:] / scale[1:]
    dtrans = np.einsum("tbi,tbj->ij", alpha[:-1], after, optimize=True) * move
    np.add.at(dtrans, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
    return de / b, dtrans / b


@lru_cache(maxsize=1)
def trained(examples: int = TRAIN_EXAMPLES, seed: int = SEED, epochs: int = 6, batch: int = 192) -> dict:
    """The tagger, trained from ``examples`` generated labelled lines."""
    rng = np.random.default_rng(seed)
    codes, tags = [], []
    for _ in range(examples):
        text, labels = labelled_example(rng)
        row, tag = char_codes(text), np.zeros(len(text), dtype=np.int64)
        for a, z, kind in labels:
            tag[a:z] = 2 + 2 * kind
            tag[a] = 1 + 2 * kind
        # random window of the line, padded with class 0
        a = int(rng.integers(0, max(1, len(row) - WINDOW + 1)))
        row, tag = row[a:a + WINDOW], tag[a:a + WINDOW]
        if tag[0] and tag[0] % 2 == 0:
            cut = int(np.argmax(tag != tag[0])) if (tag != tag[0]).any() else len(tag)
            tag[:cut] = 0                       # a cut span counts as outside
        codes.append(np.pad(row, (0, WINDOW - len(row))))
        tags.append(np.pad(tag, (0, WINDOW - len(tag))))
    x, y = np.array(codes), np.array(tags)
    m, mask = init(rng), allowed()
    first = {k: np.zeros_like(v) for k, v in m.items()}
    second = {k: np.zeros_like(v) for k, v in m.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(order) - batch + 1, batch):
            pick = order[lo:lo + batch]
            grad = {k: np.zeros_like(v) for k, v in m.items()}
            emb = m["embed"][x[pick].T]
            tf, tb = [], []
            h = np.concatenate([lstm(m, "f", emb, tf), lstm(m, "b", emb, tb)], axis=2)
            de, grad["trans"] = crf_gradient(h @ m["out"] + m["out_b"], m["trans"] + mask, y[pick])
            grad["out"] = np.einsum("tbh,tbk->hk", h, de)
            grad["out_b"] = de.sum(axis=(0, 1))
            dh = de @ m["out"].T
            dx = (lstm_back(m, "f", emb, tf, dh[:, :, :HIDDEN], grad)
                  + lstm_back(m, "b", emb, tb, dh[:, :, HIDDEN:], grad))
            np.add.at(grad["embed"], x[pick].T, dx)
            step += 1
            rate = 0.02 * (1 - 0.8 * step / (epochs * (len(order) // batch)))
            for k in m:
                g = np.clip(grad[k], -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g ** 2
                m[k] = (m[k] - rate * first[k] / (1 - 0.9 ** step)
                        / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    m["least"] = least_margins(m, seed + 1)
    return m


def least_margins(m: dict, seed: int, examples: int = VALIDATION_EXAMPLES, precision: float = PRECISION) -> np.ndarray:
    """Per kind the least mean margin an added span needs: the lowest one at which
    the added spans of generated validation lines have the given precision."""
    rng = np.random.default_rng(seed)
    lines = [labelled_example(rng) for _ in range(examples)]
    found: list[list[tuple[float, bool]]] = [[] for _ in KINDS]
    for (text, labels), tagged in zip(lines, tagged_spans([t for t, _ in lines], m)):
        base = base_spans(text)
        for span in tagged:
            for a, kind, z in added_spans(text, [span], base, np.full(len(KINDS), -np.inf)):
                found[kind].append((span[3] / (span[1] - span[0]), (a, z, kind) in labels))
    least = np.zeros(len(KINDS))
    for kind, cases in enumerate(found):
        cases.sort(reverse=True)
        right = np.cumsum([ok for _, ok in cases]) if cases else np.zeros(0)
        good = np.flatnonzero(right >= precision * np.arange(1, len(cases) + 1))
        least[kind] = cases[good[-1]][0] if len(good) else np.inf
    return least


def decode(m: dict, scores: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Viterbi tags of each (time, TAGS) sequence of tag scores, and each
    character's margin over outside."""
    trans = m["trans"] + allowed()
    lengths = np.array([len(s) for s in scores])
    t, b = int(lengths.max()), len(scores)
    e = np.zeros((t, b, TAGS), np.float32)
    for row, s in enumerate(scores):
        e[:len(s), row] = s
    best, back = e[0].copy(), np.zeros((t, b, TAGS), dtype=np.int8)
    best[:, 2::2] -= 1e4                        # a path can't start inside a span
    for k in range(1, t):
        move = best[:, :, None] + trans
        live = (k < lengths)[:, None]           # a path that has ended stands still
        back[k] = np.where(live, move.argmax(axis=1), np.arange(TAGS))
        best = np.where(live, move.max(axis=1) + e[k], best)
        best -= best.max(axis=1, keepdims=True)
    tags = np.zeros((b, t), dtype=np.int64)
    state, rows = best.argmax(axis=1), np.arange(b)
    for k in range(t - 1, -1, -1):
        tags[:, k] = state
        state = back[k][rows, state]
    return [(tags[row, :n], np.take_along_axis(s, tags[row, :n, None], 1)[:, 0] - s[:, 0])
            for row, (n, s) in enumerate(zip(lengths, scores))]


# --- windows, reconciliation -------------------------------------------------------

def windows_of(text: str) -> list[int]:
    """Starts of the overlapping windows that hold a digit or an at sign."""
    starts: set[int] = set()
    for m in TRIGGER.finditer(text):
        k = m.start() // STRIDE
        starts.add(k)
        if k:
            starts.add(k - 1)
    return [k * STRIDE for k in sorted(starts)]


def schedule(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """The set of non-overlapping (start, end, kind, score) of greatest score."""
    spans = sorted(set(spans), key=lambda s: (s[1], s[0], s[2]))
    ends = [s[1] for s in spans]
    from bisect import bisect_right

    best: list[tuple[float, tuple]] = [(0.0, ())]
    for k, s in enumerate(spans):
        before = best[bisect_right(ends, s[0], 0, k)]
        best.append(max(best[k], (before[0] + s[3], (before[1], s)), key=lambda x: x[0]))
    chosen, chain = [], best[-1][1]
    while chain:
        chain, s = chain
        chosen.append(s)
    return chosen[::-1]


CENTRE = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]


def runs_of(text: str) -> list[tuple[int, int]]:
    """(first, last) window number of each run of overlapping windows."""
    runs: list[tuple[int, int]] = []
    for a in windows_of(text):
        k = a // STRIDE
        if runs and runs[-1][1] == k - 1:
            runs[-1] = (runs[-1][0], k)
        else:
            runs.append((k, k))
    return runs


def spans_in(tag: np.ndarray, margin: np.ndarray, a: int) -> Iterator[tuple[int, int, int, float]]:
    """(start, end, kind, score) of a path that starts at character ``a``."""
    for i in np.flatnonzero(tag % 2 == 1):
        j = i + 1
        while j < len(tag) and tag[j] == tag[i] + 1:
            j += 1
        yield a + int(i), a + int(j), int(tag[i] - 1) // 2, round(float(margin[i:j].sum()), 4)


def window_scores(m: dict, texts: list[str], at: list[tuple[int, int]], seen: list[set]) -> np.ndarray:
    """Tag scores (time, window, TAGS) of windows given as (text, start). Spans that
    a window sees whole are added to ``seen`` of their text."""
    codes = np.zeros((len(at), WINDOW), dtype=np.int64)
    for row, (k, a) in enumerate(at):
        c = char_codes(texts[k][a:a + WINDOW])
        codes[row, :len(c)] = c
    e = emissions(m, codes)
    for (k, a), (tag, margin) in zip(at, decode(m, list(e.transpose(1, 0, 2)))):
        if tag.any():
            n = len(texts[k])
            seen[k].update(s for s in spans_in(tag[:n - a], margin, a)
                           if (s[0] > a or not a) and (s[1] < a + WINDOW or s[1] == n))
    return e


def run_scores(m: dict, texts: list[str], runs: list[tuple[int, int, int]], block: int,
               seen: list[set]) -> list[np.ndarray]:
    """Tag scores (time, TAGS) of (text, first, last) runs: the mean of the
    windows' scores, weighted to their centres."""
    at = [(r, k, w * STRIDE) for r, (k, first, last) in enumerate(runs) for w in range(first, last + 1)]
    sizes = [min((last - first) * STRIDE + WINDOW, len(texts[k]) - first * STRIDE) for k, first, last in runs]
    total = [np.zeros((n, TAGS), np.float32) for n in sizes]
    weight = [np.zeros((n, 1), np.float32) for n in sizes]
    for lo in range(0, len(at), block):
        part = at[lo:lo + block]
        e = window_scores(m, texts, [(k, a) for _, k, a in part], seen)
        for row, (r, k, a) in enumerate(part):
            lo_at = a - runs[r][1] * STRIDE
            n = min(WINDOW, sizes[r] - lo_at)
            total[r][lo_at:lo_at + n] += e[:n, row] * CENTRE[:n]
            weight[r][lo_at:lo_at + n] += CENTRE[:n]
    return [s / w for s, w in zip(total, weight)]


def long_path(m: dict, texts: list[str], run: tuple[int, int, int], block: int,
              seen: list[set]) -> tuple[np.ndarray, np.ndarray]:
    """Viterbi tags and margins of one long run, the same as those of the whole,
    from pieces of ``block`` windows: scores are kept only as far back as the
    survivor paths still differ, tags and margins take five bytes a character."""
    k, first, last = run
    trans = m["trans"] + allowed()
    size = min((last - first) * STRIDE + WINDOW, len(texts[k]) - first * STRIDE)
    tags, margins = np.zeros(size, dtype=np.int8), np.zeros(size, np.float32)
    states = np.arange(TAGS)
    best = None
    scores = np.zeros((0, TAGS), np.float32)        # undecided characters, the last of them at the piece's end
    back = np.zeros((0, TAGS), dtype=np.int8)
    done = 0
    overlap, overlap_weight = np.zeros((STRIDE, TAGS), np.float32), np.zeros((STRIDE, 1), np.float32)
    for lo in range(first, last + 1, block):
        hi = min(lo + block - 1, last)
        e = window_scores(m, texts, [(k, w * STRIDE) for w in range(lo, hi + 1)], seen)
        total = np.zeros(((hi - lo) * STRIDE + WINDOW, TAGS), np.float32)
        weight = np.zeros((len(total), 1), np.float32)
        total[:STRIDE] += overlap
        weight[:STRIDE] += overlap_weight
        for row in range(hi - lo + 1):
            total[row * STRIDE:row * STRIDE + WINDOW] += e[:, row] * CENTRE
            weight[row * STRIDE:row * STRIDE + WINDOW] += CENTRE
        ready = size - (lo - first) * STRIDE if hi == last else (hi - lo + 1) * STRIDE
        overlap, overlap_weight = total[ready:ready + STRIDE].copy(), weight[ready:ready + STRIDE].copy()
        fresh = total[:ready] / weight[:ready]
        links = np.zeros((ready, TAGS), dtype=np.int8)
        for t in range(ready):
            if best is None:
                best = fresh[t].copy()
                best[2::2] -= 1e4                   # a path can't start inside a span
                links[t] = states
                continue
            move = best[:, None] + trans
            links[t] = move.argmax(axis=0)
            best = move.max(axis=0) + fresh[t]
            best -= best.max()
        scores, back = np.concatenate([scores, fresh]), np.concatenate([back, links])
        # walk back from every state (at the end from the best one) until the paths meet
        ends = np.array([best.argmax()]) if hi == last else states
        at = len(scores) - 1
        while at >= 0 and len(set(ends.tolist())) > 1:
            ends = back[at][ends].astype(np.int64)
            at -= 1
        state = int(ends[0])
        for t in range(at, -1, -1):
            tags[done + t] = state
            margins[done + t] = scores[t, state] - scores[t, 0]
            state = int(back[t, state])
        done += at + 1
        scores, back = scores[at + 1:], back[at + 1:]
    return tags.astype(np.int64), margins


def batches_of(runs: list[tuple[int, int, int]], block: int) -> Iterator[list[tuple[int, int, int]]]:
    """Runs of like length together, about ``block`` windows at a time; a longer
    run is alone."""
    part: list[tuple[int, int, int]] = []
    for run in sorted(runs, key=lambda r: (r[2] - r[1], r)):
        if part and (len(part) + 1) * (run[2] - run[1] + 1) > block:
            yield part
            part = []
        part.append(run)
    if part:
        yield part


def tagged_spans(texts: list[str], m: dict, block: int = BLOCK) -> list[list[tuple[int, int, int, float]]]:
    """Reconciled spans of the tagger for each text."""
    found: list[dict[tuple[int, int], list]] = [{} for _ in texts]
    seen: list[set] = [set() for _ in texts]
    todo = [(k, first, last) for k, t in enumerate(texts) for first, last in runs_of(t)]
    for k, first, last in todo:
        found[k][first, last] = []
    reach = 1                                   # windows that a run grows by
    while todo:
        grown: dict[int, list[tuple[int, int]]] = {}
        for part in batches_of(todo, block):
            if part[0][2] - part[0][1] >= block:    # a long run is alone
                paths = [long_path(m, texts, part[0], block, seen)]
            else:
                paths = decode(m, run_scores(m, texts, part, block, seen))
            for (k, first, last), (tag, margin) in zip(part, paths):
                if not tag.any():
                    continue
                a, end = first * STRIDE, (len(texts[k]) - 1) // STRIDE
                more = (max(0, first - reach) if tag[0] else first,
                        min(end, last + reach) if tag[-1] and a + len(tag) < len(texts[k]) else last)
                if more != (first, last):
                    grown.setdefault(k, []).append(more)
                    continue
                found[k][first, last] = list(spans_in(tag, margin, a))
        todo = []
        for k, wider in grown.items():
            # grown runs take in the runs that they reach
            merged: list[tuple[int, int]] = []
            for first, last in sorted([*found[k], *wider]):
                if merged and first <= merged[-1][1] + 1:
                    merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
                else:
                    merged.append((first, last))
            todo += [(k, *r) for r in merged if r not in found[k]]
            found[k] = {r: found[k].get(r, []) for r in merged}
        reach *= 2
    spans = [[*whole, *(s for part in f.values() for s in part)] for whole, f in zip(seen, found)]
    return [schedule(s) if s else s for s in spans]


def added_spans(text: str, tagged: list[tuple[int, int, int, float]], base: list[tuple[int, int, int]],
                least: np.ndarray) -> list[tuple[int, int, int]]:
    """The tagger's spans that reach their kind's ``least`` margin, hold what they
    need and touch no base span."""
    out = []
    for a, z, kind, score in tagged:
        length = z - a
        if kind == 0 and (core := AT_CORE.search(text, a, z)):      # words beside an address are none of it
            a, z = core.span()
        while a < z and text[a].isspace():
            a += 1
        while z > a and (text[z - 1].isspace() or text[z - 1] in ".,;:"):
            z -= 1
        # numbers cut out of longer ones or of words are no finds
        inner = (a and text[a - 1].isalnum()) or (z < len(text) and text[z].isalnum())
        if (not inner and score >= least[kind] * length and valid_added(kind, text[a:z])
                and all(z <= b or a >= e for b, _, e in base)):
            out.append((a, kind, z))
    return out


def find_spans(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None,
               model: dict | None = None) -> DataFrame:
    """The kept columns (all by default) and ``pii``: spans by start, then kind,
    as structs (kind, start, end, base)."""
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
    return add_columns(docs, text_col, lambda: lambda texts: [spans_of(texts, shared.value)],
                       [("pii", "array<struct<kind:string,start:int,end:int,base:boolean>>", pa.list_(span))], keep)


def spans_of(texts: list[str | None], m: dict) -> list[list[dict]]:
    """All spans of each text, by start, then kind."""
    texts = [t or "" for t in texts]
    out = []
    for text, tagged in zip(texts, tagged_spans(texts, m)):
        base = base_spans(text)
        more = added_spans(text, tagged, base, m["least"]) if tagged else []
        rows = sorted([(a, k, z, True) for a, k, z in base] + [(a, k, z, False) for a, k, z in more])
        out.append([{"kind": KINDS[k], "start": a, "end": z, "base": b} for a, k, z, b in rows])
    return out


def masked(text: str | None, spans: list) -> str | None:
    """The text with every span replaced by its kind in brackets; of spans that
    overlap, the union is replaced under the first one's kind."""
    if text is None or not spans:
        return text
    out, at, last = [], 0, None
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if last is not None and s["start"] < at:
            at = max(at, s["end"])
            continue
        out += [text[at:s["start"]], f"[{s['kind'].upper()}]"]
        at, last = s["end"], s
    return "".join(out) + text[at:]


def mask_texts(docs: DataFrame, text_col: str = "text", model: dict | None = None) -> DataFrame:
    """``docs`` with the personal data of every text masked; same columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())

    def work(texts: list) -> list:
        return [[masked(t, s) for t, s in zip(texts, spans_of(texts, shared.value))]]

    return add_columns(docs, text_col, lambda: work, [(text_col, "string", pa.string())]).select(*docs.columns)
