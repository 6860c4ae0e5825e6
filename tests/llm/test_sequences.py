"""Periodic runs, token alignment and vector search: the registered queries on
small tables against brute force, with nulls, empty and very long texts, repeated
rows, clashing columns and empty tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptlens.llm import alignment, catalog, hamming_index, periodic_runs
from scriptlens.llm.tokens import tokenizer_path

LONG = " ".join(f"w{i % 900}x{i % 7}" for i in range(9_000))
TEXTS = [
    (1, "to be or not to be " * 9), (2, None), (3, ""), (4, " \t\n "), (5, LONG), (6, "a " * 5), (7, "a " * 6),
    (8, "x a b a b a b a b y"), (9, "a b a b a b a"), (10, "one two three four five six seven"),
    (10, "one two three four five six seven"), (None, "ha ha ha ha ha ha ha"), (None, None),
    (11, "Ärger über Öl \U0001F600 ça va? <|endoftext|> it's 12 34 </s><unk><0x41>  two  spaces\n\n"),
    (12, "a literal ▁ piece mark"), (13, "日本語のテキスト 日本語"), (14, "a a a b a a a b a a a b a a a b a"),
    *[(100 + k, " ".join(f"v{(k * 7 + i) % 31}" for i in range(20 + k))) for k in range(40)],
]
SCHEMA = "doc_id long, text string, runs string, size int, run_source string, pairs string, n_a int, id string, key string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A table folder with the texts above as ``documents``."""
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "r", 1, "s", "p", 2, "i", "k") for i, t in TEXTS], SCHEMA).repartition(3).write.parquet(
        f"{at}/documents.parquet")
    return at


@pytest.fixture(scope="module")
def empty_folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return at


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


# --- periodic runs -------------------------------------------------------------

def slow_lyndon(s):
    out = []
    for i in range(len(s)):
        best = 1
        for j in range(i + 1, len(s) + 1):
            w = s[i:j]
            if all(w < w[k:] for k in range(1, len(w))):
                best = j - i
        out.append(best)
    return out


def slow_runs(s, min_words=6, min_exponent=4):
    out = []
    for q in range(1, len(s)):
        i = 0
        while i + q < len(s):
            if s[i] != s[i + q]:
                i += 1
                continue
            a = i
            while i + q < len(s) and s[i] == s[i + q]:
                i += 1
            n = i + q - a
            if n >= max(min_words, min_exponent * q) and not any(
                    all(s[a + t] == s[a + t + p] for t in range(n - p)) for p in range(1, q)):
                out.append((a, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=20))
def test_lyndon_arrays_of_both_orders(s):
    assert periodic_runs.lyndon_array(s) == slow_lyndon(s)
    assert periodic_runs.lyndon_array([-x for x in s]) == slow_lyndon([-x for x in s])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 6)), max_size=6))
def test_runs_are_those_of_brute_force(blocks):
    s = [x for block, times in blocks for x in block * times]
    for bounds in ((6, 4), (1, 3), (9, 5)):
        assert periodic_runs.runs_of(np.array(s, dtype=np.int64), *bounds) == slow_runs(s, *bounds)
    words = [str(x) for x in s]
    assert periodic_runs.batch_runs([words, [], words]) == [slow_runs(s), [], slow_runs(s)]


def test_a_long_run_and_a_long_text_without_one():
    block = [f"b{i}" for i in range(5_000)]
    words = ["x", *block * 4, *block[:17], "y"]
    assert periodic_runs.batch_runs([words, [f"u{i}" for i in range(50_000)], ["z"] * 40_000]) == [
        [(1, 20_017, 5_000)], [], [(0, 40_000, 1)]]


def contract_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = slow_runs(words)
    gone = {i for s, n_run, q in runs for i in range(s + q, s + n_run)}
    best = min(runs, key=lambda r: (-(r[1] / r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{n_run},{q}\n" for s, n_run, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op11_query_against_brute_force(spark, folder):
    out = catalog.op11_periodic_runs(spark, folder)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                           "collapsed_sha256"]
    assert {t for c, t in out.dtypes if c not in ("runs_sha256", "collapsed_sha256")} == {"bigint"}
    want = collections.Counter(contract_row(i, t) for i, t in TEXTS if t is not LONG)
    got = rows_of(out.where("doc_id is null or doc_id <> 5"))
    assert got == want
    assert sum(n for r, n in got.items() if r[1]) >= 8


def test_planted_repeats_reach_runs(spark, folder):
    changed = [i for i, t in TEXTS if t and i is not None and zlib.crc32(str(i).encode()) % 10 == 0]
    assert changed
    for i, t in TEXTS:
        if i in changed and i != 5:
            row = catalog.op11_periodic_runs(spark, folder).where(F.col("doc_id") == i).first()
            assert tuple(row) == contract_row(i, t)
            break


def test_runs_keep_other_columns_and_empty_tables(spark, folder, empty_folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = periodic_runs.find_runs(docs)
    assert out.count() == len(TEXTS) and {"size", "pairs", "collapsed_text"} <= set(out.columns)
    assert catalog.op11_periodic_runs(spark, empty_folder).collect() == []


# --- token alignment -------------------------------------------------------------

@pytest.fixture(scope="module")
def pair():
    return alignment.sides(tokenizer_path(alignment.A_FILE), tokenizer_path(alignment.B_FILE))


def slow_alignment(text, pair, kind=alignment.OVERLAP):
    """Token ids, links and the group string by comparing all pairs."""
    if not text:
        return [], [], [], ""
    a_side, b_side = pair
    (a,), (b,) = a_side.encode([text]), b_side.encode([text])
    raw = (" " + text).encode()
    if b"".join(a_side.tokens[i] for i in a) != raw or b"".join(b_side.tokens[i] for i in b) != raw:
        return [], [], [], ""

    def ranges(ids, side):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(side.tokens[i])))
            at = out[-1][1]
        return out

    ra, rb = ranges(a, a_side), ranges(b, b_side)
    links = [(i, j) for i, (s, e) in enumerate(ra) for j, (u, v) in enumerate(rb)
             if (e == v if kind == alignment.END else s < v and u < e)]
    groups, lo = [], 0
    for cut in sorted({e for _, e in ra} & {e for _, e in rb}):
        groups.append(",".join(str(a[i]) for i, (_, e) in enumerate(ra) if lo < e <= cut) + "|"
                      + ",".join(str(b[j]) for j, (_, e) in enumerate(rb) if lo < e <= cut))
        lo = cut
    return a, b, links, ";".join(groups)


SHORT = [(i, t) for i, t in TEXTS if t is not LONG]


def slow_op12(pair, kind=alignment.OVERLAP):
    found = [(i, *slow_alignment(t, pair, kind)) for i, t in SHORT]
    counts = collections.Counter((a[x], b[y]) for _, a, b, links, _ in found for x, y in links)
    top = collections.Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for i, a, b, links, groups in found:
        times = [counts[a[x], b[y]] for x, y in links]
        best = sum(n == top[b[y]] for n, (_, y) in zip(times, links))
        out.append((i, len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), best, sum(times),
                    hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    return collections.Counter(out)


@pytest.mark.parametrize("head", [None, 0, 40])
def test_op12_against_brute_force(spark, folder, pair, head):
    """Also with no pair and with few pairs in the broadcast head."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is null or doc_id <> 5")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    extra = {} if head is None else {"head_pairs": head}
    assert rows_of(alignment.alignment_counts(docs, keep=["doc_id"], **extra).select(*names)) == slow_op12(pair)


@pytest.mark.parametrize("head", [None, 40])
def test_op12_links_end_together(spark, folder, pair, head):
    """The contract's links: token pairs whose byte ranges end together."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is null or doc_id <> 5")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    extra = {} if head is None else {"head_pairs": head}
    out = alignment.alignment_counts(docs, keep=["doc_id"], links=alignment.END, **extra).select(*names)
    assert rows_of(out) == slow_op12(pair, alignment.END) != slow_op12(pair)


def test_op12_query_links_tokens_that_end_together(spark, tmp_path):
    texts = [(1, "unbelievable tokenizations"), (2, "unbelievable"), (3, None)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalog.op12_token_alignment(spark, str(tmp_path)).collect()
    assert len(rows) == 3 and all(r["n_links"] == r["n_groups"] for r in rows)
    assert any(r["n_groups"] < max(r["n_a"], r["n_b"]) for r in rows)


def test_op12_query_columns_long_text_and_empty_table(spark, folder, empty_folder, pair):
    out = catalog.op12_token_alignment(spark, folder)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {t for c, t in out.dtypes if c != "groups_sha256"} == {"bigint"}
    assert out.count() == len(TEXTS)
    (a,), (b,) = (side.encode([LONG]) for side in pair)
    row = out.where("doc_id = 5").first()
    assert (row["n_a"], row["n_b"]) == (len(a), len(b)) and row["n_links"] == row["n_groups"]
    assert catalog.op12_token_alignment(spark, empty_folder).collect() == []


def test_aligned_tokens_and_groups(spark, folder, pair):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is null or doc_id <> 5")
    out = alignment.aligned_tokens(docs, keep=["doc_id", "text"]).collect()
    assert len(out) == len(SHORT)
    for r in out:
        a, b, links, groups = slow_alignment(r["text"], pair)
        assert r["a_ids"] == a and r["b_ids"] == b and [tuple(x) for x in r["links"]] == links
        assert [(g["n_a"], g["n_b"]) for g in r["groups"]] == [
            tuple(part.count(",") + 1 for part in g.split("|")) for g in groups.split(";") if g]


def test_batches_do_not_change_an_alignment(pair):
    texts = [t for _, t in SHORT]
    whole = alignment.group_strings(alignment.align(texts, *pair), len(texts), *pair)
    parts = [alignment.group_strings(alignment.align(part, *pair), len(part), *pair)
             for part in alignment.batches_of(texts, 60)]
    assert [s for part in parts for s in part] == whole


# --- vector search -----------------------------------------------------------------

def vectors(n, width, seed=3, spread=0.35):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(1, n // 12), width))
    return centres[rng.integers(0, len(centres), n)] + spread * rng.standard_normal((n, width))


def slow_nearest(rows, asks, k=5):
    """Exact neighbours of (id, vector) rows."""
    best = {}
    for q, x in rows:
        if not asks(q):
            continue
        for v, y in rows:
            if v != q:
                c = float(np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)))
                best[q, v] = max(best.get((q, v), -2.0), c)
    out = {}
    for (q, v), c in best.items():
        out.setdefault(q, []).append((-c, v))
    return {q: [(v, -c) for c, v in sorted(found)[:k]] for q, found in out.items()}


def test_a_radius_search_finds_every_code():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (20, 32), dtype=np.uint8)
    codes = base[rng.integers(0, 20, 900)].copy()
    for row in codes:
        for bit in rng.choice(256, rng.integers(0, 60), replace=False):
            row[bit // 8] ^= 1 << (bit % 8)
    block = hamming_index.Block(np.arange(900), codes, np.ones((900, 2)))
    for code in codes[:25]:
        far = np.bitwise_count(codes ^ code).sum(axis=1)
        for radius in (0, 3, 17, 33, 47, 90, 140, 256):
            assert block.within(code, radius).tolist() == np.flatnonzero(far <= radius).tolist()


def test_both_ways_of_probing_are_used_and_agree():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 256, (6_000, 32), dtype=np.uint8)
    codes[1] = codes[0]
    block = hamming_index.Block(np.arange(6_000), codes, np.ones((6_000, 2)))
    assert hamming_index.WITHIN[2] < len(block.keys[0]) < hamming_index.WITHIN[6]
    for radius in (40, 110):
        far = np.bitwise_count(codes ^ codes[0]).sum(axis=1)
        assert block.within(codes[0], radius).tolist() == np.flatnonzero(far <= radius).tolist()


def test_queries_probe_together_with_the_work_of_a_few_array_passes(monkeypatch):
    """A wide radius over a large block: no step for each bucket of each query."""
    codes = np.random.default_rng(5).integers(0, 256, (20_000, 32), dtype=np.uint8)
    block = hamming_index.Block(np.arange(20_000), codes, np.ones((20_000, 2)))
    assert hamming_index.WITHIN[5] < len(block.keys[0])
    calls = []
    plain = hamming_index.ball_queries
    monkeypatch.setattr(hamming_index, "ball_queries", lambda subs, near: calls.append(near) or plain(subs, near))
    for radius in (100, 45):
        found = list(block.all_within(codes[:70], radius))
        assert len(found) == 70
        for code, places in zip(codes[:70], found):
            far = np.bitwise_count(codes ^ code).sum(axis=1)
            assert places.tolist() == np.flatnonzero(far <= radius).tolist()
    assert calls == [6] * 5 + [5] * 11 + [6] * 5 + [5] * 11     # two rounds of queries at radius 100; listed at 45


def test_pigeonhole_radii():
    for radius in range(0, 257):
        near = hamming_index.substring_radii(radius, 16)
        assert sum(r + 1 for r in near) == radius + 1      # the least total that still holds the bound


def test_full_target_equals_brute_force(spark):
    data = vectors(420, 12)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(data)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    out = hamming_index.nearest_neighbours(table, F.col("vec_id") % 10 == 0, target=1.0).collect()
    want = slow_nearest([(i, np.array(v)) for i, v in rows], lambda q: q % 10 == 0)
    got = collections.defaultdict(dict)
    for r in out:
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert sorted(found) == [1, 2, 3, 4, 5]
        listed = [found[i] for i in range(1, 6)]
        assert listed == sorted(listed, key=lambda x: (-x[1], x[0]))
        exact = {v: float(data[q] @ data[v] / np.sqrt(data[q] @ data[q] * (data[v] @ data[v]))) for v, _ in listed}
        assert all(abs(exact[v] - s) < 1e-12 for v, s in listed)
        hits += len({v for v, _ in listed} & {v for v, _ in want[q]})
    assert hits >= 0.97 * 5 * len(want)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0, 0.0]), (50, [0.0, 2.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]),
            (2, [2.0, 0.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 0.0]),
            (8, [nan, 1.0, 0.0]), (9, [inf, 0.0, 1.0]), (None, [1.0, 0.0, 0.0]), (10, [1e-200, 1e-200, 0.0]),
            (11, [1e200, 0.0, 0.0]), (0, [0.0, 0.0, -3.0]), (100, None), (12, [0.0, 0.0, -1.0])]
    table = spark.createDataFrame([(i, v, "x", "y", "z", 1) for i, v in rows],
                                  "vec_id long, embedding array<double>, id string, code string, packed string, block int")
    out = hamming_index.nearest_neighbours(table, F.col("vec_id") % 50 == 0).collect()
    found = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], round(r["score"], 9)))
    half = round(0.5 ** 0.5, 9)
    # id 0 has two vectors: its neighbours are near to either
    assert found[0] == [(1, 1.0), (2, 1.0), (11, 1.0), (12, 1.0), (10, half)]
    assert found[50] == [(3, 1.0), (10, half), (0, 0.0), (1, 0.0), (2, 0.0)]
    assert set(found) == {0, 50}


def test_fewer_rows_than_asked_for_and_empty_table(spark, empty_folder):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<float>")
    out = hamming_index.nearest_neighbours(table, F.col("vec_id") % 50 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in out] == [(0, 1, 7)]
    none = catalog.op13_hamming_neighbours(spark, empty_folder)
    assert none.collect() == [] and none.columns == ["query_id", "rank", "vec_id", "score"]
    with pytest.raises(ValueError):
        hamming_index.nearest_neighbours(table.withColumn("vec_id", F.col("vec_id").cast("string")), F.lit(True))


def test_op13_recall_on_the_given_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float))
            for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want = slow_nearest(rows, lambda q: q % 50 == 0)
    got = collections.defaultdict(set)
    for r in catalog.op13_hamming_neighbours(spark, path).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = sum(len(got[q] & {v for v, _ in found}) for q, found in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
