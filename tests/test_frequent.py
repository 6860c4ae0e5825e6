"""Frequent terms by bounded summaries and stored sketches against exact counts."""

import random
from collections import Counter

import pandas as pd
import pytest

from scriptlens.operators import frequent as R
from scriptlens.operators import sketches as K
from scriptlens.session import new_table_path

LINES = "show_key string, season int, episode bigint, episode_title string, line_no bigint, character string, dialogue string"


def zipf_counts(spark, seed=1, n=3_000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        terms = Counter([f"common{int(rng.paretovariate(0.9)) % 60}" for _ in range(12)] + [f"rare{i}_{j}" for j in range(8)])
        rows += [(i, t, c) for t, c in terms.items()]
    return spark.createDataFrame(rows, "row_id long, term string, cnt long").repartition(4), rows


def test_top_terms_are_exact_and_fewer_rows_move(spark):
    counts, rows = zipf_counts(spark)
    found = R.frequent_terms(counts, 20, capacity=300)
    cf, df = Counter(), Counter()
    for _, t, c in rows:
        cf[t] += c
        df[t] += 1
    want = sorted(cf, key=lambda t: (-cf[t], t))[:20]
    got = {r["term"]: (r["cf"], r["df"]) for r in found.stats.collect()}
    assert found.proven and set(want) <= set(got)
    assert all(got[t] == (cf[t], df[t]) for t in got)
    # only candidates are grouped, not the 24,000 rare terms
    assert found.candidates == len(got) < 0.05 * len(cf)
    assert R.summaries(counts, 300).count() <= 4 * 601


def test_bounds_hold_for_every_term(spark):
    counts, rows = zipf_counts(spark, 5, 800)
    kept = R.summaries(counts, 50).collect()
    off = sum(r["off"] for r in kept)
    low, cf = Counter(), Counter()
    for r in kept:
        if r["term"] is not None:
            low[r["term"]] += r["low"]
    for _, t, c in rows:
        cf[t] += c
    assert off > 0 and all(low[t] <= cf[t] <= low[t] + off for t in cf)


def test_flat_counts_take_the_full_path(spark):
    rows = [(i, f"t{i}", 1) for i in range(5_000)]
    counts = spark.createDataFrame(rows, "row_id long, term string, cnt long").repartition(3)
    found = R.frequent_terms(counts, 100, capacity=50)
    assert not found.proven and found.stats.count() == 5_000
    small = R.frequent_terms(counts, 100, capacity=10_000)
    assert small.proven and small.stats.count() == 5_000
    assert R.frequent_terms(counts.where("false"), 10).stats.count() == 0


def test_pruning_takes_the_same_from_all():
    held = pd.Series({f"t{k}": k for k in range(1, 11)})
    cut, off = R.pruned(held, 3)
    assert off == 7 and cut.to_dict() == {"t8": 1, "t9": 2, "t10": 3}
    assert R.pruned(held, 5)[1] == 0


def test_sketches_unite_within_their_bound(spark):
    rng = random.Random(2)
    rows = [(f"s{k % 3}", k % 4, k // 10, f"T{k // 10}", k, rng.choice(["Ann", "Bo", None]),
             rng.choice([None, "", " ".join(f"word{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}{chr(97 + j // 676)}" for j in rng.sample(range(9_000), 12))]))
            for k in range(3_000)]
    lines = spark.createDataFrame(rows, LINES)
    path = K.write_sketches(spark, lines, new_table_path(spark, "sketches"))
    checked = K.checked_counts(spark, lines, path).collect()
    assert len(checked) == 9 and all(r["in_bound"] for r in checked)
    exact = {(r["show_key"], r["thing"]): r["exact"] for r in checked}
    assert exact["s0", "characters"] == 2 and exact["s0", "words"] > 1_000
    every = {r["thing"]: r["estimate"] for r in K.united_counts(spark.read.parquet(path), []).collect()}
    n_words = len({w for r in rows for w in (r[6] or "").split()})
    assert every["characters"] == 2 and every["words"] == pytest.approx(n_words, rel=K.BOUND)
