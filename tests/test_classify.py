"""Split, folds, TF-IDF and naive Bayes against brute-force Python on a small fixture."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from scriptlens.functions.text import normalize_baseline
from scriptlens.operators import classify as C
from scriptlens.sources import adapters


@pytest.fixture(scope="module")
def posts_local(spark):
    posts = adapters.posts(spark, SF001)
    texts = posts.select("row_id", "type", normalize_baseline("posts", True).alias("text"))
    return posts, sorted((r.row_id, r.type, r.text) for r in texts.collect())


def brute_folds(ids, labels, k=3):
    """Unshuffled stratified k-fold test-fold ids, classes by first appearance."""
    order = []
    for y in labels:
        if y not in order:
            order.append(y)
    enc = [order.index(y) for y in labels]
    y_sorted = sorted(enc)
    alloc = [[y_sorted[i::k].count(c) for c in range(len(order))] for i in range(k)]
    folds = [None] * len(ids)
    for c in range(len(order)):
        seq = [f for f in range(k) for _ in range(alloc[f][c])]
        pos = [i for i, e in enumerate(enc) if e == c]
        for p, f in zip(pos, seq):
            folds[p] = f
    return dict(zip(ids, folds))


def test_folds_match_brute_force(spark, posts_local):
    posts, local = posts_local
    got = {(r.row_id, r.dim): r.fold for r in C.stratified_folds(C.long_labels(posts)).collect()}
    for i, (dim, pos, _neg) in enumerate([("EI", "E", "I"), ("SN", "S", "N"), ("TF", "T", "F"), ("JP", "J", "P")]):
        ids = [r[0] for r in local]
        labels = [1 if r[1][i] == pos else 0 for r in local]
        want = brute_folds(ids, labels)
        assert {rid: got[(rid, dim)] for rid in ids} == want


def test_split_sizes(spark, posts_local):
    posts, local = posts_local
    split = C.stratified_split(posts.select("row_id", "type")).collect()
    by_type = defaultdict(Counter)
    for r in split:
        by_type[r.type][r.split] += 1
    for t, c in by_type.items():
        n = sum(c.values())
        n_test = math.floor(0.2 * n + 0.5)
        assert c["test"] == n_test
        assert c["val"] == math.floor(0.125 * (n - n_test) + 0.5)


def test_ordered_rank_is_exact_with_small_buckets(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 5000).alias("k"))
    ranked = C.ordered_rank(df, ["g"], ["k"], (F.col("k") / 100).cast("int"), n_buckets=51)
    got = {(r.g, r.k): r.rank0 for r in ranked.collect()}
    for g in range(3):
        ks = sorted(k for (gg, k) in got if gg == g)
        assert [got[(g, k)] for k in ks] == list(range(len(ks)))


def brute_tfidf_nb(local, max_features=1500):
    import re
    tok = re.compile(r"(?u)\b\w\w+\b")
    docs = [Counter(tok.findall(t.lower())) for _, _, t in local]
    cf, df = Counter(), Counter()
    for d in docs:
        cf.update(d)
        df.update(d.keys())
    vocab = sorted(cf, key=lambda w: (-cf[w], w))[:max_features]
    n = len(docs)
    idf = {w: math.log((1 + n) / (1 + df[w])) + 1 for w in vocab}
    X = np.zeros((n, len(vocab)))
    col = {w: j for j, w in enumerate(vocab)}
    for i, d in enumerate(docs):
        for w, c in d.items():
            if w in col:
                X[i, col[w]] = c * idf[w]
        nrm = np.linalg.norm(X[i])
        if nrm > 0:
            X[i] /= nrm
    return vocab, idf, X


def test_tfidf_and_nb_match_brute_force(spark, posts_local):
    posts, local = posts_local
    vocab, idf, X = brute_tfidf_nb(local)
    texts = posts.select("row_id", normalize_baseline("posts", True).alias("text"))
    counts = C.term_counts(texts, "row_id", "text")
    v = C.fit_tfidf(counts, posts.count())
    got_idf = {r.term: r.idf for r in v.collect()}
    assert set(got_idf) == set(vocab)
    for w in vocab:
        assert got_idf[w] == pytest.approx(idf[w], rel=1e-9)
    x = C.tfidf_weights(counts, v, "row_id")
    ids = [r[0] for r in local]
    got_x = {(r.row_id, r.term): r.x for r in x.collect()}
    for i, rid in enumerate(ids):
        for j, w in enumerate(vocab):
            assert got_x.get((rid, w), 0.0) == pytest.approx(X[i, j], abs=1e-12)
    # naive Bayes on EI, fitted on all rows
    labels = C.long_labels(posts)
    logp, priors = C.fit_nb(x, labels, v)
    y = np.array([1 if t[0] == "E" else 0 for _, t, _ in local])
    lp = {(r.label, r.term): r.logp for r in logp.where("dim = 'EI'").collect()}
    for c in (0, 1):
        fc = X[y == c].sum(axis=0) + 1.0
        want = np.log(fc / fc.sum())
        for j, w in enumerate(vocab):
            assert lp[(c, w)] == pytest.approx(want[j], abs=1e-9)
    pri = {r.label: r.prior for r in priors.where("dim = 'EI'").collect()}
    assert pri[1] == pytest.approx(math.log((y == 1).mean()))
    pred = C.nb_predict(C.nb_joint(x, posts.select("row_id"), logp, priors)).where("dim = 'EI'")
    got_pred = {r.row_id: r.pred for r in pred.collect()}
    W = np.array([[lp[(c, w)] for w in vocab] for c in (0, 1)])
    jll = X @ W.T + np.array([pri[0], pri[1]])
    want_pred = jll.argmax(axis=1)
    assert [got_pred[rid] for rid in ids] == list(want_pred)
