"""Trained heads, text embedding and vector index against brute force in numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from scriptlens.functions.text import normalize_classifier
from scriptlens.operators import classify as C
from scriptlens.operators import embedding as E
from scriptlens.operators import heads as H
from scriptlens.operators import similar as V
from scriptlens.operators import vector_index as I
from scriptlens.sources import adapters


# --- heads -------------------------------------------------------------------

@pytest.fixture(scope="module")
def posts(spark):
    return adapters.posts(spark, SF001).cache()


@pytest.fixture(scope="module")
def heads(posts):
    return H.train_heads(posts, epochs=6)


def dense(spark, posts, model):
    """Feature matrix (bias first), labels and split in numpy."""
    texts = posts.select("row_id", normalize_classifier("posts", True).alias("text"))
    x = C.tfidf_weights(C.term_counts(texts, "row_id", "text"), model.vocab, "row_id").collect()
    column = {r["term"]: r["term_index"] - 1 for r in model.vocab.collect()}
    split = {r["row_id"]: r["split"] for r in model.split.collect()}
    ids = sorted(split)
    row = {i: k for k, i in enumerate(ids)}
    grid = np.zeros((len(ids), len(column) + 1))
    grid[:, 0] = 1
    for r in x:
        grid[row[r["row_id"]], column[r["term"]]] = r["x"]
    y = np.full((len(ids), 4), np.nan)
    for r in C.long_labels(posts).collect():
        y[row[r["row_id"]], H.HEADS.index(r["dim"])] = r["label"]
    return grid, y, np.array([split[i] for i in ids])


def brute_heads(grid, y, split, epochs, patience, rate):
    w = np.zeros((grid.shape[1], 4))
    best, best_loss, waited, log = w, math.inf, 0, []
    train, val = split == "train", split == "val"
    for epoch in range(1, epochs + 1):
        p = 1 / (1 + np.exp(-grid[train] @ w))
        w = w - rate * grid[train].T @ (p - y[train]) / train.sum()
        loss = {}
        for name, rows in (("train", train), ("val", val)):
            z = grid[rows] @ w
            loss[name] = np.mean(np.logaddexp(0, z) - y[rows] * z, axis=0)
        log.append((epoch, loss["train"], loss["val"]))
        if loss["val"].mean() < best_loss:
            best, best_loss, waited, chosen = w, loss["val"].mean(), 0, epoch
        else:
            waited += 1
            if waited >= patience:
                break
    return best, log, chosen


@pytest.mark.parametrize("rate,epochs,patience", [(4.0, 6, 3), (60.0, 10, 2)])
def test_heads_equal_brute_force_with_and_without_early_stop(spark, posts, heads, rate, epochs, patience):
    model = heads if rate == 4.0 else H.train_heads(posts, heads.split, epochs, patience, rate)
    want, log, chosen = brute_heads(*dense(spark, posts, model), epochs, patience, rate)
    history = model.history.collect()
    assert len(history) == 4 * len(log) and {r["epoch"] for r in history if r["chosen"]} == {chosen}
    if rate == 60.0:
        assert len(log) < epochs and chosen < len(log)      # it stopped early and went back
    for r in history:
        _, train, val = log[r["epoch"] - 1]
        k = H.HEADS.index(r["dim"])
        assert r["train_loss"] == pytest.approx(train[k], abs=1e-9) and r["val_loss"] == pytest.approx(val[k], abs=1e-9)
    index = {r["term"]: r["term_index"] - 1 for r in model.vocab.collect()} | {None: 0}
    for r in model.weights.collect():
        assert [r[f"w_{d}"] for d in H.HEADS] == pytest.approx(want[index[r["term"]]].tolist(), abs=1e-9)


def test_training_lowers_the_loss(heads):
    by_epoch = {}
    for r in heads.history.collect():
        by_epoch.setdefault(r["epoch"], []).append(r["train_loss"])
    means = [sum(v) / 4 for _, v in sorted(by_epoch.items())]
    assert all(a > b for a, b in zip(means, means[1:])) and means[0] < math.log(2)


def test_saved_heads_predict_the_same(spark, posts, heads):
    again = H.load_heads(spark, H.save_heads(spark, heads))
    a = {(r["row_id"], r["dim"]): r["p1"] for r in H.head_predictions(heads, posts).collect()}
    b = {(r["row_id"], r["dim"]): r["p1"] for r in H.head_predictions(again, posts).collect()}
    assert a == b and len(a) == 4 * posts.count() and all(0 < p < 1 for p in a.values())


def test_heads_without_validation_rows_and_with_wordless_texts(spark):
    rows = [(i, "ESTJ" if i % 2 else "INFP", "alpha beta gamma" if i % 2 else "delta epsilon") for i in range(20)]
    rows += [(100, "ESTJ", None), (101, "INFP", "!!!"), (102, "QQQQ", "alpha")]
    posts = spark.createDataFrame(rows, "row_id long, type string, posts string")
    split = posts.select("row_id", "type", F.lit("train").alias("split"))
    model = H.train_heads(posts, split, epochs=4)
    assert {r["epoch"] for r in model.history.where("chosen").collect()} == {4}
    assert model.history.where("val_loss is not null").count() == 0
    probs = {r["row_id"]: r for r in H.head_probs(
        model, C.term_counts(posts.select("row_id", F.coalesce("posts", F.lit("")).alias("t")), "row_id", "t"), posts, "row_id").collect()}
    assert probs[1]["p_EI"] > 0.5 > probs[2]["p_EI"] and probs[1]["mbti"] == "ESTJ" and probs[2]["mbti"] == "INFP"
    assert probs[100]["p_EI"] == pytest.approx(probs[101]["p_EI"]) and len(probs) == 23


def test_an_epoch_sends_sums_only(posts, heads):
    rows = H.packed_rows(C.tfidf_weights(C.term_counts(
        posts.select("row_id", normalize_classifier("posts", True).alias("text")), "row_id", "text"), heads.vocab, "row_id"),
        C.long_labels(posts), heads.split, heads.vocab)
    gradient, loss = H.epoch_sums(rows, {d: [0.0] * (heads.vocab.count() + 1) for d in H.HEADS})
    assert set(loss) == {(s, d) for s in ("train", "val") for d in H.HEADS}
    assert loss["train", "EI"][0] == pytest.approx(math.log(2) * loss["train", "EI"][1])
    assert all(len(g) <= heads.vocab.count() + 1 for g in gradient.values())


# --- embedding ---------------------------------------------------------------

@pytest.fixture(scope="module")
def topics(spark):
    """Lines of four topics with words of their own, in a few shared ones."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(160):
        topic = k % 4
        words = [f"topic{'abcd'[topic]}{'abcdefgh'[j]}" for j in rng.integers(0, 8, 9)] + ["shared", "common"][: int(rng.integers(0, 3))]
        rows.append((f"speaker {topic % 2}", k, " ".join(words)))
    rows += [("speaker 0", 900, None), ("speaker 0", 901, "..."), ("speaker 1", 902, rows[1][2])]
    return spark.createDataFrame(rows, "character string, line_id long, dialogue string")


def test_axes_span_the_leading_singular_directions(spark, topics):
    model, rows = E.fit_embedding(topics, axes=4, iterations=8)
    n = model.vocab.count()
    packed = rows.orderBy("line_id").collect()
    grid = np.zeros((len(packed), n))
    for k, r in enumerate(packed):
        grid[k, np.array(r["idx"]) - 1] = r["val"]
    _, values, axes = np.linalg.svd(grid, full_matrices=False)
    assert model.singular_values == pytest.approx(values[:4], rel=1e-6)
    overlap = np.linalg.svd(model.basis.T @ axes[:4].T, compute_uv=False)
    assert overlap == pytest.approx(np.ones(4), abs=1e-5)
    assert model.basis.T @ model.basis == pytest.approx(np.eye(4), abs=1e-9)
    top = np.abs(model.basis).argmax(axis=0)
    assert (model.basis[top, np.arange(4)] > 0).all()
    found = {r["line_id"]: r["embedding"] for r in E.embed_lines(topics, model, rows).collect()}
    assert set(found) == {r["line_id"] for r in packed} and not {900, 901} & set(found)
    for k, r in enumerate(packed):
        assert found[r["line_id"]] == pytest.approx((grid[k] @ model.basis).tolist(), abs=1e-9)
    asked = E.embed_texts(topics, model, "line_id", "dialogue").collect()
    assert {r["line_id"]: pytest.approx(r["embedding"]) for r in asked} == found


def test_saved_embedding_and_small_vocabulary(spark, topics):
    model, rows = E.fit_embedding(topics.where("line_id in (0, 901)"), axes=8)
    assert 0 < model.basis.shape[1] <= 8 and model.basis.shape[0] == model.vocab.count()
    again = E.load_embedding(spark, E.save_embedding(spark, model))
    assert (again.basis == model.basis).all() and (again.singular_values == model.singular_values).all()
    none, packed = E.fit_embedding(topics.where("line_id = 901"))
    assert none.basis.size == 0 and packed.count() == 0


def test_nearest_lines_share_the_topic(spark, topics):
    model, rows = E.fit_embedding(topics, axes=4)
    vectors = E.embed_lines(topics, model, rows)
    asked = E.embed_texts(spark.createDataFrame([(0, "topicaa topicab topicac")], "id long, t string"), model, "id", "t").first()
    requests = spark.createDataFrame([("r", "speaker 0", list(asked["embedding"]))],
                                     "request_id string, character string, request_vec array<double>")
    near = V.nearest_lines(vectors, requests).collect()
    assert len(near) == 5 and all(r["line_id"] % 4 == 0 for r in near)


# --- vector index ----------------------------------------------------------------

@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(600):
        centre = np.eye(6)[k % 6] * 3
        v = (centre + 0.4 * rng.standard_normal(6)).astype(np.float32)
        rows.append((f"c{k % 3}" if k % 11 else "hot", k, f"line {k}", [float(x) for x in v]))
    rows += [("c0", 1000, "zero", [0.0] * 6), ("c0", 1001, "null", None), ("c1", 1002, "twin", rows[4][3]), ("alone", 1003, "one", rows[9][3])]
    return spark.createDataFrame(rows, "character string, line_id long, dialogue string, embedding array<float>").repartition(3)


@pytest.fixture(scope="module")
def requests(spark):
    rng = np.random.default_rng(9)
    rows = [(f"r{k}", ["c0", "c1", "c2", "hot", "alone", "nobody"][k % 6], [float(x) for x in rng.standard_normal(6)])
            for k in range(24)] + [("zero", "c0", [0.0] * 6)]
    return spark.createDataFrame(rows, "request_id string, character string, request_vec array<double>")


def sorted_rows(df):
    return sorted(tuple(r) for r in df.select("request_id", "example_rank", "line_id", "cosine").collect())


def test_exact_search_equals_the_scan(spark, points, requests):
    index = I.build_vector_index(spark, points, cells=9)
    sound = points.where("embedding is not null and line_id <> 1000")
    want = sorted_rows(V.nearest_lines(sound, requests.where("request_id <> 'zero'")))
    for probes in (1, 3, 9):
        assert sorted_rows(I.exact_lines(index, requests, probes=probes)) == want
    assert index.vectors.count() == sound.count() and index.cells.agg(F.sum("n_rows")).first()[0] == sound.count()


def test_probed_search_recall_and_pruning(spark, points, requests):
    index = I.build_vector_index(spark, points, cells=9)
    exact = {r[:1] + r[2:3] for r in sorted_rows(I.exact_lines(index, requests))}
    fast = {r[:1] + r[2:3] for r in sorted_rows(I.probed_lines(index, requests, probes=4))}
    assert len(fast & exact) >= 0.9 * len(exact)
    near = I.top_k(I.cell_angles(index, requests.limit(1)), ["request_id"], ["gap", "cell"], 1, "probe")
    plan = I.reranked(index, near)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "dynamicpruning" in plan.lower()
    # the cells left out by the bound hold no better row: fewer rows are read than the characters have
    one = requests.where("request_id = 'r0'")
    ranked = I.cell_angles(index, one).count()
    assert ranked > 1


def test_vector_index_of_no_rows(spark, points, requests):
    index = I.build_vector_index(spark, points.where("false"))
    assert I.exact_lines(index, requests).count() == 0 and I.probed_lines(index, requests).count() == 0


def test_centroids_are_grouped_averages(spark):
    rows = [("c", k, "x", [1.0, 0.02 * (k % 5)] if k % 2 else [0.02 * (k % 3), 1.0]) for k in range(40)]
    table = spark.createDataFrame(rows, "character string, line_id long, dialogue string, embedding array<double>")
    centroids = np.array(I.fit_centroids(table.withColumn("norm", V.norm("embedding")), 2))
    data = np.array([r[3] for r in rows])
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    cell = (data @ centroids.T).argmax(axis=1)
    for k in range(2):
        mean = data[cell == k].mean(axis=0)
        assert centroids[k] == pytest.approx(mean / np.linalg.norm(mean), abs=1e-9)
