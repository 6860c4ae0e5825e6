"""The registered queries on a small table folder: contract columns against brute force."""

import collections
import hashlib
import re
import zlib

import pytest
from conftest import SF001
from pyspark.sql import functions as F
from test_operators import ROWS, bag, brute_components, reference_ids

from scriptlens.llm import catalog, pii

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The odd rows and the documents of the smallest table, with an extra column."""
    at = str(tmp_path_factory.mktemp("catalog"))
    odd = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in ROWS],
                                "doc_id long, text string, lang string, source string, n_chars long")
    plain = spark.read.parquet(f"{SF001}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100)
    odd.unionByName(plain).withColumn("bucket", F.lit("x")).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{SF001}/labels.parquet").withColumn("doc_id", F.col("doc_id") + 100).write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def rows(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n if doc_id is not None else None


def test_op1_columns(spark, folder, rows):
    out = catalog.op1_pii_bilstm_crf(spark, folder).collect()
    want = []
    for i, t in rows:
        base = pii.base_spans(t or "")
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in base)
        want.append((i, *(sum(k == n for _, k, _ in base) for n in range(4)), hashlib.sha256(joined.encode()).hexdigest()))
    assert bag((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out) == bag(want)
    for r in out:
        spans = r.spans.split(",") if r.spans else []
        assert len(spans) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added
        starts = [(int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])) for s in spans]
        assert starts == sorted(starts)


def test_op1_adds_spans_that_the_patterns_miss(spark, tmp_path):
    texts = [(1, "please call (030) 555-1234 today"), (2, "host 192[.]168[.]1[.]20 and mail a@b.org"), (3, "no numbers")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in catalog.op1_pii_bilstm_crf(spark, str(tmp_path)).collect()}
    assert [(out[i].n_added, out[i].spans) for i in (1, 2, 3)] == [
        (1, "phone:12:26"), (1, "ip:5:23,email:33:40"), (0, "")]


def test_op3_columns(spark, folder, rows):
    out = catalog.op3_external_shuffle(spark, folder).collect()
    assert bag((r.doc_id, r["size"], r.text_crc32) for r in out) == bag(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op4_columns(spark, folder, rows):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = catalog.op4_language_spans(spark, folder).collect()
    assert bag((r.doc_id, r.held_out) for r in out) == bag((i, crc(i, 4) == 2) for i, _ in rows)
    text = {i: t for i, t in rows if i is not None}
    for r in out:
        assert 0 <= r.score <= 1 and r.lang_pred in {"en", "de", "fr", "es", "und"}
        if r.doc_id is not None and not any(c.isalpha() for c in text[r.doc_id] or ""):
            assert r.lang_pred == "und"
        spans = [s.split(":") for s in r.lang_spans.split(",")] if r.lang_spans else []
        assert all(int(a) < int(z) for _, a, z in spans)
    plain = [r for r in out if r.held_out and r.doc_id >= 100 and lang[r.doc_id]]
    assert len(plain) > 20 and sum(r.lang_pred == lang[r.doc_id] for r in plain) >= 0.9 * len(plain)


def test_op8_columns(spark, folder, rows):
    out = catalog.op8_ngram_jaccard_join(spark, folder).collect()
    assert bag(map(tuple, out)) == brute_components(rows)


def test_op9_columns(spark, folder, rows):
    out = catalog.op9_toxicity(spark, folder).collect()
    assert bag((r.doc_id, r.held_out) for r in out) == bag((i, crc(i, 5) == 0) for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in out if r.held_out and r.doc_id in toxic]
    assert held and sum(r.predicted == toxic[r.doc_id] for r in held) >= 0.8 * len(held)


def test_op10_columns(spark, folder, rows):
    out = catalog.op10_best_fit_packing(spark, folder).collect()
    want = []
    for i, t in rows:
        ids = reference_ids(t)
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want.append((i, piece, at, len(part), zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in part))))
    assert bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == bag(want)
    places = collections.defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-sum(w[3] for w in want) // 4096) * 1.05 + 1


def test_hot_key_is_dealt_over_buckets(spark):
    """A third of the rows under one id, and rows without an id that agree in text."""
    from scriptlens.llm import shuffle

    hot = [(7, "the same text " * 4)] * 400 + [(None, "no id at all " * 4)] * 200
    rows = hot + [(1_000 + k, f"text {k} " * 5) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = shuffle.external_shuffle(df, bucket_bytes=1_000).collect()
    assert bag((r.doc_id, r.text) for r in out) == bag(rows)
    sizes = collections.Counter(r.bucket for r in out)
    assert max(sizes.values()) <= 30
    places = collections.Counter((r.shard, r.slot) for r in out)
    assert set(places.values()) == {1} and len(places) == len(rows)
    shards = collections.Counter(r.shard for r in out)
    assert max(shards.values()) - min(shards.values()) <= 1
