"""The pipeline against a brute-force version, stage by stage on small tables."""

import collections

import corpus_pipeline
import pytest
from conftest import SF001
from pyspark.sql import functions as F
from test_operators import bag, brute_components, brute_hits, reference_ids

from scriptlens.llm import pii, toxicity


@pytest.fixture(scope="module")
def inputs(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    odd = docs.limit(2).select((F.col("doc_id") + 5_000).alias("doc_id"), F.lit(None).cast("string").alias("text"),
                               "lang", "source", "n_chars")
    no_id = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit("no id here").alias("text"),
                                 "lang", "source", "n_chars")
    return docs.unionByName(odd).unionByName(no_id).unionByName(docs.limit(3)).cache()


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "pii", "packing"]


def test_stages_equal_brute_force(spark, inputs):
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, inputs, SF001).cache()
    assert clean.columns == inputs.columns
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = toxicity.train(inputs, spark.read.parquet(f"{SF001}/labels.parquet"), fold != 0)
    words = toxicity.WordFeatures(model["keep"])
    want = [(i, t) for i, t in rows(inputs) if toxicity.score_text(t, model, words) < 0.5]
    assert bag(rows(clean)) == bag(want) and len(want) < inputs.count()

    single = stage["ngram_join"](spark, clean, SF001).cache()
    assert single.columns == inputs.columns
    component = {i: c for i, _, c in brute_components(rows(clean))}
    kept = {(i, t) for i, t in rows(clean) if i is None or component[i] == i}
    assert bag(rows(single)) == bag(kept)

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    grams = collections.defaultdict(set)
    fair = stage["decontamination"](spark, single, SF001).cache()
    assert fair.columns == inputs.columns
    from scriptlens.llm.decontam import words_of
    for name, text in bench:
        w = words_of(text)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            grams[n].add(tuple(w[a:a + n]))

    def hit(text):
        w = words_of(text)
        return any(tuple(w[a:a + n]) in g for n, g in grams.items() for a in range(len(w) - n + 1))

    assert bag(rows(fair)) == bag(r for r in rows(single) if not hit(r[1]))
    probe = next(r for r in rows(single) if hit(r[1]))
    assert brute_hits(probe[1], bench)[1] > 0

    masked = stage["pii"](spark, fair, SF001).cache()
    assert masked.columns == inputs.columns
    tagger = pii.trained()
    assert bag(rows(masked)) == bag(
        (i, t if t is None else pii.masked(t, pii.spans_of([t], tagger)[0])) for i, t in rows(fair))

    packed = stage["packing"](spark, masked, SF001).collect()
    tokens = sum(len(reference_ids(t)) for _, t in rows(masked))
    assert sum(r.length for r in packed) == tokens
    ends = collections.Counter()
    for r in packed:
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 4096 and len(ends) <= -(-tokens // 4096) * 1.02 + 1


def test_group_stage_tells_texts_under_one_id_apart(spark):
    base, other = [f"b{i}" for i in range(50)], [f"o{i}" for i in range(50)]
    docs = [(5, " ".join(base)), (5, " ".join(other)), (3, " ".join(base[:-1])), (9, " ".join(other)), (9, " ".join(other)),
            (7, None), (7, None), (7, "own words of one document"), (None, " ".join(base)), (None, " ".join(base))]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs],
                               "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.one_per_group(spark, df, SF001)
    assert bag(rows(kept)) == bag([(3, docs[2][1]), (5, docs[1][1]), (7, None), (7, docs[7][1]), docs[8], docs[8]])
    text_ids = df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    assert corpus_pipeline.one_per_group(spark, text_ids, SF001).count() == 6


def test_stages_of_an_empty_table(spark, inputs):
    docs = inputs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF001)
        assert out.count() == 0, name
        if name != "packing":
            assert out.columns == inputs.columns
