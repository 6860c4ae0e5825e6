"""File-stream ingest: appends new files once, never twice."""

from pyspark.sql import functions as F

from conftest import SF001
from scriptlens.session import new_table_path
from scriptlens.sources import adapters
from scriptlens.streaming.ingest import ingest_line_files, read_line_table


def test_ingest_is_incremental_and_idempotent(spark):
    lines = adapters.dialogue_lines(spark, SF001)
    src = new_table_path(spark, "test-line-files")
    table, ckpt = new_table_path(spark, "test-line-table"), new_table_path(spark, "test-ckpt")
    first = lines.where(F.col("season") < 2)
    rest = lines.where(F.col("season") >= 2)
    first.write.parquet(src + "/batch1")
    ingest_line_files(spark, src + "/*", table, ckpt)
    assert read_line_table(spark, table).count() == first.count()
    rest.write.parquet(src + "/batch2")
    ingest_line_files(spark, src + "/*", table, ckpt)
    ingest_line_files(spark, src + "/*", table, ckpt)
    assert read_line_table(spark, table).count() == lines.count()


def test_user_scorer_hook(spark):
    import numpy as np

    from scriptlens.operators.hooks import scorer_udf, scores_to_columns

    def make():
        def predict(texts):
            return np.array([[0.9, 0.1, 0.5, float(len(t) % 2)] for t in texts])
        return predict

    df = spark.createDataFrame([("ab",), ("abc",)], "text string")
    out = scores_to_columns(df, scorer_udf(make)("text")).orderBy("text").collect()
    assert [r.p_JP for r in out] == [0.0, 1.0] and out[0].p_EI == 0.9


def test_character_lookup_and_maps(spark):
    from scriptlens.operators.profiles import character_lookup, probability_map

    types = spark.createDataFrame([("s", "ross", 3, 0.7, 0.2, 0.5, 0.4, "ENTP")],
                                  "show_key string, character_key string, n_lines long, p_EI double, "
                                  "p_SN double, p_TF double, p_JP double, mbti string")
    req = spark.createDataFrame([(1, "s", "ROSS"), (2, "s", "Nobody")], "request_id int, show_key string, character string")
    out = {r.request_id: r for r in character_lookup(req, types).collect()}
    assert out[1].success and out[1].mbti == "ENTP"
    assert not out[2].success and "Nobody" in out[2].error
    m = probability_map(types).first()
    assert m.probabilities["EI"]["E"] == 0.7 and m.letters_by_probability[0] == "EI"
