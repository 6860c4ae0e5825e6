import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]")
        .appName("scriptlens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scriptlens-test-ckpt-"))
    yield s


@pytest.fixture()
def one(spark):
    """Evaluate a Column expression on a one-row frame of given string values."""
    def run(expr_fn, *values):
        cols = [f"c{i}" for i in range(len(values))]
        df = spark.createDataFrame([tuple(values)], ", ".join(f"{c} string" for c in cols))
        return df.select(expr_fn(*[df[c] for c in cols]).alias("r")).first()["r"]
    return run


@pytest.fixture()
def sample_episode_lines(spark):
    """The three-episode search fixture as a line table (one line per episode)."""
    rows = [
        ("friends", 1, 1, "Pilot", 0, "x", "Welcome to Central Perk. This is a coffee shop."),
        ("friends", 1, 2, "The One About Coffee", 1, "x", "Let us talk about coffee and more coffee."),
        ("friends", 2, 1, "The Wedding", 2, "x", "The wedding was beautiful. Everyone loved it."),
    ]
    return spark.createDataFrame(
        rows, "show_key string, season int, episode bigint, episode_title string, line_no bigint, "
              "character string, dialogue string")
