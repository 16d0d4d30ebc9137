import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hot():
    """Series of very different lengths: key 0 holds most rows, key 3 a single one."""
    import random

    rng = random.Random(5)
    lengths = {0: 90, 1: 23, 2: 8, 3: 1}
    return {k: [round(rng.uniform(0, 1), 3) for _ in range(n)] for k, n in lengths.items()}


@pytest.fixture
def hot_df(spark, hot):
    rows = [(k, i, v) for k, vs in hot.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "sid bigint, idx bigint, x double").repartition(4)
