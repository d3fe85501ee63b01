import os
import sys
from datetime import date, timedelta

# Spark's threads and those of the linear algebra would wait for each other.
os.environ.setdefault("OMP_NUM_THREADS", "1")

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import configure  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        configure(SparkSession.builder).master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def walk(n, seed, start=date(2020, 1, 5), step=7, drift=0.01, size=0.05):
    """A random walk in logs near ln 100."""
    rng = np.random.default_rng(seed)
    y = np.log(100) + np.cumsum(drift + size * rng.standard_normal(n))
    return pd.DataFrame({"ds": [start + timedelta(days=step * i) for i in range(n)], "y": y})


@pytest.fixture(scope="session")
def walks():
    """Three series of different lengths, as pandas."""
    parts = [walk(n, seed).assign(series_id=name)
             for name, n, seed in (("a", 120, 1), ("b", 90, 2), ("c", 150, 3))]
    return pd.concat(parts)[["series_id", "ds", "y"]]


@pytest.fixture(scope="session")
def panel(spark, walks):
    return spark.createDataFrame(walks, "series_id string, ds date, y double").cache()
