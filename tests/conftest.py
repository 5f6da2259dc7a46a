import os
import sys
import tempfile

import numpy as np
import pytest
from helpers import unit
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{base}/warehouse")
        .config("spark.checkpoint.dir", f"{base}/checkpoint")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def world(spark):
    """A small random gallery with queries near their truths, as numpy and DataFrames."""
    rng = np.random.default_rng(7)
    n, d = 60, 8
    v, t, a = unit(rng, n, d), unit(rng, n, d), unit(rng, n, d)
    qc, qa = v + t + 0.8 * rng.normal(size=(n, d)), a + 0.8 * rng.normal(size=(n, d))
    qc /= np.linalg.norm(qc, axis=1, keepdims=True)
    qa /= np.linalg.norm(qa, axis=1, keepdims=True)
    gallery = spark.createDataFrame(
        [(i, i % 3, v[i].tolist(), t[i].tolist(), a[i].tolist()) for i in range(n)],
        "id long, category int, visual array<double>, caption array<double>, audio array<double>",
    )
    queries = spark.createDataFrame(
        [(1000 + i, i, i % 3, qc[i].tolist(), qa[i].tolist()) for i in range(n)],
        "qid long, truth long, category int, q_clip array<double>, q_clap array<double>",
    )
    sims = {"v": qc @ v.T, "t": qc @ t.T, "a": qa @ a.T}
    return {"n": n, "d": d, "v": v, "t": t, "a": a, "qc": qc, "qa": qa, "sims": sims,
            "gallery": gallery, "queries": queries}
