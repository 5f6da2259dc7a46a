"""Registered queries against their SQL in DuckDB on the smallest tables.

A spread of queries runs by default; ALL_QUERIES=1 runs every one.
"""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SPREAD = [
    "s1_scan_manifest", "p10_partial_match", "t1_chunk_text", "u1_encode", "v12_affine", "j3_score_angular",
    "j7_caption_max_sim_loo", "w2_top_k", "w6_random_negatives", "m7_by_category", "e7_failure_class",
    "g15_sweep_train_select", "x4_format_explanation", "x5_search", "d03_pos_neg_overlap", "d15_skew_vs_k",
    "l10_local_scaling", "o3_approx_ndcg", "w2_top_k_with_gaps", "w4_rank_of_truth_with_gaps", "l5_cca_reconstruction",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def cell(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, (int, float)):
        f = float(v)
        return "nan" if math.isnan(f) else f"{f:.6f}"
    return str(v) if not hasattr(v, "is_integer") else f"{float(v):.6f}"


def table(columns, rows):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted(tuple(cell(r[i]) for i in at) for r in rows)


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.limit(5).count() == 5


NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else SPREAD


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(entry.oracle_sql()[name])
    want = table([d[0] for d in res.description], res.fetchall())
    assert got == want


def test_executors_need_no_installed_package(tmp_path):
    """The package travels with the tasks: run from a folder that cannot import it."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import importlib.util
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spec = importlib.util.spec_from_file_location("entry", {os.path.join(root, '__spark_entry__.py')!r})
m = importlib.util.module_from_spec(spec)
spec.loader.exec_module(m)
for name in ("w2_top_k", "l4_fit_procrustes", "g10_gate_mlp", "u1_encode"):
    assert m.queries()[name](spark, {SF!r}).count() > 0
print("done")
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("done"), done.stderr[-2000:]
