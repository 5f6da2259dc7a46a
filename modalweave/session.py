"""Session helpers: scratch space that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The temporary folder of local sessions without a setting; the caller's settings stay as they are.
_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster in ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for written intermediate tables."""
    return f"{shared_dir(spark)}/modalweave/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
