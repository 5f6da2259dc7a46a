"""Keyed vector stores and metric reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import vectors as V


def scan_store(spark: SparkSession, path: str) -> DataFrame:
    """(id, vec) as doubles.  A store with several rows per id stays long."""
    df = spark.read.parquet(path)
    return df.withColumn("vec", V.as_double("vec"))


def scan_collapsed_store(spark: SparkSession, path: str) -> DataFrame:
    """(id, vec) with the rows of an id collapsed by coordinate-wise maximum."""
    return A.max_pool(scan_store(spark, path), "id", "vec").select("id", "vec")


def write_store(df: DataFrame, path: str, single: bool = True) -> None:
    """Unit vectors keyed by id, stored as floats."""
    out = df.withColumn("vec", V.l2_normalize("vec"))
    if single:
        out = out.withColumn("vec", F.col("vec").cast("array<float>"))
    out.write.mode("overwrite").parquet(path)


def write_report(metrics: DataFrame, path: str, fmt: str = "json") -> None:
    """A long (system, stratum, metric, value) table as JSON lines or CSV."""
    writer = metrics.write.mode("overwrite")
    if fmt == "json":
        writer.json(path)
    elif fmt == "csv":
        writer.option("header", "true").csv(path)
    else:
        raise ValueError(f"unknown report format {fmt!r}")


def scan_report(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    reader = spark.read.schema("system string, stratum string, metric string, value double")
    return reader.json(path) if fmt == "json" else reader.option("header", "true").csv(path)


def write_bucketed_store(df: DataFrame, table: str, path: str, buckets: int) -> None:
    """A store as a bucketed table: joins of such stores on id need no shuffle."""
    out = df.withColumn("vec", V.l2_normalize("vec").cast("array<float>"))
    (
        out.write.mode("overwrite").format("parquet")
        .bucketBy(buckets, "id").sortBy("id")
        .option("path", path).saveAsTable(table)
    )


def scan_bucketed_store(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table).withColumn("vec", V.as_double("vec"))
