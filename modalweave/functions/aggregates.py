"""Vector aggregates: sums, means and maxima of ARRAY<DOUBLE> by key.

Each task first combines its own rows (so a hot key leaves a task as one row),
then partial rows meet by key and are combined again as a sorted stream.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    LongType,
    StructField,
    StructType,
)

from . import vectors as V

VECTOR = ArrayType(DoubleType())


def vector_array(matrix: np.ndarray) -> pa.Array:
    n, d = matrix.shape
    offsets = np.arange(0, (n + 1) * d, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1)))


def combine_vectors(df: DataFrame, key: str, vec: str, how: str = "sum") -> DataFrame:
    """(key, n, vec): component-wise ``sum`` or ``max`` of the vectors of a key."""
    ufunc = {"sum": np.add, "max": np.maximum}[how]
    schema = StructType(
        [
            StructField("key", df.schema[key].dataType),
            StructField("n", LongType()),
            StructField("vec", VECTOR),
        ]
    )
    arrow_schema = to_arrow_schema(schema)

    def emit(keys, counts, matrix):
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys, type=arrow_schema.field(0).type),
                pa.array(counts, type=pa.int64()),
                vector_array(matrix).cast(arrow_schema.field(2).type),
            ],
            schema=arrow_schema,
        )

    def runs(keys, counts, matrix):
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return (
            keys[starts],
            np.add.reduceat(counts, starts),
            ufunc.reduceat(matrix, starts, axis=0),
        )

    def rows_of(batch):
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        counts = batch.column(1).to_numpy(zero_copy_only=False)
        flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
        return keys, counts, flat.reshape(len(keys), -1)

    def within_task(batches):
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = rows_of(batch)
            if held is not None:
                rows = tuple(np.concatenate([a, b]) for a, b in zip(held, rows))
            order = np.argsort(rows[0], kind="stable")
            held = runs(*(a[order] for a in rows))
            if len(held[0]) > 4096:  # many keys: pass on, nothing to gain
                yield emit(*held)
                held = None
        if held is not None:
            yield emit(*held)

    def sorted_stream(batches):
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = rows_of(batch)
            if held is not None:
                rows = tuple(np.concatenate([a, b]) for a, b in zip(held, rows))
            keys, counts, matrix = runs(*rows)
            if len(keys) > 1:
                yield emit(keys[:-1], counts[:-1], matrix[:-1])
            held = keys[-1:], counts[-1:], matrix[-1:]
        if held is not None:
            yield emit(*held)

    rows = df.filter(F.col(vec).isNotNull()).select(
        F.col(key).alias("key"), F.lit(1).cast("long").alias("n"), F.col(vec).alias("vec")
    )
    partial = rows.mapInArrow(within_task, schema)
    return (
        partial.repartition("key").sortWithinPartitions("key").mapInArrow(sorted_stream, schema)
    )


def mean_pool(df: DataFrame, key: str, vec: str, renormalize: bool = True) -> DataFrame:
    """(key, n, vec): mean vector per key, unit length unless told otherwise."""
    total = combine_vectors(df, key, vec, "sum")
    mean = F.transform("vec", lambda x: x / F.col("n"))
    return total.select(
        F.col("key").alias(key), "n",
        (V.l2_normalize(mean) if renormalize else mean).alias("vec"),
    )


def max_pool(df: DataFrame, key: str, vec: str, renormalize: bool = True) -> DataFrame:
    """Coordinate-wise maximum per key (the legacy way to collapse captions)."""
    top = combine_vectors(df, key, vec, "max")
    return top.select(
        F.col("key").alias(key), "n",
        (V.l2_normalize("vec") if renormalize else F.col("vec")).alias("vec"),
    )


def mean_pool_by_position(df: DataFrame, key: str, vec: str) -> DataFrame:
    """The same mean as plain SQL: explode positions, average, put back in order."""
    parts = df.select(key, F.posexplode(vec).alias("pos", "x"))
    means = parts.groupBy(key, "pos").agg(F.avg("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy(key).agg(
        V.l2_normalize(F.transform(ordered, lambda p: p["x"])).alias("vec")
    )


def centroids(df: DataFrame, cols) -> dict[str, np.ndarray]:
    """Mean vector of each column, all in one pass (d numbers reach the driver).

    Rows where any of the vectors is NULL do not count.
    """
    widths = F.array(*[F.size(c).cast("double") for c in cols])
    packed = df.select(F.lit(0).alias("k"), F.concat(widths, *cols).alias("vec"))
    row = combine_vectors(packed, "k", "vec").first()
    mean = np.array(row["vec"]) / row["n"]
    ends = np.cumsum(np.rint(mean[: len(cols)]).astype(int))
    return dict(zip(cols, np.split(mean[len(cols) :], ends[:-1])))


def centroid(df: DataFrame, vec: str) -> np.ndarray:
    return centroids(df, [vec])[vec]


def map_vector(df: DataFrame, col: str, fn, out: str | None = None) -> DataFrame:
    """Apply ``fn: matrix -> matrix`` to a vector column in Arrow batches."""
    out = out or col
    kept = [f for f in df.schema.fields if f.name != out]
    schema = StructType(kept + [StructField(out, VECTOR)])
    arrow_schema = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            column = batch.column(batch.schema.get_field_index(col))
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            result = fn(flat.reshape(batch.num_rows, -1))
            arrays = [
                batch.column(batch.schema.get_field_index(f.name)).cast(
                    arrow_schema.field(f.name).type
                )
                for f in kept
            ]
            arrays.append(vector_array(result).cast(arrow_schema.field(out).type))
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow_schema)

    return df.mapInArrow(run, schema)


def constant_vector(values) -> Column:
    return F.lit([float(x) for x in values]).cast("array<double>")
