"""What the operators share: reading the named columns, span strings, hot groups in cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by exact name.

    Other columns are neither read nor returned, so they may bear any name,
    also one that differs in case only or that an operator uses for its output.
    """
    held = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return held.select(*[F.col(f"_{df.columns.index(n)}").alias(n) for n in names])


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with all columns but the named ones called _r0, _r1, ..., and the function that puts the names back.

    Operators that return the columns of their input work on this form, so that
    no other column can clash with theirs. Both steps go by position.
    """
    given = df.columns
    first = {given.index(n) for n in names}
    held = df.toDF(*[n if i in first else f"_r{i}" for i, n in enumerate(given)])
    order = held.columns
    return held, lambda out: out.select(*order).toDF(*given)


def documents(df: DataFrame) -> DataFrame:
    """(doc_id, text) with a null text as the empty text."""
    return pick(df, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def per_document(df: DataFrame, schema: str | StructType, row: Callable[[], Callable]) -> DataFrame:
    """Map each (doc_id, text) to (doc_id, *values) in Arrow batches.

    ``row`` is called once per task and returns the function from text to a
    tuple of values; schema names the values' columns.
    """
    out = pick(df, "doc_id").schema
    extra = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = StructType(out.fields + extra.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        made, shape = row(), to_arrow_schema(full)
        for batch in batches:
            values = [made(t) for t in batch.column("text").to_pylist()]
            columns = zip(*values) if values else [[] for _ in extra.fields]
            arrays = [batch.column("doc_id")] + [pa.array(list(c), f.type) for c, f in zip(columns, list(shape)[1:])]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, shape)], schema=shape)

    return df.select("doc_id", "text").mapInArrow(run, full)


def span_string(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def of_kinds(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def hex_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def pair_cells(df: DataFrame, key: list[str], node: str, chunk: int) -> DataFrame:
    """Deal the rows of each key into cells so that any two meet in exactly one cell.

    A key with c x ``chunk`` rows becomes c(c+1)/2 cells of at most about two
    chunks: cell (i, i) compares all pairs in chunk i, cell (i, j) only pairs
    across the two chunks. Rows are copied c times, so a hot key costs its
    comparisons, spread over many tasks, and never one large group. Keys of one
    row have no pair and are left out. Adds _i, _j (the cell) and _own (chunk).
    """
    sizes = df.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1")
    sized = df.join(sizes.withColumn("_c", F.ceil(F.col("_n") / chunk).cast("int")).drop("_n"), key)
    own = F.pmod(F.xxhash64(F.col(node), F.lit(7)), F.col("_c")).cast("int")
    dealt = sized.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    return dealt.select(
        *df.columns, F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own"
    )
