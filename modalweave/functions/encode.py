"""Encoder hook: batched model inference over a column.

The caller brings a factory that builds the model once per task.  The
built-in encoder hashes words, so it needs no weights and is reproducible in
any engine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import aggregates as A
from . import vectors as V
from .text import chunk_text, is_blank

Encoder = Callable[[list], np.ndarray]


def hashing_encoder(width: int = 64) -> Callable[[], Encoder]:
    """Signed feature hashing of lower-cased words (md5), unit length."""

    def build() -> Encoder:
        slots: dict[str, tuple[int, float]] = {}

        def slot(word):
            hit = slots.get(word)
            if hit is None:
                digest = hashlib.md5(word.encode()).hexdigest()
                sign = 1.0 if int(digest[8:10], 16) < 128 else -1.0
                hit = slots[word] = (int(digest[:8], 16) % width, sign)
                if len(slots) > 200_000:
                    slots.clear()
            return hit

        def encode(texts):
            out = np.zeros((len(texts), width))
            for row, text in zip(out, texts):
                for word in text.lower().split():
                    i, sign = slot(word)
                    row[i] += sign
            length = np.sqrt((out * out).sum(axis=1, keepdims=True))
            return out / np.maximum(length, V.EPS)

        return encode

    return build


def encode(
    df: DataFrame,
    col: str,
    out: str,
    build: Callable[[], Encoder] | None = None,
    batch: int = 256,
) -> DataFrame:
    """Add ``out`` = encoder(col) as a vector; NULL where the text is blank."""
    build = build or hashing_encoder()

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = build()
        for part in parts:
            texts = part.fillna("").tolist()
            rows = []
            for lo in range(0, len(texts), batch):
                rows.extend(np.asarray(model(texts[lo : lo + batch]), dtype=np.float64))
            yield pd.Series(rows, index=part.index, dtype=object)

    return df.withColumn(out, F.when(~is_blank(col), run(F.col(col))))


def encode_chunks(
    df: DataFrame, id_col: str, col: str, out: str, build=None, budget: int = 72
) -> DataFrame:
    """(id, out): mean of the unit vectors of a long text's chunks, unit length."""
    chunks = df.select(id_col, F.explode(chunk_text(col, budget)).alias("chunk"))
    encoded = encode(chunks, "chunk", "vec", build)
    return A.mean_pool(encoded, id_col, "vec").select(id_col, F.col("vec").alias(out))


def text_variant(df: DataFrame, id_col: str, variant: str, build=None) -> DataFrame:
    """(id, vec) for ``description``, ``transcript`` or ``fused`` text."""
    if variant not in ("description", "transcript", "fused"):
        raise ValueError(f"unknown text variant {variant!r}")
    desc = encode(df.select(id_col, "text_description"), "text_description", "d", build)
    if variant == "description":
        return desc.filter("d is not null").select(id_col, F.col("d").alias("vec"))
    trans = encode_chunks(df, id_col, "text_transcript", "t", build)
    if variant == "transcript":
        return trans.select(id_col, F.col("t").alias("vec"))
    both = desc.select(id_col, "d").join(trans, id_col, "left")
    return both.select(id_col, V.blend("d", "t", 0.5).alias("vec")).filter("vec is not null")
