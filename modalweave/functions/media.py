"""Sampling plans for media files: which frames, segments and offsets to take."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import col_of


def frame_times(duration, n: int = 16) -> Column:
    """Mid-points of ``n`` equal slices; NULL for a non-positive duration."""
    d = col_of(duration)
    times = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i + F.lit(0.5)) * d / F.lit(n)
    )
    return F.when(d > 0, times)


def frame_indices(total, n: int = 16) -> Column:
    """First frame of each of ``n`` equal slices of ``total`` frames."""
    t = col_of(total)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.floor(i * t / F.lit(n)).cast("long"),
    )


def segment_plan(duration, segment: float = 10.0, n: int = 3, whole: float = 30.0) -> Column:
    """Segments to cut from a track: all of it if short, else start, middle, end."""
    if n != 3:
        raise ValueError("the plan is defined for start, middle and end")
    d = col_of(duration)
    part = lambda start, length: F.struct(
        start.cast("double").alias("start"), length.cast("double").alias("length")
    )
    seg = F.lit(float(segment))
    return F.when(d <= whole, F.array(part(F.lit(0.0), d))).otherwise(
        F.array(
            part(F.lit(0.0), seg),
            part(d / 2.0 - seg / 2.0, seg),
            part(d - seg, seg),
        )
    )


def segment_offsets(samples, rate: int = 48_000, seconds: int = 10) -> Column:
    """Sample offsets of the clips to embed, with the zero padding each needs."""
    n = col_of(samples)
    size = rate * seconds
    dur = n / F.lit(float(rate))

    def clip(offset):
        offset = offset.cast("long")
        have = F.least(F.lit(size).cast("long"), n - offset)
        return F.struct(offset.alias("offset"), (F.lit(size) - have).alias("padding"))

    return F.when(dur <= seconds, F.array(clip(F.lit(0)))).otherwise(
        F.array(
            clip(F.lit(0)),
            clip((dur - seconds) / 2 * rate),
            clip((dur - seconds) * rate),
        )
    )


def window_offsets(samples, rate: int = 16_000, seconds: int = 2) -> Column:
    """Back-to-back windows; a track shorter than one window gives one."""
    n = col_of(samples)
    size = rate * seconds
    count = F.greatest(F.lit(1).cast("long"), F.floor(n / F.lit(size)).cast("long"))
    return F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: i * size)
