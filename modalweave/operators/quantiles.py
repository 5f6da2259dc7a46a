"""Exact quantiles of a large column without bringing it into one task.

``percentile`` keeps every distinct value of a group in one buffer.  Here the
wanted places are narrowed down by histograms: each pass is one aggregate, and
only bin counts and the values of small bins reach the driver.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 4_096
FETCH = 20_000


def _places(n: int, p: float) -> tuple[int, int, int]:
    """0-based places: both neighbours of p*(n-1), and the discrete one."""
    h = p * (n - 1)
    return math.floor(h), math.ceil(h), max(0, math.ceil(p * n) - 1)


def _select(df: DataFrame, sizes: dict, wanted: dict, bins: int, fetch: int) -> dict:
    """{group: {place: value}} for 0-based places in ascending order."""
    spark = df.sparkSession
    found = {g: {} for g in wanted}
    todo = [(g, lo, hi, 0, n, sorted(set(wanted[g]))) for g, (n, lo, hi) in sizes.items() if n]
    group_type = df.schema["_g"].dataType.simpleString()
    while todo:
        narrow, small = [], []
        for item in todo:
            g, lo, hi, before, n, places = item
            if lo == hi:
                found[g].update({k: lo for k in places})
            else:
                (small if n <= fetch else narrow).append(item)
        todo = []
        if small:
            ends = [(i, g, lo, hi) for i, (g, lo, hi, *_) in enumerate(small)]
            table = F.broadcast(spark.createDataFrame(ends, f"_i int, _g {group_type}, _lo double, _hi double"))
            rows = df.join(table, "_g").filter("_x between _lo and _hi").select("_i", "_x").toArrow()
            values = {}
            for i, x in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                values.setdefault(i, []).append(x)
            for i, (g, _, _, before, _, places) in enumerate(small):
                ordered = sorted(values[i])
                found[g].update({k: ordered[k - before] for k in places})
        if narrow:
            # the width of a range may overflow although its ends do not
            ends = [(i, g, lo, hi, 1.0 if math.isfinite(hi - lo) else 0.5) for i, (g, lo, hi, *_) in enumerate(narrow)]
            table = F.broadcast(spark.createDataFrame(ends, f"_i int, _g {group_type}, _lo double, _hi double, _scale double"))
            x, lo, hi = (F.col(c) * F.col("_scale") for c in ("_x", "_lo", "_hi"))
            place = F.floor((x - lo) / (hi - lo) * bins)
            counts = (
                df.join(table, "_g").filter("_x between _lo and _hi")
                .groupBy("_i", F.least(F.lit(bins - 1), place).alias("_b"))
                .agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
                .collect()
            )
            for i, (g, _, _, before, _, places) in enumerate(narrow):
                mine = sorted((r for r in counts if r["_i"] == i), key=lambda r: r["_b"])
                starts = [before, *accumulate((r["n"] for r in mine), initial=before)][1:]
                hit = {}
                for k in places:
                    hit.setdefault(bisect_right(starts, k) - 1, []).append(k)
                for b, ks in hit.items():
                    r = mine[b]
                    todo.append((g, r["lo"], r["hi"], starts[b], r["n"], ks))
    return found


def exact_quantiles(
    df: DataFrame, value, ps, by: str | None = None, bins: int = BINS, fetch: int = FETCH
) -> dict:
    """{group: {p: (interpolated, discrete)}}; the group is None without ``by``.

    ``by`` has few values (systems, modalities). Values are ordered -inf, finite,
    inf, NaN; nulls do not count.
    """
    value = F.col(value) if isinstance(value, str) else value
    key = F.col(by) if by else F.lit("all")
    rows = df.select(key.alias("_g"), value.cast("double").alias("_x")).filter("_x is not null")
    x, top = F.col("_x"), F.lit(float("inf"))
    finite = ~F.isnan(x) & (F.abs(x) < top)
    ends = rows.groupBy("_g").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(x == -top).alias("low"), F.count_if(finite).alias("mid"),
        F.count_if(x == top).alias("high"),
        F.min(F.when(finite, x)).alias("lo"), F.max(F.when(finite, x)).alias("hi"),
    ).collect()
    sizes = {r["_g"]: (r["n"], r["lo"], r["hi"]) for r in ends}
    wanted = {g: [k for p in ps for k in _places(n, p)] for g, (n, _, _) in sizes.items()}
    # only finite values are narrowed down; the places of the others follow from their counts
    inner = {r["_g"]: (r["mid"], r["lo"], r["hi"]) for r in ends if r["mid"]}
    shift = {r["_g"]: r["low"] for r in ends}
    inside = {g: [k - shift[g] for k in wanted[g] if 0 <= k - shift[g] < inner[g][0]] for g in inner}
    chosen = _select(rows.filter(finite), {g: inner[g] for g in inside if inside[g]}, inside, bins, fetch)
    found = {}
    for r in ends:
        g, known = r["_g"], chosen.get(r["_g"], {})
        over = r["low"] + r["mid"]
        found[g] = {
            k: float("-inf") if k < r["low"] else known[k - r["low"]] if k < over else float("inf") if k < over + r["high"] else float("nan")
            for k in wanted[g]
        }
    out = {}
    for g, (n, _, _) in sizes.items():
        per_p = {}
        for p in ps:
            i, j, d = _places(n, p)
            lo, hi = found[g][i], found[g][j]
            share = p * (n - 1) - i
            per_p[p] = (lo if i == j else lo * (1 - share) + hi * share, found[g][d])
        out[g if by else None] = per_p
    return out


def lookup(by: str, values: dict) -> Column:
    """The value of each group as a column."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.element_at(F.create_map(*pairs), F.col(by))
