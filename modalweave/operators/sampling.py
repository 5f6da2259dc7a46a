"""Seeded order, samples and splits that any engine can repeat (md5 based)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def md5_key(seed, *cols) -> Column:
    parts = [F.lit(str(seed))] + [
        (F.col(c) if isinstance(c, str) else c).cast("string") for c in cols
    ]
    return F.md5(F.concat_ws(":", *parts))


def join_same(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Inner join on equal keys where two nulls are equal too; the keys appear once."""
    renamed = right.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in right.columns])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return left.join(renamed, on).drop(*[f"_k_{k}" for k in keys])


def md5_int(seed, *cols) -> Column:
    """First 32 bits of the md5 as a BIGINT."""
    return F.conv(F.substring(md5_key(seed, *cols), 1, 8), 16, 10).cast("long")


def shuffled_position(df: DataFrame, id_col: str, seed, keys=(), out: str = "position") -> DataFrame:
    """0-based place of each row in the seeded random order, within ``keys``.

    A plain row_number would put a whole key (or the whole table) into one
    task.  Rows are numbered inside 4096 hash ranges of the order instead, and
    the ranges' running counts are added.
    """
    keys = list(keys)
    keyed = df.withColumn("_key", md5_key(seed, id_col)).withColumn(
        "_range", F.substring("_key", 1, 3)
    )
    in_range = Window.partitionBy(*keys, "_range").orderBy("_key", id_col)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    counts = keyed.groupBy(*keys, "_range").count()
    offsets = counts.select(
        *keys, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    placed = keyed.withColumn("_local", F.row_number().over(in_range) - 1)
    return (
        join_same(placed, offsets, [*keys, "_range"])
        .withColumn(out, (F.col("_before") + F.col("_local")).cast("long"))
        .drop("_key", "_range", "_local", "_before")
    )


def id_position(df: DataFrame, id_col: str, out: str = "position", width: int = 65_536) -> DataFrame:
    """0-based place of a numeric id in id order, numbered range by range.

    Ranges of about ``width`` rows come from approximate quantiles of the ids,
    however the ids are spread; at most 4096 of them are summed up in one task.
    """
    parts = min(4096, max(1, df.count() // width))
    cuts = sorted(set(df.approxQuantile(id_col, [i / parts for i in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []
    below = F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(id_col)) if cuts else None
    keyed = df.withColumn("_range", F.size(below) if cuts else F.lit(0))
    w = Window.partitionBy("_range").orderBy(id_col)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("_range").count().select(
        "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    return (
        keyed.withColumn("_local", F.row_number().over(w) - 1)
        .join(offsets, "_range")
        .withColumn(out, (F.col("_before") + F.col("_local")).cast("long"))
        .drop("_range", "_local", "_before")
    )


def sample(df: DataFrame, n: int, seed, id_col: str = "id") -> DataFrame:
    """``n`` rows without replacement: the first in the seeded order, numbered range by range."""
    return shuffled_position(df, id_col, seed, out="_place").filter(F.col("_place") < n).drop("_place")


def stratified_split(
    df: DataFrame, category: str, id_col: str, share: float = 0.85, seed: int = 42
) -> DataFrame:
    """Add ``split``: per category the first max(1, floor(share*n)) are train."""
    placed = shuffled_position(df, id_col, seed, [category], "_pos")
    sizes = df.groupBy(category).agg(
        F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(share))).alias("_train")
    )
    return (
        join_same(placed, sizes, [category])
        .withColumn("split", F.when(F.col("_pos") < F.col("_train"), "train").otherwise("test"))
        .drop("_pos", "_train")
    )


def pilot_sample(df: DataFrame, category: str, id_col: str, n: int = 30, seed: int = 42) -> DataFrame:
    """At most ``n`` rows per category, in the seeded order."""
    w = Window.partitionBy(category).orderBy(md5_key(seed, id_col), id_col)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def group_split(df: DataFrame, group: str, share: float = 0.15, seed: int = 42) -> DataFrame:
    """Add ``part``: all rows of a group share ``val`` or ``train``."""
    groups = df.select(group).distinct()
    placed = shuffled_position(groups, group, seed, out="_pos")
    n = groups.count()
    size = max(1, int(n * share))
    parts = placed.select(
        group, F.when(F.col("_pos") < size, "val").otherwise("train").alias("part")
    )
    return join_same(df, parts, [group]).select(*df.columns, "part")


def leakage(df: DataFrame, group: str, part: str = "part") -> DataFrame:
    """Groups found in both parts; empty for a sound split."""
    side = lambda name: df.filter(F.col(part) == name).select(group)
    return side("train").intersect(side("val"))


def pick_subset(df: DataFrame, relevant: DataFrame, n: int, seed, id_col: str = "id") -> DataFrame:
    """All relevant rows plus seeded others up to ``n`` rows; flagged by source."""
    ids = relevant.select(id_col).distinct()
    chosen = df.join(ids, id_col, "left_semi").withColumn("relevant", F.lit(True))
    room = max(0, n - chosen.count())
    others = sample(df.join(ids, id_col, "left_anti"), room, seed, id_col)
    return chosen.unionByName(others.withColumn("relevant", F.lit(False)))


def random_negatives(queries: DataFrame, gallery: DataFrame, k: int, seed) -> DataFrame:
    """(qid, id, draw): ``k`` distinct gallery ids per query, never its truth.

    Each query reads k+1 consecutive places of one seeded shuffle from its own
    start, so drawing is an equi-join on the place and no pair is scanned.
    """
    places = shuffled_position(gallery.select("id"), "id", seed, out="place")
    n = gallery.count()
    if n < k + 1:
        raise ValueError("the gallery is too small for that many negatives")
    start = F.pmod(md5_int(seed, "qid"), F.lit(n))
    wanted = queries.select(
        "qid", "truth", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("step")
    ).withColumn("place", F.pmod(start + F.col("step"), F.lit(n)))
    drawn = wanted.join(places, "place").filter(F.col("id") != F.col("truth"))
    w = Window.partitionBy("qid").orderBy("step")
    return (
        drawn.withColumn("draw", F.row_number().over(w))
        .filter(F.col("draw") <= k)
        .select("qid", "id", "draw")
    )
