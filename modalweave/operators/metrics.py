"""Retrieval metrics: aggregates over a table of truth ranks.

Input rows are (system, qid, rk, ...); no operator here looks at scores again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .blocks import fits_broadcast
from .quantiles import exact_quantiles, lookup
from .sampling import md5_int, shuffled_position

KS = (1, 5, 10)


def recall(k, rk="rk") -> Column:
    return F.avg((F.col(rk) <= k).cast("int"))


def recall_at_k(ranks: DataFrame, ks=KS, by=("system",)) -> DataFrame:
    return ranks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_queries"),
        *[recall(k).alias(f"r{k}") for k in ks],
    )


def mrr(ranks: DataFrame, by=("system",)) -> DataFrame:
    return ranks.groupBy(*by).agg(F.avg(1.0 / F.col("rk")).alias("mrr"))


def rank_summary(ranks: DataFrame, by: str = "system") -> DataFrame:
    """Mean and both medians of the 0-based rank (lower middle; mean of middles)."""
    zero = F.col("rk") - 1
    medians = {g: m[0.5] for g, m in exact_quantiles(ranks, zero, [0.5], by).items()}
    return ranks.groupBy(by).agg(F.avg(zero).alias("mean_rank")).select(
        by, "mean_rank",
        lookup(by, {g: m[1] for g, m in medians.items()}).alias("median_low"),
        lookup(by, {g: m[0] for g, m in medians.items()}).alias("median_mid"),
    )


def ndcg(k, rk="rk") -> Column:
    gain = F.when(F.col(rk) <= k, 1.0 / F.log2(F.col(rk) + 1.0)).otherwise(0.0)
    return F.avg(gain)


def average_precision(k, rk="rk") -> Column:
    return F.avg(F.when(F.col(rk) <= k, 1.0 / F.col(rk)).otherwise(0.0))


def ndcg_at_k(ranks: DataFrame, ks=(1, 3, 5), by=("system",)) -> DataFrame:
    return ranks.groupBy(*by).agg(*[ndcg(k).alias(f"ndcg{k}") for k in ks])


def ap_at_k(ranks: DataFrame, ks=(3, 5), by=("system",)) -> DataFrame:
    return ranks.groupBy(*by).agg(*[average_precision(k).alias(f"ap{k}") for k in ks])


def cmc(ranks: DataFrame, ks=(1, 2, 5, 10, 20, 50, 100)) -> DataFrame:
    """(system, k, recall) at the published cut-offs and at the gallery size."""
    wide = ranks.groupBy("system").agg(
        F.max("n").alias("gallery"),
        *[recall(k).alias(f"k{k}") for k in ks],
        F.avg((F.col("rk") <= F.col("n")).cast("int")).alias("kn"),
    )
    points = [F.struct(F.lit(k).cast("long").alias("k"), F.col(f"k{k}").alias("recall")) for k in ks]
    points.append(F.struct(F.col("gallery").alias("k"), F.col("kn").alias("recall")))
    return wide.select("system", F.explode(F.array(*points)).alias("p")).select("system", "p.*")


def by_category(ranks: DataFrame, ks=KS) -> DataFrame:
    """Every category and the total in one pass; the total is category 'all'."""
    return (
        ranks.withColumn("category", F.col("category").cast("string"))
        .rollup("system", "category")
        .agg(
            F.grouping_id().alias("_g"),
            F.count(F.lit(1)).alias("n_queries"),
            *[recall(k).alias(f"r{k}") for k in ks],
        )
        .filter("_g <= 1")
        .withColumn("category", F.when(F.col("_g") == 1, "all").otherwise(F.col("category")))
        .drop("_g")
    )


def chance_ratio(ranks: DataFrame) -> DataFrame:
    base = ranks.groupBy("system").agg(recall(1).alias("r1"), F.max("n").alias("gallery"))
    return base.withColumn("chance", 1.0 / F.col("gallery")).withColumn(
        "ratio", F.col("r1") * F.col("gallery")
    )


def rank_bucket(rk="rk") -> Column:
    r = F.col(rk)
    return (
        F.when(r == 1, "perfect").when(r <= 10, "near").when(r <= 100, "far")
        .otherwise("very_far")
    )


def rank_buckets(ranks: DataFrame) -> DataFrame:
    """(system, bucket, n, share) for rank 1, 2-10, 11-100 and beyond."""
    counts = ranks.groupBy("system", rank_bucket().alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = F.sum("n").over(Window.partitionBy("system"))
    return counts.withColumn("share", F.col("n") / total)


def rank_shares(ranks: DataFrame, thresholds=(0, 1, 5, 10, 50, 100, 500, 1000)) -> DataFrame:
    """(system, threshold, share): share of queries with 0-based rank <= threshold."""
    wide = ranks.groupBy("system").agg(
        *[F.avg((F.col("rk") - 1 <= t).cast("int")).alias(f"t{t}") for t in thresholds]
    )
    points = [
        F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("share")) for t in thresholds
    ]
    return wide.select("system", F.explode(F.array(*points)).alias("p")).select("system", "p.*")


def compare_variants(ranks: DataFrame, baseline: str, variants) -> DataFrame:
    """One row per system: R@1 of each variant, its delta to the baseline, the winner."""
    names = [baseline, *[v for v in variants if v != baseline]]
    r1 = ranks.groupBy("system", "variant").agg(recall(1).alias("r1"))
    wide = r1.groupBy("system").pivot("variant", names).agg(F.first("r1"))
    winner = r1.groupBy("system").agg(
        F.min_by("variant", F.struct(-F.col("r1"), F.col("variant"))).alias("winner")
    )
    cols = ["system", *[F.col(v).alias(f"{v}_r1") for v in names]]
    cols += [(F.col(v) - F.col(baseline)).alias(f"{v}_delta") for v in names[1:]]
    return wide.select(*cols).join(winner, "system")


# Published leave-one-out recall of the earlier corpus.
ANCHORS = {
    "visual": 0.2165,
    "text": 0.3972,
    "audio": 0.0102,
    "equal": 0.4303,
    "gated": 0.3983,
}


def anchor_comparison(ranks: DataFrame, anchors=ANCHORS) -> DataFrame:
    """R@1 per system beside its published anchor."""
    anchor = F.create_map(*[F.lit(x) for pair in anchors.items() for x in pair])
    r1 = ranks.groupBy("system").agg(recall(1).alias("r1"))
    return (
        r1.withColumn("anchor", F.try_element_at(anchor, F.col("system")))
        .filter("anchor is not null")
        .withColumn("delta", F.col("r1") - F.col("anchor"))
    )


def top_systems(metrics: DataFrame, metric: str, n: int | None = None) -> DataFrame:
    ordered = metrics.orderBy(F.col(metric).desc(), "system")
    return ordered if n is None else ordered.limit(n)


def bootstrap_ci(
    ranks: DataFrame, ks=KS, rounds: int = 1000, seed: int = 42, level: float = 0.95
) -> DataFrame:
    """(system, k, recall, lo, hi): percentile interval of resampled recall.

    Recall is a mean of per-query hits, so a resample only redraws hits: each
    of the n places of a round names one query place by hash, and an equi-join
    on the place fetches that query's ranks.  All systems answer the same n
    queries.
    """
    hits = shuffled_position(ranks.select("system", "qid", "rk"), "qid", seed, ["system"], "place")
    hits = materialize(hits.select("system", "place", "rk"), "hits")
    n = hits.agg(F.max("place") + 1).first()[0]
    spark = ranks.sparkSession
    draws = (
        spark.range(n * rounds)
        .select(F.expr(f"id div {n} + 1").alias("b"), F.expr(f"id % {n}").alias("i"))
        .select("i", "b", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
        .select("b", "k", F.pmod(md5_int(seed, "k", "b", "i"), F.lit(n)).alias("place"))
    )
    if fits_broadcast(hits):
        hits = F.broadcast(hits)
    rounds_ = draws.join(hits, "place").groupBy("system", "k", "b").agg(
        F.avg((F.col("rk") <= F.col("k")).cast("int")).alias("recall")
    )
    tail = (1.0 - level) / 2
    # a group holds ``rounds`` values, whatever the number of queries
    return rounds_.groupBy("system", "k").agg(
        F.percentile("recall", F.lit(tail)).alias("lo"),
        F.percentile("recall", F.lit(1.0 - tail)).alias("hi"),
    )


def bootstrap_ci_large(
    ranks: DataFrame, ks=KS, rounds: int = 1000, seed: int = 42, level: float = 0.95
) -> DataFrame:
    """The same interval for many queries, by one draw a round.

    n redraws of a 0/1 hit are one Binomial(n, recall) draw, so after one pass
    that counts hits the work is about 24 * sqrt(n * recall * (1 - recall))
    table rows and ``rounds`` draws per (system, k), whatever n is.
    """
    wide = ranks.groupBy("system").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum((F.col("rk") <= k).cast("long")).alias(f"h{k}") for k in ks],
    )
    points = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks])
    long = wide.select("system", "n", F.explode(points).alias("p")).select("system", "n", "p.*")
    drawn = binomial_draws(long, ["system", "k"], rounds, seed)
    tail = (1.0 - level) / 2
    return drawn.groupBy("system", "k").agg(
        F.percentile(F.col("hits") / F.col("n"), F.lit(tail)).alias("lo"),
        F.percentile(F.col("hits") / F.col("n"), F.lit(1.0 - tail)).alias("hi"),
    )


def binomial_draws(counts: DataFrame, keys: list[str], rounds: int, seed: int = 42) -> DataFrame:
    """(*keys, n, b, hits): ``rounds`` draws of Binomial(n, hits / n) for every row of ``counts``.

    Round b takes the uniform number (v + 1/2) / 2^32, v being the first 32
    bits of md5(seed:k:b) with k the last key, and gives the least count whose
    distribution function reaches it. The function is tabulated by the
    quotients of neighbouring probabilities within 12 standard deviations and
    24 counts of the mean; what lies beyond has a probability below 1e-15, far
    under the step of the uniform numbers. Rows with no hit or only hits give
    just that. ``keys`` tell rows apart; ``counts`` holds (*keys, n, hits).
    """
    p = F.col("hits") / F.col("n")
    width = F.when((F.col("hits") > 0) & (F.col("hits") < F.col("n")), F.ceil(12 * F.sqrt(F.col("n") * p * (1 - p))) + 24)
    width = F.coalesce(width, F.lit(0)).cast("long")
    spread = counts.select(
        *keys, "n", F.col("hits").alias("mean"),
        F.explode(F.sequence(
            F.greatest(F.lit(0).cast("long"), F.col("hits") - width), F.least(F.col("n"), F.col("hits") + width)
        )).alias("hits"),
    )
    up = Window.partitionBy(*keys).orderBy("hits")
    one = Window.partitionBy(*keys)
    odds = F.col("mean") / (F.col("n") - F.col("mean"))
    step = F.ln((F.col("n") - F.col("hits") + 1) / F.col("hits") * odds)
    step = F.when(F.row_number().over(up) == 1, 0.0).otherwise(step)
    table = (
        spread.withColumn("_step", step)
        .withColumn("_log", F.sum("_step").over(up))
        .withColumn("_mass", F.exp(F.col("_log") - F.max("_log").over(one)))
        .withColumn("u", F.sum("_mass").over(up) / F.sum("_mass").over(one))
        .select(*keys, "n", "u", F.lit(None).cast("long").alias("b"), "hits")
    )
    uniform = (md5_int(seed, keys[-1], "b") + 0.5) / F.lit(2.0**32)
    draws = counts.select(*keys, "n", F.explode(F.sequence(F.lit(1), F.lit(rounds)).cast("array<long>")).alias("b"))
    draws = draws.select(*keys, "n", uniform.alias("u"), "b", F.lit(None).cast("long").alias("hits"))
    # one sort from the top: a draw takes the last count passed, that of a draw on its edge included
    # (a frame that runs on to the end instead would start anew at every row)
    ahead = Window.partitionBy(*keys).orderBy(F.col("u").desc(), F.col("b").isNull().desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        table.unionByName(draws)
        .withColumn("hits", F.min("hits").over(ahead))
        .filter("b is not null")
        .select(*keys, "n", "b", "hits")
    )
