"""Fusion weights: constant, heuristic and query-dependent, as query columns.

A set of weights is either a ``System`` with numbers or three columns
(w_v, w_t, w_a) on the query table that a ``System`` refers to by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import vectors as V
from ..session import materialize
from .blocks import CLIP_CLAP, System
from .quantiles import exact_quantiles, lookup
from .scoring import best_scores, score_stats, truth_ranks

WEIGHTS = ("w_v", "w_t", "w_a")
MODALITY_NAMES = ("visual", "caption", "audio")

SINGLE = (
    System("visual", (1, 0, 0)),
    System("text", (0, 1, 0)),
    System("audio", (0, 0, 1)),
)
PAIRS = (
    System("visual+text", (0.5, 0.5, 0)),
    System("visual+audio", (0.5, 0, 0.5)),
    System("text+audio", (0, 0.5, 0.5)),
)
TRIPLE = System("equal", (1 / 3, 1 / 3, 1 / 3))
GATED = System("gated", WEIGHTS)
GATED_NO_AUDIO = System("gated_no_audio", ("n_v", "n_t", 0))

# Published constant weightings.
FIXED = {
    "fixed_20_70_10": (0.2, 0.7, 0.1),
    "fixed_15_80_05": (0.15, 0.8, 0.05),
    "fixed_30_60_10": (0.3, 0.6, 0.1),
    "fixed_text_only": (0.0, 1.0, 0.0),
    "fixed_equal": (1 / 3, 1 / 3, 1 / 3),
}


def equal_systems() -> tuple[System, ...]:
    return (*PAIRS, TRIPLE)


def fixed_systems(weights=FIXED, scale_a: float = 0.8) -> tuple[System, ...]:
    return tuple(System(n, (v, t, a * scale_a)) for n, (v, t, a) in weights.items())


def with_softmax_weights(df: DataFrame, logits) -> DataFrame:
    for name, w in zip(WEIGHTS, V.softmax(logits)):
        df = df.withColumn(f"_{name}", w)
    kept = [c for c in df.columns if c not in WEIGHTS and c not in [f"_{w}" for w in WEIGHTS]]
    return df.select(*kept, *[F.col(f"_{w}").alias(w) for w in WEIGHTS])


def scaled_audio(df: DataFrame, scale_a: float = 0.8) -> DataFrame:
    return df.withColumn("w_a", F.col("w_a") * F.lit(scale_a))


def max_confidence(queries, gallery, tau: float = 1.0, spaces=CLIP_CLAP, limits=None) -> DataFrame:
    """Weights = softmax of each modality's best score for the query."""
    stats = best_scores(queries, gallery, spaces, limits=limits)
    # a pass over all pairs, while the weights are read several times
    best = materialize(stats.groupBy("qid").pivot("space", [s.name for s in spaces]).agg(F.first("hi")), "best-scores")
    joined = queries.join(best, "qid")
    return with_softmax_weights(joined, [F.col(s.name) / tau for s in spaces]).drop(
        *[s.name for s in spaces]
    )


def mean_confidence(queries, gallery, tau: float = 1.0, spaces=CLIP_CLAP, limits=None) -> DataFrame:
    """Weights = softmax of each modality's mean score for the query.

    A mean of dot products is the dot product with the centroid, so cosine
    spaces need one pass over the gallery and none over the pairs.
    """
    if all(s.metric == "cosine" for s in spaces):
        centres = A.centroids(gallery, list(dict.fromkeys(s.g for s in spaces)))
        means = [
            V.dot(s.q, A.constant_vector(centres[s.g])) / s.tau * s.scale for s in spaces
        ]
        return with_softmax_weights(queries, [m / tau for m in means])
    stats = score_stats(queries, gallery, spaces, limits=limits, ends=False)
    mean = stats.withColumn("m", F.col("s1") / F.col("n"))
    wide = materialize(mean.groupBy("qid").pivot("space", [s.name for s in spaces]).agg(F.first("m")), "mean-scores")
    joined = queries.join(wide, "qid")
    return with_softmax_weights(joined, [F.col(s.name) / tau for s in spaces]).drop(
        *[s.name for s in spaces]
    )


def inverse_rank_weights(train: DataFrame, gallery: DataFrame, spaces=CLIP_CLAP, limits=None):
    """Constant weights proportional to each modality's MRR on train queries."""
    ranks = truth_ranks(train, gallery, spaces, SINGLE, limits=limits)
    rows = ranks.groupBy("system").agg(F.avg(1.0 / F.col("rk")).alias("mrr")).collect()
    mrr = {r["system"]: r["mrr"] for r in rows}
    total = sum(mrr[s.name] for s in SINGLE)
    return tuple(mrr[s.name] / total for s in SINGLE)


def truth_similarities(queries: DataFrame, gallery: DataFrame, spaces=CLIP_CLAP) -> DataFrame:
    """Queries with t_v, t_t, t_a: the score of their truth in each space."""
    names = list(dict.fromkeys(s.g for s in spaces))
    truth = gallery.select(
        F.col("id").alias("truth"), *[F.col(n).alias(f"_gt_{n}") for n in names]
    )
    joined = queries.join(truth, "truth")
    for s in spaces:
        cos = F.round(V.dot(s.q, f"_gt_{s.g}"), 12)
        value = V.to_angular(cos, s.tau) if s.metric == "angular" else cos / s.tau
        joined = joined.withColumn(f"t_{s.name}", value * s.scale)
    return joined.drop(*[f"_gt_{n}" for n in names])


def hard_oracle(queries, gallery, spaces=CLIP_CLAP) -> DataFrame:
    """One-hot weights on the modality that scores the truth highest (first on ties)."""
    q = truth_similarities(queries, gallery, spaces)
    v, t, a = (F.col(f"t_{s.name}") for s in spaces)
    pick_v = (v >= t) & (v >= a)
    pick_t = ~pick_v & (t >= a)
    flags = [pick_v, pick_t, ~pick_v & ~pick_t]
    for name, flag in zip(WEIGHTS, flags):
        q = q.withColumn(name, flag.cast("double"))
    return q


def soft_oracle(queries, gallery, tau: float = 0.5, spaces=CLIP_CLAP) -> DataFrame:
    """Weights = softmax of the truth's scores over the modalities."""
    q = truth_similarities(queries, gallery, spaces)
    return with_softmax_weights(q, [F.col(f"t_{s.name}") / tau for s in spaces])


def mask_and_renormalize(
    queries: DataFrame, clip: str = "q_clip", clap: str = "q_clap", on_empty: str = "raise"
) -> DataFrame:
    """Zero the weights of modalities the query cannot reach, rescale the rest.

    Without a CLIP-space vector the gate has no input: the reachable
    modalities share the weight equally.  A query with neither vector is an
    error, or dropped with ``on_empty='drop'``.
    """
    has_clip, has_clap = F.col(clip).isNotNull(), F.col(clap).isNotNull()
    if on_empty == "drop":
        queries = queries.filter(has_clip | has_clap)
    reach = [has_clip, has_clip, has_clap]
    kept = [
        F.when(r, F.when(has_clip, F.col(w)).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))
        for r, w in zip(reach, WEIGHTS)
    ]
    total = kept[0] + kept[1] + kept[2]
    if on_empty == "raise":
        empty = F.raise_error(
            F.lit("a query has neither of its two vectors")
        ).cast("double")
        total = F.when(has_clip | has_clap, total).otherwise(empty)
    rest = [c for c in queries.columns if c not in WEIGHTS]
    return queries.select(*rest, *[(k / total).alias(w) for k, w in zip(kept, WEIGHTS)])


def without_audio(queries: DataFrame) -> DataFrame:
    """Add n_v, n_t: the visual and caption weights rescaled to leave audio out."""
    total = F.col("w_v") + F.col("w_t") + F.lit(1e-8)
    return queries.withColumn("n_v", F.col("w_v") / total).withColumn("n_t", F.col("w_t") / total)


def constant_gate(queries: DataFrame, logits) -> DataFrame:
    """The same softmax weights on every query."""
    return with_softmax_weights(queries, [F.lit(float(x)) for x in logits])


def dominant(weights=WEIGHTS) -> Column:
    """Name of the largest weight, the first one on ties."""
    v, t, a = (F.col(w) for w in weights)
    return (
        F.when((v >= t) & (v >= a), MODALITY_NAMES[0])
        .when(t >= a, MODALITY_NAMES[1])
        .otherwise(MODALITY_NAMES[2])
    )


def spread(weights=WEIGHTS) -> Column:
    cols = [F.col(w) for w in weights]
    return F.greatest(*cols) - F.least(*cols)


def long_weights(queries: DataFrame) -> DataFrame:
    items = F.array(
        *[
            F.struct(F.lit(m).alias("modality"), F.col(w).alias("w"))
            for m, w in zip(MODALITY_NAMES, WEIGHTS)
        ]
    )
    return queries.select("qid", F.explode(items).alias("_x")).select("qid", "_x.*")


def weight_stats(queries: DataFrame) -> DataFrame:
    """Per modality: distribution of its weight, extreme shares, times dominant."""
    won = queries.groupBy(dominant().alias("modality")).agg(
        F.count(F.lit(1)).alias("times_dominant")
    )
    long = long_weights(queries)
    medians = {m: q[0.5][0] for m, q in exact_quantiles(long, "w", [0.5], "modality").items()}
    stats = long.groupBy("modality").agg(
        F.avg("w").alias("mean"),
        F.stddev_samp("w").alias("std"),
        F.stddev_pop("w").alias("std_pop"),
        F.min("w").alias("lo"),
        F.max("w").alias("hi"),
        F.avg((F.col("w") > 0.9).cast("int")).alias("above_90"),
        F.avg((F.col("w") < 0.5).cast("int")).alias("below_50"),
    )
    stats = stats.withColumn("median", lookup("modality", medians))
    return stats.join(won, "modality", "left").withColumn(
        "times_dominant", F.coalesce("times_dominant", F.lit(0))
    )


def weight_histogram(queries: DataFrame, bins: int = 5) -> DataFrame:
    """(modality, bin, n): equal bins between a weight's minimum and maximum."""
    long = long_weights(queries)
    ends = long.groupBy("modality").agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    place = F.floor((F.col("w") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), place)).otherwise(F.lit(0))
    return (
        long.join(ends, "modality")
        .groupBy("modality", bin_.cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def modality_scaling(tau: dict | None = None, scale: dict | None = None):
    """Angular spaces with temperatures clamped to [.05, 5] and scales to [.1, 2]."""
    from dataclasses import replace

    tau = {"v": 1.0, "t": 1.0, "a": 0.5, **(tau or {})}
    scale = {"v": 1.0, "t": 1.0, "a": 0.8, **(scale or {})}
    bound = lambda x, lo, hi: min(hi, max(lo, x))
    return tuple(
        replace(
            s, metric="angular",
            tau=bound(tau[s.name], 0.05, 5.0), scale=bound(scale[s.name], 0.1, 2.0),
        )
        for s in CLIP_CLAP
    )


def routing_table(queries: DataFrame, gallery: DataFrame, spaces=CLIP_CLAP, limits=None) -> DataFrame:
    """Per query: weights, dominant modality, spread, best score per modality, fused best."""
    from .scoring import score_top_k

    stats = best_scores(queries, gallery, spaces, limits=limits)
    best = stats.groupBy("qid").pivot("space", [s.name for s in spaces]).agg(F.first("hi"))
    best = best.select("qid", *[F.col(s.name).alias(f"max_sim_{s.name}") for s in spaces])
    top = score_top_k(queries, gallery, 1, spaces, (GATED,), limits=limits)
    top = top.select("qid", F.col("score").alias("fused_top1"))
    shown = queries.select(
        "qid", "kind", *WEIGHTS, dominant().alias("dominant"), spread().alias("spread")
    )
    return shown.join(best, "qid").join(top, "qid")


def routing_acceptance(table: DataFrame, expected: str = "expected") -> DataFrame:
    """Three yes/no criteria: some clear spread, varied dominants, half as expected."""
    return table.agg(
        F.max((F.col("spread") >= 0.15).cast("int")).cast("boolean").alias("clear_spread"),
        F.countDistinct("dominant").alias("n_dominant"),
        (F.countDistinct("dominant") > 1).alias("varied"),
        (F.avg((F.col("dominant") == F.col(expected)).cast("int")) >= 0.5).alias("as_expected"),
    )


def multi_seed(metrics: DataFrame) -> DataFrame:
    """(method, metric, mean, std, n) over seeds; std is the sample form, 0 for one seed."""
    return metrics.groupBy("method", "metric").agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.count(F.lit(1)).alias("n"),
    )


def compare_methods(summary: DataFrame, base: str, other: str, t_crit: float = 2.776) -> DataFrame:
    """Per metric: difference of two methods and its 95 % half width over seeds."""
    side = lambda m, p: summary.filter(F.col("method") == m).select(
        "metric", *[F.col(c).alias(f"{p}_{c}") for c in ("mean", "std", "n")]
    )
    joined = side(base, "a").join(side(other, "b"), "metric")
    half = F.lit(t_crit) * F.sqrt(
        F.col("a_std") * F.col("a_std") / F.col("a_n")
        + F.col("b_std") * F.col("b_std") / F.col("b_n")
    )
    diff = F.col("b_mean") - F.col("a_mean")
    return joined.select(
        "metric", "a_mean", "b_mean", diff.alias("diff"), half.alias("half_width"),
        (diff - half > 0).alias("strictly_better"),
        (-diff <= half).alias("within_noise"),
    )
