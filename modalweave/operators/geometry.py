"""Embedding-geometry diagnostics.

Means and spreads over all pairs come from Gram sums: for pair cosines
sum(x_i . y_j) = (sum x) . (sum y) and sum((x_i . y_j)^2) = <X'X, Y'Y>, so
they cost one pass over the rows instead of one per pair.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import aggregates as A
from ..functions import vectors as V
from ..session import materialize
from .align import Gram, fit_zca, gram, grams
from .blocks import SCORE_DECIMALS, Space, System, block_join
from .curate import positive_pairs
from .quantiles import exact_quantiles
from .scoring import _fields, score_stats, score_top_k

ONE = System("s", (1,))


def as_queries(store: DataFrame) -> DataFrame:
    return store.select(F.col("id").alias("qid"), F.col("id").alias("truth"), F.col("vec").alias("q"))


def as_gallery(store: DataFrame) -> DataFrame:
    return store.select("id", F.col("vec").alias("g"))


PAIR = (Space("s", "q", "g"),)


def alignment(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positive-pair cosine summary and E||x - y||^2 of two unit stores."""
    pairs = positive_pairs(a, b).withColumn("_sq", F.greatest(F.lit(0.0), 2.0 - 2.0 * F.col("cos")))
    ps = (0.05, 0.25, 0.5, 0.75, 0.95)
    q = exact_quantiles(pairs, "cos", ps).get(None, {})
    return pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("cos").alias("mean_cos"),
        F.stddev_samp("cos").alias("std_cos"),
        *[F.lit(q[p][0] if q else None).alias(f"q{int(p * 100):02d}") for p in ps],
        F.avg(F.sqrt("_sq")).alias("mean_l2"),
        F.avg("_sq").alias("alignment"),
    )


class ExpPotential:
    """Sum over all pairs of exp(-t * squared distance of unit vectors)."""

    def __init__(self, t):
        self.t = t

    def start(self, q):
        return np.zeros(q["_n"])

    def update(self, state, q, g):
        for lo in range(0, q["_n"], 64):  # the matrix of a few queries stays in a core's cache
            for at in range(0, g["_n"], 2048):
                e = (2.0 * self.t * q["q"][lo : lo + 64]) @ g["g"][at : at + 2048].T
                e -= 2.0 * self.t
                state[lo : lo + 64] += np.exp(e, out=e).sum(axis=1)
        return state

    def finish(self, state, q):
        return {"potential": state.sum(keepdims=True)}


def uniformity(store: DataFrame, t: float = 2.0, include_self: bool = True, limits=None) -> DataFrame:
    """ln of the mean Gaussian potential over all pairs; lower is more uniform.

    Self pairs (potential 1 each) count unless ``include_self`` is off.
    """
    q = as_queries(store).select("qid", "q")
    schema = StructType([StructField("potential", DoubleType())])
    partial = block_join(
        q, as_gallery(store), ExpPotential(t), schema, q_key=["qid"], g_key=["id"], limits=limits
    )
    rows = store.count()
    n, total = float(rows), F.sum("potential")  # n * n leaves the range of an integer from 46 341 rows on
    pairs = F.lit(n * n if include_self else n * (n - 1))
    mean = F.try_divide(total if include_self else total - F.lit(n), pairs)
    return partial.agg(F.lit(rows).alias("n"), F.ln(mean).alias("uniformity"))


class Histogram:
    """Counts of non-positive pair scores per equal bin of [lo, hi]."""

    def __init__(self, lo, hi, bins):
        self.lo, self.hi, self.bins = lo, hi, bins

    def start(self, q):
        return np.zeros(self.bins, dtype=np.int64)

    def update(self, state, q, g):
        s = np.round(q["q"] @ g["g"].T, SCORE_DECIMALS)
        s = s[q["truth"][:, None] != g["id"][None, :]]
        place = np.floor((s - self.lo) / (self.hi - self.lo) * self.bins).astype(np.int64)
        state += np.bincount(np.clip(place, 0, self.bins - 1), minlength=self.bins)
        return state

    def finish(self, state, q):
        return {"bin": np.arange(self.bins, dtype=np.int64), "n": state}


def pos_neg_histograms(a: DataFrame, b: DataFrame, bins: int = 100, limits=None) -> DataFrame:
    """(bin, n_pos, n_neg) over the common range of both distributions."""
    q, g = as_queries(a), as_gallery(b)
    pos = positive_pairs(a, b).select(F.round("cos", SCORE_DECIMALS).alias("cos"))
    neg = score_stats(q, g, PAIR, exclude="truth", limits=limits)
    p = pos.agg(F.min("cos").alias("lo"), F.max("cos").alias("hi")).first()
    n = neg.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    lo, hi = min(p["lo"], n["lo"]), max(p["hi"], n["hi"])
    schema = StructType([StructField("bin", LongType()), StructField("n", LongType())])
    neg_bins = block_join(
        q.select("qid", "truth", "q"), g, Histogram(lo, hi, bins), schema,
        q_key=["qid"], g_key=["id"], limits=limits,
    ).groupBy("bin").agg(F.sum("n").alias("n_neg"))
    place = F.floor((F.col("cos") - F.lit(lo)) / F.lit(hi - lo) * bins)
    pos_bins = pos.groupBy(
        F.greatest(F.lit(0), F.least(F.lit(bins - 1), place)).cast("long").alias("bin")
    ).agg(F.count(F.lit(1)).alias("n_pos"))
    return neg_bins.join(pos_bins, "bin", "full").select(
        "bin", F.coalesce("n_pos", F.lit(0)).alias("n_pos"),
        F.coalesce("n_neg", F.lit(0)).alias("n_neg"),
    )


def pos_neg_overlap(a: DataFrame, b: DataFrame, bins: int = 100, limits=None) -> DataFrame:
    """Overlap of positive and negative densities, separation, and its ratio.

    Mean and spread of the negatives follow from Gram sums.
    """
    hist = pos_neg_histograms(a, b, bins, limits)
    totals = hist.agg(
        F.sum("n_pos").alias("p"), F.sum("n_neg").alias("n")
    ).first()
    overlap = hist.agg(
        F.sum(
            F.least(F.col("n_pos") / F.lit(totals["p"]), F.col("n_neg") / F.lit(totals["n"]))
        ).alias("overlap")
    )
    ga, gb = gram(a, "vec"), gram(b, "vec")
    pos = positive_pairs(a, b).agg(
        F.count(F.lit(1)).alias("n"), F.sum("cos").alias("s1"),
        F.sum(F.col("cos") * F.col("cos")).alias("s2"),
        F.avg("cos").alias("mean"), F.stddev_pop("cos").alias("std"),
    ).first()
    n = ga.n * gb.n - pos["n"]
    s1 = float(ga.sx @ gb.sx) - pos["s1"]
    s2 = float((ga.sxx * gb.sxx).sum()) - pos["s2"]
    neg_mean = s1 / n
    neg_std = float(np.sqrt(max(0.0, s2 / n - neg_mean**2)))
    sep = pos["mean"] - neg_mean
    return overlap.select(
        F.lit(pos["mean"]).alias("pos_mean"), F.lit(pos["std"]).alias("pos_std"),
        F.lit(neg_mean).alias("neg_mean"), F.lit(neg_std).alias("neg_std"),
        F.lit(sep).alias("separation"), F.lit(sep / (pos["std"] + neg_std)).alias("ratio"),
        "overlap",
    )


def margins(a: DataFrame, b: DataFrame, limits=None) -> DataFrame:
    """(id, pos, max_neg, mean_neg, min_neg, margin) per positive pair."""
    stats = score_stats(as_queries(a), as_gallery(b), PAIR, exclude="truth", limits=limits)
    pos = positive_pairs(a, b)
    joined = pos.join(stats.withColumnRenamed("qid", "id"), "id")
    return joined.select(
        "id", F.col("cos").alias("pos"), F.col("hi").alias("max_neg"),
        (F.col("s1") / F.col("n")).alias("mean_neg"), F.col("lo").alias("min_neg"),
        (F.col("cos") - F.col("hi")).alias("margin"),
    )


def margin_summary(m: DataFrame) -> DataFrame:
    median = exact_quantiles(m, "max_neg", [0.5])[None][0.5][0]
    return m.agg(
        F.avg("max_neg").alias("max_neg_mean"),
        F.lit(median).alias("max_neg_median"),
        F.avg("mean_neg").alias("mean_neg_mean"),
        F.avg("min_neg").alias("min_neg_mean"),
        F.avg("margin").alias("margin_mean"),
        F.avg((F.col("margin") >= 0).cast("int")).alias("share_ge_0"),
        F.avg((F.col("max_neg") > F.col("pos")).cast("int")).alias("hard_negative_ratio"),
    )


def temperature_sweep(queries, gallery, spaces, taus=(0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0), limits=None):
    """(tau, r1): recall under scores scaled by tau; the same for every tau > 0."""
    from .scoring import truth_ranks

    systems = tuple(System(f"{t:g}", (float(t),)) for t in taus)
    ranks = truth_ranks(queries, gallery, spaces, systems, limits=limits)
    return ranks.groupBy(F.col("system").cast("double").alias("tau")).agg(
        F.avg((F.col("rk") == 1).cast("int")).alias("r1")
    )


def centroid_spread(df: DataFrame, cols) -> DataFrame:
    """(modality, norm, mean_distance) of the centroid of each vector column."""
    out = None
    for c, mean in A.centroids(df, cols).items():
        centre = A.constant_vector(mean)
        part = df.select(V.norm(V.add(c, centre, 1.0, -1.0)).alias("_d")).agg(
            F.lit(c).alias("modality"), V.norm(centre).alias("norm"),
            F.avg("_d").alias("mean_distance"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def _frame(spark: SparkSession, rows, schema):
    return spark.createDataFrame(rows, schema)


def modality_gap(df: DataFrame, cols) -> DataFrame:
    """(a, b, euclidean, cosine, cosine_distance) of the unit centroids of each pair."""
    unit = {}
    for c, m in A.centroids(df, cols).items():
        length = np.linalg.norm(m)
        unit[c] = m / length if length > V.EPS else m
    rows = []
    for i, a in enumerate(cols):
        for b in cols[i + 1 :]:
            cos = float(unit[a] @ unit[b])
            rows.append((a, b, float(np.linalg.norm(unit[a] - unit[b])), cos, 1.0 - cos))
    return _frame(
        df.sparkSession, rows,
        "a string, b string, euclidean double, cosine double, cosine_distance double",
    )


def component_spread(df: DataFrame, cols) -> DataFrame:
    """(modality, spread): mean over components of their sample deviation."""
    out = None
    for c in cols:
        per = df.select(F.posexplode(c).alias("pos", "x")).groupBy("pos").agg(
            F.stddev_samp("x").alias("sd")
        )
        part = per.agg(F.lit(c).alias("modality"), F.avg("sd").alias("spread"))
        out = part if out is None else out.unionByName(part)
    return out


def gap_ratio(df: DataFrame, cols, reference=("audio", "caption")) -> DataFrame:
    """Modality gap divided by the mean spread of the reference modalities."""
    gaps = modality_gap(df, cols)
    spread = component_spread(df, list(reference)).agg(F.avg("spread").alias("s")).first()["s"]
    return gaps.select("a", "b", "euclidean", (F.col("euclidean") / F.lit(spread + 1e-8)).alias("gap_ratio"))


def _pair_moments(ga: Gram, gb: Gram):
    n = ga.n * gb.n
    return n, float(ga.sx @ gb.sx), float((ga.sxx * gb.sxx).sum())


def cross_vs_intra(df: DataFrame, cols_a: str, cols_b: str) -> DataFrame:
    """Mean and sample std of all pair cosines between and within two columns."""
    g = grams(df, [cols_a, cols_b])
    ga, gb = g[(cols_a, cols_a)], g[(cols_b, cols_b)]
    rows = []
    for name, x, y in (("cross", ga, gb), (f"intra_{cols_a}", ga, ga), (f"intra_{cols_b}", gb, gb)):
        n, s1, s2 = _pair_moments(x, y)
        rows.append((name, n, s1 / n, float(np.sqrt(max(0.0, (s2 - s1 * s1 / n) / (n - 1))))))
    return _frame(df.sparkSession, rows, "pairs string, n long, mean double, std double")


def anisotropy_of(g: Gram) -> tuple[float, float]:
    """Mean and population std of the off-diagonal cosines of n unit rows."""
    n = g.n * (g.n - 1)
    s1 = float(g.sx @ g.sx) - float(np.trace(g.sxx))
    # each self pair contributes |x|^4: 1 for a unit row, 0 for a zero row
    s2 = float((g.sxx * g.sxx).sum()) - float(np.trace(g.sxx))
    mean = s1 / n
    return mean, float(np.sqrt(max(0.0, s2 / n - mean * mean)))


def anisotropy(df: DataFrame, cols) -> DataFrame:
    g = grams(df, cols)
    rows = [(c, *anisotropy_of(g[(c, c)])) for c in cols]
    return _frame(df.sparkSession, rows, "modality string, mean_cos double, std_cos double")


def effective_dim_of(cov: np.ndarray) -> float:
    values = np.maximum(np.linalg.eigvalsh(cov), 0.0)
    total = values.sum()
    if total <= 1e-12:
        return 1.0
    p = values / total
    p = p[p > 0]
    return float(np.exp(-(p * np.log(p)).sum()))


def effective_dim(df: DataFrame, cols) -> DataFrame:
    g = grams(df, cols)
    rows = [(c, effective_dim_of(g[(c, c)].cov_x())) for c in cols]
    return _frame(df.sparkSession, rows, "modality string, effective_dim double")


def pca_explained_of(cov: np.ndarray, top: int = 10) -> list[float]:
    values = np.maximum(np.linalg.eigvalsh(cov), 0.0)[::-1]
    total = values.sum()
    if total <= 1e-12:
        return [0.0] * top
    return (np.cumsum(values) / total)[:top].tolist()


def pca_explained(df: DataFrame, cols, top: int = 10) -> DataFrame:
    g = grams(df, cols)
    rows = [
        (c, i + 1, float(x))
        for c in cols for i, x in enumerate(pca_explained_of(g[(c, c)].cov_x(), top))
    ]
    return _frame(df.sparkSession, rows, "modality string, component int, cumulative double")


def whitening_effect(df: DataFrame, cols, eps: float = 1e-4) -> DataFrame:
    """Mean cosine and effective dimension before and after ZCA whitening."""
    from .align import affine

    before = grams(df, cols)
    white = df.select(*cols)
    for c in cols:
        white = affine(white, c, fit_zca(before[(c, c)], eps), normalize_input=False)
    after = grams(white, cols)
    rows = []
    for c in cols:
        g, gw = before[(c, c)], after[(c, c)]
        rows.append(
            (c, anisotropy_of(g)[0], anisotropy_of(gw)[0],
             effective_dim_of(g.cov_x()), effective_dim_of(gw.cov_x()))
        )
    return _frame(
        df.sparkSession, rows,
        "modality string, cos_before double, cos_after double, dim_before double, dim_after double",
    )


# ---------------------------------------------------------------------- hubness


def k_occurrence(top: DataFrame, gallery: DataFrame) -> DataFrame:
    """(id, occ): how many top lists hold each gallery item, zero included."""
    counts = top.groupBy("id").agg(F.count(F.lit(1)).alias("occ"))
    return gallery.select("id").join(counts, "id", "left").select(
        "id", F.coalesce("occ", F.lit(0)).alias("occ")
    )


def skew(c) -> "F.Column":
    """Population skewness, 0 where there is no spread."""
    return F.when(F.stddev_pop(c) > 0, F.skewness(c)).otherwise(F.lit(0.0))


def occurrence_summary(occ: DataFrame) -> DataFrame:
    return occ.agg(
        F.count(F.lit(1)).alias("n"), F.avg("occ").alias("mean_occ"),
        F.max("occ").alias("max_occ"), skew("occ").alias("skewness"),
    )


def hub_threshold(occ: DataFrame) -> int:
    row = occ.agg(F.count(F.lit(1)).alias("n"), F.avg("occ").alias("m")).first()
    return max(10, int(row["n"] * 0.10 * row["m"]))


def hubs(occ: DataFrame, threshold: int | None = None) -> DataFrame:
    t = hub_threshold(occ) if threshold is None else threshold
    return occ.filter(F.col("occ") > t)


def top_hubs(occ: DataFrame, n: int = 10) -> DataFrame:
    return occ.orderBy(F.col("occ").desc(), "id").limit(n)


def skew_vs_k(top: DataFrame, gallery: DataFrame, ks=(1, 2, 5, 10, 20)) -> DataFrame:
    """(k, skewness): one top-max(k) list serves every k."""
    counts = top.groupBy("id").agg(
        *[F.count_if(F.col("rk") <= k).alias(f"k{k}") for k in ks]
    )
    all_ids = gallery.select("id").join(counts, "id", "left").na.fill(0)
    wide = all_ids.agg(*[skew(f"k{k}").alias(f"k{k}") for k in ks])
    points = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("skewness")) for k in ks])
    return wide.select(F.explode(points).alias("p")).select("p.*")


def hub_overlap(top1: DataFrame, queries: DataFrame, hub_ids: DataFrame) -> DataFrame:
    """Queries whose truth is a hub, whose top result is a hub, and both."""
    flag = hub_ids.select("id").distinct().withColumn("_hub", F.lit(True))
    q = queries.select("qid", "truth").join(
        top1.select("qid", F.col("id").alias("top1")), "qid", "left"
    )
    q = q.join(flag.select(F.col("id").alias("truth"), F.col("_hub").alias("gt")), "truth", "left")
    q = q.join(flag.select(F.col("id").alias("top1"), F.col("_hub").alias("t1")), "top1", "left")
    gt, t1 = F.coalesce("gt", F.lit(False)), F.coalesce("t1", F.lit(False))
    return q.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(gt).alias("gt_is_hub"),
        F.count_if(t1).alias("top1_is_hub"), F.count_if(gt & t1).alias("both"),
    )


def kth_neighbor_sim(store: DataFrame, k: int = 5, limits=None) -> DataFrame:
    """(id, sigma): similarity of the k-th nearest other row of the same store."""
    q = as_queries(store)
    top = score_top_k(q, as_gallery(store), k, PAIR, (ONE,), exclude="qid", limits=limits)
    return top.filter(F.col("rk") == k).select(F.col("qid").alias("id"), F.col("score").alias("sigma"))


def mutual_knn(a: DataFrame, b: DataFrame, k: int = 5, limits=None) -> DataFrame:
    """(qid, id, score, rk, mutual, adjusted) for the top-k edges a -> b.

    An edge is mutual if the query is also among the k best of the item; other
    edges are pushed down by 1000.
    """
    forward = score_top_k(as_queries(a), as_gallery(b), k, PAIR, (ONE,), limits=limits)
    back = score_top_k(as_queries(b), as_gallery(a), k, PAIR, (ONE,), limits=limits)
    return mutual_edges(forward, back)


def mutual_edges(forward: DataFrame, back: DataFrame) -> DataFrame:
    """The edges of ``mutual_knn`` from the top lists of both directions."""
    edges = back.select(F.col("id").alias("qid"), F.col("qid").alias("id"), F.lit(True).alias("_m"))
    joined = forward.select("qid", "id", "score", "rk").join(edges, ["qid", "id"], "left")
    mutual = F.coalesce("_m", F.lit(False))
    return joined.select(
        "qid", "id", "score", "rk", mutual.alias("mutual"),
        F.when(mutual, F.col("score")).otherwise(F.col("score") - 1e3).alias("adjusted"),
    )


def mutual_knn_ranks(ranks: DataFrame, edges: DataFrame) -> DataFrame:
    """Truth ranks after the mutual filter: mutual edges first, in score order.

    ``ranks`` are the plain truth ranks (qid, truth, rk, s_truth).
    """
    m = edges.filter("mutual")
    own = m.select("qid", F.col("id").alias("truth"), F.lit(True).alias("_own"))
    per_q = m.join(ranks.select("qid", "truth", F.col("rk").alias("_rk")), "qid").groupBy("qid").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("rk") < F.col("_rk")).alias("_ahead"),
    )
    joined = ranks.join(own, ["qid", "truth"], "left").join(per_q, "qid", "left").na.fill(
        0, ["_n", "_ahead"]
    )
    new = F.when(F.col("_own"), F.col("_ahead") + 1).otherwise(
        F.col("rk") + F.col("_n") - F.col("_ahead")
    )
    return joined.withColumn("rk", new).drop("_own", "_n", "_ahead")


def noisy_pairs(
    a: DataFrame, b: DataFrame, items: DataFrame, q: float = 0.10, limits=None
) -> DataFrame:
    """Pairs at or below the q-quantile of the positive cosine, with the hardest
    other cosine, the category and the first 80 characters of the description."""
    m = materialize(margins(a, b, limits), "margins")
    cut = exact_quantiles(m, "pos", [q])[None][q][0]
    low = m.filter(F.col("pos") <= F.lit(cut)).select("id", "pos", "max_neg")
    return low.join(
        items.select("id", "category", F.substring("text", 1, 80).alias("description")), "id", "left"
    )
