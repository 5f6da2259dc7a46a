"""Ranking losses as aggregates over scores; also the objectives of the fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import materialize
from . import sieve
from .blocks import CLIP_CLAP, block_join
from .fusion import WEIGHTS, soft_oracle, truth_similarities
from .scoring import (
    EQUAL,
    _fields,
    _gallery_columns,
    _query_columns,
    _tile,
    _truth,
    exp_sums,
    exp_sums_of,
    score_pairs,
    score_top_k,
    truth_scores,
    vectors_of,
)
from .sampling import id_position, random_negatives


def softmax_ce(queries, gallery, tau=1.0, spaces=CLIP_CLAP, systems=(EQUAL,), limits=None) -> DataFrame:
    """(system, loss): cross entropy of softmax(scores / tau) at the truth.

    CE, ListNet, ListMLE (top one), MNRL and InfoNCE are this formula with
    their own temperature.
    """
    sums = exp_sums(queries, gallery, tau, spaces, systems, limits=limits)
    return sums.groupBy("system").agg(F.avg(F.ln("e_all")).alias("loss"))


def softmax_ces(queries, gallery, taus, spaces=CLIP_CLAP, systems=(EQUAL,), limits=None) -> dict:
    """tau -> (system, loss) as in ``softmax_ce``; one pass over the pairs serves all temperatures."""
    means = [F.avg(F.ln(f"e_{j}")).alias(f"l_{j}") for j in range(len(taus))]
    table = exp_sums_of(queries, gallery, taus, spaces, systems, limits=limits).groupBy("system").agg(*means)
    table = materialize(table, "softmax")
    return {t: table.select("system", F.col(f"l_{j}").alias("loss")) for j, t in enumerate(taus)}


# Default temperature of each named form.
SOFTMAX_TAUS = {"ce": 1.0, "listnet": 0.1, "listmle": 0.1, "mnrl": 0.07, "info_nce": 0.07}


def _with_truth_score(negatives, queries, gallery, spaces, systems):
    return negatives.join(truth_scores(queries, gallery, spaces, systems), ["system", "qid"])


def margin_hard(queries, gallery, margin=0.2, k=10, spaces=CLIP_CLAP, systems=(EQUAL,), limits=None):
    """(system, loss): mean max(0, margin - (s+ - s-)) over the k hardest negatives."""
    neg = score_top_k(queries, gallery, k, spaces, systems, exclude="truth", limits=limits)
    gap = F.col("s_truth") - F.col("score")
    return _with_truth_score(neg, queries, gallery, spaces, systems).groupBy("system").agg(
        F.avg(F.greatest(F.lit(0.0), F.lit(margin) - gap)).alias("loss")
    )


def margin_random(queries, gallery, margin=0.2, k=10, seed=42, spaces=CLIP_CLAP, weights=(1 / 3,) * 3):
    """(loss): the same over k seeded random negatives of each query itself."""
    pairs = random_negatives(queries, gallery, k, seed)
    scored = score_pairs(pairs, queries, gallery, spaces)
    truth = truth_similarities(queries, gallery, spaces)
    fuse = lambda p: sum(F.lit(w) * F.col(f"{p}_{s.name}") for w, s in zip(weights, spaces))
    joined = scored.join(truth.select("qid", *[f"t_{s.name}" for s in spaces]), "qid")
    return joined.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.greatest(F.lit(0.0), F.lit(margin) - (fuse("t") - fuse("sim")))).alias("loss"),
    )


class ApproxNdcg:
    """Weighted sigmoid of (s- - s+)/tau; weight 1/log2(j+1) by gallery place j."""

    def __init__(self, spaces, system, tau):
        self.spaces, self.system, self.tau = spaces, system, tau

    def start(self, q):
        truth, gaps = _truth(self.spaces, q)
        return {"truth": self.system.fuse(q, truth, gaps), "num": np.zeros(q["_n"]), "den": np.zeros(q["_n"])}

    def update(self, state, q, g):
        if g["_n"] < sieve.MANY or not np.isfinite(state["truth"]).all() or any(f"_null_{s.g}" in g for s in self.spaces):
            return self._all_pairs(state, q, g)
        if "_ordered" not in g:
            order = np.argsort(g["place"], kind="stable")
            g["_ordered"] = {n: v[order] for n, v in g.items() if isinstance(v, np.ndarray)} | {"_n": g["_n"]}
        scores = sieve.Dense.of([self.system], self.spaces, q, g["_ordered"])
        if scores is None or (scores.reach()[0] + np.abs(state["truth"])).max() > 80 * self.tau:
            return self._all_pairs(state, q, g)
        return self._dense(state, q, g["_ordered"], scores)

    def _dense(self, state, q, g, scores):
        """In single precision, by the order of places: a weight belongs to a place before the truth or after it."""
        own, place = q["truth_place"], g["place"]
        late, early = 1.0 / np.log2(np.maximum(place, 1) + 1.0), 1.0 / np.log2(place + 2.0)
        before, after = (np.searchsorted(place, own, side=side) for side in ("left", "right"))
        of_early, of_late = (np.concatenate([[0.0], np.cumsum(w)]) for w in (early, late))
        state["den"] += of_early[before] + of_late[-1] - of_late[after]
        late, early = late.astype(np.float32), early.astype(np.float32)
        truth = (state["truth"] / self.tau).astype(np.float32)[None, :]
        shape = (min(sieve.STEP, scores.n), scores.width)
        kept = np.empty(shape, np.float32)
        for _, at, score in scores.tiles():
            m = len(score)
            x = kept[:m]
            np.subtract(truth, sieve.times(score, scores.scales[0] / self.tau, x), out=x)
            np.exp(x, out=x)
            x += np.float32(1)
            np.reciprocal(x, out=x)
            w_early, w_late = early[at : at + m], late[at : at + m]
            lo, hi = before - at, after - at  # rows [lo, hi) hold the truth itself
            if (lo >= m).any():
                state["num"] += np.where(lo >= m, w_early @ x, 0.0)
            if (hi <= 0).any():
                state["num"] += np.where(hi <= 0, w_late @ x, 0.0)
            for k in np.flatnonzero((hi > 0) & (lo < m)):
                a, b = max(lo[k], 0), min(hi[k], m)
                state["num"][k] += w_early[:a] @ x[:a, k] + w_late[b:] @ x[b:, k]
        return state

    def _all_pairs(self, state, q, g):
        sims, gaps = _tile(self.spaces, q, g)
        with np.errstate(invalid="ignore"):
            diff = (state["truth"][:, None] - self.system.fuse(q, sims, gaps)) / self.tau
        diff = np.where(np.isnan(diff), 0.0, diff)  # neither competes: a tie
        place = np.broadcast_to(g["place"][None, :], diff.shape)
        own = q["truth_place"][:, None]
        j = np.where(place < own, place + 1, place)  # 1-based among the negatives
        w = np.where(place == own, 0.0, 1.0 / np.log2(np.maximum(j, 1) + 1.0))
        state["num"] += (w / (1.0 + np.exp(np.clip(diff, -500, 500)))).sum(axis=1)
        state["den"] += w.sum(axis=1)
        return state

    def finish(self, state, q):
        return {"qid": q["qid"], "num": state["num"], "den": state["den"]}


def approx_ndcg(queries, gallery, tau=0.1, spaces=CLIP_CLAP, system=EQUAL, limits=None) -> DataFrame:
    """(loss) smooth NDCG surrogate; places are gallery positions in id order."""
    placed = id_position(gallery, "id", "place")
    q = _query_columns(queries, spaces, (system,), ["truth"])
    q = q.join(placed.select(F.col("id").alias("truth"), F.col("place").alias("truth_place")), "truth")
    g = _gallery_columns(placed, spaces, ["place"])
    schema = StructType(
        _fields(q, ["qid"]) + [StructField("num", DoubleType()), StructField("den", DoubleType())]
    )
    partial = block_join(
        q, g, ApproxNdcg(spaces, system, tau), schema, q_key=["qid"], g_key=["id"],
        truth=vectors_of(spaces), limits=limits,
    )
    per_q = partial.groupBy("qid").agg((F.sum("num") / F.sum("den")).alias("l"))
    return per_q.agg(F.avg("l").alias("loss"))


def listnet_hybrid(queries, gallery, tau=0.1, alpha=0.5, spaces=CLIP_CLAP, systems=(EQUAL,), limits=None):
    """(system, loss): alpha * ListNet + (1 - alpha) * margin(0.1, ten hardest)."""
    a = softmax_ce(queries, gallery, tau, spaces, systems, limits)
    b = margin_hard(queries, gallery, 0.1, 10, spaces, systems, limits)
    joined = a.withColumnRenamed("loss", "a").join(b.withColumnRenamed("loss", "b"), "system")
    return joined.select("system", (F.col("a") * alpha + F.col("b") * (1 - alpha)).alias("loss"))


def distillation(queries, gallery, tau: float = 0.5, spaces=CLIP_CLAP) -> DataFrame:
    """(kl, mse, ce) between the queries' weights and their soft-oracle weights.

    As published: the student side of KL is log_softmax of the weights, and CE
    takes the oracle's largest modality as the class.
    """
    mine = queries.select("qid", *[F.col(w).alias(f"m_{w}") for w in WEIGHTS])
    oracle = soft_oracle(queries.drop(*WEIGHTS), gallery, tau, spaces).select("qid", *WEIGHTS)
    j = mine.join(oracle, "qid")
    m = [F.col(f"m_{w}") for w in WEIGHTS]
    o = [F.greatest(F.col(w), F.lit(1e-7)) for w in WEIGHTS]
    lse = F.ln(sum(F.exp(x) for x in m))
    logp = [x - lse for x in m]
    kl = sum(t * (F.ln(t) - lp) for t, lp in zip(o, logp))
    mse = sum((x - F.col(w)) * (x - F.col(w)) for x, w in zip(m, WEIGHTS)) / 3.0
    first = F.when((o[0] >= o[1]) & (o[0] >= o[2]), -logp[0]).when(o[1] >= o[2], -logp[1]).otherwise(-logp[2])
    return j.agg(F.avg(kl).alias("kl"), F.avg(mse).alias("mse"), F.avg(first).alias("ce"))


def weight_regulariser(queries: DataFrame, target, reg: float) -> DataFrame:
    """(loss): reg * MSE of the mean weights against target weights."""
    means = queries.agg(*[F.avg(w).alias(w) for w in WEIGHTS])
    mse = sum((F.col(w) - F.lit(float(t))) * (F.col(w) - F.lit(float(t))) for w, t in zip(WEIGHTS, target))
    return means.select((F.lit(reg) * mse / 3.0).alias("loss"))


def symmetric_info_nce(a: DataFrame, b: DataFrame, tau: float = 0.07, limits=None) -> DataFrame:
    """(loss): mean InfoNCE of both directions between two (id, vec) stores."""
    from .geometry import ONE, PAIR, as_gallery, as_queries

    forth = softmax_ce(as_queries(a), as_gallery(b), tau, PAIR, (ONE,), limits)
    back = softmax_ce(as_queries(b), as_gallery(a), tau, PAIR, (ONE,), limits)
    return forth.unionByName(back).agg(F.avg("loss").alias("loss"))


def info_nce_hard(a: DataFrame, b: DataFrame, scale: float = 20.0, margin: float = 0.3, k: int = 20, limits=None):
    """(main, hinge, loss): InfoNCE plus a hinge on the k hardest negatives, on
    scores multiplied by ``scale``."""
    from .blocks import Space, System
    from .geometry import as_gallery, as_queries

    spaces, systems = (Space("s", "q", "g", scale=scale),), (System("s", (1,)),)
    q, g = as_queries(a), as_gallery(b)
    main = softmax_ce(q, g, 1.0, spaces, systems, limits)
    neg = score_top_k(q, g, k, spaces, systems, exclude="truth", limits=limits)
    hinge = _with_truth_score(neg, q, g, spaces, systems).groupBy("system").agg(
        F.avg(F.greatest(F.lit(0.0), F.lit(margin) + F.col("score") - F.col("s_truth"))).alias("hinge")
    )
    return main.withColumnRenamed("loss", "main").join(hinge, "system").select(
        "main", "hinge", (F.col("main") + F.col("hinge")).alias("loss")
    )


def multi_positive(queries, gallery, tau=0.05, same="category", spaces=CLIP_CLAP, systems=(EQUAL,), limits=None):
    """(system, loss): -ln(sum over positives / sum over all) of exp(score / tau)."""
    sums = exp_sums(queries, gallery, tau, spaces, systems, same=same, limits=limits)
    return sums.groupBy("system").agg(F.avg(-F.ln(F.col("e_pos") / F.col("e_all"))).alias("loss"))
