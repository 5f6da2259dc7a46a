"""Learned gates: scoring of trained ones, and small fits as repeated aggregates."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import vectors as V
from ..session import materialize
from . import sieve
from .blocks import CLIP_CLAP, SLACK, System, block_join
from .fusion import WEIGHTS, truth_similarities, with_softmax_weights
from .scoring import _fields, _gallery_columns, _tile, score_top_k

# erf on a grid; cubic Hermite steps of 1/512 keep the error below 1e-13.
_STEP = 1.0 / 512
_GRID = np.arange(-6.0, 6.0 + 2 * _STEP, _STEP)
_ERF = np.array([math.erf(x) for x in _GRID])


def _cells() -> np.ndarray:
    """Coefficients of the cubic of every step, from the constant on."""
    y, d = _ERF, 2.0 / math.sqrt(math.pi) * _STEP * np.exp(-(_GRID**2))
    y0, y1, d0, d1 = y[:-1], y[1:], d[:-1], d[1:]
    return np.stack([y0, d0, 3 * (y1 - y0) - 2 * d0 - d1, 2 * (y0 - y1) + d0 + d1])


_CELLS = _cells()
_AT_ONCE = 16_384  # numbers whose cubics stay in a core's cache


def erf(x: np.ndarray) -> np.ndarray:
    flat = np.ascontiguousarray(x, dtype=np.float64).reshape(-1)
    out = np.empty_like(flat)
    for lo in range(0, len(flat), _AT_ONCE):
        t = np.clip(flat[lo : lo + _AT_ONCE], -6.0, 6.0)
        t += 6.0
        t *= 1.0 / _STEP
        i = t.astype(np.int32)
        t -= i
        y = _CELLS[3].take(i)
        for c in (2, 1, 0):
            y *= t
            y += _CELLS[c].take(i)
        out[lo : lo + _AT_ONCE] = y
    return out.reshape(np.shape(x))


def gelu(x):
    return 0.5 * x * (1.0 + erf(x / math.sqrt(2.0)))


def layer_norm(x, weight, bias, eps=1e-5):
    mean = x.mean(axis=-1, keepdims=True)
    var = x.var(axis=-1, keepdims=True)
    return (x - mean) / np.sqrt(var + eps) * weight + bias


def linear(x, weight, bias):
    return x @ weight.T + bias


def softmax(x):
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


# Temperature and scale buffers that a checkpoint may hold besides its parameters.
BUFFERS = 64

# Parameter names and shapes of the query gate (d: input, h: hidden width).
def gate_shapes(d: int = 512, h: int = 128) -> dict[str, tuple[int, ...]]:
    return {
        "layer_norm_in.weight": (d,), "layer_norm_in.bias": (d,),
        "fc1.weight": (h, d), "fc1.bias": (h,),
        "ln1.weight": (h,), "ln1.bias": (h,),
        "fc2.weight": (h // 2, h), "fc2.bias": (h // 2,),
        "ln2.weight": (h // 2,), "ln2.bias": (h // 2,),
        "fc3.weight": (3, h // 2), "fc3.bias": (3,),
    }


def candidate_gate_shapes(d: int = 512, h: int = 64) -> dict[str, tuple[int, ...]]:
    return {
        "query_fc.weight": (h, d), "query_fc.bias": (h,),
        "query_ln.weight": (h,), "query_ln.bias": (h,),
        "sim_ln.weight": (3,), "sim_ln.bias": (3,),
        "sim_fc1.weight": (h, 3), "sim_fc1.bias": (h,),
        "sim_ln1.weight": (h,), "sim_ln1.bias": (h,),
        "sim_fc2.weight": (h // 2, h), "sim_fc2.bias": (h // 2,),
        "sim_ln2.weight": (h // 2,), "sim_ln2.bias": (h // 2,),
        "fusion_fc.weight": (3, h + h // 2), "fusion_fc.bias": (3,),
    }


def seeded_parameters(shapes, seed: int = 0) -> dict[str, np.ndarray]:
    """Xavier-uniform weights, unit norms and zero biases, as a fresh gate has."""
    rng = np.random.default_rng(seed)
    out = {}
    for name, shape in shapes.items():
        if len(shape) == 2:
            bound = math.sqrt(6.0 / sum(shape))
            out[name] = rng.uniform(-bound, bound, shape)
        else:
            out[name] = np.zeros(shape) if name.endswith("bias") else np.ones(shape)
    return out


def save_gate(spark: SparkSession, params: dict, path: str) -> None:
    rows = [(k, list(v.shape), [float(x) for x in v.reshape(-1)]) for k, v in params.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, value array<double>").write.mode(
        "overwrite"
    ).parquet(path)


def load_gate(spark: SparkSession, path: str, shapes: dict) -> dict[str, np.ndarray]:
    """Read gate parameters; a missing, extra or misshapen one is an error.

    Temperature and scale buffers of newer checkpoints are accepted.
    """
    stored, most = spark.read.parquet(path), len(shapes) + BUFFERS
    count = stored.count()
    if count > most:
        raise RuntimeError(f"gate does not match: {count} parameters stored, at most {most} expected")
    rows = stored.collect()
    found = {r["name"]: np.array(r["value"]).reshape(r["shape"]) for r in rows}
    extra = {n for n in set(found) - set(shapes) if not n.startswith(("tau_", "scale_", "log_"))}
    missing = set(shapes) - set(found)
    if missing or extra:
        raise RuntimeError(f"gate does not match: missing={sorted(missing)} extra={sorted(extra)}")
    for name, shape in shapes.items():
        if tuple(found[name].shape) != tuple(shape):
            raise RuntimeError(f"gate does not match: {name} has shape {found[name].shape}")
    return {n: found[n] for n in shapes}


def gate_forward(p: dict, x: np.ndarray) -> np.ndarray:
    """Weights [n, 3] of the query gate (dropout is off when scoring)."""
    x = layer_norm(x, p["layer_norm_in.weight"], p["layer_norm_in.bias"])
    h = layer_norm(gelu(linear(x, p["fc1.weight"], p["fc1.bias"])), p["ln1.weight"], p["ln1.bias"])
    h = layer_norm(gelu(linear(h, p["fc2.weight"], p["fc2.bias"])), p["ln2.weight"], p["ln2.bias"])
    return softmax(linear(h, p["fc3.weight"], p["fc3.bias"]))


def gate_mlp(queries: DataFrame, params: dict, col: str = "q_clip") -> DataFrame:
    """Add w_v, w_t, w_a from the query gate; NULL where the vector is NULL."""
    shared = queries.sparkSession.sparkContext.broadcast(params)

    @F.pandas_udf("struct<w_v:double,w_t:double,w_a:double>")
    def run(v: pd.Series) -> pd.DataFrame:
        out = np.full((len(v), 3), np.nan)
        there = v.notna().to_numpy()
        if there.any():
            out[there] = gate_forward(shared.value, np.stack(v[there].to_list()))
        return pd.DataFrame(out, columns=list(WEIGHTS))

    rest = [c for c in queries.columns if c not in WEIGHTS]
    scored = queries.withColumn("_w", run(F.col(col)))
    return scored.select(
        *rest, *[F.when(F.col(col).isNotNull(), F.col(f"_w.{w}")).alias(w) for w in WEIGHTS]
    )


@dataclass(frozen=True)
class CandidateGate(System):
    """A fused score whose weights depend on the query and the candidate's scores."""

    params: dict = None
    query_col: str = "q_clip"
    min_weight: float = 0.0
    pairs_at_once: int = 65_536
    sums = False

    def columns(self):
        return [self.query_col]

    def bars(self, spaces, q, sims, truth):
        """The weights of a pair add up to one, so a score that reaches the truth's has a part that does."""
        out = np.repeat((truth - 4 * SLACK)[None, :], len(spaces), axis=0)
        for i, space in enumerate(spaces):  # without a vector all rows score zero
            out[i, ~space._asks(q)] = np.inf
        nothing = np.logical_or.reduce([~space._asks(q) for space in spaces]) & (truth <= 4 * SLACK)
        out[0, nothing | ~np.isfinite(truth)] = -np.inf
        return out

    def most(self, sims, slips):
        """The highest fused score that pairs with these scores, up to their errors, can have.

        The weights add up to one and none is below its share of ``min_weight``; the rest may lie on the best score.
        """
        least = self.min_weight / (1.0 + (len(sims) - 1) * self.min_weight) * (1.0 - 1e-9)
        high = [s + e for s, e in zip(sims, slips)]
        return least * sum(high) + (1.0 - len(sims) * least) * np.maximum.reduce(high)

    def pair_columns(self, q, rows):
        """What ``fuse`` needs of the queries of pairs: their part of the logits, made once per query."""
        kept = f"_logits_{self.name}"
        if kept not in q:
            q[kept] = self.query_logits(q[self.query_col])
        return {"_logits": q[kept][rows]}

    def query_logits(self, q: np.ndarray) -> np.ndarray:
        """[n, 3]: what the query adds to the logits of all its candidates."""
        p = self.params
        feat = layer_norm(linear(q, p["query_fc.weight"], p["query_fc.bias"]),
                          p["query_ln.weight"], p["query_ln.bias"])
        feat = gelu(feat)
        return feat @ p["fusion_fc.weight"][:, : feat.shape[1]].T + p["fusion_fc.bias"]

    def candidate_weights(self, q: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """[n, m, 3] weights for queries [n, d] and scores [n, m, 3]."""
        return self._weights(self.query_logits(q), sims)

    def _weights(self, of_query: np.ndarray, sims: np.ndarray) -> np.ndarray:
        p = self.params
        x = layer_norm(sims, p["sim_ln.weight"], p["sim_ln.bias"])
        h = gelu(layer_norm(linear(x, p["sim_fc1.weight"], p["sim_fc1.bias"]),
                            p["sim_ln1.weight"], p["sim_ln1.bias"]))
        h = gelu(layer_norm(linear(h, p["sim_fc2.weight"], p["sim_fc2.bias"]),
                            p["sim_ln2.weight"], p["sim_ln2.bias"]))
        wide = len(p["query_fc.weight"])
        logits = h @ p["fusion_fc.weight"][:, wide:].T + of_query[:, None, :]
        w = softmax(logits)
        if self.min_weight > 0:
            w = np.maximum(w, self.min_weight)
            w = w / w.sum(axis=-1, keepdims=True)
        return w

    def fuse(self, q, sims, gaps=()):
        """Weighted sum of the scores with weights of the pair's own.

        All scores of a pair feed the gate and a softmax weight is never zero,
        so a gallery row without a vector that the query asks for in any space
        does not compete: its score is -inf.
        """
        paired = sims[0].ndim == 1
        stack = np.stack(sims, axis=-1)
        if paired:
            stack = stack[:, None, :]
        out = np.empty(stack.shape[:2])
        of_query = q["_logits"] if "_logits" in q else self.query_logits(q[self.query_col])
        step = max(1, self.pairs_at_once // max(1, stack.shape[1]))
        for lo in range(0, len(stack), step):
            part = stack[lo : lo + step]
            w = self._weights(of_query[lo : lo + step], part)
            out[lo : lo + step] = (w * part).sum(axis=-1)
        out = out[:, 0] if paired else out
        for gap in gaps:
            if gap is not None:
                out = np.where(gap, -np.inf, out)
        return out


# ------------------------------------------------------------------ small fits


def negatives_table(queries, gallery, k: int = 10, spaces=CLIP_CLAP, name="negatives") -> DataFrame:
    """(qid, d_v, d_t, d_a): truth minus hard negative score, per modality.

    Hard negatives are the top-k rows under equal fusion that are not the truth.
    Written once; every optimiser step is one aggregate over it.
    """
    neg = score_top_k(queries, gallery, k, spaces, exclude="truth")
    truth = truth_similarities(queries, gallery, spaces)
    joined = neg.join(truth.select("qid", *[f"t_{s.name}" for s in spaces]), "qid")
    table = joined.select(
        "qid", *[(F.col(f"t_{s.name}") - F.col(f"sim_{s.name}")).alias(f"d_{s.name}") for s in spaces]
    )
    return materialize(table, name)


def _softmax3(z):
    e = np.exp(z - z.max())
    return e / e.sum()


def fit_constant_gate(
    negatives: DataFrame,
    margin: float = 0.2,
    loss: str = "pairwise_margin",
    tau: float = 0.07,
    init=(1 / 3, 1 / 3, 1 / 3),
    reg: float = 0.0,
    target=None,
    lr: float = 1.0,
    steps: int = 20,
) -> dict:
    """Three logits by gradient steps; each step is one aggregate of six numbers."""
    z = np.log(np.array(init, dtype=float) + 1e-7)
    target = None if target is None else np.array(target, dtype=float)
    d = [F.col(c) for c in ("d_v", "d_t", "d_a")]
    history = []
    for _ in range(steps):
        w = _softmax3(z)
        gap = sum(F.lit(float(wi)) * di for wi, di in zip(w, d))
        if loss == "pairwise_margin":
            value = F.greatest(F.lit(0.0), F.lit(margin) - gap)
            slope = F.when(gap < margin, F.lit(-1.0)).otherwise(F.lit(0.0))
        elif loss == "mnrl":
            # softplus form of the softmax loss over each hard negative
            value = F.log1p(F.exp(-gap / tau))
            slope = -1.0 / (F.lit(tau) * (1.0 + F.exp(gap / tau)))
        else:
            raise ValueError(f"unknown loss {loss!r}")
        row = negatives.agg(
            F.avg(value).alias("loss"), *[F.avg(slope * di).alias(f"g{i}") for i, di in enumerate(d)]
        ).first()
        total = row["loss"]
        grad_w = np.array([row["g0"], row["g1"], row["g2"]])
        if reg and target is not None:
            total += reg * float(((w - target) ** 2).mean())
            grad_w = grad_w + reg * 2.0 * (w - target) / 3.0
        history.append(total)
        z = z - lr * (w * (grad_w - float(w @ grad_w)))
    return {"logits": z, "weights": _softmax3(z), "history": history}


class SoftmaxMoments:
    """Per query: sum of e^s and of e^s * sim per modality, for the fused score s."""

    def __init__(self, spaces, system):
        self.spaces, self.system = spaces, system

    def start(self, q):
        return np.zeros((4, q["_n"]))

    def update(self, state, q, g):
        sims, gaps = _tile(self.spaces, q, g)
        e = np.exp(self.system.fuse(q, sims, gaps))
        state[0] += e.sum(axis=1)
        for i, s in enumerate(sims):
            state[i + 1] += (e * s).sum(axis=1)
        return state

    def finish(self, state, q):
        return {"qid": q["qid"], "z": state[0], "z_v": state[1], "z_t": state[2], "z_a": state[3]}


def softmax_moments(queries, gallery, spaces=CLIP_CLAP, limits=None) -> DataFrame:
    names = list(dict.fromkeys(["qid", *[s.q for s in spaces], *WEIGHTS]))
    q = queries.select(*names)
    g = _gallery_columns(gallery, spaces)
    schema = StructType(
        _fields(q, ["qid"]) + [StructField(n, DoubleType()) for n in ("z", "z_v", "z_t", "z_a")]
    )
    partial = block_join(
        q, g, SoftmaxMoments(spaces, System("gated", WEIGHTS)), schema,
        q_key=["qid"], g_key=["id"], limits=limits,
    )
    return partial.groupBy("qid").agg(*[F.sum(c).alias(c) for c in ("z", "z_v", "z_t", "z_a")])


#: Powers of the two free weights in the expansion of a query's sum, lowest degree first; the third weight is one minus both.
DEGREE = 4
TERMS = [(n - j, j) for n in range(DEGREE + 1) for j in range(n + 1)]
Z_TERMS = [f"z{i}{j}" for i, j in TERMS]
#: Relative error of a sum from which a new expansion is made.
EXPANSION_ERROR = 1e-8
#: Rows and columns of a tile that stays in a core's cache.
EXPANSION_ROWS, EXPANSION_COLUMNS = 128, 512


def _cubic_rest(degree: int = 6) -> np.ndarray:
    """Coefficients of (e^s - 1 - s - s^2/2) / s^3 between -1 and 1, to 1e-8."""
    series = lambda s: sum(s**k / math.factorial(k + 3) for k in range(20))
    fit = np.polynomial.chebyshev.chebinterpolate(series, degree)
    return np.polynomial.chebyshev.cheb2poly(fit).astype(np.float32)


_REST = _cubic_rest()


class WeightExpansion:
    """Per query: the sum of e^s over the gallery as a polynomial in its weights, around those in WEIGHTS.

    s = w_v s_v + w_t s_t + w_a s_a with weights that add up to one, so with u = (s_v - s_a, s_t - s_a)
    and a step d of the first two weights the sum is that of e^s (d.u)^n / n!. Of e^s the part
    1 + s + s^2/2 is summed in double precision by sums and Gram matrices, without pairs; what is left
    (s^3/6 and beyond, e^s from the third power of u on) is small and goes through all pairs in single precision.
    For plain cosine spaces and vectors up to length one.
    """

    def __init__(self, spaces):
        self.spaces = spaces

    def start(self, q):
        return np.zeros((len(TERMS), q["_n"]))

    def update(self, state, q, g):
        self._low(state, q, g)
        self._rest(state, q, g)
        return state

    def _low(self, state, q, g):
        if "_sums" not in g:
            names = [s.g for s in self.spaces]
            g["_sums"] = [g[n].sum(axis=0) for n in names], [[g[n].T @ g[m] for m in names] for n in names]
        sums, grams = g["_sums"]
        a = [q[s.q] for s in self.spaces]
        w = [q[n] for n in WEIGHTS]
        one = [x @ m for x, m in zip(a, sums)]
        two = [[np.einsum("ij,ij->i", x @ grams[i][j], y) for j, y in enumerate(a)] for i, x in enumerate(a)]
        by_w = [sum(t * x for t, x in zip(row, w)) for row in two]
        state[0] += g["_n"] + sum(x * (m + b / 2) for x, m, b in zip(w, one, by_w))
        for k, i in ((1, 0), (2, 1)):
            state[k] += one[i] - one[2] + by_w[i] - by_w[2]
        for k, i, j in ((3, 0, 0), (4, 0, 1), (5, 1, 1)):
            state[k] += two[i][j] - two[i][2] - two[2][j] + two[2][2]

    def _rest(self, state, q, g):
        left = [sieve.single(q, s.q)[0] for s in self.spaces]
        right = [sieve.single(g, s.g)[0] for s in self.spaces]
        w = [q[n].astype(np.float32)[:, None] for n in WEIGHTS[:2]]
        shape = min(EXPANSION_ROWS, q["_n"]), min(EXPANSION_COLUMNS, g["_n"])
        kept = [np.empty(shape, np.float32) for _ in range(10)]
        for lo in range(0, q["_n"], EXPANSION_ROWS):
            rows = slice(lo, lo + EXPANSION_ROWS)
            for at in range(0, g["_n"], EXPANSION_COLUMNS):
                tile = [(x[rows], y[at : at + EXPANSION_COLUMNS]) for x, y in zip(left, right)]
                u, v, s, half, rest, e_u, e_v, uu, uv, vv = (k[: len(tile[0][0]), : len(tile[0][1])] for k in kept)
                for to, (x, y) in zip((u, v, s), tile):
                    np.matmul(x, y.T, out=to)
                u -= s
                v -= s
                s += np.multiply(w[0][rows], u, out=half)
                s += np.multiply(w[1][rows], v, out=half)
                np.multiply(s, s, out=half)
                np.multiply(s, _REST[-1], out=rest)
                for c in _REST[-2:0:-1]:
                    rest += c
                    rest *= s
                rest += _REST[0]
                rest *= half
                rest *= s  # e^s less its terms to the second power, then to the first, to the constant, none
                half *= 0.5
                out = [rest.sum(axis=1)]
                rest += half
                out += [np.vecdot(rest, u), np.vecdot(rest, v)]
                rest += s
                np.multiply(rest, u, out=e_u)
                np.multiply(rest, v, out=e_v)
                out += [np.vecdot(e_u, u), np.vecdot(e_u, v), np.vecdot(e_v, v)]
                rest += 1
                np.multiply(u, u, out=uu)
                np.multiply(u, v, out=uv)
                np.multiply(v, v, out=vv)
                np.multiply(rest, uu, out=e_u)
                np.multiply(rest, vv, out=e_v)
                out += [np.vecdot(e_u, u), np.vecdot(e_u, v), np.vecdot(e_v, u), np.vecdot(e_v, v)]
                out += [np.vecdot(e_u, uu), np.vecdot(e_u, uv), np.vecdot(e_u, vv), np.vecdot(e_v, uv), np.vecdot(e_v, vv)]
                state[:, rows] += out

    def finish(self, state, q):
        return {"qid": q["qid"]} | dict(zip(Z_TERMS, state))


def weight_expansion(queries, gallery, spaces=CLIP_CLAP, limits=None) -> DataFrame:
    """(qid, z00, z10, ...): ``WeightExpansion`` of each query, in one pass over all pairs."""
    q = queries.select(*dict.fromkeys(["qid", *[s.q for s in spaces], *WEIGHTS]))
    schema = StructType(_fields(q, ["qid"]) + [StructField(n, DoubleType()) for n in Z_TERMS])
    g = _gallery_columns(gallery, spaces)
    partial = block_join(q, g, WeightExpansion(spaces), schema, q_key=["qid"], g_key=["id"], limits=limits)
    return partial.groupBy("qid").agg(*[F.sum(c).alias(c) for c in Z_TERMS])


def can_expand(queries, gallery, spaces=CLIP_CLAP) -> bool:
    """Plain cosine spaces, vectors all there and no longer than one?"""
    if len(spaces) != 3 or any((s.metric, s.tau, s.scale, s.factor) != ("cosine", 1.0, 1.0, None) for s in spaces):
        return False
    for df, names in ((queries, {s.q for s in spaces}), (gallery, {s.g for s in spaces})):
        names = sorted(names)
        longest = df.agg(*[F.max(F.coalesce(V.norm(n), F.lit(math.inf))).alias(n) for n in names]).first()
        if not all(longest[n] is not None and longest[n] <= 1 + 1e-6 for n in names):
            return False
    return True


_SLOPES = [f"b{j}" for j in range(3)] + [f"w{i}{j}" for i in range(3) for j in range(3)]


def _expanded_step(table: DataFrame, w: np.ndarray, b: np.ndarray):
    """Mean loss and slopes at W and b by the expansions in table, and the largest relative error of a sum."""
    names = ["n", "loss", *_SLOPES, "error"]
    schema = StructType([StructField(n, DoubleType()) for n in names])

    def run(batches):
        for batch in batches:
            col = lambda *cs: np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cs])
            f, t, centre, terms = col("f_v", "f_t", "f_a"), col("t_0", "t_1", "t_2"), col(*WEIGHTS), col(*Z_TERMS)
            z = f.T @ w + b
            e = np.exp(z - z.max(axis=1, keepdims=True))
            now = (e / e.sum(axis=1, keepdims=True)).T
            d = now - centre
            total, slope = 0.0, [0.0, 0.0, 0.0]
            for (i, j), c in zip(TERMS, terms):
                c = c / (math.factorial(i) * math.factorial(j))
                total = total + c * d[0] ** i * d[1] ** j
                if i:
                    slope[0] = slope[0] + c * i * d[0] ** (i - 1) * d[1] ** j
                if j:
                    slope[1] = slope[1] + c * j * d[0] ** i * d[1] ** (j - 1)
            far = np.abs(d).sum(axis=0)
            spread = np.maximum(d[0] ** 2 * terms[3] + 2 * d[0] * d[1] * terms[4] + d[1] ** 2 * terms[5], 0.0)
            error = np.exp(far) * far ** (DEGREE - 1) * spread / math.factorial(DEGREE + 1) / np.abs(total)
            # slopes against that of the third score, which takes nothing from the differences between them
            h = np.stack([x / total for x in slope]) - t
            grad = now * (h - (now * h).sum(axis=0))
            sums = [len(far), (np.log(total) - (now * t).sum(axis=0)).sum(), *grad.sum(axis=1), *(f @ grad.T).ravel(), error.max(initial=0.0)]
            yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in sums], names)

    parts = table.mapInArrow(run, schema)
    return parts.agg(
        F.max("error").alias("error"), *[(F.sum(c) / F.sum("n")).alias(c) for c in ("loss", *_SLOPES)]
    ).first()


def linear_gate_weights(queries: DataFrame, w: np.ndarray, b: np.ndarray) -> DataFrame:
    """w = softmax(features @ W + b) over the columns f_v, f_t, f_a."""
    f = [F.col(c) for c in ("f_v", "f_t", "f_a")]
    logits = [
        sum(fi * F.lit(float(w[i, j])) for i, fi in enumerate(f)) + F.lit(float(b[j]))
        for j in range(3)
    ]
    return with_softmax_weights(queries, logits)


def mean_score_features(queries: DataFrame, gallery: DataFrame, spaces=CLIP_CLAP) -> DataFrame:
    """Add f_v, f_t, f_a: mean score of the query per modality (by centroids)."""
    from ..functions import aggregates as A

    centres = A.centroids(gallery, list(dict.fromkeys(s.g for s in spaces)))
    for s in spaces:
        queries = queries.withColumn(f"f_{s.name}", V.dot(s.q, A.constant_vector(centres[s.g])))
    return queries


def fit_linear_gate(
    queries: DataFrame, gallery: DataFrame, lr: float = 0.5, steps: int = 5, spaces=CLIP_CLAP
) -> dict:
    """W (3x3) and b (3) by gradient steps on the softmax cross entropy of the truth.

    One pass over all pairs expands the sum of each query in its weights and serves all steps whose weights stay
    near enough (``EXPANSION_ERROR``); then the next pass is made. Spaces or vectors that this does not
    suit (``can_expand``) take a pass per step.
    """
    base = mean_score_features(truth_similarities(queries, gallery, spaces), gallery, spaces)
    base = materialize(base, "linear-gate")
    w, b = np.zeros((3, 3)), np.zeros(3)
    history, table, expands = [], None, can_expand(base, gallery, spaces)
    for _ in range(steps):
        if expands:
            row = _expanded_step(table, w, b) if table is not None else None
            if row is None or not row["error"] <= EXPANSION_ERROR:
                weighted = linear_gate_weights(base, w, b)
                truths = [F.col(f"t_{s.name}").alias(f"t_{i}") for i, s in enumerate(spaces)]
                known = weighted.select("qid", "f_v", "f_t", "f_a", *truths, *WEIGHTS)
                table = materialize(known.join(weight_expansion(weighted, gallery, spaces), "qid"), "expansion")
                row = _expanded_step(table, w, b)
        else:
            row = _full_step(base, gallery, spaces, w, b)
        history.append(row["loss"])
        w = w - lr * np.array([[row[f"w{i}{j}"] for j in range(3)] for i in range(3)])
        b = b - lr * np.array([row[f"b{j}"] for j in range(3)])
    return {"W": w, "b": b, "history": history}


def _full_step(base: DataFrame, gallery: DataFrame, spaces, w: np.ndarray, b: np.ndarray):
    """Mean loss and slopes at W and b by a pass over all pairs."""
    weighted = linear_gate_weights(base, w, b)
    joined = weighted.join(softmax_moments(weighted, gallery, spaces), "qid")
    wt = [F.col(c) for c in WEIGHTS]
    fused_truth = sum(x * F.col(f"t_{s.name}") for x, s in zip(wt, spaces))
    slope = [F.col(f"z_{s.name}") / F.col("z") - F.col(f"t_{s.name}") for s in spaces]
    inner = sum(x * s for x, s in zip(wt, slope))
    logit_grad = [x * (s - inner) for x, s in zip(wt, slope)]
    aggs = [F.avg(F.ln("z") - fused_truth).alias("loss")]
    for j, gj in enumerate(logit_grad):
        aggs.append(F.avg(gj).alias(f"b{j}"))
        for i, f in enumerate(("f_v", "f_t", "f_a")):
            aggs.append(F.avg(F.col(f) * gj).alias(f"w{i}{j}"))
    return joined.agg(*aggs).first()
