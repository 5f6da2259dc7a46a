"""Linear maps between embedding spaces, fitted from distributed Gram sums.

Rows never leave the executors: each task contributes its d x d partial
products, and only the d x d sums reach the driver for the small solve.
Maps act on row vectors: y = x @ W + b.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import vectors as V
from ..session import materialize


@dataclass(frozen=True)
class Gram:
    """Sums over n rows x (and y): enough for every fit below."""

    n: int
    sx: np.ndarray
    sxx: np.ndarray
    sy: np.ndarray | None = None
    syy: np.ndarray | None = None
    sxy: np.ndarray | None = None

    def mean_x(self):
        return self.sx / self.n

    def mean_y(self):
        return self.sy / self.n

    def cov_x(self, ddof: int = 0):
        return (self.sxx - np.outer(self.sx, self.sx) / self.n) / (self.n - ddof)

    def cov_y(self, ddof: int = 0):
        return (self.syy - np.outer(self.sy, self.sy) / self.n) / (self.n - ddof)

    def cov_xy(self, ddof: int = 0):
        return (self.sxy - np.outer(self.sx, self.sy) / self.n) / (self.n - ddof)


    def swap(self) -> "Gram":
        return Gram(self.n, self.sy, self.syy, self.sx, self.sxx, self.sxy.T)


def _matrix(column, rows):
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows, -1)


def grams(df: DataFrame, cols) -> dict[tuple[str, str], Gram]:
    """Gram sums of every ordered pair of vector columns, in one pass."""
    cols = list(cols)
    rows = df.select(*cols).filter(" and ".join(f"{c} is not null" for c in cols))

    def partial(batches):
        total = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            parts = [_matrix(batch.column(i), batch.num_rows) for i in range(len(cols))]
            # a one for the sums, then each column's width, then the components
            head = [[1.0, *[float(p.shape[1]) for p in parts]]]
            m = np.hstack([np.repeat(head, batch.num_rows, axis=0), *parts])
            total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int64)), A.vector_array(total)],
                names=["row", "vec"],
            )

    parts = rows.mapInArrow(partial, "row long, vec array<double>")
    # as many rows as the columns have components, whatever the size of the table
    summed = A.combine_vectors(parts, "row", "vec", "sum").toArrow()
    order = np.argsort(summed.column("key").to_numpy())
    full = _matrix(summed.column("vec").combine_chunks(), summed.num_rows)[order]
    n = int(round(full[0, 0]))
    k = len(cols) + 1
    ends = k + np.cumsum(np.rint(full[0, 1:k] / n).astype(int))
    at = {c: slice(lo, hi) for c, lo, hi in zip(cols, [k, *ends[:-1]], ends)}
    return {
        (x, y): Gram(
            n, full[0, at[x]], full[at[x], at[x]], full[0, at[y]], full[at[y], at[y]], full[at[x], at[y]]
        )
        for x in cols for y in cols
    }


def gram(df: DataFrame, x: str, y: str | None = None) -> Gram:
    """n, sums and cross products of one or two vector columns in one pass."""
    return grams(df, [x] if y is None else [x, y])[(x, y or x)]


@dataclass(frozen=True)
class LinearMap:
    """y = x @ W + b, then unit length."""

    W: np.ndarray
    b: np.ndarray
    method: str

    def apply(self, m: np.ndarray) -> np.ndarray:
        return m @ self.W + self.b

    def unit(self, m: np.ndarray) -> np.ndarray:
        out = self.apply(m)
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.maximum(length, V.EPS)


def affine(df: DataFrame, col: str, fitted: LinearMap, out: str | None = None,
           normalize_input: bool = True, unit: bool = True) -> DataFrame:
    """Map a vector column; the map travels as one broadcast of d x d numbers."""
    if normalize_input:
        df = df.withColumn(col if out is None else "_in", V.l2_normalize(col))
        source = col if out is None else "_in"
    else:
        source = col
    # plain arrays: executors need no package to unpack a broadcast
    shared = df.sparkSession.sparkContext.broadcast((fitted.W, fitted.b, fitted.method))

    def fn(m):
        local = LinearMap(*shared.value)
        return local.unit(m) if unit else local.apply(m)

    mapped = A.map_vector(df, source, fn, out or col)
    return mapped.drop("_in") if source == "_in" else mapped


def fit_ridge(g: Gram, lam: float = 1e-3, bias: bool = False) -> LinearMap:
    """W = (X'X + lam I)^-1 X'Y; with ``bias`` on centred sums."""
    d = len(g.sx)
    if bias:
        xx, xy = g.cov_x() * g.n, g.cov_xy() * g.n
    else:
        xx, xy = g.sxx, g.sxy
    w = np.linalg.solve(xx + lam * np.eye(d), xy)
    b = g.mean_y() - g.mean_x() @ w if bias else np.zeros(w.shape[1])
    return LinearMap(w, b, "ridge")


def fit_zca(g: Gram, eps: float = 1e-4) -> LinearMap:
    """Whitening V diag((l+eps)^-1/2) V' of centred rows; b = -mean W."""
    values, vectors = np.linalg.eigh(g.cov_x())
    scale = 1.0 / np.sqrt(np.maximum(values, 0.0) + eps)
    w = (vectors * scale) @ vectors.T
    return LinearMap(w, -g.mean_x() @ w, "zca")


def fit_procrustes(g: Gram) -> LinearMap:
    """Orthogonal W = U V' of the centred cross product; b from the means."""
    u, _, vt = np.linalg.svd(g.cov_xy() * g.n)
    w = u @ vt
    return LinearMap(w, g.mean_y() - g.mean_x() @ w, "procrustes")


def _inv_sqrt(m):
    values, vectors = np.linalg.eigh(m)
    return (vectors / np.sqrt(np.maximum(values, 1e-15))) @ vectors.T


def fit_cca(g: Gram, rank: int = 128, eps: float = 1e-4):
    """Canonical directions of both views (train statistics) and correlations."""
    cxx = g.cov_x(1) + eps * np.eye(len(g.sx))
    cyy = g.cov_y(1) + eps * np.eye(len(g.sy))
    ix, iy = _inv_sqrt(cxx), _inv_sqrt(cyy)
    u, s, vt = np.linalg.svd(ix @ g.cov_xy(1) @ iy)
    rank = min(rank, len(s))
    wx, wy = ix @ u[:, :rank], iy @ vt.T[:, :rank]
    return (
        LinearMap(wx, -g.mean_x() @ wx, "cca_x"),
        LinearMap(wy, -g.mean_y() @ wy, "cca_y"),
        s[:rank],
    )


def canonical_correlations(g: Gram) -> np.ndarray:
    """Singular values of the standardised cross-covariance (reference figure)."""
    sd = lambda c: np.sqrt(np.diag(c)) + 1e-8
    c = g.cov_xy(1) / (np.outer(sd(g.cov_x()), sd(g.cov_y())) + 1e-8)
    return np.linalg.svd(c, compute_uv=False)


def compose(first: LinearMap, second: LinearMap, method: str) -> LinearMap:
    return LinearMap(first.W @ second.W, first.b @ second.W + second.b, method)


def whitened_gram(g: Gram, mx: LinearMap, my: LinearMap) -> Gram:
    """Sums of the mapped rows, derived without another pass over the data."""
    n = g.n
    sx, sy = g.sx @ mx.W + n * mx.b, g.sy @ my.W + n * my.b
    def cross(wl, bl, s_l, wr, br, s_r, m):
        return wl.T @ m @ wr + np.outer(s_l @ wl, br) + np.outer(bl, s_r @ wr) + n * np.outer(bl, br)
    return Gram(
        n, sx, cross(mx.W, mx.b, g.sx, mx.W, mx.b, g.sx, g.sxx),
        sy, cross(my.W, my.b, g.sy, my.W, my.b, g.sy, g.syy),
        cross(mx.W, mx.b, g.sx, my.W, my.b, g.sy, g.sxy),
    )


def fit_whiten_then_ridge(g: Gram, lam: float = 1e-2, eps: float = 1e-4) -> LinearMap:
    """Whiten both views, then ridge from the one to the other."""
    wx, wy = fit_zca(g, eps), fit_zca(g.swap(), eps)
    ridge = fit_ridge(whitened_gram(g, wx, wy), lam)
    return compose(wx, ridge, "whiten_ridge")


def fit_shared_anchor(anchor: Gram) -> LinearMap:
    """Procrustes fitted on one pair of text views, for any vector of the first space."""
    fitted = fit_procrustes(anchor)
    return LinearMap(fitted.W, fitted.b, "shared_anchor")


def positive_cosine(df: DataFrame, x: str, y: str, fitted: LinearMap | None = None) -> float:
    if fitted is not None:
        df = affine(df.select(x, y), x, fitted)
    return df.agg(F.avg(V.cosine(x, y)).alias("c")).first()["c"]


def select_map(df: DataFrame, x: str, y: str, fits) -> tuple[LinearMap, dict]:
    """The fit with the highest train positive cosine, Procrustes first on ties."""
    scores = {f.method: positive_cosine(df, x, y, f) for f in fits}
    best = max(fits, key=lambda f: (scores[f.method], f.method == "procrustes"))
    return best, scores


def save_map(spark: SparkSession, fitted: LinearMap, path: str) -> None:
    rows = [(fitted.method, [[float(v) for v in r] for r in fitted.W], [float(v) for v in fitted.b])]
    spark.createDataFrame(rows, "method string, W array<array<double>>, b array<double>").write.mode(
        "overwrite"
    ).parquet(path)


def load_map(spark: SparkSession, path: str) -> LinearMap:
    row = spark.read.parquet(path).first()
    return LinearMap(np.array(row["W"]), np.array(row["b"]), row["method"])


def map_frame(spark: SparkSession, fitted: LinearMap) -> DataFrame:
    """(i, j, w, b): a fitted map as rows, for reports."""
    rows = [
        (i, j, float(fitted.W[i, j]), float(fitted.b[j]))
        for i in range(fitted.W.shape[0]) for j in range(fitted.W.shape[1])
    ]
    return spark.createDataFrame(rows, "i int, j int, w double, b double")


def local_scaling(gallery: DataFrame, queries: DataFrame, q_col: str, g_col: str, k: int = 5,
                  limits=None) -> tuple[DataFrame, DataFrame]:
    """Queries and gallery rescaled so that their dot product is
    sim / sqrt(sigma_q * sigma_g), sigma being the k-th neighbour similarity
    within the own side (at least 1e-3)."""
    from .geometry import kth_neighbor_sim

    def rescaled(df, key, col):
        sigma = kth_neighbor_sim(df.select(F.col(key).alias("id"), F.col(col).alias("vec")), k, limits)
        sigma = materialize(sigma, "neighbours")  # a pass over all pairs, read several times
        factor = 1.0 / F.sqrt(F.greatest(F.col("sigma"), F.lit(1e-3)))
        return (
            df.join(sigma.withColumnRenamed("id", key), key)
            .withColumn(col, V.let(factor, lambda f: F.transform(F.col(col), lambda x: x * f)))
            .drop("sigma")
        )

    return rescaled(gallery, "id", g_col), rescaled(queries, "qid", q_col)


def query_expansion(queries: DataFrame, gallery: DataFrame, q_col: str, g_col: str, k: int = 3,
                    alpha: float = 0.6, limits=None) -> DataFrame:
    """Queries blended with the mean of their k best gallery vectors, unit length."""
    from .blocks import Space, System
    from .scoring import score_top_k

    top = score_top_k(
        queries, gallery, k, (Space("s", q_col, g_col),), (System("s", (1,)),), limits=limits
    )
    near = top.select("qid", "id").join(gallery.select("id", F.col(g_col).alias("_v")), "id")
    mean = A.mean_pool(near, "qid", "_v", renormalize=False).select("qid", F.col("vec").alias("_m"))
    joined = queries.join(mean, "qid")
    return joined.withColumn(q_col, V.blend(q_col, "_m", alpha)).drop("_m")


def export_store(store: DataFrame, fitted: LinearMap) -> DataFrame:
    """(id, vec): a whole store mapped and brought to unit length."""
    return affine(store.select("id", "vec"), "vec", fitted)


def norm_check(store: DataFrame) -> DataFrame:
    n = store.select(V.norm("vec").alias("norm"))
    return n.agg(
        F.count(F.lit(1)).alias("n"), F.avg("norm").alias("mean_norm"),
        F.stddev_samp("norm").alias("std_norm"),
    )
