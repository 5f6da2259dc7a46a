"""Fitted maps and spectra held against sums that SQL takes from the same rows.

A factorisation has no SQL form, but what it must reproduce has: eigenvalues
sum to the trace of the covariance, a ridge map solves its normal equations, an
inverted whitening is the covariance again. Every figure is computed from the
fitted matrices here and from the rows in SQL.
"""

from __future__ import annotations

import numpy as np

from ..operators import align as L
from ..plans import fixtures as X
from .common import GALLERY, HALVES, query, r6, with_

COLS = ("visual", "caption", "audio")

_COV = (
    HALVES, GALLERY,
    "lg AS (" + " UNION ALL ".join(
        f"SELECT id, '{c}' AS m, unnest(range(1, 33)) AS pos, unnest({c}) AS v FROM gal" for c in COLS
    ) + ")",
    """cv AS (SELECT x.m AS mx, y.m AS my, x.pos AS i, y.pos AS j, count(*) AS n, sum(x.v * y.v) AS s,
      covar_pop(x.v, y.v) AS c, covar_samp(x.v, y.v) AS c1 FROM lg x JOIN lg y USING (id) GROUP BY ALL)""",
)
_PAIR = "FROM cv WHERE mx = 'audio' AND my = 'caption'"
_SELF = "FROM cv WHERE mx = 'audio' AND my = 'audio'"


def _gram(spark, sf):
    return L.gram(X.gallery(spark, sf).select("audio", "caption"), "audio", "caption")


def _row(spark, names, *values):
    ddl = ", ".join(f"{n} {'long' if isinstance(v, int) else 'double'}" for n, v in zip(names, values))
    return spark.createDataFrame([tuple(v if isinstance(v, int) else float(v) for v in values)], ddl)


@query(
    "d10_spectrum_moments",
    with_(*_COV) + f"""SELECT mx AS modality, {r6('sum(c) FILTER (i = j)', 'total')}, {r6('sum(c * c)', 'squares')}
      FROM cv WHERE mx = my GROUP BY mx""",
)
def _(spark, sf):
    """Sum and sum of squares of the eigenvalues behind effective dimension and PCA shares."""
    g = X.gallery(spark, sf)
    rows = []
    for c in COLS:
        values = np.linalg.eigvalsh(L.gram(g.select(c), c).cov_x())
        rows.append((c, float(values.sum()), float((values**2).sum())))
    return spark.createDataFrame(rows, "modality string, total double, squares double")


@query(
    "l2_ridge_normal_equations",
    with_(*_COV) + f"SELECT max(n) AS n, {r6('sum(s)', 'total')}, {r6('sqrt(sum(s * s))', 'norm')} {_PAIR}",
)
def _(spark, sf):
    """(X'X + lam I) W is X'Y."""
    g = _gram(spark, sf)
    made = (g.sxx + 1e-3 * np.eye(len(g.sx))) @ L.fit_ridge(g, 1e-3).W
    return _row(spark, ("n", "total", "norm"), int(g.n), made.sum(), np.linalg.norm(made))


@query(
    "l3_zca_inverse",
    with_(*_COV) + f"SELECT {r6('sum(c) FILTER (i = j)', 'trace')}, {r6('sum(c)', 'total')}, {r6('sum(c * c)', 'squares')} {_SELF}",
)
def _(spark, sf):
    """The inverse of a symmetric whitening, squared, is the covariance plus eps."""
    fitted = L.fit_zca(_gram(spark, sf), 1e-4)
    back = np.linalg.inv(fitted.W)
    cov = back @ back - 1e-4 * np.eye(len(back))
    return _row(spark, ("trace", "total", "squares"), np.trace(cov), cov.sum(), (cov * cov).sum())


@query(
    "l4_procrustes_energy",
    with_(*_COV) + f"""SELECT {r6('sum(c) FILTER (i = j)', 'trace')}, {r6('sum(c * c)', 'squares')},
      (SELECT {r6('sum(c * c)')} {_PAIR}) AS crossed {_SELF}""",
)
def _(spark, sf):
    """An orthogonal map keeps the spread of what it maps; with the cross products it gives a symmetric root of C'C."""
    g = _gram(spark, sf)
    w = L.fit_procrustes(g).W
    mapped, root = w.T @ g.cov_x() @ w, w.T @ g.cov_xy()
    return _row(spark, ("trace", "squares", "crossed"), np.trace(mapped), (mapped**2).sum(), np.trace(root @ root))


@query(
    "l5_cca_reconstruction",
    with_(*_COV) + f"SELECT {r6('sum(c1)', 'total')}, {r6('sum(c1 * c1)', 'squares')} {_PAIR}",
)
def _(spark, sf):
    """Directions and correlations of full rank give the cross-covariance back."""
    g = _gram(spark, sf)
    d = len(g.sx)
    wx, wy, corr = L.fit_cca(g, d)
    ridge = 1e-4 * np.eye(d)
    made = ((g.cov_x(1) + ridge) @ wx.W * corr) @ ((g.cov_y(1) + ridge) @ wy.W).T
    return _row(spark, ("total", "squares"), made.sum(), (made * made).sum())
