"""A sieve in single precision before scores are compared exactly.

Most pairs of a tile lie far behind the score that they would have to reach.
Scores in single precision with a bound of their error tell which pairs these
are; all others are scored again in double precision, so no result depends on
the sieve. It knows cosine and angular spaces; kernels go through all
pairs in double precision where it does not apply (other metrics, weights below
zero, vectors that are not finite).
"""

from __future__ import annotations

import math

import numpy as np

from .blocks import SLACK

ROWS, COLUMNS = 64, 2048  # a tile of the sieve stays in a core's cache
TIE = 4 * SLACK
HUGE = 1e15  # norms beyond this could overflow in single precision
PAIRS = 65_536  # pairs whose vectors are gathered at once


def suits(spaces) -> bool:
    return all(s.metric in ("cosine", "angular") and s.factor is None and s.tau > 0 and s.scale > 0 for s in spaces)


def single(block: dict, name: str):
    """(matrix in single precision, norms of its rows), kept with the block; None if it is not finite."""
    kept = f"_single_{name}"
    if kept not in block:
        norms = np.sqrt(np.einsum("ij,ij->i", block[name], block[name]))
        fine = bool((norms < HUGE).all())
        block[kept] = (block[name].astype(np.float32), norms) if fine else None
    return block[kept]


def rounding(dim: int) -> float:
    """Bound of the error of a dot product in single precision, for vectors of length one."""
    return (dim + 8) * 2.0**-24


def raw_bar(space, bar):
    """The least dot product with which a score of the space can reach ``bar``."""
    x = bar * (space.tau / space.scale)
    if space.metric == "angular":
        with np.errstate(invalid="ignore"):
            low = np.cos(np.pi * (1.0 - np.clip(x, 0.0, 1.0)))
        return np.where(x <= 0, -np.inf, np.where(x == np.inf, np.inf, low - 1e-9))
    return x


def marked(near: np.ndarray):
    """(rows, columns) of a mask whose rows are padded to whole words."""
    words = np.flatnonzero(near.view(np.uint64).ravel())
    place, bit = np.nonzero(near.reshape(-1, 8)[words])
    flat = words[place] * 8 + bit
    return flat // near.shape[1], flat % near.shape[1]


def sift(q: dict, g: dict, spaces, bars):
    """Pairs of a tile that reach the bar in at least one space.

    ``bars`` has a score per space and query. Returns rows, columns and, per
    space, the dot products in single precision with the bound of their error;
    None if the tile has to be scored in full.
    """
    if not g["_n"]:
        return None
    left, right = [single(q, s.q) for s in spaces], [single(g, s.g) for s in spaces]
    if any(x is None for x in (*left, *right)) or any(a[0].shape[1] != b[0].shape[1] for a, b in zip(left, right)):
        return None
    errors, cuts = [], []
    for s, bar, (a, an), (b, bn) in zip(spaces, bars, left, right):
        error = rounding(a.shape[1]) * an * bn.max()
        errors.append(error)
        cut = raw_bar(s, bar) - error
        # a bar given in single precision is never above the one meant
        cuts.append(np.nextafter(cut.astype(np.float32), np.float32(-np.inf))[:, None])
    rows, cols, values = [], [], [[] for _ in spaces]
    for at in range(0, g["_n"], COLUMNS):
        parts = [np.ascontiguousarray(b[at : at + COLUMNS].T) for b, _ in right]
        width = parts[0].shape[1]
        padded = -(-width // 8) * 8
        room = [np.empty((ROWS, width), np.float32) for _ in spaces]
        mask, also = np.zeros((ROWS, padded), bool), np.empty((ROWS, width), bool)
        for lo in range(0, q["_n"], ROWS):
            n = min(ROWS, q["_n"] - lo)
            near = mask[:n]
            scores = [out[:n] for out in room]
            for i, (part, (a, _), cut) in enumerate(zip(parts, left, cuts)):
                np.matmul(a[lo : lo + n], part, out=scores[i])
                np.greater_equal(scores[i], cut[lo : lo + n], out=also[:n] if i else near[:, :width])
                if i:
                    near[:, :width] |= also[:n]
            r, c = marked(near)
            if len(r):
                rows.append(r + lo)
                cols.append(c + at)
                for kept, s in zip(values, scores):
                    kept.append(s[r, c])
    if not rows:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, [np.zeros(0)] * len(spaces), errors
    return (
        np.concatenate(rows), np.concatenate(cols),
        [np.concatenate(v).astype(np.float64) for v in values], errors,
    )


def rough(spaces, q, g, rows, cols, values, errors):
    """Scores of pairs from dot products in single precision, and the bounds of their error."""
    sims, slips = [], []
    for s, x, error in zip(spaces, values, errors):
        error = error[rows]
        if s.metric == "angular":
            edge = np.minimum(1.0, np.abs(x) + error)
            slope = np.sqrt(np.maximum(1.0 - edge * edge, 1e-300)) * np.pi
            error = np.minimum(error / slope, 1.0)
            x = 1.0 - np.arccos(np.clip(x, -1.0, 1.0)) / np.pi
        x, error = s._scaled(x), error * (s.scale / s.tau)
        empty = lacking(s, q, g, rows, cols)
        if empty is not None:
            x, error = np.where(empty, 0.0, x), np.where(empty, 0.0, error)
        sims.append(x)
        slips.append(error)
    return sims, slips


def lacking(space, q, g, rows, cols):
    """Pairs without one of the two vectors; None if there is none."""
    a, b = q.get(f"_null_{space.q}"), g.get(f"_null_{space.g}")
    parts = ([] if a is None else [a[rows]]) + ([] if b is None else [b[cols]])
    return None if not parts else np.logical_or.reduce(parts)


def exact(spaces, q, g, rows, cols):
    """Scores of pairs in double precision, by the same sums as those of the truth.

    The vectors of a bounded number of pairs are at hand at a time.
    """
    if len(rows) > PAIRS:
        parts = [exact(spaces, q, g, rows[lo : lo + PAIRS], cols[lo : lo + PAIRS]) for lo in range(0, len(rows), PAIRS)]
        return [np.concatenate(p) for p in zip(*parts)]
    sims, known = [], {}
    for s in spaces:
        for side, name, at in (("q", s.q, rows), ("g", s.g, cols)):
            if (side, name) not in known:
                known[side, name] = (q if side == "q" else g)[name][at]
        x = s.paired(known["q", s.q], known["g", s.g])
        if s.factor:
            x = x * g[s.factor][cols]
        empty = lacking(s, q, g, rows, cols)
        sims.append(x if empty is None else np.where(empty, 0.0, x))
    return sims


def gaps_of(spaces, q, g, rows, cols):
    """Pairs whose gallery row lacks the vector that the query asks for, per space; None if there is none."""
    out = []
    for s in spaces:
        empty = g.get(f"_null_{s.g}")
        out.append(None if empty is None or not empty.any() else s._asks(q)[rows] & empty[cols])
    return out


def sift_fused(system, spaces, q: dict, g: dict, bar):
    """(rows, columns) of a tile that may reach the bar, a fused score per query.

    Knows weighted sums of cosines and systems of a single space with a number
    as its weight; None for others and where vectors are not finite.
    """
    if not system.sums or not g["_n"]:
        return None
    used = [(w, s) for w, s in zip(system.weights, spaces) if isinstance(w, str) or w != 0]
    if any(s.factor is not None for _, s in used) or not used:
        return None
    left, right = [single(q, s.q) for _, s in used], [single(g, s.g) for _, s in used]
    if any(x is None for x in (*left, *right)) or any(a[0].shape[1] != b[0].shape[1] for a, b in zip(left, right)):
        return None
    metric, plus = used[0][1].metric, None
    if all(s.metric == "cosine" for _, s in used):
        scale = [(q[w] if isinstance(w, str) else np.full(q["_n"], float(w))) * (s.scale / s.tau) for w, s in used]
        if not all(np.isfinite(c).all() for c in scale):
            return None
        weighted = np.concatenate([c[:, None] * q[s.q] for c, (_, s) in zip(scale, used)], axis=1)
        reach = sum(np.abs(c) * a[1] * b[1].max() for c, a, b in zip(scale, left, right))
        if not (reach < HUGE).all():
            return None
        one, two = weighted.astype(np.float32), np.concatenate([b[0] for b in right], axis=1)
        cut = bar - rounding(one.shape[1]) * reach
    elif len(used) == 1 and not isinstance(used[0][0], str) and used[0][0] > 0:
        w, s = used[0]
        (one, an), (two, bn) = left[0], right[0]
        dim, goal = one.shape[1], bar / w * (s.tau / s.scale)
        if not s.tau * s.scale > 0:
            return None
        if metric == "angular":
            cut = raw_bar(s, bar / w) - rounding(dim) * an * bn.max()
        elif metric == "neg_euclidean":  # -|x - y| >= goal where x.y - |y|^2 / 2 >= (|x|^2 - goal^2) / 2
            plus = (-0.5 * bn * bn).astype(np.float32)
            cut = 0.5 * (an * an - goal * goal) - rounding(dim) * (an + bn.max()) ** 2 - SLACK
            cut = np.where(goal > 0, np.inf, cut)
        else:
            return _near_by_manhattan(s, q, g, np.where(s._asks(q), goal, np.where(bar <= 0, -np.inf, np.inf)))
        # without its vector a query scores zero with every row
        cut = np.where(s._asks(q), cut, np.where(bar <= 0, -np.inf, np.inf))
    else:
        return None
    cut = np.nextafter(np.where(np.isnan(cut), -np.inf, cut).astype(np.float32), np.float32(-np.inf))[:, None]
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, g["_n"], COLUMNS):
        part = np.ascontiguousarray(two[at : at + COLUMNS].T)
        width = part.shape[1]
        room = np.empty((ROWS, width), np.float32)
        mask = np.zeros((ROWS, -(-width // 8) * 8), bool)
        for lo in range(0, q["_n"], ROWS):
            a = one[lo : lo + ROWS]
            scores, near = room[: len(a)], mask[: len(a)]
            np.matmul(a, part, out=scores)
            if plus is not None:
                scores += plus[None, at : at + width]
            np.greater_equal(scores, cut[lo : lo + ROWS], out=near[:, :width])
            r, c = marked(near)
            rows.append(r + lo)
            cols.append(c + at)
    return np.concatenate(rows), np.concatenate(cols)


def _near_by_manhattan(space, q: dict, g: dict, goal):
    """(rows, columns) of pairs whose negative distance may reach the goal.

    The components are rounded down to steps of 16-bit integers: |x - y| = 2 max(x, y) - x - y, and a sum is off by less than
    one step per component either way.
    """
    a, b = q[space.q], g[space.g]
    dim = a.shape[1]
    if dim > 1000:
        return None
    # a distance and the sum of a query's components stay within 16 bits
    step = max(2 * np.abs(a).sum(axis=1).max() + np.abs(b).sum(axis=1).max(), 1e-300) / (32_000 - 4 * dim)
    x, y = np.floor(a.T / step).astype(np.int16), np.floor(b / step).astype(np.int16)
    x_sums, y_sums = x.sum(axis=0, dtype=np.int64), y.sum(axis=1, dtype=np.int64)
    reach = np.where(goal == -np.inf, np.inf, (-goal + SLACK) / step + dim + 1)
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    n, width = g["_n"], q["_n"]
    total, part = (np.empty((min(STEP, n), width), np.int16) for _ in range(2))
    mask = np.zeros((min(STEP, n), -(-width // 8) * 8), bool)
    bound = np.clip(np.floor((reach + x_sums) / 2), -32_768, 32_767).astype(np.int16)
    for at in range(0, n, STEP):
        few = y[at : at + STEP]
        m = len(few)
        out, more, near = total[:m], part[:m], mask[:m]
        # the maxima less half of the row's own sum
        out[:] = (-y_sums[at : at + m, None] // 2).astype(np.int16)
        for k in range(dim):
            np.maximum(few[:, k, None], x[k][None, :], out=more)
            out += more
        np.less_equal(out, bound[None, :], out=near[:, :width])
        c, r = marked(near)
        rows.append(r)
        cols.append(c + at)
    return np.concatenate(rows), np.concatenate(cols)


#: gallery rows of a dense tile: their marks are added up in single bytes
STEP = 248
#: gallery rows of a tile from which on rounding errors of sums in single precision cancel out; fewer are summed in double
MANY = 2048
BEHIND = -1e30  # added to the score of a row that does not compete


class Dense:
    """Fused cosine scores of a tile in single precision, [gallery rows, queries], with a bound of their error.

    ``of`` gives None where the bound would not hold: other metrics, vectors or weights that are not finite,
    weights below zero where rows do not compete.
    """

    @classmethod
    def of(cls, systems, spaces, q: dict, g: dict):
        if not g["_n"] or not q["_n"]:
            return None
        self = cls()
        self.n, self.width = g["_n"], q["_n"]
        #: products of the longest vectors, their weights and sums are all rounded
        self.wide = 16 + max(q[s.q].shape[1] for s in spaces)
        self.sides, self.factors, self.terms, self.scales, self.slips = {}, {}, [], [], []
        errors = {}
        for system in systems:
            used = [(w, s) for w, s in zip(system.weights, spaces) if isinstance(w, str) or w != 0] if system.sums else []
            if not used:
                return None
            terms, slip = [], 0.0
            for w, s in used:
                if s not in errors:
                    errors[s] = self._space(s, q, g)
                if errors[s] is None:
                    return None
                c = (q[w] if isinstance(w, str) else np.full(self.width, float(w))) * (s.scale / s.tau)
                if c.dtype != np.float64 or not (np.abs(c) < HUGE).all():
                    return None
                if s.gap(q, g) is not None and not ((c == 0) | (c > 1e-9)).all():
                    return None
                # the products and the sum are rounded as well
                slip = slip + np.abs(c) * errors[s]
                terms.append((s, c if isinstance(w, str) else c[0]))
            same = len({c if np.ndim(c) == 0 else None for _, c in terms}) == 1 and np.ndim(terms[0][1]) == 0
            scale = float(terms[0][1]) if same and terms[0][1] > 0 else 1.0
            row = [(s, None if scale != 1.0 or (same and c == 1) else self._coefficient(c)) for s, c in terms]
            self.terms.append(row)
            self.scales.append(scale)
            self.slips.append(slip)
        return self

    def _coefficient(self, c):
        return np.float32(c) if np.ndim(c) == 0 else c.astype(np.float32)[None, :]

    def _space(self, s, q, g):
        """Bound of the error of the scores of a space, per query; its matrices are kept."""
        if s.metric != "cosine":
            return None
        left, right = single(q, s.q), single(g, s.g)
        if left is None or right is None or left[0].shape[1] != right[0].shape[1]:
            return None
        (a, an), (b, bn) = left, right
        most = 1.0
        if s.factor:
            most = np.abs(g[s.factor]).max()
            if not most < HUGE:
                return None
            self.factors[s] = g[s.factor].astype(np.float32)[:, None]
        if (s.q, s.g) not in self.sides:
            lacking = g.get(f"_null_{s.g}")
            if lacking is not None and lacking.any():
                if s.factor:
                    return None
                a = np.concatenate([a, s._asks(q)[:, None].astype(np.float32)], axis=1)
                b = np.concatenate([b, np.where(lacking, np.float32(BEHIND), np.float32(0))[:, None]], axis=1)
            self.sides[s.q, s.g] = (np.ascontiguousarray(b), np.ascontiguousarray(a.T))
        reach = an * bn.max() * most
        return rounding(self.wide) * reach if (reach < HUGE).all() else None

    def reach(self):
        """Per system: bound of a score's size, per query."""
        return [slip / rounding(self.wide) for slip in self.slips]

    def tiles(self):
        """(system, first row, scores); the scores are in units of ``scales`` and good until the next step."""
        shape = (min(STEP, self.n), self.width)
        room = {key: np.empty(shape, np.float32) for key in self.sides}
        total, part = np.empty(shape, np.float32), np.empty(shape, np.float32)
        for at in range(0, self.n, STEP):
            m = min(STEP, self.n - at)
            for key, (b, a) in self.sides.items():
                np.matmul(b[at : at + m], a, out=room[key][:m])
            for i, terms in enumerate(self.terms):
                out = total[:m]
                for j, (s, c) in enumerate(terms):
                    x = room[s.q, s.g][:m]
                    if s in self.factors:
                        x = np.multiply(x, self.factors[s][at : at + m], out=part[:m])
                    if c is not None:
                        x = np.multiply(x, c, out=out if j == 0 else part[:m])
                    if len(terms) == 1:
                        out = x
                    elif j == 0:
                        first = x
                    else:
                        np.add(first, x, out=out)
                        first = out
                yield i, at, out


def held(c: float) -> bool:
    """Can scores be multiplied by the number, or divided by its inverse, without rounding the number itself?"""
    return float(np.float32(c)) == c or abs(1 / c - round(1 / c)) < 1e-12 * abs(1 / c)


def times(x, c: float, out):
    """x * c in single precision; the errors differ from element to element if the number is ``held``."""
    if c == 1:
        return x
    if abs(1 / c - round(1 / c)) < 1e-12 * abs(1 / c):
        return np.divide(x, np.float32(round(1 / c)), out=out)
    return np.multiply(x, np.float32(c), out=out)


def _exp_bias() -> float:
    x = np.linspace(-10, 10, 1 << 18, dtype=np.float32)
    return float((np.exp(x) / np.exp(x.astype(np.float64)) - 1).mean())


#: mean relative error of exp in single precision, which sums would keep
EXP_BIAS = _exp_bias()


#: the square of a cosine up to which ``arc_rest`` holds
FLAT = 0.49


def _arc_series(degree: int = 7) -> list:
    """Coefficients of (asin(x) - x) / x^3 by x^2, between 0 and FLAT."""
    series = lambda y: sum(math.comb(2 * k, k) / 4.0**k / (2 * k + 1) * y ** (k - 1) for k in range(1, 60))
    fit = np.polynomial.chebyshev.chebinterpolate(lambda t: series((t + 1) * FLAT / 2), degree)
    line = np.polynomial.Polynomial([-1.0, 2.0 / FLAT])
    return [np.float32(c) for c in np.polynomial.Polynomial(np.polynomial.chebyshev.cheb2poly(fit))(line).coef[::-1]]


_ARC = _arc_series()


def arc_rest(x, out, square):
    """asin(x) - x of the elements in single precision, where ``square``, which gets their squares, is at most FLAT."""
    np.multiply(x, x, out=square)
    np.multiply(square, _ARC[0], out=out)
    for c in _ARC[1:-1]:
        out += c
        out *= square
    out += _ARC[-1]
    out *= square
    out *= x
    return out


def column_sums(x):
    """Sums over the rows, in double precision after the first eight."""
    k = len(x) // 8
    total = x[8 * k :].sum(axis=0, dtype=np.float64)
    return total + x[: 8 * k].reshape(8, k, x.shape[1]).sum(axis=0).sum(axis=0, dtype=np.float64) if k else total


def below(x):
    """In single precision, never above."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def above(x):
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))
