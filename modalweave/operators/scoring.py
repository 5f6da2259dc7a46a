"""Query x gallery scoring: top-k lists, rank of truth, score statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from . import sieve
from .blocks import (
    CLIP_CLAP,
    SCORE_DECIMALS,
    SLACK,
    ROW,
    Limits,
    Merge,
    Space,
    System,
    block_join,
    settle,
    split_block,
    to_block,
    with_truth,
)

EQUAL = System("equal", (1 / 3, 1 / 3, 1 / 3))


def unique(names) -> list[str]:
    return list(dict.fromkeys(names))


def _fields(df: DataFrame, names) -> list[StructField]:
    return [StructField(n, df.schema[n].dataType, True) for n in names]


def _double(*names):
    return [StructField(n, DoubleType(), True) for n in names]


def _long(*names):
    return [StructField(n, LongType(), True) for n in names]


def _places_of(wanted, ids):
    """(rows, cols) where wanted[row] == ids[col]; ids are unique."""
    order = np.argsort(ids, kind="stable")
    ordered = ids[order]
    place = np.searchsorted(ordered, wanted)
    place[place == len(ids)] = 0
    rows = np.flatnonzero(ordered[place] == wanted)
    return rows, order[place[rows]]


def _tiled(q, names, m) -> dict:
    """Query columns, and their row numbers where there are any, once per system or space."""
    return {name: np.tile(q[name], m) for name in [*names, ROW] if name in q}


def _tile(spaces, q, g):
    """Scores of a tile per space, and the pairs that do not compete in it."""
    known = {}
    return [s.scores(q, g, known) for s in spaces], [s.gap(q, g) for s in spaces]


def _truth(spaces, q):
    return [s.truth(q) for s in spaces], [s.truth_gap(q) for s in spaces]


class TopK:
    """Best ``k`` gallery rows per (system, query), ordered (score desc, id asc)."""

    FIRST = 256

    def __init__(self, k, spaces, systems, exclude=None):
        self.k, self.spaces, self.systems, self.exclude = k, spaces, systems, exclude

    def start(self, q):
        # per system: the lists so far and the score a row must reach to enter
        return [(None, None)] * len(self.systems)

    def update(self, state, q, g):
        """A few rows give each query a score to beat, the rest of the tile is sifted by it.

        In the first tile the score rises with parts that double in size, so that few pairs pass in each.
        """
        head = max(self.FIRST, self.k)
        if g["_n"] <= 2 * head:
            return self._all_pairs(state, q, g)
        if all(cut is not None for _, cut in state):
            return self._sifted(state, q, g)
        ends = [head]
        while ends[-1] < g["_n"]:
            ends.append(min(2 * ends[-1], g["_n"]))
        arrays = {n: v for n, v in g.items() if isinstance(v, np.ndarray)}
        for lo, hi in zip([0, *ends], ends):
            part = {n: v[lo:hi] for n, v in arrays.items()} | {"_n": hi - lo}
            state = self._sifted(state, q, part) if lo else self._all_pairs(state, q, part)
        return state

    def _competing(self, system, q, g):
        """The rows that compete under the system; all of them where that is not the same for every query."""
        used = [s for w, s in zip(system.weights, self.spaces) if not isinstance(w, str) and w != 0]
        used = [s for s in used if f"_null_{s.g}" in g and s._asks(q).all()]
        if not used:
            return g
        kept = "_competing_" + "_".join(s.g for s in used)
        if kept not in g:
            there = ~np.logical_or.reduce([g[f"_null_{s.g}"] for s in used])
            g[kept] = {n: v[there] for n, v in g.items() if isinstance(v, np.ndarray)} | {"_n": int(there.sum())}
        return g[kept]

    def _sifted(self, state, q, g):
        full = []
        for i, system in enumerate(self.systems):
            old, cut = state[i]
            part = self._competing(system, q, g)
            found = None if cut is None else sieve.sift_fused(system, self.spaces, q, part, cut - sieve.TIE)
            if found is None:
                full.append(i)
                continue
            rows, cols = found
            if self.exclude is not None:
                other = part["id"][cols] != q[self.exclude][rows]
                rows, cols = rows[other], cols[other]
            sims = sieve.exact(self.spaces, q, part, rows, cols)
            gaps = sieve.gaps_of(self.spaces, q, part, rows, cols)
            score = settle(system.fuse(system.pair_columns(q, rows), sims, gaps))
            keep = score > -np.inf
            found = tuple(a[keep] for a in (rows, part["id"][cols], score, *sims))
            state[i] = self._merged(old, found, q["_n"])
        return self._all_pairs(state, q, g, full) if full else state

    def _merged(self, old, found, n):
        """The lists with the rows found, and the scores to beat: -inf while a list is not full."""
        best = self._best(old, found)
        count = np.bincount(best[0], minlength=n)
        last = np.full(n, -np.inf)
        ends = np.searchsorted(best[0], np.arange(n), side="right") - 1
        last[count >= self.k] = best[2][ends[count >= self.k]]
        return best, last

    def _all_pairs(self, state, q, g, only=None):
        sims, gaps = _tile(self.spaces, q, g)
        barred = None
        if self.exclude is not None:
            barred = _places_of(q[self.exclude], g["id"])
        for i in range(len(self.systems)) if only is None else only:
            system, (old, cut) = self.systems[i], state[i]
            fused = system.fuse(q, sims, gaps)
            if barred is not None:
                fused = np.array(fused)
                fused[barred] = -np.inf
            if cut is None:
                k = min(self.k, fused.shape[1])
                cut = np.partition(fused, fused.shape[1] - k, axis=1)[:, -k]
            rows, cols = np.nonzero(fused >= cut[:, None] - SLACK)
            score = settle(fused[rows, cols])
            keep = score > -np.inf
            rows, cols, score = rows[keep], cols[keep], score[keep]
            found = (rows, g["id"][cols], score) + tuple(s[rows, cols] for s in sims)
            state[i] = self._merged(old, found, q["_n"])
        return state

    def _best(self, old, new):
        if old is not None:
            new = tuple(np.concatenate([a, b]) for a, b in zip(old, new))
        order = np.lexsort((new[1], -new[2], new[0]))
        new = tuple(a[order] for a in new)
        rows = new[0]
        first = np.searchsorted(rows, rows, side="left")
        keep = np.arange(len(rows)) - first < self.k
        return tuple(a[keep] for a in new)

    def finish(self, state, q):
        out = {"system": [], "qid": [], "id": [], "score": []}
        sims = [[] for _ in self.spaces]
        for system, (found, _) in zip(self.systems, state):
            if found is None:
                continue
            out["system"].append(np.full(len(found[0]), system.name, dtype=object))
            out["qid"].append(q["qid"][found[0]])
            out["id"].append(found[1])
            out["score"].append(found[2])
            for dst, src in zip(sims, found[3:]):
                dst.append(src)
        merged = {n: np.concatenate(v) for n, v in out.items()}
        for space, parts in zip(self.spaces, sims):
            merged[f"sim_{space.name}"] = np.concatenate(parts)
        return merged


def _query_columns(queries, spaces, systems, extra=()):
    weights = [w for s in systems for w in s.columns()]
    names = unique(["qid", *extra, *[s.q for s in spaces], *weights])
    return queries.select(*names)


def vectors_of(spaces) -> list[str]:
    """What the spaces read of a gallery row."""
    return unique([c for s in spaces for c in s.gallery_columns])


def _gallery_columns(gallery, spaces, extra=()):
    return gallery.select(*unique(["id", *extra, *vectors_of(spaces)]))


def score_top_k(
    queries: DataFrame,
    gallery: DataFrame,
    k: int,
    spaces=CLIP_CLAP,
    systems=(EQUAL,),
    exclude: str | None = None,
    limits: Limits | None = None,
) -> DataFrame:
    """(system, qid, id, score, sim_*, rk): the ``k`` best rows of every query.

    ``exclude`` names a query column whose value is barred from the result
    (``truth`` for hard negatives, ``qid`` for neighbours other than self).
    """
    extra = [exclude] if exclude else []
    q = _query_columns(queries, spaces, systems, extra)
    g = _gallery_columns(gallery, spaces)
    schema = StructType(
        [StructField("system", StringType())]
        + _fields(q, ["qid"])
        + _fields(g, ["id"])
        + _double("score", *[f"sim_{s.name}" for s in spaces])
    )
    found = block_join(
        q, g, TopK(k, spaces, systems, exclude), schema,
        q_key=["qid"], g_key=["id"], limits=limits,
    )
    return rank_scores(found, k)


def rank_scores(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Number rows per (system, query) by (score desc, id asc); keep the first k."""
    w = Window.partitionBy("system", "qid").orderBy(F.col("score").desc(), F.col("id"))
    ranked = scores.withColumn("rk", F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col("rk") <= k)


class TruthRank:
    """Counts gallery rows that rank before the truth, per (system, query).

    Where few rows reach the truth's score in any space, these alone are looked at; else all
    scores of a tile are compared in single precision and only those near the truth's again.
    """

    PROBE = 256
    #: share of pairs, per system, from which on comparing all of them is less work
    FEW = 1 / 150

    def __init__(self, spaces, systems, carry):
        self.spaces, self.systems, self.carry = spaces, systems, carry

    def start(self, q):
        truth, gaps = _truth(self.spaces, q)
        fused = [settle(s.fuse(q, truth, gaps)) for s in self.systems]
        bars = None
        if sieve.suits(self.spaces):
            bars = [s.bars(self.spaces, q, truth, t) for s, t in zip(self.systems, fused)]
            bars = None if any(b is None for b in bars) else np.minimum.reduce(bars)
        return {
            "truth": fused,
            "sims": truth,
            "bars": bars,
            "better": np.zeros((len(self.systems), q["_n"]), dtype=np.int64),
            "n": 0,
            "dense": None,
        }

    def update(self, state, q, g):
        if state["dense"] is None and g["_n"]:
            state["dense"] = state["bars"] is None or self._many(state, q, g)
        if state["dense"]:
            scores = None
            if all((np.isfinite(t) | (t == -np.inf)).all() for t in state["truth"]):
                scores = sieve.Dense.of(self.systems, self.spaces, q, g)
            if scores is not None:
                return self._dense(state, q, g, scores)
        found = None if state["bars"] is None else sieve.sift(q, g, self.spaces, state["bars"])
        if found is None:
            return self._all_pairs(state, q, g)
        rows, cols, values, errors = found
        other = g["id"][cols] != q["truth"][rows]
        rows, cols, values = rows[other], cols[other], [v[other] for v in values]
        gaps = sieve.gaps_of(self.spaces, q, g, rows, cols)
        sims, slips = sieve.rough(self.spaces, q, g, rows, cols, values, errors)
        for i, system in enumerate(self.systems):
            truth = state["truth"][i]
            if not system.sums:
                close = np.flatnonzero(system.most(sims, slips) >= truth[rows] - sieve.TIE)
            else:
                columns, own = system.pair_columns(q, rows), truth[rows]
                fused = system.fuse(columns, sims, gaps)
                slip = system.slip(columns, slips) + sieve.TIE
                ahead = fused > own + slip
                state["better"][i] += np.bincount(rows[ahead], minlength=q["_n"])
                close = np.flatnonzero((fused >= own - slip) & ~ahead)
            if len(close):
                r, c = rows[close], cols[close]
                true_sims = sieve.exact(self.spaces, q, g, r, c)
                part = [None if gap is None else gap[close] for gap in gaps]
                score, own = settle(system.fuse(system.pair_columns(q, r), true_sims, part)), truth[r]
                first = (score > own) | ((score == own) & (g["id"][c] < q["truth"][r]))
                state["better"][i] += np.bincount(r[first], minlength=q["_n"])
        state["n"] += g["_n"]
        return state

    def _many(self, state, q, g):
        """Do many of the first rows reach the truth's score in some space?"""
        few = {n: v[: self.PROBE] for n, v in g.items() if isinstance(v, np.ndarray)} | {"_n": min(self.PROBE, g["_n"])}
        found = sieve.sift(q, few, self.spaces, state["bars"])
        return found is None or len(found[0]) > len(self.systems) * self.FEW * q["_n"] * few["_n"]

    def _dense(self, state, q, g, scores):
        n = q["_n"]
        lost = [t == -np.inf for t in state["truth"]]
        low, high = [], []
        for t, gone, scale, slip in zip(state["truth"], lost, scores.scales, scores.slips):
            slip = slip + sieve.TIE
            low.append(np.where(gone, np.float32(np.inf), sieve.below((t - slip) / scale)))
            high.append(np.where(gone, np.float32(np.inf), sieve.above((t + slip) / scale)))
        room = np.zeros((2, sieve.STEP, -(-n // 8) * 8), bool)
        close = [[] for _ in self.systems]
        for i, at, score in scores.tiles():
            near, ahead = room[:, : len(score)]
            np.greater_equal(score, low[i], out=near[:, :n])
            np.greater(score, high[i], out=ahead[:, :n])
            # fewer than 256 rows, so a byte holds their count
            state["better"][i] += np.add.reduce(ahead.view(np.uint8), axis=0, dtype=np.uint8)[:n]
            near ^= ahead
            cols, rows = sieve.marked(near)
            if len(rows):
                close[i].append((rows, cols + at))
        for i, (system, truth) in enumerate(zip(self.systems, state["truth"])):
            if close[i]:
                r, c = (np.concatenate(x) for x in zip(*close[i]))
                other = g["id"][c] != q["truth"][r]
                self._settle(state, i, q, g, r[other], c[other])
            if lost[i].any():
                self._lost(state, i, q, g, np.flatnonzero(lost[i]))
        state["n"] += g["_n"]
        return state

    def _lost(self, state, i, q, g, rows):
        """Truths that do not compete: all rows that do are ahead, and of the others those with a smaller id."""
        few = {n: v[rows] for n, v in q.items() if isinstance(v, np.ndarray)} | {"_n": len(rows)}
        asked, lacking = [], []
        for w, space in zip(self.systems[i].weights, self.spaces):
            if isinstance(w, str) or w != 0:
                lacking.append(g.get(f"_null_{space.g}", np.zeros(g["_n"], bool)))
                asked.append(space._asks(few) & (few[w] != 0 if isinstance(w, str) else True))
        alike, kind = np.unique(np.array(asked).T, axis=0, return_inverse=True)
        for k, spaces in enumerate(alike):
            out = np.logical_or.reduce([x for x, on in zip(lacking, spaces) if on] or [np.zeros(g["_n"], bool)])
            own, ids, rest = rows[kind.ravel() == k], np.sort(g["id"][out]), g["id"][~out]
            truth = q["truth"][own]
            state["better"][i][own] += len(rest) - np.isin(truth, rest) + np.searchsorted(ids, truth)

    def _settle(self, state, i, q, g, r, c):
        """Count those of the pairs that are ahead of the truth by exact scores."""
        sims, gaps = sieve.exact(self.spaces, q, g, r, c), sieve.gaps_of(self.spaces, q, g, r, c)
        system, own = self.systems[i], state["truth"][i][r]
        score = settle(system.fuse(system.pair_columns(q, r), sims, gaps))
        first = (score > own) | ((score == own) & (g["id"][c] < q["truth"][r]))
        state["better"][i] += np.bincount(r[first], minlength=q["_n"])

    def _all_pairs(self, state, q, g):
        sims, gaps = _tile(self.spaces, q, g)
        own = _places_of(q["truth"], g["id"])
        for i, system in enumerate(self.systems):
            fused = np.array(system.fuse(q, sims, gaps))
            fused[own] = -np.inf
            truth = state["truth"][i]
            ahead = fused > truth[:, None] + SLACK
            close = fused >= truth[:, None] - SLACK
            close &= ~ahead
            better = ahead.sum(axis=1)
            rows, cols = np.nonzero(close)
            if len(rows):
                score = settle(fused[rows, cols])
                tied = (score == truth[rows]) & (g["id"][cols] < q["truth"][rows])
                first = (score > truth[rows]) | tied
                better += np.bincount(rows[first], minlength=q["_n"])
            state["better"][i] += better
        state["n"] += g["_n"]
        return state

    def finish(self, state, q):
        m, n = len(self.systems), q["_n"]
        out = {"system": np.repeat([s.name for s in self.systems], n).astype(object)}
        out |= _tiled(q, ["qid", "truth", *self.carry], m)
        out["s_truth"] = np.concatenate(state["truth"])
        for space, s in zip(self.spaces, state["sims"]):
            out[f"gt_sim_{space.name}"] = np.tile(s, m)
        out["better"] = state["better"].reshape(-1)
        out["seen"] = np.full(m * n, state["n"], dtype=np.int64)
        return out


def truth_ranks(
    queries: DataFrame,
    gallery: DataFrame,
    spaces=CLIP_CLAP,
    systems=(EQUAL,),
    carry=(),
    limits: Limits | None = None,
) -> DataFrame:
    """(system, qid, truth, *carry, s_truth, gt_sim_*, rk, n): 1-based truth ranks.

    Nothing is sorted: the rank is one plus the number of rows that beat the
    truth.  Queries whose truth is not in the gallery drop out.  Rows that do
    not compete for want of a vector rank behind all others, by id; a truth
    among them has s_truth -inf.
    """
    carry = [c for c in carry if c not in ("qid", "truth")]
    q = _query_columns(queries, spaces, systems, ["truth", *carry])
    g = _gallery_columns(gallery, spaces)
    gt_sims = [f"gt_sim_{s.name}" for s in spaces]
    schema = StructType(
        [StructField("system", StringType())]
        + _fields(q, ["qid", "truth", *carry])
        + _double("s_truth", *gt_sims)
        + _long("better", "seen")
    )
    values = {"s_truth": "max", **{c: "max" for c in gt_sims}, "better": "sum", "seen": "sum"}
    merged = block_join(
        q, g, TruthRank(spaces, systems, carry), schema,
        q_key=["qid"], g_key=["id"], truth=vectors_of(spaces),
        merge=Merge(("system",), ("qid", "truth", *carry), values), limits=limits,
    )
    return merged.select(
        "system", "qid", "truth", *carry, "s_truth", *gt_sims,
        (F.col("better") + 1).alias("rk"), F.col("seen").alias("n"),
    )


def truth_scores(
    queries: DataFrame, gallery: DataFrame, spaces=CLIP_CLAP, systems=(EQUAL,)
) -> DataFrame:
    """(system, qid, s_truth) as in ``truth_ranks``, by an equi-join without scoring the gallery."""
    q = _query_columns(queries, spaces, systems, ["truth"])
    names = vectors_of(spaces)
    schema = StructType([StructField("system", StringType())] + _fields(q, ["qid"]) + _double("s_truth"))
    arrow_schema = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            block = to_block(batch)
            if not block["_n"]:
                continue
            truth, gaps = _truth(spaces, block)
            for system in systems:
                score = settle(system.fuse(block, truth, gaps))
                arrays = [[system.name] * block["_n"], block["qid"], score]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, type=f.type) for a, f in zip(arrays, arrow_schema)], schema=arrow_schema
                )

    return with_truth(q, _gallery_columns(gallery, spaces), names).mapInArrow(run, schema)


class ScoreStats:
    """Per query and space: count, sum, sum of squares, min, max of all scores.

    Without the ends (min, max) large tiles go through single precision: sums of cosines come from sums and Gram
    matrices, counts from scores with a bound of their error and exact ones near a threshold.
    """

    def __init__(self, spaces, exclude=None, thresholds=(), ends=True):
        self.spaces, self.exclude, self.thresholds, self.ends = spaces, exclude, thresholds, ends

    def start(self, q):
        n, m = q["_n"], len(self.spaces)
        return {
            "n": np.zeros((m, n), dtype=np.int64),
            "s1": np.zeros((m, n)),
            "s2": np.zeros((m, n)),
            "lo": np.full((m, n), np.inf),
            "hi": np.full((m, n), -np.inf),
            "above": np.zeros((len(self.thresholds), m, n), dtype=np.int64),
        }

    def update(self, state, q, g):
        left = []
        for i, space in enumerate(self.spaces):
            scores = self._single(space, q, g)
            if scores is None:
                left.append(i)
            elif space.metric == "cosine":
                self._cosines(state, i, q, g, scores)
            else:
                self._angles(state, i, q, g, scores)
        return self._all_pairs(state, q, g, left) if left else state

    def _single(self, space, q, g):
        if self.ends or self.exclude is not None or g["_n"] < sieve.MANY or space.factor or not space.scale / space.tau > 0:
            return None
        if f"_null_{space.q}" in q or f"_null_{space.g}" in g:
            return None
        if space.metric != "cosine" and (space.metric != "angular" or self.thresholds):
            return None
        return sieve.Dense.of([System("s", (1,))], [Space("s", space.q, space.g)], q, g)

    def _cosines(self, state, i, q, g, scores):
        space, n = self.spaces[i], q["_n"]
        c, slip = space.scale / space.tau, scores.slips[0].max() + sieve.TIE
        a, kept = q[space.q], f"_gram_{space.g}"
        if kept not in g:
            g[kept] = g[space.g].sum(axis=0), g[space.g].T @ g[space.g]
        state["n"][i] += g["_n"]
        state["s1"][i] += c * (a @ g[kept][0])
        state["s2"][i] += c * c * np.einsum("ij,ij->i", a @ g[kept][1], a)
        cuts = [(sieve.below(np.float64(t / c - slip)), sieve.above(np.float64(t / c + slip))) for t in self.thresholds]
        room = np.zeros((2, sieve.STEP, -(-n // 8) * 8), bool)
        close = [[] for _ in cuts]
        for _, at, score in scores.tiles() if cuts else ():
            near, ahead = room[:, : len(score)]
            for j, (low, high) in enumerate(cuts):
                np.greater_equal(score, low, out=near[:, :n])
                np.greater(score, high, out=ahead[:, :n])
                # fewer than 256 rows, so a byte holds their count
                state["above"][j, i] += np.add.reduce(ahead.view(np.uint8), axis=0, dtype=np.uint8)[:n]
                near ^= ahead
                cols, rows = sieve.marked(near)
                close[j].append((rows, cols + at))
        for j, t in enumerate(self.thresholds):
            r, k = (np.concatenate(x) for x in zip(*close[j]))
            over = settle(sieve.exact([space], q, g, r, k)[0]) > t
            state["above"][j, i] += np.bincount(r[over], minlength=n)

    def _angles(self, state, i, q, g, scores):
        space, n = self.spaces[i], q["_n"]
        c = space.scale / space.tau
        room = np.zeros((sieve.STEP, -(-n // 8) * 8), bool)
        kept = np.empty((2, min(sieve.STEP, scores.n), n), np.float32)
        # asin(x) = x, whose sum needs no pairs, and a small rest
        s1, s2 = q[space.q] @ g[space.g].sum(axis=0), np.zeros(n)
        for _, at, score in scores.tiles():
            rest, square = kept[:, : len(score)]
            sieve.arc_rest(score, rest, square)
            near = room[: len(score)]
            np.greater(square, np.float32(sieve.FLAT), out=near[:, :n])
            cols, rows = sieve.marked(near)
            x = np.einsum("ij,ij->i", q[space.q][rows], g[space.g][cols + at])
            right = np.arcsin(np.clip(x, -1.0, 1.0))
            rest[cols, rows] = 0.0
            whole = np.add(score, rest, out=square)
            whole[cols, rows] = 0.0
            s1 += sieve.column_sums(rest) + np.bincount(rows, right - x, n)
            s2 += sieve.column_sums(np.multiply(whole, whole, out=square)) + np.bincount(rows, right * right, n)
        state["n"][i] += g["_n"]
        state["s1"][i] += c * (0.5 * g["_n"] + s1 / np.pi)
        state["s2"][i] += c * c * (0.25 * g["_n"] + s1 / np.pi + s2 / np.pi**2)

    def _all_pairs(self, state, q, g, only):
        others = None
        if self.exclude is not None:
            others = q[self.exclude][:, None] != g["id"][None, :]
        for i in only:
            space = self.spaces[i]
            s, gap, keep = settle(space.scores(q, g)), space.gap(q, g), others
            if gap is not None:
                keep = ~gap if keep is None else keep & ~gap
            if keep is None:
                state["n"][i] += s.shape[1]
                z = s
                lo = hi = s
            else:
                state["n"][i] += keep.sum(axis=1)
                z = np.where(keep, s, 0.0)
                lo, hi = np.where(keep, s, np.inf), np.where(keep, s, -np.inf)
            state["s1"][i] += z.sum(axis=1)
            state["s2"][i] += (z * z).sum(axis=1)
            state["lo"][i] = np.minimum(state["lo"][i], lo.min(axis=1))
            state["hi"][i] = np.maximum(state["hi"][i], hi.max(axis=1))
            for j, t in enumerate(self.thresholds):
                over = s > t
                if keep is not None:
                    over &= keep
                state["above"][j, i] += over.sum(axis=1)
        return state

    def finish(self, state, q):
        m, n = len(self.spaces), q["_n"]
        out = {"space": np.repeat([s.name for s in self.spaces], n).astype(object)}
        out |= _tiled(q, ["qid"], m)
        for name in ("n", "s1", "s2", "lo", "hi"):
            out[name] = state[name].reshape(-1)
        for j in range(len(self.thresholds)):
            out[f"above_{j}"] = state["above"][j].reshape(-1)
        return out


class BestScore:
    """Per query and space: the best of all scores, -inf where no row competes."""

    FIRST = 256

    def __init__(self, spaces):
        self.spaces = spaces

    def start(self, q):
        return np.full((len(self.spaces), q["_n"]), -np.inf)

    def update(self, state, q, g):
        if (state == -np.inf).any():
            first = {n: v[: self.FIRST] for n, v in g.items() if isinstance(v, np.ndarray)}
            self._all_pairs(state, q, first | {"_n": min(self.FIRST, g["_n"])}, self.spaces)
        for hi, space in zip(state, self.spaces):
            # a query without the vector scores zero with every row, which the first rows have shown
            bar = np.where(space._asks(q), hi, np.inf)
            found = sieve.sift(q, g, [space], [bar]) if sieve.suits([space]) else None
            if found is None:
                self._all_pairs(hi[None, :], q, g, [space])
                continue
            rows, cols = found[0], found[1]
            score = settle(sieve.exact([space], q, g, rows, cols)[0])
            gap = sieve.gaps_of([space], q, g, rows, cols)[0]
            np.maximum.at(hi, rows, score if gap is None else np.where(gap, -np.inf, score))
        return state

    def _all_pairs(self, state, q, g, spaces):
        for hi, space in zip(state, spaces):
            s, gap = settle(space.scores(q, g)), space.gap(q, g)
            s = s if gap is None else np.where(gap, -np.inf, s)
            np.maximum(hi, s.max(axis=1, initial=-np.inf), out=hi)

    def finish(self, state, q):
        out = {"space": np.repeat([s.name for s in self.spaces], q["_n"]).astype(object), "hi": state.reshape(-1)}
        return out | _tiled(q, ["qid"], len(self.spaces))


def best_scores(queries: DataFrame, gallery: DataFrame, spaces=CLIP_CLAP, limits: Limits | None = None) -> DataFrame:
    """(space, qid, hi): the best score of a query, as in ``score_stats``; NULL if no row competes."""
    q, g = _query_columns(queries, spaces, ()), _gallery_columns(gallery, spaces)
    schema = StructType([StructField("space", StringType()), *_fields(q, ["qid"]), *_double("hi")])
    merged = block_join(
        q, g, BestScore(spaces), schema, q_key=["qid"], g_key=["id"],
        merge=Merge(("space",), ("qid",), {"hi": "max"}), limits=limits,
    )
    return merged.select("space", "qid", F.when(F.col("hi") > -np.inf, F.col("hi")).alias("hi"))


def score_stats(
    queries: DataFrame,
    gallery: DataFrame,
    spaces=CLIP_CLAP,
    exclude: str | None = None,
    thresholds=(),
    limits: Limits | None = None,
    ends: bool = True,
) -> DataFrame:
    """(space, qid, n, s1, s2, lo, hi, above_*): summary of all scores of a query.

    Gallery rows without a vector in the space are not counted; lo and hi are
    NULL where n is 0, and left out without ``ends``, which is less work.
    """
    q = _query_columns(queries, spaces, (), [exclude] if exclude else [])
    g = _gallery_columns(gallery, spaces)
    above = [f"above_{j}" for j in range(len(thresholds))]
    schema = StructType(
        [StructField("space", StringType())]
        + _fields(q, ["qid"])
        + _long("n")
        + _double("s1", "s2", "lo", "hi")
        + _long(*above)
    )
    values = {"n": "sum", "s1": "sum", "s2": "sum", "lo": "min", "hi": "max", **{c: "sum" for c in above}}
    merged = block_join(
        q, g, ScoreStats(spaces, exclude, tuple(thresholds), ends), schema,
        q_key=["qid"], g_key=["id"], merge=Merge(("space",), ("qid",), values), limits=limits,
    )
    return merged.select(
        "space", "qid", "n", "s1", "s2",
        *[F.when(F.col("n") > 0, F.col(c)).alias(c) for c in ("lo", "hi") if ends], *above,
    )


class ExpSum:
    """Per (system, query) and temperature: sum of exp((s - s_truth)/tau) over all / positive rows.

    Plain cosine scores go through single precision: the exponents are rounded one by one (vectors are divided by the
    temperature before they are rounded, what is lost on a query's own terms is made good), so errors of the pairs do not add up.
    Tiles of few rows are summed in double precision.
    """

    #: exponents up to this stay far inside the range of single precision
    LARGEST = 60.0

    def __init__(self, spaces, systems, taus, same=None):
        self.spaces, self.systems, self.same = spaces, systems, same
        self.taus = tuple(taus) if isinstance(taus, (tuple, list)) else (taus,)
        #: base -> places of the temperatures whose exponents are its own times a number that rounding leaves as it is
        self.shared = {}
        for j, tau in sorted(enumerate(self.taus), key=lambda x: -x[1]):
            base = next((b for b in self.shared if sieve.held(round(b / tau, 12)) and abs(b - round(b / tau, 12) * tau) < 1e-15), tau)
            self.shared.setdefault(base, []).append(j)

    def start(self, q):
        truth, gaps = _truth(self.spaces, q)
        shape = (len(self.taus), len(self.systems), q["_n"])
        return {
            "truth": [s.fuse(q, truth, gaps) for s in self.systems],
            "all": np.zeros(shape),
            "pos": np.zeros(shape),
            "scaled": {},
        }

    def update(self, state, q, g):
        scores = self._single(state, q, g)
        if scores is None:
            return self._all_pairs(state, q, g)
        for base, few in scores.items():
            self._dense(state, base, few)
        return state

    def _single(self, state, q, g):
        """base -> scores divided by it; None where double precision is called for."""
        if self.same is not None or g["_n"] < sieve.MANY or not all(np.isfinite(t).all() for t in state["truth"]):
            return None
        if any(f"_null_{s.g}" in g for s in self.spaces):
            return None
        for system in self.systems:  # a constant that is rounded shifts all scores alike
            used = {w for w in system.weights if not isinstance(w, str) and w != 0}
            if len(used) > 1 and not all(map(sieve.held, used)):
                return None
        found = {}
        for base in self.shared:
            if base not in state["scaled"]:
                plain = {n: v for n, v in q.items() if not n.startswith("_single_")}
                state["scaled"][base] = plain | {s.q: q[s.q] / base for s in self.spaces}
            scores = sieve.Dense.of(self.systems, self.spaces, state["scaled"][base], g)
            if scores is None or not all(map(sieve.held, scores.scales)):
                return None
            largest = max((r + np.abs(t) / base).max() for r, t in zip(scores.reach(), state["truth"]))
            if largest * base / min(self.taus) > self.LARGEST:
                return None
            found[base] = scores
        return found

    def _dense(self, state, base, scores):
        own = [(t / base).astype(np.float32) for t in state["truth"]]
        lost = [x - t / base for x, t in zip(own, state["truth"])]
        sums = np.zeros_like(state["all"])
        kept = np.empty((2, min(sieve.STEP, scores.n), scores.width), np.float32)
        for i, _, score in scores.tiles():
            x, e = kept[:, : len(score)]
            np.subtract(sieve.times(score, scores.scales[i], x), own[i][None, :], out=x)
            for j in self.shared[base]:
                np.exp(sieve.times(x, round(base / self.taus[j], 12), e), out=e)
                sums[j, i] += sieve.column_sums(e)
        for j in self.shared[base]:
            for i, missing in enumerate(lost):
                state["all"][j, i] += sums[j, i] * np.exp(missing * (base / self.taus[j])) / (1.0 + sieve.EXP_BIAS)

    def _all_pairs(self, state, q, g):
        """Tile by small tile, so that what is made of the scores stays in a core's cache."""
        parts = split_block({n: v for n, v in g.items() if isinstance(v, np.ndarray)} | {"_n": g["_n"]}, sieve.COLUMNS)
        queries = {n: v for n, v in q.items() if isinstance(v, np.ndarray)} | {"_n": q["_n"]}
        for k, few in enumerate(split_block(queries, sieve.ROWS)):
            rows = slice(k * sieve.ROWS, (k + 1) * sieve.ROWS)
            view = {"truth": [t[rows] for t in state["truth"]], "all": state["all"][..., rows], "pos": state["pos"][..., rows]}
            for part in parts:
                self._add(view, few, part)
        return state

    def _add(self, state, q, g):
        sims, gaps = _tile(self.spaces, q, g)
        same = None
        if self.same is not None:
            same = q[self.same][:, None] == g[self.same][None, :]
        for i, system in enumerate(self.systems):
            fused = system.fuse(q, sims, gaps)
            lost = None if all(gap is None for gap in gaps) else fused == -np.inf
            with np.errstate(invalid="ignore"):
                above = fused - state["truth"][i][:, None]
            for j, tau in enumerate(self.taus):
                with np.errstate(invalid="ignore"):
                    e = np.exp(above / tau)
                if lost is not None:
                    e = np.where(lost, 0.0, e)
                state["all"][j, i] += e.sum(axis=1)
                if same is not None:
                    state["pos"][j, i] += np.where(same, e, 0.0).sum(axis=1)

    def finish(self, state, q):
        m, n = len(self.systems), q["_n"]
        out = {"system": np.repeat([s.name for s in self.systems], n).astype(object)} | _tiled(q, ["qid"], m)
        for j in range(len(self.taus)):
            out |= {f"e_{j}": state["all"][j].reshape(-1), f"p_{j}": state["pos"][j].reshape(-1)}
        return out


def exp_sums_of(
    queries, gallery, taus, spaces=CLIP_CLAP, systems=(EQUAL,), same=None, limits=None
) -> DataFrame:
    """(system, qid, e_*, p_*): the sums of ``exp_sums`` for every temperature, in one pass."""
    extra = ["truth"] + ([same] if same else [])
    q = _query_columns(queries, spaces, systems, extra)
    g = _gallery_columns(gallery, spaces, [same] if same else [])
    names = [f"{n}_{j}" for j in range(len(taus)) for n in "ep"]
    schema = StructType([StructField("system", StringType()), *_fields(q, ["qid"]), *_double(*names)])
    return block_join(
        q, g, ExpSum(spaces, systems, tuple(taus), same), schema,
        q_key=["qid"], g_key=["id"], truth=vectors_of(spaces),
        merge=Merge(("system",), ("qid",), dict.fromkeys(names, "sum")), limits=limits,
    )


def exp_sums(
    queries, gallery, tau, spaces=CLIP_CLAP, systems=(EQUAL,), same=None, limits=None
) -> DataFrame:
    """(system, qid, e_all, e_pos) with scores shifted by the truth's score.

    ln(e_all) is then the softmax cross entropy of the truth itself; infinite
    where the truth does not compete for want of a vector.
    """
    sums = exp_sums_of(queries, gallery, (tau,), spaces, systems, same, limits)
    return sums.select("system", "qid", F.col("e_0").alias("e_all"), F.col("p_0").alias("e_pos"))


def score_pairs(pairs: DataFrame, queries: DataFrame, gallery: DataFrame, spaces=CLIP_CLAP):
    """Scores of given (qid, id) pairs by two equi-joins; cosine spaces only."""
    from ..functions import vectors as V

    q = queries.select("qid", *unique([s.q for s in spaces]))
    g = gallery.select("id", *unique([s.g for s in spaces]))
    joined = pairs.join(q, "qid").join(g, "id")
    sims = [
        F.round(V.dot(s.q, s.g), SCORE_DECIMALS).alias(f"sim_{s.name}") for s in spaces
    ]
    return joined.select(*pairs.columns, *sims)
