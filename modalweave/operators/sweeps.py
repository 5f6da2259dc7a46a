"""Sweeps of constant fusion weights: all combinations in one pass over the tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..session import materialize
from . import sieve
from .blocks import SLACK, angular_spaces, block_join, settle
from .scoring import _fields, _gallery_columns, _places_of, _query_columns, vectors_of


class SweepRank:
    """Gallery rows ahead of the truth, per query and weight combination.

    Weights are not negative, so a row behind the truth in every modality is
    behind it under any combination; only the other rows are compared.
    """

    def __init__(self, spaces, combos, most: int = 10):
        self.spaces, self.combos, self.most = spaces, np.asarray(combos, dtype=float), most
        if most > 255:
            raise ValueError("counts of more than 255 do not fit a byte")
        if (self.combos < 0).any():
            raise ValueError("fusion weights must not be negative")

    def start(self, q):
        truth = [s.truth(q) for s in self.spaces]
        lost = [s.truth_gap(q) for s in self.spaces]
        bars = None
        if sieve.suits(self.spaces):
            least = np.where(self.combos > 0, self.combos, np.inf).min(axis=0)
            bars = np.full((len(self.spaces), q["_n"]), np.inf)
            for bar, s, t, w in zip(bars, self.spaces, truth, least):
                used = s._asks(q) & (w < np.inf)
                bar[used] = t[used] - sieve.TIE / w
            # a combination may leave only spaces in which all rows tie
            asked = np.stack([s._asks(q) for s in self.spaces])
            idle = ((self.combos > 0).astype(float) @ asked == 0).any(axis=0)
            gone = np.logical_or.reduce([x for x in lost if x is not None], initial=False)
            bars[0, idle | gone | ~np.isfinite(np.stack(truth)).all(axis=0)] = -np.inf
        return {
            "truth": truth, "lost": lost, "bars": bars,
            "ahead": np.zeros((len(self.combos), q["_n"]), dtype=np.int64),
        }

    def update(self, state, q, g):
        """Combinations are taken in groups of near ones.

        The weights of a group lie in a box, which bounds the lead of a row over the
        truth for all of them; only rows whose lead may change its sign within the
        box are compared combination by combination.
        """
        found = None if state["bars"] is None else sieve.sift(q, g, self.spaces, state["bars"])
        if found is None:
            return self._all_pairs(state, q, g)
        rows, cols, values, errors = found
        other = g["id"][cols] != q["truth"][rows]
        rows, cols, values = rows[other], cols[other], [v[other] for v in values]
        sims, slips = sieve.rough(self.spaces, q, g, rows, cols, values, errors)
        least, most = self.combos.min(axis=0), self.combos.max(axis=0)
        lead = [s - t[rows] for s, t in zip(sims, state["truth"])]
        reach = sum(np.maximum(lo * d, hi * d) + hi * e for lo, hi, d, e in zip(least, most, lead, slips))
        free = self._free(state, q, g, rows, cols)
        may = np.flatnonzero((reach >= -sieve.TIE) | free)
        rows, cols, free = rows[may], cols[may], free[may]
        sims = sieve.exact(self.spaces, q, g, rows, cols)
        gaps = sieve.gaps_of(self.spaces, q, g, rows, cols)
        lead = [s - t[rows] for s, t in zip(sims, state["truth"])]
        for group in self._groups():
            least, most = self.combos[group].min(axis=0), self.combos[group].max(axis=0)
            top = sum(np.maximum(lo * d, hi * d) for lo, hi, d in zip(least, most, lead))
            low = sum(np.minimum(lo * d, hi * d) for lo, hi, d in zip(least, most, lead))
            always = (low > sieve.TIE) & ~free
            state["ahead"][group] += np.bincount(rows[always], minlength=q["_n"])
            open_ = np.flatnonzero(((top >= -sieve.TIE) & ~always) | free)
            part = [None if gap is None else gap[open_] for gap in gaps]
            self._compare(state, q, g, group, rows[open_], cols[open_], [s[open_] for s in sims], part)
        return state

    def _free(self, state, q, g, rows, cols):
        """Pairs that no box decides: a vector is missing, or a score is not a number."""
        free = ~np.isfinite(np.stack(state["truth"])).all(axis=0)[rows]
        for gap in sieve.gaps_of(self.spaces, q, g, rows, cols):
            if gap is not None:
                free |= gap
        for gone in state["lost"]:
            if gone is not None:
                free |= gone[rows]
        return free

    def _groups(self):
        order = np.lexsort((self.combos[:, 0], self.combos[:, 2]))
        return [order[lo : lo + 16] for lo in range(0, len(order), 16)]

    def _compare(self, state, q, g, group, rows, cols, scores, gaps):
        """Count the pairs ahead of the truth, for each combination of the group."""
        earlier = g["id"][cols] < q["truth"][rows]
        lost = [None if gap is None else gap[rows] for gap in state["lost"]]
        own = [t[rows] for t in state["truth"]]
        for i, w in zip(group, self.combos[group]):
            fused = settle(sum(wi * s for wi, s in zip(w, scores)))
            gt = settle(sum(wi * t for wi, t in zip(w, own)))
            for wi, gap, gone in zip(w, gaps, lost):
                if wi and gap is not None:
                    fused = np.where(gap, -np.inf, fused)
                if wi and gone is not None:
                    gt = np.where(gone, -np.inf, gt)
            ahead = (fused > gt) | ((fused == gt) & earlier)
            state["ahead"][i] += np.bincount(rows[ahead], minlength=q["_n"])

    def _all_pairs(self, state, q, g):
        sims = [s.scores(q, g) for s in self.spaces]
        near = np.zeros(sims[0].shape, dtype=bool)
        gaps = [s.gap(q, g) for s in self.spaces]
        for s, t, gap, lost in zip(sims, state["truth"], gaps, state["lost"]):
            close = s >= t[:, None] - SLACK
            near |= close if gap is None else close & ~gap
            if lost is not None:  # a truth without this vector can be beaten by any row
                near[lost] = True
        near[_places_of(q["truth"], g["id"])] = False
        rows, cols = np.nonzero(near)
        scores = [s[rows, cols] for s in sims]
        gaps = [None if gap is None else gap[rows, cols] for gap in gaps]
        self._compare(state, q, g, np.arange(len(self.combos)), rows, cols, scores, gaps)
        return state

    def finish(self, state, q):
        """One row per query: its counts of all combinations, a byte each, as no more than ``most`` matter."""
        counts = np.minimum(state["ahead"].T, self.most).astype(np.uint8)
        return {"qid": q["qid"], "ahead": [row.tobytes() for row in np.ascontiguousarray(counts)]}


def _hits(partial: DataFrame, combos: int, ks) -> DataFrame:
    """(combo, n, r*): over all queries, how many have their truth among the first k.

    ``partial`` has one row per query and cell. A task adds the counts of its
    queries in order of their ids and hands on one row per combination.
    """
    schema = StructType([StructField(n, LongType()) for n in ("combo", "n", *[f"r{k}" for k in ks])])
    arrow_schema = to_arrow_schema(schema)

    def run(batches):
        hits, n, last, held = np.zeros((len(ks), combos), dtype=np.int64), 0, None, None

        def settled(ahead):
            for hit, k in zip(hits, ks):
                hit += (ahead < k).sum(axis=0)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_pylist()
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(ids), combos)
            starts = [i for i, x in enumerate(ids) if i == 0 or x != ids[i - 1]]
            sums = np.add.reduceat(rows, starts, axis=0, dtype=np.int64)
            if held is not None and ids[0] == last:
                sums[0] += held
            elif held is not None:
                settled(held[None, :])
                n += 1
            settled(sums[:-1])
            n += len(sums) - 1
            last, held = ids[-1], sums[-1]
        if held is not None:
            settled(held[None, :])
            n += 1
            columns = [np.arange(combos), np.full(combos, n), *hits]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=arrow_schema)

    dealt = partial.repartition("qid").sortWithinPartitions("qid").select("qid", "ahead")
    return dealt.mapInArrow(run, schema).groupBy("combo").agg(*[F.sum(c).alias(c) for c in schema.names[1:]])


def sweep_recall(
    queries: DataFrame, gallery: DataFrame, combos, ks=(1, 5, 10), spaces=None,
    scale_a: float = 0.8, limits=None,
) -> DataFrame:
    """(w_v, w_t, w_a, r1, r5, r10) for every weight combination."""
    spaces = spaces or angular_spaces()
    scaled = [(v, t, a * scale_a) for v, t, a in combos]
    q = _query_columns(queries, spaces, (), ["truth"])
    g = _gallery_columns(gallery, spaces)
    schema = StructType(_fields(q, ["qid"]) + [StructField("ahead", BinaryType())])
    partial = block_join(
        q, g, SweepRank(spaces, scaled, max(ks)), schema, q_key=["qid"], g_key=["id"],
        truth=vectors_of(spaces), limits=limits,
    )
    by_combo = _hits(partial, len(combos), ks).select("combo", *[(F.col(f"r{k}") / F.col("n")).alias(f"r{k}") for k in ks])
    weights = [F.lit([float(c[i]) for c in combos]) for i in range(3)]
    at = (F.col("combo") + 1).cast("int")
    named = [F.element_at(w, at).alias(n) for w, n in zip(weights, ("w_v", "w_t", "w_a"))]
    return by_combo.select(*named, *[f"r{k}" for k in ks])


def thousandths(lo: int, hi: int, step: int):
    """lo, lo+step, ... below hi, in integers so that bounds are exact."""
    return range(lo, hi, step)


def coarse_grid():
    """Published coarse grid: w_a in {.005,.01,.02}, w_v .28-.50 by .005, .4<=w_t<=.7."""
    out = []
    for a in (5, 10, 20):
        for v in thousandths(280, 500, 5):
            t = 1000 - v - a
            if 400 <= t <= 700:
                out.append((v / 1000, t / 1000, a / 1000))
    return out


def train_grid():
    """Published train-selection grid: seven w_a values, w_v .28-.48, .4<=w_t<=.72."""
    out = []
    for a in (0, 2, 5, 8, 10, 15, 20):
        for v in thousandths(280, 480, 5):
            t = 1000 - v - a
            if 400 <= t <= 720:
                out.append((v / 1000, t / 1000, a / 1000))
    return out


def fine_grid(best):
    """Around each best combination: w_a +-.01, w_v +-.03 by .002, .4<=w_t<=.72."""
    out = []
    for bv, _, ba in best:
        v0, a0 = round(bv * 1000), round(ba * 1000)
        for a in thousandths(max(0, a0 - 10), a0 + 11, 2):
            for v in thousandths(v0 - 30, v0 + 31, 2):
                t = 1000 - v - a
                if 400 <= t <= 720:
                    out.append((v / 1000, t / 1000, a / 1000))
    return list(dict.fromkeys(out))


def best_first(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy(F.col("r1").desc(), F.col("w_v"), F.col("w_a"))


def _weights(rows):
    return [(r["w_v"], r["w_t"], r["w_a"]) for r in rows]


def weight_sweep(queries: DataFrame, gallery: DataFrame, limits=None) -> DataFrame:
    """Coarse grid, then a fine grid around its best three; both stages listed.

    Selecting on the queries that are also reported overstates the result;
    ``sweep_train_select`` is the sound form.
    """
    # read twice, a row per combination
    coarse = materialize(sweep_recall(queries, gallery, coarse_grid(), limits=limits), "coarse")
    best3 = _weights(best_first(coarse).limit(3).collect())
    fine = sweep_recall(queries, gallery, fine_grid(best3), limits=limits)
    return coarse.withColumn("stage", F.lit("coarse")).unionByName(
        fine.withColumn("stage", F.lit("fine"))
    )


def sweep_train_select(
    train: DataFrame, test: DataFrame, gallery: DataFrame, test_gallery: DataFrame | None = None,
    n: int = 15, limits=None,
) -> DataFrame:
    """The ``n`` combinations best on train, with their recall on test."""
    on_train = best_first(sweep_recall(train, gallery, train_grid(), limits=limits)).limit(n)
    chosen = on_train.collect()
    train_r1 = F.lit([float(r["r1"]) for r in chosen])
    combos = _weights(chosen)
    on_test = sweep_recall(
        test, gallery if test_gallery is None else test_gallery, combos, limits=limits
    )
    keys = F.lit([f"{v:.3f}/{a:.3f}" for v, _, a in combos])
    place = F.array_position(keys, F.format_string("%.3f/%.3f", "w_v", "w_a")).cast("int")
    return on_test.withColumn("train_r1", F.element_at(train_r1, place))
