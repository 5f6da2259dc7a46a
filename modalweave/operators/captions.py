"""Caption matching: a video scores by the best of its captions.

A task keeps, per query, the k best videos of the captions it saw.  A video of
the final top k is among the k best wherever its best caption lies, so the
captions of one video may be spread over any number of tasks and a video with
a third of all captions is no special case.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .blocks import SCORE_DECIMALS, block_join
from .scoring import _fields


class CaptionTopK:
    """Best ``k`` videos per query by maximum caption similarity.

    With ``loo`` the query's own caption does not count for its own video; a
    video with no other caption keeps the score -inf.  ``fuse`` adds
    video-level scores: sum of weight * (query column . video column).
    """

    def __init__(self, k, loo=False, caption_weight=1.0, fuse=()):
        self.k, self.loo = k, loo
        self.caption_weight, self.fuse = caption_weight, tuple(fuse)

    def start(self, q):
        return None

    def update(self, state, q, g):
        order = np.lexsort((g["pos"], g["video"]))
        videos = g["video"][order]
        sims = q["vec"] @ g["vec"][order].T
        if self.loo:
            own = (videos[None, :] == q["truth"][:, None]) & (
                g["pos"][order][None, :] == q["own_pos"][:, None]
            )
            sims = np.where(own, -np.inf, sims)
        starts = np.flatnonzero(np.r_[True, videos[1:] != videos[:-1]])
        best = np.maximum.reduceat(sims, starts, axis=1)
        score = best if self.caption_weight == 1.0 else self.caption_weight * best
        for weight, q_col, g_col in self.fuse:
            score = score + weight * (q[q_col] @ g[g_col][order][starts].T)
        score = np.round(score, SCORE_DECIMALS)
        k = min(self.k, len(starts))
        cut = np.partition(score, len(starts) - k, axis=1)[:, -k]
        rows, cols = np.nonzero(score >= cut[:, None])
        return self._merge(state, (rows, videos[starts][cols], score[rows, cols]))

    def _merge(self, old, new):
        if old is not None:
            new = tuple(np.concatenate([a, b]) for a, b in zip(old, new))
        rows, vids, score = new
        order = np.lexsort((-score, vids, rows))
        rows, vids, score = rows[order], vids[order], score[order]
        first = np.r_[True, (rows[1:] != rows[:-1]) | (vids[1:] != vids[:-1])] if len(rows) else []
        rows, vids, score = rows[first], vids[first], score[first]
        order = np.lexsort((vids, -score, rows))
        rows, vids, score = rows[order], vids[order], score[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < self.k
        return rows[keep], vids[keep], score[keep]

    def finish(self, state, q):
        if state is None:
            empty = np.zeros(0, dtype=np.int64)
            return {"qid": q["qid"][empty], "video": empty, "score": np.zeros(0)}
        rows, vids, score = state
        return {"qid": q["qid"][rows], "video": vids, "score": score}


def own_positions(queries: DataFrame, captions: DataFrame) -> DataFrame:
    """Add own_pos: where the query's text stands among its video's captions.

    A text that occurs several times counts at its last position.
    """
    last = captions.groupBy(F.col("video").alias("truth"), "text").agg(
        F.max("pos").alias("own_pos")
    )
    return queries.drop("own_pos").join(last, ["truth", "text"], "left").withColumn(
        "own_pos", F.coalesce("own_pos", F.lit(-1).cast("long"))
    )


def caption_top_k(
    queries: DataFrame, captions: DataFrame, k: int, loo: bool = False,
    caption_weight: float = 1.0, fuse=(), limits=None,
) -> DataFrame:
    """(qid, video, score, rk): the ``k`` best videos of every query.

    ``queries``: qid, truth, own_pos, vec; ``captions``: video, pos, vec.
    """
    q = queries.select("qid", "truth", "own_pos", "vec", *{c for _, c, _ in fuse} - {"vec"})
    g = captions.select("video", "pos", "vec", *{c for _, _, c in fuse} - {"vec"})
    schema = StructType(
        _fields(q, ["qid"]) + _fields(g, ["video"]) + [StructField("score", DoubleType())]
    )
    partial = block_join(
        q, g, CaptionTopK(k, loo, caption_weight, fuse), schema,
        q_key=["qid"], g_key=["video", "pos"], limits=limits,
    )
    best = partial.groupBy("qid", "video").agg(F.max("score").alias("score"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "video")
    return best.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)


def caption_recall(top: DataFrame, queries: DataFrame, ks=(1, 5, 10)) -> DataFrame:
    """Recall@K from top lists; queries whose truth is not listed miss."""
    hit = queries.select("qid", "truth").join(
        top.select("qid", F.col("video").alias("truth"), "rk"), ["qid", "truth"], "left"
    )
    return hit.agg(
        F.count(F.lit(1)).alias("n_queries"),
        *[F.avg(F.coalesce((F.col("rk") <= k).cast("int"), F.lit(0))).alias(f"r{k}") for k in ks],
    )


def caption_success(top: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, success): is the truth the best video?"""
    first = top.filter("rk = 1").select("qid", F.col("video").alias("top1"))
    return queries.select("qid", "truth").join(first, "qid", "left").select(
        "qid", F.coalesce(F.col("top1") == F.col("truth"), F.lit(False)).alias("success")
    )
