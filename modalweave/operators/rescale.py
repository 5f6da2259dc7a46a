"""Scores put on a common scale before they are fused."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import vectors as V
from .align import gram
from .scoring import score_top_k


def norm_scores(pairs: DataFrame, gallery: DataFrame, q: str = "q_clap", g: str = "audio") -> DataFrame:
    """(qid, norm, s): the score of each pair divided by the length of its query's score row.

    pairs: queries beside a gallery vector. The length of a query's row of
    scores is sqrt(q' (X'X) q), so no other pair is formed.
    """
    sums = gram(gallery, g).sxx
    own = pairs.select("qid", q, V.dot(q, g).alias("own"))
    turned = A.map_vector(own, q, lambda m: m @ sums, "_turned")
    norm = F.sqrt(V.dot(q, "_turned"))
    return turned.select("qid", norm.alias("norm"), (F.col("own") / norm).alias("s"))


def rank_scores_linear(queries: DataFrame, gallery: DataFrame, k: int, spaces, systems) -> DataFrame:
    """(qid, id, s): the k best rows of each query scored 1 - (rank - 1) / gallery size.

    All places of all queries would be every pair; k is the depth that is fused.
    """
    n = gallery.count()
    top = score_top_k(queries, gallery, k, spaces, systems)
    return top.select("qid", "id", (1.0 - (F.col("rk") - 1) / F.lit(n)).alias("s"))


def adaptive_rescale(
    pairs: DataFrame, queries: DataFrame, gallery: DataFrame, q: str = "q_clap", g: str = "audio",
    mean: float = 0.1, std: float = 0.2,
) -> DataFrame:
    """(qid, s): scores of pairs moved so that all scores have the given mean and sample deviation.

    Mean and deviation over all pairs follow from the Gram sums of both sides.
    """
    one, two = gram(queries, q), gram(gallery, g)
    n = one.n * two.n
    s1, s2 = float(one.sx @ two.sx), float((one.sxx * two.sxx).sum())
    middle, spread = s1 / n, float(np.sqrt((s2 - s1 * s1 / n) / (n - 1)))
    score = V.dot(q, g)
    return pairs.select("qid", ((score - middle) * (std / spread) + mean).alias("s"))
