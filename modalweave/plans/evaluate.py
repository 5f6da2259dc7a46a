"""Batch evaluation: many fused systems, one pass over the tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.blocks import CLIP_CLAP
from ..operators.curate import drop_unanswerable
from ..operators.fusion import (
    GATED,
    GATED_NO_AUDIO,
    SINGLE,
    TRIPLE,
    equal_systems,
    without_audio,
)
from ..operators.scoring import truth_ranks
from ..session import materialize


def standard_systems(gated: bool = True):
    """Singles, equal pairs, equal triple and, with weights at hand, the gate."""
    return (*SINGLE, *equal_systems(), *((GATED, GATED_NO_AUDIO) if gated else ()))


def rank_table(queries: DataFrame, gallery: DataFrame, systems=None, spaces=CLIP_CLAP,
               carry=("category",), limits=None) -> DataFrame:
    """Truth ranks of all systems; small (systems x queries rows), kept once."""
    systems = systems or standard_systems("w_v" in queries.columns)
    if any("n_v" in s.columns() for s in systems):
        queries = without_audio(queries)
    return truth_ranks(queries, gallery, spaces, systems, carry, limits)


def long_metrics(wide: DataFrame, keys, stratum="all") -> DataFrame:
    """(system, stratum, metric, value) rows of a wide metric table."""
    values = [c for c in wide.columns if c not in keys and c != "stratum"]
    points = F.array(
        *[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values]
    )
    place = F.col("stratum") if "stratum" in wide.columns else F.lit(stratum)
    return wide.select(F.col(keys[0]), place.alias("stratum"), F.explode(points).alias("p")).select(
        F.col(keys[0]).alias("system"), "stratum", "p.*"
    )


def evaluate(queries: DataFrame, gallery: DataFrame, spaces=CLIP_CLAP, bootstrap: bool = False,
             rounds: int = 1000, limits=None) -> dict[str, DataFrame]:
    """The full report of one query table against one gallery."""
    kept, skipped = drop_unanswerable(queries, gallery)
    ranks = materialize(rank_table(kept, gallery, spaces=spaces, limits=limits), "ranks")
    out = {
        "ranks": ranks,
        "skipped": skipped.agg(F.count(F.lit(1)).alias("n_skipped")),
        "systems": M.recall_at_k(ranks),
        "categories": M.by_category(ranks),
        "anchors": M.anchor_comparison(ranks),
    }
    if bootstrap:
        out["intervals"] = M.bootstrap_ci(ranks, rounds=rounds)
    return out
