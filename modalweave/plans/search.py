"""Search: a table of queries of any kind against an index, with explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import vectors as V
from ..operators import explain
from ..operators.blocks import CLIP_CLAP
from ..operators.curate import complete_ids
from ..operators.fusion import GATED, constant_gate, mask_and_renormalize
from ..operators.gates import gate_mlp
from ..operators.scoring import score_top_k
from ..session import materialize

# Logits of the constant gate used when none is given.
EQUAL_LOGITS = (0.0, 0.0, 0.0)


def search_index(stores: dict[str, DataFrame], ids: DataFrame | None = None) -> DataFrame:
    """(id, visual, caption, audio), unit vectors, complete ids only."""
    index = complete_ids(stores, ids)
    for name in stores:
        index = index.withColumn(name, V.l2_normalize(name))
    return index


def weigh(queries: DataFrame, gate=None, on_empty: str = "raise") -> DataFrame:
    """Gate weights per query: MLP parameters (a dict), three logits, or equal."""
    if isinstance(gate, dict):
        weighted = gate_mlp(queries, gate)
    else:
        weighted = constant_gate(queries, gate or EQUAL_LOGITS)
    return mask_and_renormalize(weighted, on_empty=on_empty)


def search(
    queries: DataFrame,
    index: DataFrame,
    gate=None,
    k: int = 5,
    spaces=CLIP_CLAP,
    on_empty: str = "raise",
    limits=None,
) -> dict[str, DataFrame]:
    """Results, contributions, gate decisions and rank differences of every query.

    The index is scored once: the k hits of every query are written, and all
    results but the weights and decisions start from that table.
    The kind of a query only decides which of its vectors are NULL; the metric
    is that of ``spaces``, the same in tuning and in serving.
    """
    weighted = weigh(queries, gate, on_empty)
    top = materialize(score_top_k(weighted, index, k, spaces, (GATED,), limits=limits), "hits")
    contrib = explain.contributions(top, weighted)
    return {
        "weights": weighted,
        "results": contrib,
        "decisions": explain.gate_decision(weighted),
        "differences": explain.ranking_differences(contrib),
        "text": explain.format_explanations(contrib, k),
    }
