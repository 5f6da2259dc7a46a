"""Why a result ranks where it does: contributions, gate decision, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fusion import MODALITY_NAMES, WEIGHTS, dominant, spread

_SIMS = ("sim_v", "sim_t", "sim_a")


def contributions(top: DataFrame, weights: DataFrame) -> DataFrame:
    """Per result: weight times similarity per modality, total and percentages."""
    joined = top.join(weights.select("qid", *WEIGHTS), "qid")
    parts = {m: F.col(w) * F.col(s) for m, w, s in zip(MODALITY_NAMES, WEIGHTS, _SIMS)}
    total = parts["visual"] + parts["caption"] + parts["audio"]
    out = joined.select(
        "qid", "id", "rk", *WEIGHTS,
        *[p.alias(f"{m}_score") for m, p in parts.items()],
        total.alias("fused_score"),
    )
    for m in MODALITY_NAMES:
        pct = F.when(
            F.col("fused_score") > 0, 100.0 * F.col(f"{m}_score") / F.col("fused_score")
        ).otherwise(F.lit(0.0))
        out = out.withColumn(f"{m}_pct", pct)
    return out


def gate_decision(weights: DataFrame) -> DataFrame:
    return weights.select(
        "qid", *WEIGHTS,
        dominant().alias("dominant"),
        F.greatest(*WEIGHTS).alias("dominant_weight"),
        spread().alias("spread"),
    )


def ranking_differences(contrib: DataFrame) -> DataFrame:
    """Each result against the next one: deltas and the modality that decides."""
    w = Window.partitionBy("qid").orderBy("rk")
    step = lambda c: F.col(c) - F.lead(c).over(w)
    out = contrib.select(
        "qid", "rk", "id",
        F.lead("id").over(w).alias("next_id"),
        step("fused_score").alias("fused_delta"),
        *[step(f"{m}_score").alias(f"{m}_delta") for m in MODALITY_NAMES],
    ).filter("next_id is not null")
    v, c, a = (F.abs(F.col(f"{m}_delta")) for m in MODALITY_NAMES)
    deciding = (
        F.when((v >= c) & (v >= a), MODALITY_NAMES[0])
        .when(c >= a, MODALITY_NAMES[1])
        .otherwise(MODALITY_NAMES[2])
    )
    deciding_delta = (
        F.when(deciding == MODALITY_NAMES[0], F.col("visual_delta"))
        .when(deciding == MODALITY_NAMES[1], F.col("caption_delta"))
        .otherwise(F.col("audio_delta"))
    )
    return out.withColumn("deciding", deciding).withColumn("deciding_delta", deciding_delta)


def format_explanations(contrib: DataFrame, k: int) -> DataFrame:
    """(qid, text): the published text block, one per query.

    Only the k rows of a query meet in one group.
    """
    # The published output lines
    line = F.concat_ws(
        "\n",
        F.format_string("  %d. %s  score=%.4f", "rk", F.col("id").cast("string"), "fused_score"),
        *[
            F.format_string(f"       {m}=%.4f (%.1f%%)", f"{m}_score", f"{m}_pct")
            for m in MODALITY_NAMES
        ],
    )
    blocks = contrib.withColumn("_line", line).groupBy("qid", *WEIGHTS).agg(
        F.concat_ws(
            "\n",
            F.transform(
                F.array_sort(F.collect_list(F.struct("rk", "_line"))), lambda x: x["_line"]
            ),
        ).alias("_body")
    )
    head = F.concat_ws(
        "\n",
        F.format_string("Gating weights: [visual=%.4f, caption=%.4f, audio=%.4f]", *WEIGHTS),
        F.format_string(
            "Dominant modality: %s (%.2f, spread=%.2f)",
            dominant(), F.greatest(*WEIGHTS), spread(),
        ),
        F.lit(""),
        F.lit(f"Top-{k} results:"),
    )
    first = ranking_differences(contrib).filter("rk = 1")
    tail = first.select(
        "qid",
        F.format_string(
            "  Rank1 vs Rank2: deciding modality = %s (Δ=%.4f)", "deciding", "deciding_delta"
        ).alias("_tail"),
    )
    return blocks.join(tail, "qid", "left").select(
        "qid", F.concat_ws("\n", head, "_body", "_tail").alias("text")
    )
