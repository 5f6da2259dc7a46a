"""Per-query agreement between systems, and error analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, words
from .metrics import rank_bucket
from .sampling import md5_key


def success(ranks: DataFrame) -> DataFrame:
    return ranks.select("system", "qid", (F.col("rk") == 1).alias("success"))


def _wide(ranks: DataFrame, systems) -> DataFrame:
    """One row per query with a 0/1 success column per system (in one aggregate)."""
    return ranks.groupBy("qid").agg(
        *[
            F.max(F.when(F.col("system") == s, (F.col("rk") == 1).cast("int"))).alias(f"s_{s}")
            for s in systems
        ]
    )


def success_patterns(ranks: DataFrame, systems=("visual", "text", "audio")) -> DataFrame:
    """Contingency table over the systems' success, with margins (NULL = any)."""
    cols = [f"s_{s}" for s in systems]
    wide = _wide(ranks, systems)
    table = wide.cube(*cols).agg(F.count(F.lit(1)).alias("n"))
    # at most 3^systems rows; the grand total is the largest count
    total = F.max("n").over(Window.partitionBy(F.lit(1)))
    return table.select(*cols, "n", (F.col("n") / total).alias("share"))


def gate_only_success(ranks: DataFrame, gate: str = "gated", singles=("visual", "text", "audio")):
    """Queries only the gate solves, and queries it loses that a single modality solves."""
    wide = _wide(ranks, [gate, *singles])
    any_single = F.greatest(*[F.col(f"s_{s}") for s in singles]) == 1
    won = F.col(f"s_{gate}") == 1
    return wide.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(won & ~any_single).alias("gate_only"),
        F.count_if(~won & any_single).alias("gate_lost"),
    )


def agreement(ranks: DataFrame, a: str, b: str) -> DataFrame:
    """(outcome, n, share): both, neither, or only one of two systems succeeds."""
    wide = _wide(ranks, [a, b])
    x, y = F.col(f"s_{a}") == 1, F.col(f"s_{b}") == 1
    outcome = (
        F.when(x & y, "both").when(~x & ~y, "neither").when(x, f"{a}_only").otherwise(f"{b}_only")
    )
    counts = wide.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    # four rows
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def rank_change(ranks: DataFrame, a: str, b: str) -> DataFrame:
    """(change, n): does system ``b`` rank the truth better than ``a``?"""
    wide = ranks.groupBy("qid").agg(
        F.max(F.when(F.col("system") == a, F.col("rk"))).alias("a"),
        F.max(F.when(F.col("system") == b, F.col("rk"))).alias("b"),
    )
    change = (
        F.when(F.col("b") < F.col("a"), "improved")
        .when(F.col("b") == F.col("a"), "unchanged")
        .otherwise("degraded")
    )
    return wide.groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


def loo_gap(standard: DataFrame, loo: DataFrame) -> DataFrame:
    """Recall@1 with and without the query's own caption, drop and leaked share.

    Inputs are (qid, success) of the same queries.
    """
    joined = standard.select("qid", F.col("success").alias("std")).join(
        loo.select("qid", F.col("success").alias("loo")), "qid"
    )
    x, y = F.col("std"), F.col("loo")
    agg = joined.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x.cast("int")).alias("r1_standard"),
        F.avg(y.cast("int")).alias("r1_loo"),
        F.count_if(x & y).alias("both"),
        F.count_if(~x & ~y).alias("neither"),
        F.count_if(x & ~y).alias("standard_only"),
        F.count_if(~x & y).alias("loo_only"),
        F.count_if(x).alias("_won"),
    )
    return (
        agg.withColumn("drop", F.col("r1_standard") - F.col("r1_loo"))
        .withColumn("exact_share", F.col("standard_only") / F.col("_won"))
        .drop("_won")
    )


def failure_class(diagnosis: DataFrame) -> DataFrame:
    """(class, n, mean_rank) from (rk, category, top1_category, noisy).

    The first matching class wins; the mean rank is 0-based.
    """
    # The published class labels
    cls = (
        F.when(F.col("rk") == 1, "A_correct")
        .when(F.col("rk") <= 10, "B_near_miss")
        .when(F.col("category") == F.col("top1_category"), "C_semantic_confusion")
        .when(F.col("noisy"), "E_noisy_pair")
        .otherwise("D_missing_semantics")
    )
    return diagnosis.groupBy(cls.alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("rk") - 1).alias("mean_rank")
    )


def query_length_by_bucket(ranks: DataFrame, texts: DataFrame) -> DataFrame:
    """Mean and population std of the word count per rank bucket, and overall."""
    rows = ranks.join(texts, "qid").select(
        rank_bucket().alias("bucket"), F.size(words("text")).alias("len")
    )
    return rows.rollup("bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("len").alias("mean_len"),
        F.stddev_pop("len").alias("std_len"),
    ).withColumn("bucket", F.coalesce("bucket", F.lit("all")))


def vocab_counts(ranks: DataFrame, texts: DataFrame, stop_words=STOP_WORDS) -> DataFrame:
    """(bucket, word, n): lower-cased words longer than two, stop words dropped."""
    rows = ranks.join(texts, "qid").select(
        rank_bucket().alias("bucket"), F.explode(words(F.lower("text"))).alias("word")
    )
    kept = rows.filter((F.length("word") > 2) & ~F.col("word").isin(list(stop_words)))
    return kept.groupBy("bucket", "word").agg(F.count(F.lit(1)).alias("n"))


def top_words(counts: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy("bucket").orderBy(F.col("n").desc(), "word")
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def vocabulary_difference(counts: DataFrame, a: str, b: str) -> DataFrame:
    """(only_in, word): words of bucket ``a`` that bucket ``b`` lacks, and the other way round."""
    side = lambda name: counts.filter(F.col("bucket") == name).select("word")
    one, two = side(a).subtract(side(b)), side(b).subtract(side(a))
    return one.select(F.lit(a).alias("only_in"), "word").unionByName(two.select(F.lit(b).alias("only_in"), "word"))


def failure_only_words(counts: DataFrame, good="perfect", bad="very_far") -> DataFrame:
    """(side, word, n): words of one bucket that never occur in the other."""
    side = lambda b: counts.filter(F.col("bucket") == b)
    only = lambda a, b, label: side(a).join(side(b).select("word"), "word", "left_anti").select(
        F.lit(label).alias("side"), "word", "n"
    )
    return only(bad, good, "only_in_failures").unionByName(only(good, bad, "only_in_successes"))


def examples(ranks: DataFrame, top1: DataFrame, texts: DataFrame, n: int = 5, seed: int = 42):
    """``n`` seeded sample queries per rank bucket with their text and top result's text."""
    w = Window.partitionBy("bucket").orderBy(md5_key(seed, "qid"), "qid")
    picked = (
        ranks.select("qid", "truth", "rk", rank_bucket().alias("bucket"))
        .withColumn("place", F.row_number().over(w))
        .filter(F.col("place") <= n)
    )
    retrieved = top1.select("qid", F.col("id").alias("top1"))
    own = texts.select("qid", F.col("text").alias("query"))
    other = texts.select(F.col("qid").alias("top1"), F.col("text").alias("top1_text"))
    return picked.join(retrieved, "qid").join(own, "qid").join(other, "top1")


def caption_count_distribution(captions: DataFrame) -> DataFrame:
    """(captions, videos): how many videos have how many captions."""
    per_video = captions.groupBy("video").agg(F.count(F.lit(1)).alias("captions"))
    return per_video.groupBy("captions").agg(F.count(F.lit(1)).alias("videos"))
