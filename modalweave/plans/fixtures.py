"""Views over the given tables in the shape the operators expect.

Pure expressions over whole tables: a gallery with three modality vectors and
a query per item (``embeddings``), a curated manifest (``documents``,
``labels``) and caption rows grouped by video (``embeddings``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V

# Fixed values of the fixture.
HALF = 32
SILENT_ENERGY = 0.42  # audio halves below this energy count as missing tracks


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """One given table; an input with fewer splits than cores is spread out first.

    Tile and text work is heavy per row, so a table in a few files would keep
    most cores idle.  A large table has splits enough and is not shuffled.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def halves(spark: SparkSession, sf_dir: str, spread: bool = True) -> DataFrame:
    """(id, category, e, a, b): each embedding split in two half vectors."""
    e = table(spark, sf_dir, "embeddings", spread).select(
        F.col("vec_id").alias("id"),
        F.col("label").alias("category"),
        V.as_double("embedding").alias("e"),
    )
    return e.select(
        "id", "category", "e",
        F.slice("e", 1, HALF).alias("a"),
        F.slice("e", HALF + 1, HALF).alias("b"),
    )


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, category, visual, caption, audio), unit vectors."""
    return halves(spark, sf_dir).select(
        "id", "category",
        V.l2_normalize("a").alias("visual"),
        V.l2_normalize(V.add("a", "b", 1.0, 0.5)).alias("caption"),
        V.l2_normalize("b").alias("audio"),
    )


def gallery_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gallery, with ``audio`` NULL where the source half is nearly silent."""
    energy = F.aggregate("b", F.lit(0.0), lambda s, x: s + x * x)
    return halves(spark, sf_dir).select(
        "id", "category",
        V.l2_normalize("a").alias("visual"),
        V.l2_normalize(V.add("a", "b", 1.0, 0.5)).alias("caption"),
        F.when(energy >= SILENT_ENERGY, V.l2_normalize("b")).alias("audio"),
    )


def stores(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three keyed vector stores; the audio store misses some ids."""
    g = gallery_with_gaps(spark, sf_dir)
    return {
        name: g.filter(F.col(name).isNotNull()).select("id", F.col(name).alias("vec"))
        for name in ("visual", "caption", "audio")
    }


def kind_of(category) -> Column:
    c = V.col_of(category)
    return (
        F.when(c <= 1, "text").when(c <= 3, "image").when(c <= 5, "audio")
        .when(c <= 7, "video").otherwise("mixed")
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, truth, category, kind, q_clip, q_clap): one query per item."""
    return halves(spark, sf_dir, spread=False).select(
        F.col("id").alias("qid"),
        F.col("id").alias("truth"),
        "category",
        kind_of("category").alias("kind"),
        V.l2_normalize(V.add("a", F.reverse("b"))).alias("q_clip"),
        V.l2_normalize(V.add("b", F.reverse("a"), 1.0, 2.0)).alias("q_clap"),
    )


def queries_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose kind decides which vectors exist."""
    q = queries(spark, sf_dir)
    return q.withColumn(
        "q_clap",
        F.when(~F.col("kind").isin("image", "video"), F.col("q_clap")),
    ).withColumn("q_clip", F.when(F.col("kind") != "audio", F.col("q_clip")))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, value, has_media): one raw JSON record per document.

    Documents labelled toxic get a truncated record (a parse error), those
    labelled low quality have no media file.
    """
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    lines = F.split("text", "\n")
    record = F.to_json(
        F.struct(
            F.col("lang").alias("content_parent_category"),
            (F.col("n_chars") / 10.0).alias("duration_seconds"),
            F.col("text").alias("text_to_speech"),
            F.struct(
                F.element_at(lines, 1).alias("description"),
                F.transform(
                    F.slice(lines, F.lit(2), F.size(lines)),
                    lambda x: F.struct(x.alias("question"), F.lit("").alias("answer")),
                ).alias("qAndA"),
            ).alias("content_metadata"),
            F.array("lang", "source").alias("youtube_tags"),
            F.element_at(lines, -1).alias("youtube_title"),
        )
    )
    joined = docs.join(labels, "doc_id", "left")
    return joined.select(
        F.format_string("/raw/%s/%s.json", F.col("source"), F.col("doc_id")).alias("path"),
        F.when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, F.substring(record, 1, 20))
        .otherwise(record).alias("value"),
        (F.coalesce(F.col("quality"), F.lit(1)) != 0).alias("has_media"),
    )


def captions(spark: SparkSession, sf_dir: str, spread: bool = True) -> DataFrame:
    """(video, pos, text, vec): every embedding is a caption of its label's video."""
    return table(spark, sf_dir, "embeddings", spread).select(
        F.col("label").cast("long").alias("video"),
        F.col("vec_id").alias("pos"),
        F.col("vec_id").cast("string").alias("text"),
        V.l2_normalize(V.as_double("embedding")).alias("vec"),
    )


def caption_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, truth, text, own_pos, vec): each caption asked as a query."""
    return captions(spark, sf_dir, spread=False).select(
        F.col("pos").alias("qid"), F.col("video").alias("truth"), "text",
        F.col("pos").alias("own_pos"), "vec",
    )
