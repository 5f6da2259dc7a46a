"""Manifests, raw records, reject lists and file inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

_S = StringType()

MANIFEST_SCHEMA = StructType(
    [
        StructField("video_id", _S),
        StructField("source_dataset", _S),
        StructField("split", _S),
        StructField("content_fine_category", _S),
        StructField("content_parent_category", _S),
        StructField("duration_seconds", DoubleType()),
        StructField("resolution", _S),
        StructField("fps", DoubleType()),
        StructField("original_video_filename", _S),
        StructField("original_json_filename", _S),
        StructField("video_path", _S),
        StructField("json_path", _S),
        StructField("frames_dir", _S),
        StructField("audio_path", _S),
        StructField("text_description", _S),
        StructField("text_transcript", _S),
        StructField("text_transcript_word_count", LongType()),
        StructField(
            "timecoded_text_to_speech",
            ArrayType(
                StructType(
                    [
                        StructField("start", DoubleType()),
                        StructField("end", DoubleType()),
                        StructField("text", _S),
                    ]
                )
            ),
        ),
        StructField("youtube_title", _S),
        StructField("youtube_tags", ArrayType(_S)),
        StructField("youtube_description", _S),
        StructField("qa_questions", ArrayType(_S)),
        StructField("qa_answers", ArrayType(_S)),
    ]
)

CAPTION_SCHEMA = StructType(
    [StructField("video_id", _S), StructField("text", _S), StructField("split", _S)]
)


def scan_manifest(
    spark: SparkSession, path: str, array_file: bool = False, schema: StructType = MANIFEST_SCHEMA
) -> DataFrame:
    """Read a manifest: JSON lines (splittable), or one legacy JSON array file."""
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE")
    return reader.json(path, multiLine=array_file)


def scan_captions(spark: SparkSession, path: str, array_file: bool = False) -> DataFrame:
    """(video_id, text, split): the older layout with one row per caption."""
    return scan_manifest(spark, path, array_file, CAPTION_SCHEMA)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """JSON lines in (category, id) order; the job commit swaps the files in."""
    (
        manifest.repartitionByRange("content_fine_category", "video_id")
        .sortWithinPartitions("content_fine_category", "video_id")
        .write.mode("overwrite")
        .json(path)
    )


def scan_raw_records(spark: SparkSession, root: str) -> DataFrame:
    """(path, value, has_media) for a folder of per-category JSON files.

    Media files sit beside their record; only their listing is read.
    """
    records = spark.read.text(f"{root}/*/*.json", wholetext=True).select(
        _uri("_metadata.file_path").alias("path"), "value"
    )
    media = (
        list_files(spark, root, "*.mp4")
        .select(F.regexp_replace("path", r"\.mp4$", ".json").alias("path"))
        .withColumn("has_media", F.lit(True))
    )
    return records.join(media, "path", "left").withColumn(
        "has_media", F.coalesce("has_media", F.lit(False))
    )


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, length) of files below ``root``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(_uri("path").alias("path"), "length")
    )


def _uri(path: str):
    """Local paths spelled the same by every source."""
    return F.regexp_replace(path, r"^file:/+", "file:/")


def write_rejects(rejects: DataFrame, path: str) -> None:
    rejects.write.mode("overwrite").option("header", "true").csv(path)


def scan_rejects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").schema(
        "video_id string, category string, reason string"
    ).csv(path)


def reject_counts(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def frame_counts(paths: DataFrame) -> DataFrame:
    """(video_id, n) from a listing of ``.../<video_id>/frame_0000.jpg`` paths."""
    frames = paths.filter(F.col("path").rlike(r"/frame_\d+\.jpg$"))
    parent = F.regexp_extract("path", r"([^/]+)/frame_\d+\.jpg$", 1)
    return frames.groupBy(parent.alias("video_id")).agg(F.count(F.lit(1)).alias("n"))


def frame_inventory(paths: DataFrame, n_frames: int = 16) -> DataFrame:
    """(video_id, n, reason): reason is NULL for exactly ``n_frames`` frames."""
    return frame_counts(paths).withColumn(
        "reason",
        F.when(F.col("n") != n_frames, F.concat(F.lit("frame count "), F.col("n").cast("string"))),
    )


def resume(todo: DataFrame, done: DataFrame, n_parts: int, id_col: str = "video_id") -> DataFrame:
    """Items still to process: absent from ``done`` or only partly done."""
    complete = done.filter(F.col("n") == n_parts).select(id_col)
    return todo.join(complete, id_col, "left_anti")
