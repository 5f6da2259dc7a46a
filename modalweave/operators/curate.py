"""Curation: parse, validate, project and explode raw item records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from ..functions.text import contains_any, is_blank
from ..functions.vectors import col_of, dot
from ..session import materialize

_S = StringType()

RAW_SCHEMA = StructType(
    [
        StructField("content_parent_category", _S),
        StructField("duration_seconds", DoubleType()),
        StructField("resolution", _S),
        StructField("original_video_filename", _S),
        StructField("original_json_filename", _S),
        StructField("text_to_speech", _S),
        StructField("text_to_speech_word_count", LongType()),
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
        StructField(
            "content_metadata",
            StructType(
                [
                    StructField("description", _S),
                    StructField("fps", DoubleType()),
                    StructField(
                        "qAndA",
                        ArrayType(
                            StructType(
                                [StructField("question", _S), StructField("answer", _S)]
                            )
                        ),
                    ),
                ]
            ),
        ),
        StructField("_corrupt_record", _S),
    ]
)

# Reject reasons, first failing one wins.
MISSING_MEDIA = "missing MP4"
PARSE_ERROR = "JSON parse error"
EMPTY_DESCRIPTION = "empty description"
NO_QUESTIONS = "no Q&A questions"


def parse_records(raw: DataFrame) -> DataFrame:
    """(path, value, has_media) -> parsed ``rec`` plus id and category of the path."""
    rec = F.from_json(
        "value", RAW_SCHEMA,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
    )
    return raw.select(
        F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("video_id"),
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("category"),
        "path", "has_media",
        rec.alias("rec"),
    )


def _texts(field: str) -> Column:
    """Non-empty strings of one field of the nested question list."""
    items = F.col("rec.content_metadata.qAndA")
    values = F.filter(
        F.transform(items, lambda x: x[field]), lambda t: t.isNotNull() & (t != "")
    )
    return F.coalesce(values, F.array().cast("array<string>"))


def reject_reason() -> Column:
    """Why a parsed record is unusable; NULL for a valid one."""
    return (
        F.when(~F.col("has_media"), MISSING_MEDIA)
        .when(F.col("rec._corrupt_record").isNotNull(), PARSE_ERROR)
        .when(is_blank("rec.content_metadata.description"), EMPTY_DESCRIPTION)
        .when(F.size(_texts("question")) == 0, NO_QUESTIONS)
    )


def validate(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("reason", reject_reason())


def rejects(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reason").isNotNull()).select("video_id", "category", "reason")


def project_manifest(validated: DataFrame, source: str = "aligned", prefix: str = "items") -> DataFrame:
    """Flatten valid records to the 23 manifest fields, each with its default."""
    text = lambda name: F.coalesce(F.col(f"rec.{name}"), F.lit(""))
    rel = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    vid = F.col("video_id")
    no_text = F.array().cast("array<string>")
    return validated.filter(F.col("reason").isNull()).select(
        vid,
        F.lit(source).alias("source_dataset"),
        F.lit("train").alias("split"),
        F.col("category").alias("content_fine_category"),
        text("content_parent_category").alias("content_parent_category"),
        F.coalesce("rec.duration_seconds", F.lit(0.0)).alias("duration_seconds"),
        text("resolution").alias("resolution"),
        F.coalesce("rec.content_metadata.fps", F.lit(30.0)).alias("fps"),
        text("original_video_filename").alias("original_video_filename"),
        text("original_json_filename").alias("original_json_filename"),
        F.regexp_replace("path", r"\.json$", ".mp4").alias("video_path"),
        F.col("path").alias("json_path"),
        rel(f"data/processed/{prefix}/frames_uniform/", vid).alias("frames_dir"),
        rel(f"data/processed/{prefix}/audio/", vid, ".wav").alias("audio_path"),
        F.col("rec.content_metadata.description").alias("text_description"),
        text("text_to_speech").alias("text_transcript"),
        F.coalesce("rec.text_to_speech_word_count", F.lit(0)).alias("text_transcript_word_count"),
        F.coalesce(
            "rec.timecoded_text_to_speech",
            F.array().cast("array<struct<start:double,end:double,text:string>>"),
        ).alias("timecoded_text_to_speech"),
        text("youtube_title").alias("youtube_title"),
        F.coalesce("rec.youtube_tags", no_text).alias("youtube_tags"),
        text("youtube_description").alias("youtube_description"),
        _texts("question").alias("qa_questions"),
        _texts("answer").alias("qa_answers"),
    )


def build_manifest(raw: DataFrame, seed: int = 42, pilot: int | None = None) -> DataFrame:
    """Raw records to a split manifest of the valid ones."""
    from .sampling import pilot_sample, stratified_split

    # parsed once; the split below reads the written columns it needs
    manifest = project_manifest(validate(parse_records(raw))).drop("split")
    manifest = materialize(manifest, "manifest")
    if pilot:
        manifest = pilot_sample(manifest, "content_fine_category", "video_id", pilot, seed)
    return stratified_split(manifest, "content_fine_category", "video_id", 0.85, seed)


def filter_by_split(df: DataFrame, split: str = "test") -> DataFrame:
    return df.filter(F.col("split") == split)


def first_per_key(df: DataFrame, key: str, order: str, last: bool = False) -> DataFrame:
    """One row per key, the first (or last) by ``order``.

    min_by/max_by combine inside each task, so a hot key is no single-task sort.
    """
    rest = [c for c in df.columns if c != key]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), F.col(order))
    return df.groupBy(key).agg(pick.alias("_row")).select(key, *[f"_row.{c}" for c in rest])


def explode_queries(manifest: DataFrame) -> DataFrame:
    """(video_id, category, pos, query): one row per question."""
    return manifest.select(
        "video_id",
        F.col("content_fine_category").alias("category"),
        F.posexplode("qa_questions").alias("pos", "query"),
    )


def limit_queries(queries: DataFrame, n: int, order=("video_id", "pos")) -> DataFrame:
    return queries.orderBy(*order).limit(n)


def keyword_queries(queries: DataFrame, text: str, keywords, n: int, order) -> DataFrame:
    """The first ``n`` queries whose text holds any keyword, in any case."""
    return queries.filter(contains_any(text, keywords)).orderBy(*order).limit(n)


def verbatim_match_rate(queries: DataFrame, captions: DataFrame) -> DataFrame:
    """Share of (video, text) queries that equal a stored caption of their video."""
    stored = captions.select("video", "text").distinct().withColumn("hit", F.lit(1))
    marked = queries.select("video", "text").join(stored, ["video", "text"], "left")
    return marked.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("hit").alias("exact"),
        (F.count("hit") / F.count(F.lit(1))).alias("rate"),
    )


def _head_hits(heads: DataFrame, texts: DataFrame, bound: int) -> DataFrame:
    """(hid, tid): heads that occur in a text of the same video.

    A video with at most ``bound`` distinct heads has them tested row by row
    against each of its texts.  For any other video containment becomes an
    equi-join: a head of length L occurs in a text exactly if it equals one of
    the text's L-character windows.  Neither way forms all pairs of a video.
    """
    distinct = heads.select("video", "head").distinct()
    sizes = distinct.groupBy("video").agg(F.count(F.lit(1)).alias("_n"))
    few = (
        distinct.join(sizes.filter(F.col("_n") <= bound), "video")
        .groupBy("video").agg(F.collect_list("head").alias("_heads"))
    )
    direct = texts.join(few, "video").select(
        "tid", "video",
        F.explode(F.filter("_heads", lambda h: F.contains(F.col("text"), h))).alias("head"),
    )
    crowded = sizes.filter(F.col("_n") > bound).select("video")
    lengths = distinct.join(crowded, "video", "left_semi").select(
        "video", F.length("head").alias("_len")
    ).distinct()
    start = F.sequence(F.lit(1), F.length("text") - F.col("_len") + 1)
    windows = (
        texts.join(lengths, "video")
        .filter(F.length("text") >= F.col("_len"))
        .select("tid", "video", "text", "_len", F.explode(start).alias("_at"))
        .select("tid", "video", F.expr("substring(text, _at, _len)").alias("head"))
    )
    by_window = windows.join(distinct, ["video", "head"], "left_semi").distinct()
    found = direct.unionByName(by_window)
    return found.join(heads, ["video", "head"]).select("hid", "tid")


def partial_match(
    queries: DataFrame, captions: DataFrame, n: int = 20, bound: int = 256
) -> DataFrame:
    """(qid, pos): non-exact queries with a caption of the same video such that the
    first ``n`` characters of one text occur in the other."""
    key = ["video", "text"]
    open_q = queries.join(captions.select(*key).distinct(), key, "left_anti")
    caps = captions.join(open_q.select("video").distinct(), "video", "left_semi")
    head = F.substring("text", 1, n).alias("head")
    q_head = open_q.select(F.col("qid").alias("hid"), "video", head)
    c_head = caps.select(F.col("pos").alias("hid"), "video", head)
    q_text = open_q.select(F.col("qid").alias("tid"), "video", "text")
    c_text = caps.select(F.col("pos").alias("tid"), "video", "text")
    forth = _head_hits(q_head, c_text, bound).toDF("qid", "pos")
    back = _head_hits(c_head, q_text, bound).toDF("pos", "qid")
    return forth.unionByName(back).distinct()


def vector_health(df: DataFrame, vec: str, by: str) -> DataFrame:
    """Non-finite flags, near-unit norms and component statistics per ``by``."""
    from ..functions import vectors as V

    rows = df.select(
        by,
        V.is_non_finite(vec).alias("bad"),
        V.norm(vec).alias("norm"),
        F.col(vec).alias("_v"),
    )
    per_row = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("bad").alias("non_finite"),
        F.avg((F.col("norm") > 0.9).cast("int")).alias("near_unit"),
    )
    parts = rows.select(by, F.explode("_v").alias("x")).groupBy(by).agg(
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("lo"), F.max("x").alias("hi"),
    )
    return per_row.join(parts, by)


def positive_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, cos): dot product of the rows two (id, vec) stores share."""
    joined = a.select("id", F.col("vec").alias("_a")).join(
        b.select("id", F.col("vec").alias("_b")), "id"
    )
    return joined.select("id", dot("_a", "_b").alias("cos"))


def complete_ids(stores: dict[str, DataFrame], ids: DataFrame | None = None) -> DataFrame:
    """(id, one vector column per store): ids present in every store."""
    out = ids.select("id") if ids is not None else None
    for name, store in stores.items():
        side = store.select("id", F.col("vec").alias(name))
        out = side if out is None else out.join(side, "id")
    return out


def missing_report(stores: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """(store, id) for every wanted id a store does not have."""
    out = None
    for name, store in stores.items():
        part = ids.select("id").join(store.select("id"), "id", "left_anti").select(
            F.lit(name).alias("store"), "id"
        )
        out = part if out is None else out.unionByName(part)
    return out


def drop_unanswerable(queries: DataFrame, gallery: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped) by whether the query's truth is in the gallery."""
    ids = gallery.select(F.col("id").alias("truth"))
    return queries.join(ids, "truth", "left_semi"), queries.join(ids, "truth", "left_anti")


def similarity_buckets(pairs: DataFrame, cos: str = "cos") -> DataFrame:
    """Counts of pair cosines per published bucket (closed below, open above)."""
    edges = [0.0, 0.5, 0.7, 0.9, 0.95, 0.99, 1.0]
    c = F.col(cos)
    bucket = None
    for lo, hi in zip(edges, edges[1:]):
        cond = (c >= lo) & (c < hi)
        label = F.lit(f"{lo:g}-{hi:g}")
        bucket = F.when(cond, label) if bucket is None else bucket.when(cond, label)
    return (
        pairs.withColumn("bucket", bucket.otherwise("outside"))
        .groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    )
