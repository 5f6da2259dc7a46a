"""Sources, sinks, curation, text, media and encoder queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import encode as U
from ..functions import media as D
from ..functions import text as T
from ..functions import vectors as V
from ..operators import curate as C
from ..operators import sampling as W
from ..plans import fixtures as X
from ..session import materialize, scratch_path
from ..sources import manifest as SM
from ..sources import stores as SS
from .common import (
    BASE, GALLERY, HALVES, MANIFEST, QUERIES_SQL, SCORES, STANDARD_RANKS,
    chk, norm_of, query, r6, toy_gate, unit, with_,
)


def manifest(spark, sf):
    return C.build_manifest(X.raw_records(spark, sf))


# ------------------------------------------------------------ sources and sinks

_MAN_COLS = """video_id, split, category AS content_fine_category, lang AS content_parent_category,
  round(n_chars / 10.0::DOUBLE, 6) AS duration_seconds, 30.0::DOUBLE AS fps, md5(description) AS description,
  md5(text) AS transcript, len(questions)::BIGINT AS n_questions, 2::BIGINT AS n_tags"""


def _manifest_view(m):
    return m.select(
        "video_id", "split", "content_fine_category", "content_parent_category",
        "duration_seconds", "fps",
        F.md5("text_description").alias("description"),
        F.md5("text_transcript").alias("transcript"),
        F.size("qa_questions").cast("long").alias("n_questions"),
        F.size("youtube_tags").cast("long").alias("n_tags"),
    )


@query("s1_scan_manifest", with_(MANIFEST) + f"SELECT {_MAN_COLS} FROM man")
def _(spark, sf):
    path = scratch_path(spark, "manifest")
    SM.write_manifest(manifest(spark, sf), path)
    return _manifest_view(SM.scan_manifest(spark, path))


@query(
    "s2_scan_raw_records",
    with_(MANIFEST) + "SELECT video_id, category, coalesce(reason, 'valid') AS reason FROM raw",
)
def _(spark, sf):
    v = C.validate(C.parse_records(X.raw_records(spark, sf)))
    return v.select("video_id", "category", F.coalesce("reason", F.lit("valid")).alias("reason"))


def _store_sql(col):
    return with_(HALVES, GALLERY) + (
        f"SELECT id, round(sqrt(list_dot_product(v, v)), 4) AS norm, round({chk('v')}, 4) AS chk FROM "
        f"(SELECT id, list_transform({col}, lambda x: x::FLOAT::DOUBLE) AS v FROM gal)"
    )


def _store_view(s):
    return s.select(
        "id", F.round(V.norm("vec"), 4).alias("norm"), F.round(V.checksum("vec"), 4).alias("chk")
    )


@query("s3_scan_store", _store_sql("visual"))
def _(spark, sf):
    path = scratch_path(spark, "store")
    X.gallery(spark, sf).select(
        "id", F.col("visual").cast("array<float>").alias("vec")
    ).write.parquet(path)
    return _store_view(SS.scan_store(spark, path))


@query("s4_write_store", _store_sql("audio"))
def _(spark, sf):
    path = scratch_path(spark, "store")
    SS.write_store(X.halves(spark, sf).select("id", F.col("b").alias("vec")), path)
    return _store_view(SS.scan_store(spark, path))


@query(
    "s5_write_manifest",
    with_(MANIFEST) + """SELECT category AS content_fine_category, split, count(*) AS n,
      sum(len(questions))::BIGINT AS n_questions FROM man GROUP BY category, split""",
)
def _(spark, sf):
    path = scratch_path(spark, "manifest")
    SM.write_manifest(manifest(spark, sf), path)
    return SM.scan_manifest(spark, path).groupBy("content_fine_category", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("qa_questions")).alias("n_questions")
    )


@query(
    "s6_write_rejects",
    with_(MANIFEST) + "SELECT reason, count(*) AS n FROM raw WHERE reason IS NOT NULL GROUP BY reason",
)
def _(spark, sf):
    path = scratch_path(spark, "rejects")
    SM.write_rejects(C.rejects(C.validate(C.parse_records(X.raw_records(spark, sf)))), path)
    return SM.reject_counts(SM.scan_rejects(spark, path))


@query(
    "s7_write_report",
    with_(*STANDARD_RANKS) + f"""SELECT system, 'all' AS stratum, m.metric AS metric, {r6('m.value', 'value')} FROM (
      SELECT system, unnest([{{'metric': 'n_queries', 'value': count(*)::DOUBLE}},
        {{'metric': 'r1', 'value': avg((rk <= 1)::INT)}}, {{'metric': 'r5', 'value': avg((rk <= 5)::INT)}},
        {{'metric': 'r10', 'value': avg((rk <= 10)::INT)}}]) AS m FROM ranks GROUP BY system)""",
)
def _(spark, sf):
    from ..operators.metrics import recall_at_k
    from ..plans.evaluate import long_metrics, rank_table

    path = scratch_path(spark, "report")
    ranks = rank_table(toy_gate(X.queries(spark, sf)), X.gallery(spark, sf))
    report = long_metrics(recall_at_k(ranks), ["system"])
    SS.write_report(report, path, "json")
    return SS.scan_report(spark, path)


def _frame_paths(spark, sf):
    """A listing with one frame per 250 characters; long documents have too many frames."""
    docs = X.table(spark, sf, "documents")
    n = F.floor(F.col("n_chars") / 250).cast("int")
    return docs.filter(n > 0).select(
        F.explode(F.sequence(F.lit(0), n - 1)).alias("i"), "doc_id"
    ).select(F.format_string("/frames/%s/frame_%04d.jpg", F.col("doc_id"), F.col("i")).alias("path"))


_FRAMES = """fr AS (SELECT doc_id::VARCHAR AS video_id, floor(n_chars / 250)::BIGINT AS n
  FROM documents WHERE floor(n_chars / 250) > 0)"""


@query(
    "s8_frame_inventory",
    with_(_FRAMES) + """SELECT video_id, n, CASE WHEN n <> 16 THEN 'frame count ' || n END AS reason FROM fr""",
)
def _(spark, sf):
    return SM.frame_inventory(_frame_paths(spark, sf))


@query(
    "s9_resume",
    with_(_FRAMES) + """SELECT doc_id::VARCHAR AS video_id FROM documents
      WHERE doc_id::VARCHAR NOT IN (SELECT video_id FROM fr WHERE n = 16)""",
)
def _(spark, sf):
    todo = X.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("video_id"))
    return SM.resume(todo, SM.frame_counts(_frame_paths(spark, sf)), 16)


# --------------------------------------------------------- projections, filters


@query("p1_filter_by_split", with_(MANIFEST) + f"SELECT {_MAN_COLS} FROM man WHERE split = 'test'")
def _(spark, sf):
    return _manifest_view(C.filter_by_split(manifest(spark, sf), "test"))


@query(
    "p2_validate",
    with_(MANIFEST) + """SELECT category, coalesce(reason, 'valid') AS reason, count(*) AS n
      FROM raw GROUP BY ALL""",
)
def _(spark, sf):
    v = C.validate(C.parse_records(X.raw_records(spark, sf)))
    return v.groupBy("category", F.coalesce("reason", F.lit("valid")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "p3_project_manifest",
    with_(MANIFEST) + """SELECT video_id, 'aligned' AS source_dataset, '' AS resolution,
      '/raw/' || category || '/' || video_id || '.mp4' AS video_path,
      '/raw/' || category || '/' || video_id || '.json' AS json_path,
      'data/processed/items/audio/' || video_id || '.wav' AS audio_path, 0::BIGINT AS words,
      md5(title) AS title, lang || '|' || category AS tags, md5(array_to_string(questions, chr(10))) AS questions,
      0::BIGINT AS n_answers, 0::BIGINT AS n_timecodes FROM raw WHERE reason IS NULL""",
)
def _(spark, sf):
    m = C.project_manifest(C.validate(C.parse_records(X.raw_records(spark, sf))))
    return m.select(
        "video_id", "source_dataset", "resolution", "video_path", "json_path", "audio_path",
        F.col("text_transcript_word_count").alias("words"),
        F.md5("youtube_title").alias("title"),
        F.concat_ws("|", "youtube_tags").alias("tags"),
        F.md5(F.concat_ws("\n", "qa_questions")).alias("questions"),
        F.size("qa_answers").cast("long").alias("n_answers"),
        F.size("timecoded_text_to_speech").cast("long").alias("n_timecodes"),
    )


@query(
    "p4_first_per_key",
    """SELECT source, arg_min(doc_id, doc_id) AS first_doc, md5(arg_min(text, doc_id)) AS first_text,
      max(doc_id) AS last_doc, md5(arg_max(text, doc_id)) AS last_text FROM documents GROUP BY source""",
)
def _(spark, sf):
    docs = X.table(spark, sf, "documents").select("source", "doc_id", "text")
    first = C.first_per_key(docs, "source", "doc_id").select(
        "source", F.col("doc_id").alias("first_doc"), F.md5("text").alias("first_text")
    )
    last = C.first_per_key(docs, "source", "doc_id", last=True).select(
        "source", F.col("doc_id").alias("last_doc"), F.md5("text").alias("last_text")
    )
    return first.join(last, "source")


_QUESTIONS = """qs AS (SELECT video_id, category, u.pos - 1 AS pos, u.q AS query FROM (
  SELECT video_id, category, unnest(list_transform(questions, lambda x, i: {'pos': i, 'q': x})) AS u FROM man))"""


@query(
    "p5_explode_queries",
    with_(MANIFEST, _QUESTIONS) + "SELECT video_id, category, pos, md5(query) AS query FROM qs",
)
def _(spark, sf):
    q = C.explode_queries(manifest(spark, sf))
    return q.select("video_id", "category", F.col("pos").cast("long"), F.md5("query").alias("query"))


@query(
    "p6_limit_queries",
    with_(MANIFEST, _QUESTIONS) + """SELECT video_id, pos, md5(query) AS query FROM qs
      ORDER BY video_id, pos LIMIT 100""",
)
def _(spark, sf):
    q = C.limit_queries(C.explode_queries(manifest(spark, sf)), 100)
    return q.select("video_id", F.col("pos").cast("long"), F.md5("query").alias("query"))


_WORDS = ["in", "sound", "der", "que"]


@query(
    "p7_keyword_queries",
    """SELECT conv_id, turn, md5(text) AS text FROM conversations WHERE role = 'user'
      AND (contains(lower(text), 'sound') OR contains(lower(text), 'der') OR contains(lower(text), 'que')
           OR contains(lower(text), 'in')) ORDER BY conv_id, turn LIMIT 20""",
)
def _(spark, sf):
    turns = X.table(spark, sf, "conversations").filter("role = 'user'")
    return C.keyword_queries(turns, "text", _WORDS, 20, ("conv_id", "turn")).select(
        "conv_id", "turn", F.md5("text").alias("text")
    )


@query(
    "p8_non_blank",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
      SELECT doc_id, count(*) AS n FROM l WHERE regexp_matches(line, '\S') GROUP BY doc_id""",
)
def _(spark, sf):
    lines = X.table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return T.non_blank(lines, "line").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def _line_captions(spark, sf):
    """Every line of a document is a caption of it; queries are the first lines
    without their closing full stop."""
    docs = X.table(spark, sf, "documents")
    caps = docs.select(
        F.col("doc_id").alias("video"), F.posexplode(F.split("text", "\n")).alias("pos", "text")
    )
    qs = docs.select(
        F.col("doc_id").alias("qid"), F.col("doc_id").alias("video"),
        F.regexp_replace(F.element_at(F.split("text", "\n"), 1), r"\.$", "").alias("text"),
    )
    return qs, caps


_LINES = r"""caps AS (SELECT doc_id AS video, u.pos - 1 AS pos, u.x AS text FROM (
  SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'pos': i, 'x': x})) AS u
  FROM documents)),
lq AS (SELECT doc_id AS qid, doc_id AS video, regexp_replace(string_split(text, chr(10))[1], '\.$', '') AS text
  FROM documents)"""


@query(
    "p9_verbatim_match_rate",
    with_(_LINES) + f"""SELECT count(*) AS n, count(*) FILTER (hit) AS exact, {r6('avg(hit::INT)', 'rate')}
      FROM (SELECT EXISTS (SELECT 1 FROM caps c WHERE c.video = lq.video AND c.text = lq.text) AS hit FROM lq)""",
)
def _(spark, sf):
    qs, caps = _line_captions(spark, sf)
    return C.verbatim_match_rate(qs, caps)


@query(
    "p10_partial_match",
    with_(_LINES) + """SELECT qid, pos FROM lq JOIN caps c ON c.video = lq.video
      WHERE NOT EXISTS (SELECT 1 FROM caps e WHERE e.video = lq.video AND e.text = lq.text)
      AND (contains(c.text, substring(lq.text, 1, 20)) OR contains(lq.text, substring(c.text, 1, 20)))
      AND lq.text <> '' AND c.text <> ''""",
)
def _(spark, sf):
    qs, caps = _line_captions(spark, sf)
    found = C.partial_match(qs.filter("text <> ''"), caps.filter("text <> ''"))
    return found.select("qid", F.col("pos").cast("long").alias("pos"))


@query(
    "p11_max_queries",
    "SELECT conv_id, turn, md5(text) AS text FROM conversations ORDER BY conv_id, turn LIMIT 200",
)
def _(spark, sf):
    c = C.limit_queries(X.table(spark, sf, "conversations"), 200, ("conv_id", "turn"))
    return c.select("conv_id", "turn", F.md5("text").alias("text"))


@query(
    "p12_non_finite_check",
    with_(HALVES) + f"""SELECT category, n, non_finite, {r6('near_unit', 'near_unit')}, {r6('mean', 'mean')},
      {r6('std', 'std')}, {r6('lo', 'lo')}, {r6('hi', 'hi')} FROM
      (SELECT category, count(*) AS n, count(*) FILTER (len(list_filter(e, lambda x: isnan(x) OR isinf(x))) > 0)
         AS non_finite, avg((sqrt(list_dot_product(e, e)) > 0.9)::INT) AS near_unit FROM h GROUP BY category)
      JOIN (SELECT category, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS lo, max(x) AS hi FROM
        (SELECT category, unnest(e) AS x FROM h) GROUP BY category) USING (category)""",
)
def _(spark, sf):
    return C.vector_health(X.halves(spark, sf), "e", "category")


@query(
    "p13_score_threshold_counts",
    with_(*BASE) + f"""SELECT space, n, above_50, above_30, above_10, below_10, {r6('mean', 'mean')}, {r6('std', 'std')}
      FROM (SELECT space, count(*) AS n, count(*) FILTER (s > 0.5::DOUBLE) AS above_50,
        count(*) FILTER (s > 0.3::DOUBLE) AS above_30, count(*) FILTER (s > 0.1::DOUBLE) AS above_10,
        count(*) FILTER (s <= -0.1::DOUBLE) AS below_10, avg(s) AS mean, stddev_samp(s) AS std FROM (
          SELECT 'v' AS space, round(sim_v, 12) AS s FROM sc UNION ALL SELECT 't', round(sim_t, 12) FROM sc
          UNION ALL SELECT 'a', round(sim_a, 12) FROM sc) GROUP BY space)""",
)
def _(spark, sf):
    from ..operators.scoring import score_stats

    st = score_stats(X.queries(spark, sf), X.gallery(spark, sf), thresholds=(0.5, 0.3, 0.1, -0.1), ends=False)
    n, s1, s2 = F.sum("n"), F.sum("s1"), F.sum("s2")
    return st.groupBy("space").agg(
        n.alias("n"), F.sum("above_0").alias("above_50"), F.sum("above_1").alias("above_30"),
        F.sum("above_2").alias("above_10"), (n - F.sum("above_3")).alias("below_10"),
        (s1 / n).alias("mean"), F.sqrt((s2 - s1 * s1 / n) / (n - 1)).alias("std"),
    )


# ------------------------------------------------------------- splits, samples


@query("w9_stratified_split", with_(MANIFEST) + "SELECT video_id, category, split FROM man")
def _(spark, sf):
    m = manifest(spark, sf)
    return m.select("video_id", F.col("content_fine_category").alias("category"), "split")


@query(
    "w10_pilot_sample",
    """SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source
      ORDER BY md5('42:' || doc_id), doc_id) <= 30""",
)
def _(spark, sf):
    return W.pilot_sample(
        X.table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", 30, 42
    )


_GROUP_SPLIT = """gs AS (SELECT conv_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || conv_id), conv_id) - 1
    < greatest(1, floor(count(*) OVER () * 0.15::DOUBLE)) THEN 'val' ELSE 'train' END AS part
  FROM (SELECT DISTINCT conv_id FROM conversations))"""


@query(
    "w11_group_split",
    with_(_GROUP_SPLIT) + "SELECT conv_id, turn, part FROM conversations JOIN gs USING (conv_id)",
)
def _(spark, sf):
    rows = X.table(spark, sf, "conversations").select("conv_id", "turn")
    return W.group_split(rows, "conv_id")


@query(
    "q4_leakage_check",
    with_(_GROUP_SPLIT) + """SELECT (SELECT count(*) FROM (SELECT conv_id FROM gs WHERE part = 'train' INTERSECT
      SELECT conv_id FROM gs WHERE part = 'val')) AS overlap, (SELECT count(*) FROM gs) AS groups""",
)
def _(spark, sf):
    rows = X.table(spark, sf, "conversations").select("conv_id", "turn")
    parts = W.group_split(rows, "conv_id")
    n_groups = rows.select("conv_id").distinct().count()
    return W.leakage(parts, "conv_id").agg(
        F.count(F.lit(1)).alias("overlap"), F.lit(n_groups).cast("long").alias("groups")
    )


# ------------------------------------------------------------------ text, media

_COST = "(floor(length(w) / 4)::INT + 1)"
CHUNKS = rf"""wd AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words
  FROM documents),
ck AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] ELSE list_append(r.done, array_to_string(r.open, ' ')) END AS chunks FROM (
  SELECT doc_id, words, list_reduce(list_transform(words, lambda w, i: {{'done': []::VARCHAR[], 'open': [w],
      'cost': {_COST} + CASE WHEN i = 1 THEN 1 ELSE 0 END}}),
    lambda a, x: CASE WHEN a.cost + x.cost + 1 > 72
      THEN {{'done': list_append(a.done, array_to_string(a.open, ' ')), 'open': x.open, 'cost': x.cost}}
      ELSE {{'done': a.done, 'open': list_concat(a.open, x.open), 'cost': a.cost + x.cost + 1}} END) AS r
  FROM wd WHERE len(words) > 0)
  UNION ALL SELECT doc_id, []::VARCHAR[] FROM wd WHERE len(words) = 0)"""


@query(
    "t1_chunk_text",
    with_(CHUNKS) + """SELECT doc_id, len(chunks)::BIGINT AS n_chunks, md5(array_to_string(chunks, '|')) AS chunks
      FROM ck""",
)
def _(spark, sf):
    docs = X.table(spark, sf, "documents").select("doc_id", T.chunk_text("text").alias("c"))
    return docs.select(
        "doc_id", F.size("c").cast("long").alias("n_chunks"), F.md5(F.concat_ws("|", "c")).alias("chunks")
    )


def hash_vectors(source: str, key: str, text: str, name: str) -> str:
    """CTEs of the word-hashing encoder: sparse unit vectors (key, slot, x)."""
    return rf"""{name}_w AS (SELECT {key}, unnest(list_filter(regexp_split_to_array(lower({text}), '\s+'),
    lambda x: x <> '')) AS w FROM {source}),
{name}_s AS (SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS slot,
    sum(CASE WHEN ('0x' || substr(md5(w), 9, 2))::BIGINT < 128 THEN 1 ELSE -1 END)::DOUBLE AS c
  FROM {name}_w GROUP BY ALL),
{name} AS (SELECT {key}, slot, c / greatest(sqrt(sum(c * c) OVER (PARTITION BY {key})), 1e-12::DOUBLE) AS x
  FROM {name}_s)"""


@query(
    "u1_encode",
    with_(hash_vectors("documents", "doc_id", "text", "hv"))
    + f"SELECT doc_id, {r6('sum(x * x)', 'norm2')}, {r6('sum(x * (slot + 1))', 'chk')} FROM hv GROUP BY doc_id",
)
def _(spark, sf):
    docs = X.table(spark, sf, "documents").select("doc_id", "text")
    e = U.encode(docs, "text", "vec")
    return e.select(
        "doc_id", (V.norm("vec") * V.norm("vec")).alias("norm2"), V.checksum("vec").alias("chk")
    )


_FUSED_TEXT = (
    CHUNKS,
    "cu AS (SELECT doc_id, unnest(list_transform(chunks, lambda c, i: {'i': i, 'c': c})) AS u FROM ck)",
    "cr AS (SELECT doc_id, u.i AS i, u.c AS c FROM cu)",
    hash_vectors("cr", "doc_id, i", "c", "cv"),
    "tm AS (SELECT doc_id, slot, sum(x) AS x FROM cv GROUP BY ALL)",
    "tn AS (SELECT doc_id, slot, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 1e-12::DOUBLE) AS x FROM tm)",
    r"ds AS (SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents)",
    hash_vectors("ds", "doc_id", "line", "dv"),
)


@query(
    "t2_text_variant",
    with_(
        *_FUSED_TEXT,
        """pr AS (SELECT doc_id, slot, sum(x) AS x FROM (SELECT doc_id, slot, 0.5::DOUBLE * x AS x FROM dv
          UNION ALL SELECT doc_id, slot, 0.5::DOUBLE * x FROM tn) GROUP BY ALL)""",
        "pn AS (SELECT doc_id, slot, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 1e-12::DOUBLE) AS x FROM pr)",
    ) + f"SELECT doc_id, {r6('sum(x * (slot + 1))', 'chk')} FROM pn GROUP BY doc_id",
)
def _(spark, sf):
    docs = X.table(spark, sf, "documents").select(
        "doc_id", F.element_at(F.split("text", "\n"), 1).alias("text_description"),
        F.col("text").alias("text_transcript"),
    )
    return U.text_variant(docs, "doc_id", "fused").select("doc_id", V.checksum("vec").alias("chk"))


@query(
    "t3_augmented_targets",
    with_(MANIFEST) + r"""SELECT video_id, u.i - 1 AS pos, md5(u.t) AS text FROM (SELECT video_id,
      unnest(list_transform(list_filter(list_concat([description], questions, [title],
        ['a video tagged ' || lang, 'a video tagged ' || category], ['a video about ' || category, 'a video about ' || lang]),
        lambda t: regexp_matches(t, '\S')), lambda t, i: {'i': i, 't': t})) AS u FROM man)""",
)
def _(spark, sf):
    t = T.augmented_targets(manifest(spark, sf))
    return t.select("video_id", F.col("pos").cast("long").alias("pos"), F.md5("text").alias("text"))


_PROMPT_VARIANTS = """pv AS (SELECT item_id, 'direct' AS variant, text AS p FROM benchmark
  UNION ALL SELECT item_id, 'video_context', 'a video of ' || text FROM benchmark
  UNION ALL SELECT item_id, 'audio_context', 'the sound of ' || text FROM benchmark
  UNION ALL SELECT item_id, 'hearing', 'hearing ' || text FROM benchmark
  UNION ALL SELECT item_id, 'audio_of', 'audio of ' || text FROM benchmark)"""


@query(
    "t4_prompt_variants",
    with_(
        _PROMPT_VARIANTS, hash_vectors("pv", "item_id, variant", "p", "pe"),
        "pm AS (SELECT item_id, slot, sum(x) AS x FROM pe GROUP BY ALL)",
        "pn AS (SELECT item_id, slot, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY item_id)), 1e-12::DOUBLE) AS x FROM pm)",
    ) + f"""SELECT item_id, 5::BIGINT AS n, {r6('sum(x * (slot + 1))', 'chk')} FROM pn GROUP BY item_id""",
)
def _(spark, sf):
    p = T.prompt_variants(X.table(spark, sf, "benchmark"), "text")
    pooled = A.mean_pool(U.encode(p, "prompt", "vec"), "item_id", "vec")
    return pooled.select("item_id", "n", V.checksum("vec").alias("chk"))


@query(
    "t4_compare_prompts",
    with_(
        _PROMPT_VARIANTS, hash_vectors("pv", "item_id, variant", "p", "pe"), hash_vectors("documents", "doc_id", "text", "hv"),
        "ps AS (SELECT variant, item_id, doc_id, round(sum(pe.x * hv.x), 12) AS s FROM pe JOIN hv USING (slot) GROUP BY ALL)",
        "np AS (SELECT (SELECT count(*) FROM benchmark) * (SELECT count(*) FROM documents) AS n)",
    ) + f"""SELECT variant, n, {r6('sum(s) / n', 'mean')}, {r6('sqrt((sum(s * s) - sum(s) * sum(s) / n) / (n - 1))', 'std')},
      count(*) FILTER (s > 0.3::DOUBLE) AS above_30, count(*) FILTER (s > 0.1::DOUBLE) AS above_10 FROM ps, np GROUP BY variant, n""",
)
def _(spark, sf):
    """How close each prompt form brings the queries to all texts."""
    from ..operators.blocks import Space
    from ..operators.scoring import score_stats

    p = T.prompt_variants(X.table(spark, sf, "benchmark", spread=False), "text")
    p = U.encode(p, "prompt", "q").select(F.concat_ws("/", "variant", "item_id").alias("qid"), "q")
    docs = X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    st = score_stats(p, U.encode(docs, "text", "g"), (Space("s", "q", "g"),), thresholds=(0.3, 0.1))
    n, s1, s2 = F.sum("n"), F.sum("s1"), F.sum("s2")
    return st.groupBy(F.split("qid", "/")[0].alias("variant")).agg(
        n.alias("n"), (s1 / n).alias("mean"), F.sqrt((s2 - s1 * s1 / n) / (n - 1)).alias("std"),
        F.sum("above_0").alias("above_30"), F.sum("above_1").alias("above_10"),
    )


@query(
    "t5_frame_times",
    f"""SELECT doc_id, len(t)::BIGINT AS n, {r6('t[1]', 'first')}, {r6('t[16]', 'last')},
      {r6('list_sum(t)', 'total')} FROM (SELECT doc_id, list_transform(range(0, 16),
        lambda i: (i + 0.5::DOUBLE) * (n_chars / 10.0::DOUBLE) / 16) AS t FROM documents WHERE n_chars > 0)""",
)
def _(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 10.0).alias("d"))
    t = d.select("doc_id", D.frame_times("d").alias("t")).filter("t is not null")
    return t.select(
        "doc_id", F.size("t").cast("long").alias("n"), F.element_at("t", 1).alias("first"),
        F.element_at("t", 16).alias("last"), V.vsum("t").alias("total"),
    )


@query(
    "t6_frame_indices",
    """SELECT doc_id, list_sum(list_transform(range(0, 16), lambda i: floor(i * n_chars / 16)::BIGINT))::BIGINT AS total,
      floor(15 * n_chars / 16)::BIGINT AS last FROM documents""",
)
def _(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", D.frame_indices("n_chars").alias("t"))
    return d.select(
        "doc_id", F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"),
        F.element_at("t", 16).alias("last"),
    )


@query(
    "t7_segment_plan",
    f"""SELECT doc_id, u.i - 1 AS pos, {r6('u.s', 'start')}, {r6('u.l', 'length')} FROM (SELECT doc_id,
      unnest(CASE WHEN d <= 30 THEN [{{'i': 1, 's': 0.0::DOUBLE, 'l': d}}] ELSE
        [{{'i': 1, 's': 0.0::DOUBLE, 'l': 10.0::DOUBLE}}, {{'i': 2, 's': d / 2 - 5.0::DOUBLE, 'l': 10.0::DOUBLE}},
         {{'i': 3, 's': d - 10.0::DOUBLE, 'l': 10.0::DOUBLE}}] END) AS u
      FROM (SELECT doc_id, n_chars / 10.0::DOUBLE AS d FROM documents))""",
)
def _(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 10.0).alias("d"))
    return d.select("doc_id", F.posexplode(D.segment_plan("d")).alias("pos", "s")).select(
        "doc_id", "pos", "s.start", "s.length"
    )


@query(
    "t8_segment_offsets",
    """WITH s AS (SELECT doc_id, n_chars * 331 AS n FROM documents), o AS (SELECT doc_id, n, unnest(
        CASE WHEN n / 48000.0::DOUBLE <= 10 THEN [0::BIGINT] ELSE [0::BIGINT,
          trunc((n / 48000.0::DOUBLE - 10) / 2 * 48000)::BIGINT, trunc((n / 48000.0::DOUBLE - 10) * 48000)::BIGINT] END) AS off FROM s)
      SELECT doc_id, off AS "offset", 480000 - least(480000, n - off) AS padding,
        greatest(1, floor(n / 32000))::BIGINT AS n_windows FROM o""",
)
def _(spark, sf):
    s = X.table(spark, sf, "documents").select("doc_id", (F.col("n_chars") * 331).alias("n"))
    return s.select(
        "doc_id", F.size(D.window_offsets("n")).cast("long").alias("n_windows"),
        F.explode(D.segment_offsets("n")).alias("c"),
    ).select("doc_id", "c.offset", "c.padding", "n_windows")
