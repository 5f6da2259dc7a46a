"""Join, score and ranking queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import captions as K
from ..operators import curate as C
from ..operators import geometry as D
from ..operators import sampling as W
from ..operators import scoring as S
from ..operators.blocks import CLIP_CLAP, Space, System, angular_spaces
from ..operators.fusion import SINGLE, fixed_systems
from ..plans import fixtures as X
from .common import (
    BASE, EQUAL_SQL, GALLERY, HALVES, QUERIES_SQL, SCORES, SINGLE_SQL, ang, chk, fused, norm_of, query, r6,
    ranked, ranks, unit, with_,
)

_EQ = (*BASE, fused({"equal": EQUAL_SQL}))
_SPLIT = "sp AS (SELECT vec_id AS id, label FROM embeddings)"


def store(spark, sf, name):
    return X.gallery(spark, sf).select("id", F.col(name).alias("vec"))


@query(
    "j1_complete_ids",
    with_(HALVES, GALLERY) + f"SELECT id, {r6(chk('visual'), 'v')}, {r6(chk('audio'), 'a')} FROM gal WHERE energy >= 0.42::DOUBLE",
)
def _(spark, sf):
    ids = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    c = C.complete_ids(X.stores(spark, sf), ids)
    return c.select("id", V.checksum("visual").alias("v"), V.checksum("audio").alias("a"))


@query(
    "j2_missing_report",
    with_(HALVES, GALLERY) + """SELECT 'audio' AS store, count(*) AS n, min(id) AS first, max(id) AS last FROM gal
      WHERE energy < 0.42::DOUBLE""",
)
def _(spark, sf):
    ids = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    m = C.missing_report(X.stores(spark, sf), ids)
    return m.groupBy("store").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last")
    )


@query(
    "q1_intersect_ids",
    with_(HALVES, GALLERY) + """SELECT id FROM gal INTERSECT SELECT id FROM gal WHERE energy >= 0.42::DOUBLE""",
)
def _(spark, sf):
    s = X.stores(spark, sf)
    return s["visual"].select("id").intersect(s["audio"].select("id"))


@query(
    "q2_subtract_ids",
    with_(HALVES, GALLERY) + "SELECT id FROM gal EXCEPT SELECT id FROM gal WHERE energy >= 0.42::DOUBLE",
)
def _(spark, sf):
    s = X.stores(spark, sf)
    return s["visual"].select("id").subtract(s["audio"].select("id"))


def _stats_sql(v, t, a):
    return with_(*BASE) + f"""SELECT space, qid, n, {r6('mean', 'mean')}, {r6('lo', 'lo')}, {r6('hi', 'hi')}, {r6('rms', 'rms')} FROM (
      SELECT space, qid, count(*) AS n, avg(s) AS mean, min(s) AS lo, max(s) AS hi, sqrt(avg(s * s)) AS rms FROM (
        SELECT 'v' AS space, qid, {v} AS s FROM sc UNION ALL SELECT 't', qid, {t} FROM sc
        UNION ALL SELECT 'a', qid, {a} FROM sc) GROUP BY space, qid)"""


def _stats(spark, sf, spaces):
    st = S.score_stats(X.queries(spark, sf), X.gallery(spark, sf), spaces)
    return st.select(
        "space", "qid", "n", (F.col("s1") / F.col("n")).alias("mean"), "lo", "hi",
        F.sqrt(F.col("s2") / F.col("n")).alias("rms"),
    )


@query("j3_score_cosine", _stats_sql("sim_v", "sim_t", "sim_a"))
def _(spark, sf):
    """Every query against every item: all scores, summarised per query and modality."""
    return _stats(spark, sf, CLIP_CLAP)


@query("j3_score_angular", _stats_sql(ang("sim_v"), ang("sim_t"), ang("sim_a", 0.5)))
def _(spark, sf):
    return _stats(spark, sf, angular_spaces())


@query(
    "j4_drop_unanswerable",
    with_(HALVES, GALLERY, QUERIES_SQL) + """SELECT kind, count(*) FILTER (energy >= 0.42::DOUBLE) AS kept,
      count(*) FILTER (energy < 0.42::DOUBLE) AS skipped FROM qry JOIN gal ON id = truth GROUP BY kind""",
)
def _(spark, sf):
    complete = X.gallery_with_gaps(spark, sf).filter("audio is not null")
    kept, skipped = C.drop_unanswerable(X.queries(spark, sf), complete)
    marked = kept.select("kind", F.lit(1).alias("k")).unionByName(skipped.select("kind", F.lit(0).alias("k")))
    return marked.groupBy("kind").agg(
        F.sum("k").alias("kept"), F.sum(1 - F.col("k")).alias("skipped")
    )


@query(
    "j5_positive_pairs",
    with_(HALVES, GALLERY) + f"SELECT id, {r6('list_dot_product(audio, caption)', 'cos')} FROM gal",
)
def _(spark, sf):
    return C.positive_pairs(store(spark, sf, "audio"), store(spark, sf, "caption"))


# ------------------------------------------------------------------- captions

CAPTION_SQL = f"""ce AS (SELECT vec_id, label::BIGINT AS video, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
cn AS (SELECT *, {norm_of('e')} AS ne FROM ce),
cap AS (SELECT video, vec_id AS pos, vec_id::VARCHAR AS text, {unit('e', 'ne')} AS vec FROM cn),
cs AS (SELECT q.pos AS qid, q.video AS truth, c.video, max(list_dot_product(q.vec, c.vec)) AS std,
  coalesce(max(list_dot_product(q.vec, c.vec)) FILTER (NOT (q.video = c.video AND q.pos = c.pos)), '-Infinity'::DOUBLE) AS loo
  FROM cap q CROSS JOIN cap c GROUP BY q.pos, q.video, c.video),
cr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(std, 12) DESC, video) AS rk_std,
  row_number() OVER (PARTITION BY qid ORDER BY round(loo, 12) DESC, video) AS rk_loo FROM cs)"""


def caption_inputs(spark, sf):
    caps = X.captions(spark, sf)
    qs = K.own_positions(X.caption_queries(spark, sf), caps)
    return qs, caps


@query(
    "j6_caption_max_sim",
    with_(CAPTION_SQL) + f"SELECT qid, video, {r6('std', 'score')}, rk_std AS rk FROM cr WHERE rk_std <= 5",
)
def _(spark, sf):
    qs, caps = caption_inputs(spark, sf)
    return K.caption_top_k(qs, caps, 5)


@query(
    "j7_caption_max_sim_loo",
    with_(CAPTION_SQL) + f"SELECT qid, video, {r6('loo', 'score')}, rk_loo AS rk FROM cr WHERE rk_loo <= 5",
)
def _(spark, sf):
    qs, caps = caption_inputs(spark, sf)
    return K.caption_top_k(qs, caps, 5, loo=True)


@query(
    "j8_cross_vs_intra",
    with_(
        HALVES, GALLERY,
        """pp AS (SELECT list_dot_product(x.audio, y.caption) AS c, list_dot_product(x.audio, y.audio) AS a,
          list_dot_product(x.caption, y.caption) AS t FROM gal x CROSS JOIN gal y)""",
    ) + f"""SELECT pairs, n, {r6('mean', 'mean')}, {r6('std', 'std')} FROM (
      SELECT 'cross' AS pairs, count(*) AS n, avg(c) AS mean, stddev_samp(c) AS std FROM pp
      UNION ALL SELECT 'intra_audio', count(*), avg(a), stddev_samp(a) FROM pp
      UNION ALL SELECT 'intra_caption', count(*), avg(t), stddev_samp(t) FROM pp)""",
)
def _(spark, sf):
    """All pairs of the gallery, from one Gram pass."""
    return D.cross_vs_intra(X.gallery(spark, sf), "audio", "caption")


@query(
    "j8_cross_vs_intra_sample",
    with_(
        HALVES, GALLERY,
        """sm AS (SELECT * FROM gal ORDER BY md5('42:' || id), id LIMIT 500)""",
        """pp AS (SELECT list_dot_product(x.audio, y.caption) AS c, list_dot_product(x.audio, y.audio) AS a,
          list_dot_product(x.caption, y.caption) AS t FROM sm x CROSS JOIN sm y)""",
    ) + f"""SELECT pairs, n, {r6('mean', 'mean')}, {r6('std', 'std')} FROM (
      SELECT 'cross' AS pairs, count(*) AS n, avg(c) AS mean, stddev_samp(c) AS std FROM pp
      UNION ALL SELECT 'intra_audio', count(*), avg(a), stddev_samp(a) FROM pp
      UNION ALL SELECT 'intra_caption', count(*), avg(t), stddev_samp(t) FROM pp)""",
)
def _(spark, sf):
    """The published form: a seeded sample of 500 rows."""
    sample = W.sample(X.gallery(spark, sf), 500, 42)
    return D.cross_vs_intra(sample, "audio", "caption")


@query(
    "j9_mutual_knn",
    with_(
        HALVES, GALLERY,
        """pp AS (SELECT x.id AS qid, y.id, round(list_dot_product(x.caption, y.audio), 12) AS s FROM gal x CROSS JOIN gal y)""",
        """rr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rk,
          row_number() OVER (PARTITION BY id ORDER BY s DESC, qid) AS back FROM pp)""",
    ) + f"""SELECT qid, id, {r6('s', 'score')}, rk, back <= 5 AS mutual,
      {r6('CASE WHEN back <= 5 THEN s ELSE s - 1000 END', 'adjusted')} FROM rr WHERE rk <= 5""",
)
def _(spark, sf):
    return D.mutual_knn(store(spark, sf, "caption"), store(spark, sf, "audio"), 5)


@query(
    "j10_same_category_top1",
    with_(*_EQ, ranked()) + f"""SELECT count(*) AS n, count(*) FILTER (category = g_category) AS same,
      {r6('avg((category = g_category)::INT)', 'share')} FROM ranked WHERE rk = 1""",
)
def _(spark, sf):
    q, g = X.queries(spark, sf), X.gallery(spark, sf)
    top = S.score_top_k(q, g, 1).select("qid", "id")
    cats = g.select("id", F.col("category").alias("top_category"))
    j = top.join(cats, "id").join(q.select("qid", "category"), "qid")
    same = F.col("category") == F.col("top_category")
    return j.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(same).alias("same"),
        F.avg(same.cast("int")).alias("share"),
    )


# -------------------------------------------------------------------- ranking


@query(
    "w1_rank",
    with_(*_EQ, ranked()) + f"SELECT qid, id, rk, {r6('s', 'score')} FROM ranked WHERE rk <= 50",
)
def _(spark, sf):
    """Ranks of the 50 best places; the full ranking is every pair, so k is a parameter of score_top_k."""
    top = S.score_top_k(X.queries(spark, sf), X.gallery(spark, sf), 50)
    return S.rank_scores(top.drop("rk")).select("qid", "id", "rk", "score")


@query(
    "w2_top_k",
    with_(*_EQ, ranked()) + f"""SELECT r.qid, r.id, rk, {r6('s', 'score')}, {r6('sim_v', 'sim_v')}, {r6('sim_t', 'sim_t')},
      {r6('sim_a', 'sim_a')} FROM ranked r JOIN sc USING (qid, id) WHERE rk <= 10""",
)
def _(spark, sf):
    top = S.score_top_k(X.queries(spark, sf), X.gallery(spark, sf), 10)
    return top.select("qid", "id", "rk", "score", "sim_v", "sim_t", "sim_a")


_METRICS = ("cosine", "angular", "neg_manhattan", "neg_euclidean")


@query(
    "w2_top_k_with_gaps",
    with_(
        HALVES, GALLERY, QUERIES_SQL,
        """au AS (SELECT q.qid, q.truth, q.category, g.category AS g_category, g.id, q.q_clap AS x, g.audio AS y,
          list_dot_product(q.q_clap, g.audio) AS sim FROM qry q CROSS JOIN gal g WHERE g.energy >= 0.42::DOUBLE)""",
        fused(
            {
                "cosine": "sim", "angular": ang("sim"), "neg_euclidean": "-list_distance(x, y)",
                "neg_manhattan": "-list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2])))",
            },
            "au",
        ),
        ranked(),
    ) + f"SELECT system, qid, id, rk, {r6('s', 'score')} FROM ranked WHERE rk <= 5",
)
def _(spark, sf):
    """Five best items by audio under every metric; items without an audio vector never appear."""
    spaces = tuple(Space(m, "q_clap", "audio", m) for m in _METRICS)
    systems = tuple(System(m, tuple(int(m == o) for o in _METRICS)) for m in _METRICS)
    top = S.score_top_k(X.queries(spark, sf), X.gallery_with_gaps(spark, sf), 5, spaces, systems)
    return top.select("system", "qid", "id", "rk", "score")


@query(
    "w4_rank_of_truth_with_gaps",
    with_(
        *BASE,
        """sg AS (SELECT sc.*, g.energy >= 0.42::DOUBLE AS heard FROM sc JOIN gal g USING (id))""",
        fused({n: f"CASE WHEN heard THEN {e} ELSE '-Infinity'::DOUBLE END" for n, e in
               {"audio": "sim_a", "equal": EQUAL_SQL}.items()} | {"visual": "sim_v"}, "sg"),
        ranks(),
    ) + "SELECT system, qid, rk, n, s_truth = '-Infinity'::DOUBLE AS lost FROM ranks",
)
def _(spark, sf):
    """Ranks where some items have no audio vector: behind all others under systems that weigh audio."""
    systems = tuple(s for s in (*SINGLE, S.EQUAL) if s.name in ("audio", "visual", "equal"))
    r = S.truth_ranks(X.queries(spark, sf), X.gallery_with_gaps(spark, sf), systems=systems)
    return r.select("system", "qid", "rk", "n", (F.col("s_truth") == F.lit(float("-inf"))).alias("lost"))


@query(
    "w3_top1",
    with_(*BASE, fused({**SINGLE_SQL, "equal": EQUAL_SQL}), ranked())
    + "SELECT system, qid, id FROM ranked WHERE rk = 1",
)
def _(spark, sf):
    top = S.score_top_k(X.queries(spark, sf), X.gallery(spark, sf), 1, systems=(*SINGLE, S.EQUAL))
    return top.select("system", "qid", "id")


@query(
    "w4_rank_of_truth",
    with_(*BASE, fused({**SINGLE_SQL, "equal": EQUAL_SQL}), ranks())
    + f"SELECT system, qid, rk, n, {r6('s_truth', 's_truth')} FROM ranks",
)
def _(spark, sf):
    r = S.truth_ranks(X.queries(spark, sf), X.gallery(spark, sf), systems=(*SINGLE, S.EQUAL))
    return r.select("system", "qid", "rk", "n", "s_truth")


@query(
    "w5_hard_negatives",
    with_(*_EQ, ranked(where="id <> truth")) + f"SELECT qid, id, rk, {r6('s', 'score')} FROM ranked WHERE rk <= 10",
)
def _(spark, sf):
    top = S.score_top_k(X.queries(spark, sf), X.gallery(spark, sf), 10, exclude="truth")
    return top.select("qid", "id", "rk", "score")


RANDOM_NEG = """pl AS (SELECT vec_id AS id, row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) - 1 AS place,
    count(*) OVER () AS n FROM embeddings),
wn AS (SELECT vec_id AS qid, s AS step, (('0x' || substr(md5('42:' || vec_id), 1, 8))::BIGINT % m.n + s) % m.n AS place
  FROM embeddings, range(0, 11) r(s), (SELECT count(*) AS n FROM embeddings) m),
rn AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY step) AS draw FROM wn JOIN pl USING (place)
  WHERE id <> qid QUALIFY draw <= 10)"""


@query("w6_random_negatives", with_(RANDOM_NEG) + "SELECT qid, id, draw FROM rn")
def _(spark, sf):
    return W.random_negatives(X.queries(spark, sf), X.gallery(spark, sf), 10, 42)


KTH = """kn AS (SELECT qid, s FROM (SELECT x.id AS qid, round(list_dot_product(x.audio, y.audio), 12) AS s,
  row_number() OVER (PARTITION BY x.id ORDER BY round(list_dot_product(x.audio, y.audio), 12) DESC, y.id) AS rk
  FROM gal x JOIN gal y ON x.id <> y.id) WHERE rk = 5)"""


@query("w7_kth_neighbor_sim", with_(HALVES, GALLERY, KTH) + f"SELECT qid AS id, {r6('s', 'sigma')} FROM kn")
def _(spark, sf):
    return D.kth_neighbor_sim(store(spark, sf, "audio"), 5)


@query(
    "w8_sample",
    "SELECT vec_id AS id FROM embeddings ORDER BY md5('42:' || vec_id), vec_id LIMIT 100",
)
def _(spark, sf):
    return W.sample(X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")), 100, 42)


@query(
    "w14_pick_seeded_subset",
    """WITH r AS (SELECT vec_id AS id FROM embeddings WHERE label = 3),
      o AS (SELECT vec_id AS id FROM embeddings WHERE label <> 3 ORDER BY md5('42:' || vec_id), vec_id
        LIMIT 250 - (SELECT count(*) FROM r))
      SELECT id, true AS relevant FROM r UNION ALL SELECT id, false FROM o""",
)
def _(spark, sf):
    e = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    picked = W.pick_subset(e.select("id"), e.filter("label = 3").select("id"), 250, 42)
    return picked.select("id", "relevant")
