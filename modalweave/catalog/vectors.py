"""Vector function queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import vectors as V
from ..operators import align as L
from ..operators import curate as C
from ..operators import rescale as R
from ..operators import scoring as S
from ..operators.blocks import CLIP_CLAP, System
from ..plans import fixtures as X
from .common import BASE, HALVES, QUERIES_SQL, GALLERY, ang, chk, combine, norm_of, query, r6, unit, with_

_G = (HALVES, GALLERY)
_PAIRS = (HALVES, GALLERY, QUERIES_SQL,
          "pr AS (SELECT q.*, g.visual, g.caption, g.audio FROM qry q JOIN gal g ON g.id = q.truth)")


def own_pairs(spark, sf):
    """Each query beside the vectors of its truth."""
    g = X.gallery(spark, sf).select(F.col("id").alias("truth"), "visual", "caption", "audio")
    return X.queries(spark, sf).join(g, "truth")


@query(
    "v1_l2_normalize",
    with_(*_G) + f"SELECT id, {r6('sqrt(list_dot_product(visual, visual))', 'norm')}, {r6(chk('visual'), 'chk')} FROM gal",
)
def _(spark, sf):
    g = X.gallery(spark, sf)
    return g.select("id", V.norm("visual").alias("norm"), V.checksum("visual").alias("chk"))


@query(
    "v2_dot",
    with_(*_PAIRS) + f"""SELECT qid, {r6('list_dot_product(q_clip, visual)', 'v')}, {r6('list_dot_product(q_clip, caption)', 't')},
      {r6('list_dot_product(q_clap, audio)', 'a')} FROM pr""",
)
def _(spark, sf):
    return own_pairs(spark, sf).select(
        "qid", V.dot("q_clip", "visual").alias("v"), V.dot("q_clip", "caption").alias("t"),
        V.dot("q_clap", "audio").alias("a"),
    )


@query(
    "v3_angular",
    with_(*_PAIRS) + f"""SELECT qid, {r6(ang('list_dot_product(q_clip, visual)'), 'v')},
      {r6(ang('list_dot_product(q_clap, audio)', 0.5), 'a')} FROM pr""",
)
def _(spark, sf):
    return own_pairs(spark, sf).select(
        "qid", V.angular("q_clip", "visual").alias("v"), V.angular("q_clap", "audio", 0.5).alias("a")
    )


_ABS = "list_sum(list_transform(list_zip(q_clip, visual), lambda z: abs(z[1] - z[2])))"
_SQ = "list_sum(list_transform(list_zip(q_clip, visual), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@query("v4_neg_manhattan", with_(*_PAIRS) + f"SELECT qid, {r6('-' + _ABS, 's')} FROM pr")
def _(spark, sf):
    return own_pairs(spark, sf).select("qid", V.neg_manhattan("q_clip", "visual").alias("s"))


@query("v5_neg_euclidean", with_(*_PAIRS) + f"SELECT qid, {r6(f'-sqrt({_SQ})', 's')} FROM pr")
def _(spark, sf):
    return own_pairs(spark, sf).select("qid", V.neg_euclidean("q_clip", "visual").alias("s"))


@query(
    "v6_safe_cosine",
    with_(HALVES) + f"""SELECT id, {r6('list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) + 1e-8::DOUBLE)', 's')} FROM h""",
)
def _(spark, sf):
    return X.halves(spark, sf).select("id", V.safe_cosine("a", "b").alias("s"))


@query(
    "v7_row_normalisations",
    with_(
        HALVES,
        """st AS (SELECT id, e, list_avg(e) AS m, list_stddev_samp(e) AS sd, list_min(e) AS lo, list_max(e) AS hi,
          list_transform(e, lambda x: sign(x) * sqrt(abs(x))) AS p FROM h)""",
        f"pw AS (SELECT *, {norm_of('p')} AS np FROM st)",
    ) + f"""SELECT id, {r6(chk('list_transform(e, lambda x: (x - m) / (sd + 1e-8::DOUBLE))'), 'z')},
      {r6(chk('list_transform(e, lambda x: (x - lo) / (hi - lo + 1e-8::DOUBLE))'), 'mm')},
      {r6(chk(unit('p', 'np')), 'power')} FROM pw""",
)
def _(spark, sf):
    h = X.halves(spark, sf)
    return h.select(
        "id", V.checksum(V.zscore("e")).alias("z"), V.checksum(V.minmax("e")).alias("mm"),
        V.checksum(V.power_normalize("e")).alias("power"),
    )


def _pool_sql(agg):
    return with_(
        HALVES,
        f"""pl AS (SELECT category, pos, {agg}(x) AS x, count(*) AS n FROM (SELECT category, unnest(e) AS x,
          unnest(range(1, 65)) AS pos FROM h) GROUP BY category, pos)""",
    ) + f"""SELECT category, max(n) AS n, {r6('sum(x * pos) / sqrt(sum(x * x))', 'chk')} FROM pl GROUP BY category"""


@query("v8_mean_pool", _pool_sql("avg"))
def _(spark, sf):
    p = A.mean_pool(X.halves(spark, sf), "category", "e")
    return p.select("category", "n", V.checksum("vec").alias("chk"))


@query("v9_max_pool", _pool_sql("max"))
def _(spark, sf):
    p = A.max_pool(X.halves(spark, sf), "category", "e")
    return p.select("category", "n", V.checksum("vec").alias("chk"))


@query(
    "u2_vec_sum_and_mean",
    with_(
        HALVES,
        """pl AS (SELECT category, pos, sum(x) AS s, avg(x) AS m FROM (SELECT category, unnest(a) AS x,
          unnest(range(1, 33)) AS pos FROM h) GROUP BY category, pos)""",
    ) + f"""SELECT category, {r6('sum(s * pos)', 'sum_chk')}, {r6('sum(m * pos) / sqrt(sum(m * m))', 'mean_chk')} FROM pl GROUP BY category""",
)
def _(spark, sf):
    h = X.halves(spark, sf)
    total = A.combine_vectors(h, "category", "a").select(
        F.col("key").alias("category"), V.checksum("vec").alias("sum_chk")
    )
    mean = A.mean_pool_by_position(h, "category", "a").select(
        "category", V.checksum("vec").alias("mean_chk")
    )
    return total.join(mean, "category")


_BLEND = combine("visual", "audio", 0.6, 0.4)


@query(
    "v10_blend",
    with_(
        *_G,
        f"bl AS (SELECT id, visual, energy >= 0.42::DOUBLE AS has_audio, {_BLEND} AS m FROM gal)",
        f"bn AS (SELECT *, {norm_of('m')} AS nm FROM bl)",
    ) + f"SELECT id, {r6('CASE WHEN has_audio THEN ' + chk(unit('m', 'nm')) + ' ELSE ' + chk('visual') + ' END', 'chk')} FROM bn",
)
def _(spark, sf):
    g = X.gallery_with_gaps(spark, sf)
    return g.select("id", V.checksum(V.blend("visual", "audio", 0.6)).alias("chk"))


@query(
    "v11_mixed_query",
    with_(
        *_G,
        f"""mx AS (SELECT id, CASE WHEN energy >= 0.42::DOUBLE THEN {combine('visual', 'audio', 0.5, 0.5)}
          ELSE visual END AS m FROM gal)""",
        f"mn AS (SELECT *, {norm_of('m')} AS nm FROM mx)",
    ) + f"SELECT id, {r6(chk(unit('m', 'nm')), 'chk')} FROM mn",
)
def _(spark, sf):
    g = X.gallery_with_gaps(spark, sf)
    return g.select("id", V.checksum(V.mean_of_present(["visual", "audio"])).alias("chk"))


def hilbert_map(d: int = 32) -> L.LinearMap:
    i = np.arange(d)
    return L.LinearMap(1.0 / (1.0 + i[:, None] + i[None, :]), i / d, "hilbert")


_AFFINE = """list_transform(range(0, 32), lambda j: list_sum(list_transform(audio,
  lambda x, i: x / (i + j)::DOUBLE)) + j / 32.0::DOUBLE)"""


@query(
    "v12_affine",
    with_(*_G, f"af AS (SELECT id, {_AFFINE} AS y FROM gal)", f"an AS (SELECT *, {norm_of('y')} AS ny FROM af)")
    + f"SELECT id, {r6(chk(unit('y', 'ny')), 'chk')} FROM an",
)
def _(spark, sf):
    g = X.halves(spark, sf).select("id", F.col("b").alias("vec"))
    return L.affine(g, "vec", hilbert_map()).select("id", V.checksum("vec").alias("chk"))


@query(
    "v13_center",
    with_(
        *_G,
        """mu AS (SELECT pos, avg(x) AS m FROM (SELECT unnest(audio) AS x, unnest(range(1, 33)) AS pos FROM gal) GROUP BY pos)""",
        """xs AS (SELECT id, pos, x - m AS x FROM (SELECT id, unnest(audio) AS x, unnest(range(1, 33)) AS pos FROM gal)
          JOIN mu USING (pos))""",
    ) + f"SELECT id, {r6('sum(x * pos)', 'chk')}, {r6('sqrt(sum(x * x))', 'norm')} FROM xs GROUP BY id",
)
def _(spark, sf):
    g = X.gallery(spark, sf)
    centre = A.centroid(g, "audio")
    shift = L.LinearMap(np.eye(len(centre)), -centre, "center")
    c = L.affine(g.select("id", "audio"), "audio", shift, normalize_input=False, unit=False)
    return c.select("id", V.checksum("audio").alias("chk"), V.norm("audio").alias("norm"))


@query(
    "v14_pad",
    with_(*_G) + f"SELECT id, 64::BIGINT AS width, {r6(chk('list_concat(audio, list_transform(range(0, 32), lambda i: 0.0::DOUBLE))'), 'chk')} FROM gal",
)
def _(spark, sf):
    g = X.gallery(spark, sf).select("id", V.pad("audio", 64).alias("p"))
    return g.select("id", F.size("p").cast("long").alias("width"), V.checksum("p").alias("chk"))


@query(
    "v15_temperature_and_scale",
    with_(*_PAIRS) + f"SELECT qid, {r6('list_dot_product(q_clap, audio) / 0.5::DOUBLE * 0.8::DOUBLE', 's')} FROM pr",
)
def _(spark, sf):
    return own_pairs(spark, sf).select("qid", (V.dot("q_clap", "audio") / 0.5 * 0.8).alias("s"))


@query(
    "v16_score_norm",
    with_(*BASE) + f"""SELECT qid, {r6('sqrt(sum(sim_a * sim_a))', 'norm')},
      {r6('max(CASE WHEN id = truth THEN sim_a END) / sqrt(sum(sim_a * sim_a))', 's')} FROM sc GROUP BY qid""",
)
def _(spark, sf):
    return R.norm_scores(own_pairs(spark, sf), X.gallery(spark, sf))


@query(
    "v17_rank_normalised_score",
    with_(*BASE) + f"""SELECT qid, id, {r6('1.0::DOUBLE - (rk - 1) / 1.0::DOUBLE / n', 's')} FROM (SELECT qid, id,
      row_number() OVER (PARTITION BY qid ORDER BY round(sim_a, 12) DESC, id) AS rk,
      count(*) OVER (PARTITION BY qid) AS n FROM sc) WHERE rk <= 10""",
)
def _(spark, sf):
    """The ten best places of each query."""
    audio = (System("audio", (0, 0, 1)),)
    return R.rank_scores_linear(X.queries(spark, sf), X.gallery(spark, sf), 10, CLIP_CLAP, audio)


@query(
    "v18_adaptive_rescale",
    with_(*BASE, "ms AS (SELECT avg(sim_a) AS m, stddev_samp(sim_a) AS sd FROM sc)")
    + f"""SELECT qid, {r6('(sim_a - m) * (0.2::DOUBLE / sd) + 0.1::DOUBLE', 's')} FROM sc, ms WHERE id = truth""",
)
def _(spark, sf):
    return R.adaptive_rescale(own_pairs(spark, sf), X.queries(spark, sf), X.gallery(spark, sf))


@query(
    "v19_version_similarity",
    with_(*_G) + """SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN c >= 0.0 AND c < 0.5 THEN '0-0.5'
      WHEN c >= 0.5 AND c < 0.7::DOUBLE THEN '0.5-0.7' WHEN c >= 0.7::DOUBLE AND c < 0.9::DOUBLE THEN '0.7-0.9'
      WHEN c >= 0.9::DOUBLE AND c < 0.95::DOUBLE THEN '0.9-0.95' WHEN c >= 0.95::DOUBLE AND c < 0.99::DOUBLE THEN '0.95-0.99'
      WHEN c >= 0.99::DOUBLE AND c < 1.0 THEN '0.99-1' ELSE 'outside' END AS bucket
      FROM (SELECT list_dot_product(visual, caption) AS c FROM gal)) GROUP BY bucket""",
)
def _(spark, sf):
    g = X.gallery(spark, sf)
    pairs = C.positive_pairs(
        g.select("id", F.col("visual").alias("vec")), g.select("id", F.col("caption").alias("vec"))
    )
    return C.similarity_buckets(pairs)


@query(
    "u3_similarity_registry",
    with_(*_PAIRS) + f"""SELECT qid, {r6('list_dot_product(q_clip, visual)', 'cosine')}, {r6('list_dot_product(q_clip, visual)', '"dot"')},
      {r6(ang('list_dot_product(q_clip, visual)'), 'angular')}, {r6('-' + _ABS, 'neg_manhattan')}, {r6(f'-sqrt({_SQ})', 'neg_euclidean')},
      {r6('list_dot_product(q_clip, visual) / (sqrt(list_dot_product(q_clip, q_clip)) * sqrt(list_dot_product(visual, visual)) + 1e-8::DOUBLE)', 'safe_cosine')}
      FROM pr""",
)
def _(spark, sf):
    p = own_pairs(spark, sf)
    return p.select("qid", *[V.similarity(n, "q_clip", "visual").alias(n) for n in V.SIMILARITIES])
