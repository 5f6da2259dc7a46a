"""Embedding-geometry and ranking-loss queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion as G
from ..operators import geometry as D
from ..operators import losses as O
from ..operators import scoring as S
from ..operators.blocks import System
from ..operators.fusion import SINGLE
from ..plans import fixtures as X
from ..session import materialize
from .common import (
    BASE, EQUAL_SQL, GALLERY, GATE_SQL, HALVES, QUERIES_SQL, SINGLE_SQL, fused, query, r6, ranked, ranks, toy_gate,
    with_,
)
from .evaluation import SOFT_SQL, _TRUE
from .scoring import RANDOM_NEG, store

_G = (HALVES, GALLERY)
COLS = ["audio", "visual", "caption"]


def pairs_sql(a="audio", b="caption"):
    return f"""pp AS (SELECT x.id AS qid, y.id, round(list_dot_product(x.{a}, y.{b}), 12) AS s, x.category,
      y.category AS g_category FROM gal x CROSS JOIN gal y)"""


_PP = (*_G, pairs_sql())


@query(
    "d01_alignment",
    with_(*_G, "c AS (SELECT list_dot_product(audio, caption) AS c FROM gal)")
    + f"""SELECT count(*) AS n, {r6('avg(c)', 'mean_cos')}, {r6('stddev_samp(c)', 'std_cos')}, {r6('quantile_cont(c, 0.05)', 'q05')},
      {r6('quantile_cont(c, 0.25)', 'q25')}, {r6('quantile_cont(c, 0.5)', 'q50')}, {r6('quantile_cont(c, 0.75)', 'q75')},
      {r6('quantile_cont(c, 0.95)', 'q95')}, {r6('avg(sqrt(2 - 2 * c))', 'mean_l2')}, {r6('avg(2 - 2 * c)', 'alignment')} FROM c""",
)
def _(spark, sf):
    return D.alignment(store(spark, sf, "audio"), store(spark, sf, "caption"))


@query(
    "d02_uniformity",
    with_(*_G, "u AS (SELECT list_dot_product(x.audio, y.audio) AS c FROM gal x CROSS JOIN gal y)")
    + f"SELECT (SELECT count(*) FROM gal) AS n, {r6('ln(avg(exp(-2.0::DOUBLE * (2 - 2 * c))))', 'uniformity')} FROM u",
)
def _(spark, sf):
    return D.uniformity(store(spark, sf, "audio"))


_HIST = """mm AS (SELECT min(s) AS lo, max(s) AS hi FROM pp),
hb AS (SELECT least(99, greatest(0, floor((s - lo) / (hi - lo) * 100)))::BIGINT AS bin, count(*) FILTER (qid = id) AS n_pos,
  count(*) FILTER (qid <> id) AS n_neg FROM pp, mm GROUP BY bin)"""


@query("d03_pos_neg_histograms", with_(*_PP, _HIST) + """SELECT r.bin, coalesce(n_pos, 0) AS n_pos, coalesce(n_neg, 0) AS n_neg
  FROM range(0, 100) r(bin) LEFT JOIN hb USING (bin)""")
def _(spark, sf):
    return D.pos_neg_histograms(store(spark, sf, "audio"), store(spark, sf, "caption"))


@query(
    "d03_pos_neg_overlap",
    with_(
        *_PP, _HIST,
        "ov AS (SELECT sum(least(n_pos / (SELECT sum(n_pos) FROM hb), n_neg / (SELECT sum(n_neg) FROM hb))) AS overlap FROM hb)",
        """st AS (SELECT avg(s) FILTER (qid = id) AS pm, stddev_pop(s) FILTER (qid = id) AS ps, avg(s) FILTER (qid <> id) AS nm,
          stddev_pop(s) FILTER (qid <> id) AS ns FROM pp)""",
    ) + f"""SELECT {r6('pm', 'pos_mean')}, {r6('ps', 'pos_std')}, {r6('nm', 'neg_mean')}, {r6('ns', 'neg_std')},
      {r6('pm - nm', 'separation')}, {r6('(pm - nm) / (ps + ns)', 'ratio')}, {r6('overlap', 'overlap')} FROM st, ov""",
)
def _(spark, sf):
    return D.pos_neg_overlap(store(spark, sf, "audio"), store(spark, sf, "caption"))


_MARGIN = """mg AS (SELECT qid AS id, max(s) FILTER (qid = id) AS pos, max(s) FILTER (qid <> id) AS max_neg,
  avg(s) FILTER (qid <> id) AS mean_neg, min(s) FILTER (qid <> id) AS min_neg FROM pp GROUP BY qid)"""


@query(
    "d04_margins",
    with_(*_PP, _MARGIN) + f"""SELECT id, {r6('pos', 'pos')}, {r6('max_neg', 'max_neg')}, {r6('mean_neg', 'mean_neg')},
      {r6('min_neg', 'min_neg')}, {r6('pos - max_neg', 'margin')} FROM mg""",
)
def _(spark, sf):
    return D.margins(store(spark, sf, "audio"), store(spark, sf, "caption"))


@query(
    "d04_margin_summary",
    with_(*_PP, _MARGIN) + f"""SELECT {r6('avg(max_neg)', 'max_neg_mean')}, {r6('quantile_cont(max_neg, 0.5)', 'max_neg_median')},
      {r6('avg(mean_neg)', 'mean_neg_mean')}, {r6('avg(min_neg)', 'min_neg_mean')}, {r6('avg(pos - max_neg)', 'margin_mean')},
      {r6('avg((pos >= max_neg)::INT)', 'share_ge_0')}, {r6('avg((max_neg > pos)::INT)', 'hard_negative_ratio')} FROM mg""",
)
def _(spark, sf):
    m = D.margins(store(spark, sf, "audio"), store(spark, sf, "caption"))
    return D.margin_summary(materialize(m, "margins"))


@query(
    "d05_temperature_sweep",
    with_(*_PP, "pr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rk FROM pp)")
    + f"""SELECT tau, {r6('avg((id = qid)::INT)', 'r1')} FROM pr CROSS JOIN (SELECT unnest([0.5, 1, 2, 5, 10, 20, 50]::DOUBLE[]) AS tau)
      WHERE rk = 1 GROUP BY tau""",
)
def _(spark, sf):
    q, g = D.as_queries(store(spark, sf, "audio")), D.as_gallery(store(spark, sf, "caption"))
    return D.temperature_sweep(q, g, D.PAIR)


def _long_sql(*cols):
    return "lg AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS modality, id, unnest({c}) AS x, unnest(range(1, 33)) AS pos FROM gal" for c in cols
    ) + ")"


_CENTRES = "ce AS (SELECT modality, pos, avg(x) AS m, stddev_samp(x) AS sd FROM lg GROUP BY modality, pos)"


@query(
    "d06_centroid_spread",
    with_(*_G, _long_sql(*COLS), _CENTRES, """ds AS (SELECT modality, id, sqrt(sum((x - m) * (x - m))) AS d FROM lg
      JOIN ce USING (modality, pos) GROUP BY modality, id)""") + f"""SELECT modality, {r6('norm', 'norm')}, {r6('d', 'mean_distance')} FROM
      (SELECT modality, sqrt(sum(m * m)) AS norm FROM ce GROUP BY modality) JOIN
      (SELECT modality, avg(d) AS d FROM ds GROUP BY modality) USING (modality)""",
)
def _(spark, sf):
    return D.centroid_spread(X.gallery(spark, sf), COLS)


_GAP = (
    *_G, _long_sql(*COLS), _CENTRES,
    "cu AS (SELECT modality, pos, m / sqrt(sum(m * m) OVER (PARTITION BY modality)) AS u FROM ce)",
    """gp AS (SELECT x.modality AS a, y.modality AS b, sqrt(sum((x.u - y.u) * (x.u - y.u))) AS e, sum(x.u * y.u) AS c FROM cu x
      JOIN cu y USING (pos) WHERE (x.modality, y.modality) IN (('audio', 'visual'), ('audio', 'caption'), ('visual', 'caption')) GROUP BY ALL)""",
)


@query(
    "d07_modality_gap",
    with_(*_GAP) + f"SELECT a, b, {r6('e', 'euclidean')}, {r6('c', 'cosine')}, {r6('1 - c', 'cosine_distance')} FROM gp",
)
def _(spark, sf):
    return D.modality_gap(X.gallery(spark, sf), COLS)


@query(
    "d08_component_spread",
    with_(*_G, _long_sql(*COLS), _CENTRES) + f"SELECT modality, {r6('avg(sd)', 'spread')} FROM ce GROUP BY modality",
)
def _(spark, sf):
    return D.component_spread(X.gallery(spark, sf), COLS)


@query(
    "d08_gap_ratio",
    with_(*_GAP, "sp AS (SELECT avg(s) AS s FROM (SELECT avg(sd) AS s FROM ce WHERE modality <> 'visual' GROUP BY modality))")
    + f"SELECT a, b, {r6('e', 'euclidean')}, {r6('e / (s + 1e-8::DOUBLE)', 'gap_ratio')} FROM gp, sp",
)
def _(spark, sf):
    return D.gap_ratio(X.gallery(spark, sf), COLS)


@query(
    "d09_anisotropy",
    with_(*_G, "an AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS modality, list_dot_product(x.{c}, y.{c}) AS c FROM gal x JOIN gal y ON x.id <> y.id" for c in COLS
    ) + ")") + f"SELECT modality, {r6('avg(c)', 'mean_cos')}, {r6('stddev_pop(c)', 'std_cos')} FROM an GROUP BY modality",
)
def _(spark, sf):
    return D.anisotropy(X.gallery(spark, sf), COLS)


@query("d10_effective_dim")
def _(spark, sf):
    return D.effective_dim(X.gallery(spark, sf), COLS)


@query("d11_pca_explained")
def _(spark, sf):
    return D.pca_explained(X.gallery(spark, sf), COLS)


@query("d12_whitening_effect")
def _(spark, sf):
    return D.whitening_effect(X.gallery(spark, sf), COLS)


# -------------------------------------------------------------------- hubness

_HUB = (
    *_G, pairs_sql("caption", "audio"),
    "pr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rk FROM pp)",
    "oc AS (SELECT g.id, count(p.qid) AS occ FROM gal g LEFT JOIN pr p ON p.id = g.id AND p.rk <= 5 GROUP BY g.id)",
    "th AS (SELECT greatest(10, floor(count(*) * 0.1::DOUBLE * avg(occ))) AS t FROM oc)",
)


def _hub_inputs(spark, sf):
    return D.as_queries(store(spark, sf, "caption")), D.as_gallery(store(spark, sf, "audio"))


def _occ(spark, sf, k=5):
    q, g = _hub_inputs(spark, sf)
    return D.k_occurrence(S.score_top_k(q, g, k, D.PAIR, (D.ONE,)), g)


def skew_sql(x):
    return f"coalesce(avg(power(({x} - m) / nullif(sd, 0), 3)), 0)"


@query("d13_k_occurrence", with_(*_HUB) + "SELECT id, occ FROM oc")
def _(spark, sf):
    return _occ(spark, sf)


@query(
    "d13_occurrence_summary",
    with_(*_HUB, "ms AS (SELECT avg(occ) AS m, stddev_pop(occ) AS sd FROM oc)") + f"""SELECT count(*) AS n, {r6('avg(occ)', 'mean_occ')},
      max(occ) AS max_occ, {r6(skew_sql('occ'), 'skewness')} FROM oc, ms""",
)
def _(spark, sf):
    return D.occurrence_summary(_occ(spark, sf))


@query(
    "d14_hubs",
    with_(*_HUB) + f"""SELECT id, occ, occ > 8 AS is_hub, (SELECT count(*) FROM oc, th WHERE occ > t) AS n_published,
      {r6('(SELECT avg((occ > 8)::INT) FROM oc)', 'share')} FROM oc ORDER BY occ DESC, id LIMIT 10""",
)
def _(spark, sf):
    """Ten most retrieved items; hubs by the published threshold and by a lower one."""
    occ = _occ(spark, sf)
    n_hubs = D.hubs(occ).count()
    share = D.hubs(occ, 8).count() / occ.count()
    return D.top_hubs(occ, 10).select(
        "id", "occ", (F.col("occ") > 8).alias("is_hub"),
        F.lit(n_hubs).cast("long").alias("n_published"), F.lit(share).alias("share"),
    )


@query(
    "d15_skew_vs_k",
    with_(*_HUB, """ok AS (SELECT g.id, k, count(p.qid) AS occ FROM gal g CROSS JOIN (SELECT unnest([1, 2, 5, 10, 20]) AS k) ks
      LEFT JOIN pr p ON p.id = g.id AND p.rk <= k GROUP BY g.id, k)""",
          "om AS (SELECT *, avg(occ) OVER (PARTITION BY k) AS m, stddev_pop(occ) OVER (PARTITION BY k) AS sd FROM ok)")
    + f"SELECT k, {r6(skew_sql('occ'), 'skewness')} FROM om GROUP BY k",
)
def _(spark, sf):
    q, g = _hub_inputs(spark, sf)
    return D.skew_vs_k(S.score_top_k(q, g, 20, D.PAIR, (D.ONE,)), g)


@query(
    "d16_hub_overlap",
    with_(*_HUB, "hb AS (SELECT id FROM oc WHERE occ > 8)") + """SELECT count(*) AS n, count(*) FILTER (qid IN (SELECT id FROM hb)) AS gt_is_hub,
      count(*) FILTER (id IN (SELECT id FROM hb)) AS top1_is_hub,
      count(*) FILTER (qid IN (SELECT id FROM hb) AND id IN (SELECT id FROM hb)) AS both FROM pr WHERE rk = 1""",
)
def _(spark, sf):
    q, g = _hub_inputs(spark, sf)
    top = S.score_top_k(q, g, 5, D.PAIR, (D.ONE,))
    hub_ids = D.hubs(D.k_occurrence(top, g), 8)
    return D.hub_overlap(top.filter("rk = 1"), q, hub_ids)


@query(
    "d17_noisy_pairs",
    with_(*_PP, _MARGIN, "ct AS (SELECT quantile_cont(pos, 0.1) AS cut FROM mg)") + f"""SELECT mg.id, {r6('pos', 'pos')}, {r6('max_neg', 'max_neg')},
      i.category, md5(substring(i.text, 1, 80)) AS description FROM mg LEFT JOIN
      (SELECT gal.id, gal.category, documents.text FROM gal JOIN documents ON doc_id = gal.id) i ON i.id = mg.id, ct WHERE pos <= cut""",
)
def _(spark, sf):
    g = X.gallery(spark, sf).select("id", "category")
    docs = X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    noisy = D.noisy_pairs(store(spark, sf, "audio"), store(spark, sf, "caption"), g.join(docs, "id"))
    return noisy.withColumn("description", F.md5("description"))


# --------------------------------------------------------------------- losses

_SYS = {**SINGLE_SQL, "equal": EQUAL_SQL}
_SYSTEMS = (*SINGLE, S.EQUAL)
_F = (*BASE, fused(_SYS))
_TS = "ts AS (SELECT system, qid, s AS st FROM f WHERE id = truth)"


def _io(spark, sf):
    return X.queries(spark, sf), X.gallery(spark, sf)


def _ce_sql(tau):
    return with_(*_F, _TS, f"ce AS (SELECT system, qid, ln(sum(exp((s - st) / {tau}::DOUBLE))) AS l FROM f JOIN ts USING (system, qid) GROUP BY system, qid)")


def _softmax_forms_sql():
    from ..operators.losses import SOFTMAX_TAUS

    parts = [
        f"SELECT '{name}' AS form, system, ln(sum(exp((s - st) / {tau}::DOUBLE))) AS l FROM f JOIN ts USING (system, qid) GROUP BY system, qid"
        for name, tau in SOFTMAX_TAUS.items()
    ]
    return with_(*_F, _TS, "ce AS (" + " UNION ALL ".join(parts) + ")") + f"SELECT form, system, {r6('avg(l)', 'loss')} FROM ce GROUP BY form, system"


@query("o1_softmax_ce", _softmax_forms_sql())
def _(spark, sf):
    """Five published names of one formula: equal temperatures give equal losses."""
    q, g = _io(spark, sf)
    by_tau = O.softmax_ces(q, g, tuple(sorted(set(O.SOFTMAX_TAUS.values()))), systems=_SYSTEMS)
    out = None
    for form, tau in O.SOFTMAX_TAUS.items():
        part = by_tau[tau].select(F.lit(form).alias("form"), "system", "loss")
        out = part if out is None else out.unionByName(part)
    return out


_NEG = ranked(where="id <> truth")


@query(
    "o2_margin_hard",
    with_(*_F, _TS, _NEG) + f"SELECT system, {r6('avg(greatest(0, 0.2::DOUBLE - (st - s)))', 'loss')} FROM ranked JOIN ts USING (system, qid) WHERE rk <= 10 GROUP BY system",
)
def _(spark, sf):
    q, g = _io(spark, sf)
    return O.margin_hard(q, g, systems=_SYSTEMS)


@query(
    "o2_margin_random",
    with_(*BASE, fused({"equal": EQUAL_SQL}), _TS, RANDOM_NEG) + f"""SELECT count(*) AS n, {r6('avg(greatest(0, 0.2::DOUBLE - (st - s)))', 'loss')}
      FROM rn JOIN f USING (qid, id) JOIN ts USING (qid)""",
)
def _(spark, sf):
    return O.margin_random(*_io(spark, sf))


@query(
    "o3_approx_ndcg",
    with_(
        *BASE, fused({"equal": EQUAL_SQL}), _TS,
        "ng AS (SELECT qid, s, st, row_number() OVER (PARTITION BY qid ORDER BY id) AS j FROM f JOIN ts USING (system, qid) WHERE id <> truth)",
        "nl AS (SELECT qid, sum(1 / log2(j + 1.0::DOUBLE) / (1 + exp((st - s) / 0.1::DOUBLE))) / sum(1 / log2(j + 1.0::DOUBLE)) AS l FROM ng GROUP BY qid)",
    ) + f"SELECT {r6('avg(l)', 'loss')} FROM nl",
)
def _(spark, sf):
    return O.approx_ndcg(*_io(spark, sf))


@query(
    "o4_listnet_hybrid",
    with_(*_F, _TS, _NEG, "ce AS (SELECT system, qid, ln(sum(exp((s - st) / 0.1::DOUBLE))) AS l FROM f JOIN ts USING (system, qid) GROUP BY system, qid)")
    + f"""SELECT system, {r6('0.5::DOUBLE * a + 0.5::DOUBLE * b', 'loss')} FROM (SELECT system, avg(l) AS a FROM ce GROUP BY system) JOIN
      (SELECT system, avg(greatest(0, 0.1::DOUBLE - (st - s))) AS b FROM ranked JOIN ts USING (system, qid) WHERE rk <= 10 GROUP BY system) USING (system)""",
)
def _(spark, sf):
    q, g = _io(spark, sf)
    return O.listnet_hybrid(q, g, systems=_SYSTEMS)


@query(
    "o5_distillation",
    with_(
        *BASE, GATE_SQL, _TRUE,
        f"so AS (SELECT qid, {SOFT_SQL[0]} AS o1, {SOFT_SQL[1]} AS o2, {SOFT_SQL[2]} AS o3 FROM tr)",
        "lp AS (SELECT *, ln(exp(w_v) + exp(w_t) + exp(w_a)) AS z FROM gw JOIN so USING (qid))",
    ) + f"""SELECT {r6('avg(o1 * (ln(o1) - (w_v - z)) + o2 * (ln(o2) - (w_t - z)) + o3 * (ln(o3) - (w_a - z)))', 'kl')},
      {r6('avg(((w_v - o1) * (w_v - o1) + (w_t - o2) * (w_t - o2) + (w_a - o3) * (w_a - o3)) / 3)', 'mse')},
      {r6('avg(z - CASE WHEN o1 >= o2 AND o1 >= o3 THEN w_v WHEN o2 >= o3 THEN w_t ELSE w_a END)', 'ce')} FROM lp""",
)
def _(spark, sf):
    q, g = _io(spark, sf)
    return O.distillation(toy_gate(q), g)


@query(
    "o6_weight_regulariser",
    with_(HALVES, GALLERY, QUERIES_SQL, GATE_SQL) + f"""SELECT {r6('0.1::DOUBLE * (power(avg(w_v) - 0.359::DOUBLE, 2) + power(avg(w_t) - 0.639::DOUBLE, 2) + power(avg(w_a) - 0.002::DOUBLE, 2)) / 3', 'loss')} FROM gw""",
)
def _(spark, sf):
    return O.weight_regulariser(toy_gate(X.queries(spark, sf)), (0.359, 0.639, 0.002), 0.1)


_TWO_WAY = (
    *_G, "pp AS (SELECT x.id AS i, y.id AS j, round(list_dot_product(x.audio, y.caption), 12) AS s FROM gal x CROSS JOIN gal y)",
    "dg AS (SELECT i AS d, s AS sd FROM pp WHERE i = j)",
)


@query(
    "o7_symmetric_info_nce",
    with_(*_TWO_WAY, "r AS (SELECT i, ln(sum(exp((s - sd) / 0.07::DOUBLE))) AS l FROM pp JOIN dg ON d = i GROUP BY i)",
          "c AS (SELECT j, ln(sum(exp((s - sd) / 0.07::DOUBLE))) AS l FROM pp JOIN dg ON d = j GROUP BY j)")
    + f"SELECT {r6('((SELECT avg(l) FROM r) + (SELECT avg(l) FROM c)) / 2', 'loss')}",
)
def _(spark, sf):
    return O.symmetric_info_nce(store(spark, sf, "audio"), store(spark, sf, "caption"))


@query(
    "o8_info_nce_hard",
    with_(*_TWO_WAY, "r AS (SELECT i, ln(sum(exp(20 * (s - sd)))) AS l FROM pp JOIN dg ON d = i GROUP BY i)",
          "hn AS (SELECT i, s, sd FROM pp JOIN dg ON d = i WHERE i <> j QUALIFY row_number() OVER (PARTITION BY i ORDER BY s DESC, j) <= 20)",
          "ab AS (SELECT (SELECT avg(l) FROM r) AS a, (SELECT avg(greatest(0, 0.3::DOUBLE + 20 * (s - sd))) FROM hn) AS b)")
    + f"SELECT {r6('a', 'main')}, {r6('b', 'hinge')}, {r6('a + b', 'loss')} FROM ab",
)
def _(spark, sf):
    return O.info_nce_hard(store(spark, sf, "audio"), store(spark, sf, "caption"))


@query(
    "o9_multi_positive",
    with_(*_F, "mp AS (SELECT system, qid, -ln(sum(exp(s / 0.05::DOUBLE)) FILTER (category = g_category) / sum(exp(s / 0.05::DOUBLE))) AS l FROM f GROUP BY system, qid)")
    + f"SELECT system, {r6('avg(l)', 'loss')} FROM mp GROUP BY system",
)
def _(spark, sf):
    q, g = _io(spark, sf)
    return O.multi_positive(q, g, systems=_SYSTEMS)
