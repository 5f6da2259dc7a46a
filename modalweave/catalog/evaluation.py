"""Metric, error-analysis, fusion and explanation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import captions as K
from ..operators import errors as E
from ..operators import explain as P
from ..operators import fusion as G
from ..operators import gates as N
from ..operators import metrics as M
from ..operators import sampling as W
from ..operators import scoring as S
from ..operators import sweeps as Z
from ..operators.blocks import CLIP_CLAP, Space, System, angular_spaces
from ..operators.quantiles import exact_quantiles
from ..plans import fixtures as X
from ..plans.evaluate import rank_table
from ..plans.search import search, search_index, weigh
from ..session import materialize
from .common import (
    BASE, EQUAL_SQL, GALLERY, GATED_BASE, GATED_SQL, GATE_SQL, HALVES, NO_AUDIO_SQL, PAIR_SQL, QUERIES_SQL, SCORES,
    SINGLE_SQL, STANDARD_RANKS, STANDARD_SQL, ang, combine, fused, norm_of, query, r6, ranked, ranks, softmax3,
    toy_gate, unit, with_,
)
from .scoring import CAPTION_SQL, caption_inputs, store


def standard_ranks(spark, sf):
    return rank_table(toy_gate(X.queries(spark, sf)), X.gallery(spark, sf))


def avg_le(k):
    return f"avg((rk <= {k})::INT)"


_R3 = f"{r6(avg_le(1), 'r1')}, {r6(avg_le(5), 'r5')}, {r6(avg_le(10), 'r10')}"


# -------------------------------------------------------------------- metrics


@query(
    "m1_recall_at_k",
    with_(*STANDARD_RANKS) + f"SELECT system, count(*) AS n_queries, {_R3} FROM ranks GROUP BY system",
)
def _(spark, sf):
    return M.recall_at_k(standard_ranks(spark, sf))


@query("m2_mrr", with_(*STANDARD_RANKS) + f"SELECT system, {r6('avg(1.0::DOUBLE / rk)', 'mrr')} FROM ranks GROUP BY system")
def _(spark, sf):
    return M.mrr(standard_ranks(spark, sf))


@query(
    "m3_rank_summary",
    with_(*STANDARD_RANKS) + f"""SELECT system, {r6('avg(rk - 1)', 'mean_rank')}, {r6('quantile_disc(rk - 1, 0.5)', 'median_low')},
      {r6('quantile_cont(rk - 1, 0.5)', 'median_mid')} FROM ranks GROUP BY system""",
)
def _(spark, sf):
    return M.rank_summary(materialize(standard_ranks(spark, sf), "ranks"))


def _gain(k):
    return f"avg(CASE WHEN rk <= {k} THEN 1.0::DOUBLE / log2(rk + 1.0::DOUBLE) ELSE 0 END)"


@query(
    "m4_ndcg_at_k",
    with_(*STANDARD_RANKS) + f"SELECT system, {r6(_gain(1), 'ndcg1')}, {r6(_gain(3), 'ndcg3')}, {r6(_gain(5), 'ndcg5')} FROM ranks GROUP BY system",
)
def _(spark, sf):
    return M.ndcg_at_k(standard_ranks(spark, sf))


def _ap(k):
    return f"avg(CASE WHEN rk <= {k} THEN 1.0::DOUBLE / rk ELSE 0 END)"


@query(
    "m5_ap_at_k",
    with_(*STANDARD_RANKS) + f"SELECT system, {r6(_ap(3), 'ap3')}, {r6(_ap(5), 'ap5')} FROM ranks GROUP BY system",
)
def _(spark, sf):
    return M.ap_at_k(standard_ranks(spark, sf))


@query(
    "m6_cmc",
    with_(*STANDARD_RANKS, "ks AS (SELECT unnest([1, 2, 5, 10, 20, 50, 100])::BIGINT AS k UNION ALL SELECT max(n) FROM ranks)")
    + f"SELECT system, k, {r6('avg((rk <= k)::INT)', 'recall')} FROM ranks CROSS JOIN ks GROUP BY system, k",
)
def _(spark, sf):
    return M.cmc(standard_ranks(spark, sf))


@query(
    "m7_by_category",
    with_(*STANDARD_RANKS) + f"""SELECT system, coalesce(category::VARCHAR, 'all') AS category, count(*) AS n_queries, {_R3}
      FROM ranks GROUP BY GROUPING SETS ((system, category), (system))""",
)
def _(spark, sf):
    return M.by_category(standard_ranks(spark, sf))


@query(
    "m8_chance_ratio",
    with_(*STANDARD_RANKS) + f"""SELECT system, {r6(avg_le(1), 'r1')}, max(n)::BIGINT AS gallery, {r6('1.0::DOUBLE / max(n)', 'chance')},
      {r6(avg_le(1) + ' * max(n)', 'ratio')} FROM ranks GROUP BY system""",
)
def _(spark, sf):
    return M.chance_ratio(standard_ranks(spark, sf))


def pair_ranks_sql(x: str, y: str, name: str) -> str:
    return f"""{name} AS (SELECT q.id AS qid, 1 + count(*) FILTER (g.id <> q.id AND
      (round(list_dot_product(q.{x}, g.{y}), 12) > round(list_dot_product(q.{x}, q.{y}), 12)
       OR (round(list_dot_product(q.{x}, g.{y}), 12) = round(list_dot_product(q.{x}, q.{y}), 12) AND g.id < q.id))) AS rk
      FROM gal q CROSS JOIN gal g GROUP BY q.id)"""


def _direction_sql(name):
    return f"""SELECT '{name}' AS direction, {_R3}, {r6('avg(1.0::DOUBLE / rk)', 'mrr')}, {r6('avg(rk - 1)', 'mean_rank')},
      {r6('quantile_disc(rk - 1, 0.5)', 'median_rank')} FROM {name}"""


def directions(a, b, names=("t2a", "a2t"), limits=None):
    """Metric block of both retrieval directions between two stores."""
    from ..operators.geometry import ONE, PAIR, as_gallery, as_queries

    out = None
    for name, x, y in zip(names, (a, b), (b, a)):
        r = materialize(S.truth_ranks(as_queries(x), as_gallery(y), PAIR, (ONE,), limits=limits), "ranks")
        zero = F.col("rk") - 1
        median = exact_quantiles(r, zero, [0.5])[None][0.5][1]
        part = r.agg(
            F.lit(name).alias("direction"), *[M.recall(k).alias(f"r{k}") for k in (1, 5, 10)],
            F.avg(1.0 / F.col("rk")).alias("mrr"), F.avg(zero).alias("mean_rank"),
            F.lit(median).alias("median_rank"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "m9_both_directions",
    with_(HALVES, GALLERY, pair_ranks_sql("caption", "audio", "t2a"), pair_ranks_sql("audio", "caption", "a2t"))
    + _direction_sql("t2a") + " UNION ALL " + _direction_sql("a2t"),
)
def _(spark, sf):
    return directions(store(spark, sf, "caption"), store(spark, sf, "audio"))


_BUCKET = "CASE WHEN rk = 1 THEN 'perfect' WHEN rk <= 10 THEN 'near' WHEN rk <= 100 THEN 'far' ELSE 'very_far' END"


@query(
    "m10_rank_buckets",
    with_(*STANDARD_RANKS) + f"""SELECT system, {_BUCKET} AS bucket, count(*) AS n,
      {r6('count(*) / sum(count(*)) OVER (PARTITION BY system)', 'share')} FROM ranks GROUP BY system, bucket""",
)
def _(spark, sf):
    return M.rank_buckets(standard_ranks(spark, sf))


@query(
    "m10_rank_shares",
    with_(*STANDARD_RANKS, "ts AS (SELECT unnest([0, 1, 5, 10, 50, 100, 500, 1000]) AS threshold)")
    + f"SELECT system, threshold, {r6('avg((rk - 1 <= threshold)::INT)', 'share')} FROM ranks CROSS JOIN ts GROUP BY ALL",
)
def _(spark, sf):
    return M.rank_shares(standard_ranks(spark, sf))


@query(
    "m11_system_table",
    with_(*STANDARD_RANKS) + f"""SELECT system, {_R3}, {r6('avg(1.0::DOUBLE / rk)', 'mrr')}, {r6('avg(rk)', 'mean_rank')}
      FROM ranks GROUP BY system""",
)
def _(spark, sf):
    return standard_ranks(spark, sf).groupBy("system").agg(
        *[M.recall(k).alias(f"r{k}") for k in (1, 5, 10)],
        F.avg(1.0 / F.col("rk")).alias("mrr"), F.avg("rk").alias("mean_rank"),
    )


# Two audio stores compared under a query of the visual space.
_VARIANT_SYSTEMS = (System("audio", (0, 0, 1)), System("equal", (1 / 3, 1 / 3, 1 / 3)), G.GATED)


def _variant_spaces(audio):
    v, t, _ = CLIP_CLAP
    return (v, t, Space("a", "q_clip", audio))


_VARIANTS = (
    HALVES, GALLERY, QUERIES_SQL, GATE_SQL,
    f"al0 AS (SELECT id, {combine('audio', 'visual', 1, 0.5)} AS m FROM gal)",
    f"al1 AS (SELECT id, m, {norm_of('m')} AS nm FROM al0)",
    f"al AS (SELECT id, {unit('m', 'nm')} AS aligned FROM al1)",
    """sv AS (SELECT q.qid, q.truth, q.category, g.id, g.category AS g_category, v.variant, w_v, w_t, w_a,
      list_dot_product(q.q_clip, g.visual) AS sim_v, list_dot_product(q.q_clip, g.caption) AS sim_t,
      list_dot_product(q.q_clip, CASE WHEN v.variant = 'raw' THEN g.audio ELSE al.aligned END) AS sim_a
      FROM qry q JOIN gw USING (qid) CROSS JOIN gal g JOIN al ON al.id = g.id
      CROSS JOIN (SELECT unnest(['raw', 'aligned']) AS variant) v)""",
    """fv AS (SELECT variant, 'audio' AS system, qid, truth, id, round(sim_a, 12) AS s FROM sv
      UNION ALL SELECT variant, 'equal', qid, truth, id, round(""" + EQUAL_SQL + """, 12) FROM sv
      UNION ALL SELECT variant, 'gated', qid, truth, id, round(""" + GATED_SQL + """, 12) FROM sv)""",
    """rv AS (SELECT s.system, s.variant, s.qid, 1 + count(*) FILTER (s.id <> s.truth AND (s.s > t.s OR (s.s = t.s
      AND s.id < s.truth))) AS rk FROM fv s JOIN fv t ON t.variant = s.variant AND t.system = s.system
      AND t.qid = s.qid AND t.id = t.truth GROUP BY ALL)""",
    """r1 AS (SELECT system, avg((rk <= 1)::INT) FILTER (variant = 'raw') AS a,
      avg((rk <= 1)::INT) FILTER (variant = 'aligned') AS b FROM rv GROUP BY system)""",
)


@query(
    "m12_compare_variants",
    with_(*_VARIANTS) + f"""SELECT system, {r6('a', 'raw_r1')}, {r6('b', 'aligned_r1')}, {r6('b - a', 'aligned_delta')},
      CASE WHEN b >= a THEN 'aligned' ELSE 'raw' END AS winner FROM r1""",
)
def _(spark, sf):
    g = X.gallery(spark, sf).withColumn("aligned", V.l2_normalize(V.add("audio", "visual", 1.0, 0.5)))
    q = toy_gate(X.queries(spark, sf))
    parts = [
        S.truth_ranks(q, g, _variant_spaces(col), _VARIANT_SYSTEMS).withColumn("variant", F.lit(name))
        for name, col in (("raw", "audio"), ("aligned", "aligned"))
    ]
    return M.compare_variants(parts[0].unionByName(parts[1]), "raw", ["aligned"])


@query(
    "m13_anchor_comparison",
    with_(*STANDARD_RANKS, """an(system, anchor) AS (VALUES ('visual', 0.2165::DOUBLE), ('text', 0.3972::DOUBLE),
      ('audio', 0.0102::DOUBLE), ('equal', 0.4303::DOUBLE), ('gated', 0.3983::DOUBLE))""")
    + f"""SELECT system, {r6('r1', 'r1')}, {r6('anchor', 'anchor')}, {r6('r1 - anchor', 'delta')} FROM
      (SELECT system, {avg_le(1)} AS r1 FROM ranks GROUP BY system) JOIN an USING (system)""",
)
def _(spark, sf):
    return M.anchor_comparison(standard_ranks(spark, sf))


@query(
    "w12_bootstrap_ci",
    with_(
        *BASE, fused({"equal": EQUAL_SQL}), ranks(),
        "pl AS (SELECT qid, rk, row_number() OVER (ORDER BY md5('42:' || qid), qid) - 1 AS place, count(*) OVER () AS n FROM ranks)",
        """dr AS (SELECT k, b, ('0x' || substr(md5('42:' || k || ':' || b || ':' || place), 1, 8))::BIGINT % n AS place
          FROM pl, range(1, 1001) r(b), (SELECT unnest([1, 5, 10]) AS k) ks)""",
        "bs AS (SELECT k, b, avg((rk <= k)::INT) AS recall FROM dr JOIN pl USING (place) GROUP BY k, b)",
    ) + f"""SELECT 'equal' AS system, k, {r6('quantile_cont(recall, 0.025)', 'lo')}, {r6('quantile_cont(recall, 0.975)', 'hi')}
      FROM bs GROUP BY k""",
)
def _(spark, sf):
    return M.bootstrap_ci(S.truth_ranks(X.queries(spark, sf), X.gallery(spark, sf)))


_BINOMIAL_SQL = (
    """pt AS (SELECT k, n, hits, hits / n AS p, CASE WHEN hits > 0 AND hits < n THEN ceil(12 * sqrt(hits * (1 - hits / n))) + 24 ELSE 0 END::BIGINT AS w
      FROM (SELECT k, count(*) AS n, count(*) FILTER (rk <= k) AS hits FROM ranks, (SELECT unnest([1, 5, 10]) AS k) GROUP BY k))""",
    "js AS (SELECT k, n, hits, unnest(range(greatest(0, hits - w), least(n, hits + w) + 1)) AS j FROM pt)",
    """lg AS (SELECT k, n, j, sum(step) OVER (PARTITION BY k ORDER BY j) AS l FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY k ORDER BY j) = 1
      THEN 0.0::DOUBLE ELSE ln((n - j + 1) / j * (hits / (n - hits))) END AS step FROM js))""",
    "ma AS (SELECT k, n, j, exp(l - max(l) OVER (PARTITION BY k)) AS m FROM lg)",
    "cd AS (SELECT k, n, j, sum(m) OVER (PARTITION BY k ORDER BY j) / sum(m) OVER (PARTITION BY k) AS c FROM ma)",
    """un AS (SELECT k, b, (('0x' || substr(md5('42:' || k || ':' || b), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u
      FROM range(1, 1001) r(b), (SELECT unnest([1, 5, 10]) AS k))""",
    "dw AS (SELECT un.k, b, min(j) / any_value(n) AS recall FROM un JOIN cd ON cd.k = un.k AND c >= u GROUP BY un.k, b)",
)


@query(
    "w12_bootstrap_ci_large",
    with_(*BASE, fused({"equal": EQUAL_SQL}), ranks(), *_BINOMIAL_SQL)
    + f"""SELECT 'equal' AS system, k, {r6('quantile_cont(recall, 0.025)', 'lo')}, {r6('quantile_cont(recall, 0.975)', 'hi')}
      FROM dw GROUP BY k""",
)
def _(spark, sf):
    return M.bootstrap_ci_large(S.truth_ranks(X.queries(spark, sf), X.gallery(spark, sf)))


@query(
    "w13_top_systems",
    with_(*STANDARD_RANKS) + f"SELECT system, {r6(avg_le(1), 'r1')} FROM ranks GROUP BY system ORDER BY {avg_le(1)} DESC, system LIMIT 5",
)
def _(spark, sf):
    return M.top_systems(M.recall_at_k(standard_ranks(spark, sf), (1,)).select("system", "r1"), "r1", 5)


# ------------------------------------------------------------- error analysis

_WIDE = """wd AS (SELECT qid, max((rk = 1)::INT) FILTER (system = 'visual') AS s_visual,
  max((rk = 1)::INT) FILTER (system = 'text') AS s_text, max((rk = 1)::INT) FILTER (system = 'audio') AS s_audio,
  max((rk = 1)::INT) FILTER (system = 'equal') AS s_equal, max((rk = 1)::INT) FILTER (system = 'gated') AS s_gated,
  max(rk) FILTER (system = 'equal') AS r_equal, max(rk) FILTER (system = 'gated') AS r_gated FROM ranks GROUP BY qid)"""


@query("e1_success", with_(*STANDARD_RANKS) + "SELECT system, qid, rk = 1 AS success FROM ranks")
def _(spark, sf):
    return E.success(standard_ranks(spark, sf))


@query(
    "e2_success_patterns",
    with_(*STANDARD_RANKS, _WIDE) + f"""SELECT s_visual, s_text, s_audio, count(*) AS n,
      {r6('count(*) / (SELECT count(*) FROM wd)', 'share')} FROM wd GROUP BY CUBE (s_visual, s_text, s_audio)""",
)
def _(spark, sf):
    return E.success_patterns(standard_ranks(spark, sf))


@query(
    "e3_gate_only_success",
    with_(*STANDARD_RANKS, _WIDE) + """SELECT count(*) AS n,
      count(*) FILTER (s_gated = 1 AND greatest(s_visual, s_text, s_audio) = 0) AS gate_only,
      count(*) FILTER (s_gated = 0 AND greatest(s_visual, s_text, s_audio) = 1) AS gate_lost FROM wd""",
)
def _(spark, sf):
    return E.gate_only_success(standard_ranks(spark, sf))


@query(
    "e4_agreement",
    with_(*STANDARD_RANKS, _WIDE) + f"""SELECT outcome, count(*) AS n, {r6('count(*) / (SELECT count(*) FROM wd)', 'share')} FROM
      (SELECT CASE WHEN s_text = 1 AND s_audio = 1 THEN 'both' WHEN s_text = 0 AND s_audio = 0 THEN 'neither'
         WHEN s_text = 1 THEN 'text_only' ELSE 'audio_only' END AS outcome FROM wd) GROUP BY outcome""",
)
def _(spark, sf):
    return E.agreement(standard_ranks(spark, sf), "text", "audio")


@query(
    "e5_rank_change",
    with_(*STANDARD_RANKS, _WIDE) + """SELECT CASE WHEN r_gated < r_equal THEN 'improved' WHEN r_gated = r_equal
      THEN 'unchanged' ELSE 'degraded' END AS change, count(*) AS n FROM wd GROUP BY change""",
)
def _(spark, sf):
    return E.rank_change(standard_ranks(spark, sf), "equal", "gated")


@query(
    "e6_loo_gap",
    with_(CAPTION_SQL, """su AS (SELECT qid, bool_or(rk_std = 1 AND video = truth) AS std, bool_or(rk_loo = 1 AND video = truth) AS loo
      FROM cr GROUP BY qid)""") + f"""SELECT count(*) AS n, {r6('avg(std::INT)', 'r1_standard')}, {r6('avg(loo::INT)', 'r1_loo')},
      count(*) FILTER (std AND loo) AS both, count(*) FILTER (NOT std AND NOT loo) AS neither,
      count(*) FILTER (std AND NOT loo) AS standard_only, count(*) FILTER (NOT std AND loo) AS loo_only,
      {r6('avg(std::INT) - avg(loo::INT)', '"drop"')},
      {r6('count(*) FILTER (std AND NOT loo) / count(*) FILTER (std)', 'exact_share')} FROM su""",
)
def _(spark, sf):
    qs, caps = caption_inputs(spark, sf)
    std = K.caption_success(K.caption_top_k(qs, caps, 1), qs)
    loo = K.caption_success(K.caption_top_k(qs, caps, 1, loo=True), qs)
    return E.loo_gap(std, loo)


_PAIR_SQL = (
    HALVES, GALLERY,
    """pp AS (SELECT x.id AS qid, x.category, y.id, y.category AS g_category,
      round(list_dot_product(x.audio, y.caption), 12) AS s FROM gal x CROSS JOIN gal y)""",
    """pr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rk FROM pp)""",
    "nz AS (SELECT quantile_cont(s, 0.1) AS cut FROM pp WHERE qid = id)",
)


@query(
    "e7_failure_class",
    with_(*_PAIR_SQL, """dg AS (SELECT t.qid, t.rk, t.category, o.g_category AS top1, t.s <= nz.cut AS noisy FROM pr t
      JOIN pr o ON o.qid = t.qid AND o.rk = 1, nz WHERE t.id = t.qid)""") + f"""SELECT class, count(*) AS n, {r6('avg(rk - 1)', 'mean_rank')}
      FROM (SELECT rk, CASE WHEN rk = 1 THEN 'A_correct' WHEN rk <= 10 THEN 'B_near_miss'
        WHEN category = top1 THEN 'C_semantic_confusion' WHEN noisy THEN 'E_noisy_pair'
        ELSE 'D_missing_semantics' END AS class FROM dg) GROUP BY class""",
)
def _(spark, sf):
    from ..operators.geometry import ONE, PAIR, as_gallery, as_queries

    a, b = store(spark, sf, "audio"), store(spark, sf, "caption")
    q, g = as_queries(a), as_gallery(b)
    r = materialize(S.truth_ranks(q, g, PAIR, (ONE,)), "pair-ranks")
    cut = exact_quantiles(r, "s_truth", [0.1])[None][0.1][0]
    cats = X.gallery(spark, sf).select(F.col("id").alias("qid"), "category")
    top = S.score_top_k(q, g, 1, PAIR, (ONE,)).select("qid", F.col("id").alias("top"))
    top = top.join(cats.select(F.col("qid").alias("top"), F.col("category").alias("top1_category")), "top")
    d = r.join(cats, "qid").join(top, "qid").withColumn("noisy", F.col("s_truth") <= F.lit(cut))
    return E.failure_class(d)


def _texts(spark, sf):
    return X.table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), "text")


def _audio_ranks(spark, sf):
    return S.truth_ranks(
        X.queries(spark, sf), X.gallery(spark, sf), systems=(System("audio", (0, 0, 1)),)
    )


_AUDIO_RANKS = (*BASE, fused({"audio": "sim_a"}), ranks())
_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


@query(
    "e8_query_length_by_bucket",
    with_(*_AUDIO_RANKS, f"""ln AS (SELECT {_BUCKET} AS bucket, len({_WORDS}) AS l FROM ranks JOIN documents ON doc_id = qid)""")
    + f"""SELECT coalesce(bucket, 'all') AS bucket, count(*) AS n, {r6('avg(l)', 'mean_len')}, {r6('stddev_pop(l)', 'std_len')}
      FROM ln GROUP BY ROLLUP (bucket)""",
)
def _(spark, sf):
    return E.query_length_by_bucket(_audio_ranks(spark, sf), _texts(spark, sf))


def _stop_sql():
    from ..functions.text import STOP_WORDS

    return ", ".join(f"'{w}'" for w in STOP_WORDS)


_VOCAB = (
    *_AUDIO_RANKS,
    rf"""vw AS (SELECT {_BUCKET} AS bucket, unnest(regexp_split_to_array(lower(text), '\s+')) AS word
      FROM ranks JOIN documents ON doc_id = qid)""",
    f"""vc AS (SELECT bucket, word, count(*) AS n FROM vw WHERE length(word) > 2 AND word NOT IN ({_stop_sql()})
      GROUP BY bucket, word)""",
)


@query(
    "e9_vocab_top_words",
    with_(*_VOCAB) + """SELECT bucket, word, n, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, word) AS place
      FROM vc QUALIFY place <= 10""",
)
def _(spark, sf):
    return E.top_words(E.vocab_counts(_audio_ranks(spark, sf), _texts(spark, sf)), 10)


@query(
    "e9_vocab_only_in",
    with_(*_VOCAB) + """SELECT 'only_in_failures' AS side, word, n FROM vc v WHERE bucket = 'very_far' AND NOT EXISTS
        (SELECT 1 FROM vc o WHERE o.bucket = 'perfect' AND o.word = v.word)
      UNION ALL SELECT 'only_in_successes', word, n FROM vc v WHERE bucket = 'perfect' AND NOT EXISTS
        (SELECT 1 FROM vc o WHERE o.bucket = 'very_far' AND o.word = v.word)""",
)
def _(spark, sf):
    return E.failure_only_words(E.vocab_counts(_audio_ranks(spark, sf), _texts(spark, sf)))


@query(
    "q3_vocab_difference",
    with_(*_VOCAB) + """SELECT 'far' AS only_in, word FROM
        (SELECT word FROM vc WHERE bucket = 'far' EXCEPT SELECT word FROM vc WHERE bucket = 'perfect')
      UNION ALL SELECT 'perfect', word FROM
        (SELECT word FROM vc WHERE bucket = 'perfect' EXCEPT SELECT word FROM vc WHERE bucket = 'far')""",
)
def _(spark, sf):
    return E.vocabulary_difference(E.vocab_counts(_audio_ranks(spark, sf), _texts(spark, sf)), "far", "perfect")


@query(
    "e10_examples",
    with_(*_AUDIO_RANKS, ranked(), f"""ex AS (SELECT qid, truth, rk, {_BUCKET} AS bucket,
      row_number() OVER (PARTITION BY {_BUCKET} ORDER BY md5('42:' || qid), qid) AS place FROM ranks QUALIFY place <= 5)""")
    + """SELECT bucket, place, ex.qid, ex.rk, t.id AS top1, md5(a.text) AS query, md5(b.text) AS top1_text FROM ex
      JOIN ranked t ON t.qid = ex.qid AND t.rk = 1 JOIN documents a ON a.doc_id = ex.qid JOIN documents b ON b.doc_id = t.id""",
)
def _(spark, sf):
    audio = (System("audio", (0, 0, 1)),)
    top = S.score_top_k(X.queries(spark, sf), X.gallery(spark, sf), 1, systems=audio)
    ex = E.examples(_audio_ranks(spark, sf), top, _texts(spark, sf))
    return ex.select(
        "bucket", "place", "qid", "rk", "top1", F.md5("query").alias("query"), F.md5("top1_text").alias("top1_text")
    )


@query(
    "e11_caption_count_distribution",
    """SELECT captions, count(*) AS videos FROM (SELECT label, count(*) AS captions FROM embeddings GROUP BY label)
      GROUP BY captions""",
)
def _(spark, sf):
    return E.caption_count_distribution(X.captions(spark, sf))


# --------------------------------------------------------------------- fusion


@query(
    "g1_equal_fusion",
    with_(*BASE, fused({**PAIR_SQL, "equal": EQUAL_SQL}), ranks()) + f"SELECT system, count(*) AS n_queries, {_R3} FROM ranks GROUP BY system",
)
def _(spark, sf):
    r = S.truth_ranks(X.queries(spark, sf), X.gallery(spark, sf), systems=G.equal_systems())
    return M.recall_at_k(r)


_AV, _AT, _AA = ang("sim_v"), ang("sim_t"), ang("sim_a", 0.5)
ANGULAR = f"sa AS (SELECT qid, truth, category, id, g_category, {_AV} AS sim_v, {_AT} AS sim_t, {_AA} AS sim_a FROM sc)"
_FIXED_SQL = {
    n: f"{v}::DOUBLE * sim_v + {t}::DOUBLE * sim_t + ({a}::DOUBLE * 0.8::DOUBLE) * sim_a"
    for n, (v, t, a) in G.FIXED.items()
}


@query(
    "g2_fixed_weights",
    with_(*BASE, ANGULAR, fused(_FIXED_SQL, "sa"), ranks()) + f"SELECT system, count(*) AS n_queries, {_R3} FROM ranks GROUP BY system",
)
def _(spark, sf):
    r = S.truth_ranks(
        X.queries(spark, sf), X.gallery(spark, sf), angular_spaces(), G.fixed_systems()
    )
    return M.recall_at_k(r)


def _confidence_sql(agg):
    w = softmax3("mv", "mt", "ma")
    return with_(
        *BASE, ANGULAR,
        f"mx AS (SELECT qid, {agg}(round(sim_v, 12)) AS mv, {agg}(round(sim_t, 12)) AS mt, {agg}(round(sim_a, 12)) AS ma FROM sa GROUP BY qid)",
        f"ww AS (SELECT qid, {w[0]} AS w_v, {w[1]} AS w_t, {w[2]} AS w_a FROM mx)",
        "sw AS (SELECT sa.*, w_v, w_t, w_a FROM sa JOIN ww USING (qid))",
        fused({"gated": "w_v * sim_v + w_t * sim_t + (w_a * 0.8::DOUBLE) * sim_a"}, "sw"), ranks(),
    ) + f"""SELECT count(*) AS n_queries, {_R3}, {r6('avg(w_v)', 'w_v')}, {r6('avg(w_t)', 'w_t')}, {r6('avg(w_a)', 'w_a')}
      FROM ranks JOIN ww USING (qid)"""


def _confidence(spark, sf, weigh):
    g = X.gallery(spark, sf)
    q = weigh(X.queries(spark, sf), g, 1.0, angular_spaces())
    r = S.truth_ranks(G.scaled_audio(q), g, angular_spaces(), (G.GATED,), carry=["w_v", "w_t", "w_a"])
    return r.agg(
        F.count(F.lit(1)).alias("n_queries"), *[M.recall(k).alias(f"r{k}") for k in (1, 5, 10)],
        F.avg("w_v").alias("w_v"), F.avg("w_t").alias("w_t"), (F.avg("w_a") / 0.8).alias("w_a"),
    )


@query("g3_max_confidence", _confidence_sql("max"))
def _(spark, sf):
    return _confidence(spark, sf, G.max_confidence)


@query("g4_mean_confidence", _confidence_sql("avg"))
def _(spark, sf):
    return _confidence(spark, sf, G.mean_confidence)


_G4C = softmax3("mv / 0.1::DOUBLE", "mt / 0.1::DOUBLE", "ma / 0.1::DOUBLE")


@query(
    "g4_mean_confidence_cosine",
    with_(*BASE, "mx AS (SELECT qid, avg(sim_v) AS mv, avg(sim_t) AS mt, avg(sim_a) AS ma FROM sc GROUP BY qid)")
    + f"SELECT qid, {r6(_G4C[0], 'w_v')}, {r6(_G4C[1], 'w_t')}, {r6(_G4C[2], 'w_a')} FROM mx",
)
def _(spark, sf):
    """Cosine means come from centroids: one pass, no pairs."""
    q = G.mean_confidence(X.queries(spark, sf), X.gallery(spark, sf), 0.1)
    return q.select("qid", *G.WEIGHTS)


def split_queries(spark, sf, seed=42):
    """Query table with a seeded 85/15 split by category."""
    return W.stratified_split(X.queries(spark, sf), "category", "qid", 0.85, seed)


def split_sql(seed=42, name="sq"):
    return f"""{name} AS (SELECT qid, CASE WHEN row_number() OVER (PARTITION BY category ORDER BY md5('{seed}:' || qid), qid) - 1
      < greatest(1, floor(count(*) OVER (PARTITION BY category) * 0.85::DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM qry)"""


@query(
    "g5_inverse_rank_weights",
    with_(
        *BASE, ANGULAR, split_sql(), fused(SINGLE_SQL, "sa"), ranks(),
        "mr AS (SELECT system, avg(1.0::DOUBLE / rk) AS m FROM ranks JOIN sq USING (qid) WHERE split = 'train' GROUP BY system)",
        """iw AS (SELECT max(m) FILTER (system = 'visual') / sum(m) AS w_v, max(m) FILTER (system = 'text') / sum(m) AS w_t,
          max(m) FILTER (system = 'audio') / sum(m) AS w_a FROM mr)""",
        "sw AS (SELECT sa.*, w_v, w_t, w_a FROM sa JOIN sq USING (qid), iw WHERE split = 'test')",
        fused({"inverse_rank": "w_v * sim_v + w_t * sim_t + (w_a * 0.8::DOUBLE) * sim_a"}, "sw", "fi"), ranks("fi", "ri"),
    ) + f"SELECT count(*) AS n_queries, {_R3}, {r6('max(w_v)', 'w_v')}, {r6('max(w_t)', 'w_t')}, {r6('max(w_a)', 'w_a')} FROM ri, iw",
)
def _(spark, sf):
    g, q = X.gallery(spark, sf), split_queries(spark, sf)
    w = G.inverse_rank_weights(q.filter("split = 'train'"), g, angular_spaces())
    r = S.truth_ranks(
        q.filter("split = 'test'"), g, angular_spaces(), (System("inverse_rank", (w[0], w[1], w[2] * 0.8)),)
    )
    return r.agg(
        F.count(F.lit(1)).alias("n_queries"), *[M.recall(k).alias(f"r{k}") for k in (1, 5, 10)],
        *[F.lit(x).alias(n) for x, n in zip(w, G.WEIGHTS)],
    )


_TRUE = "tr AS (SELECT qid, round(sim_v, 12) AS tv, round(sim_t, 12) AS tt, round(sim_a, 12) AS ta FROM sc WHERE id = truth)"


def _oracle_query_sql(weights):
    return with_(
        *BASE, _TRUE, f"ow AS (SELECT qid, {weights[0]} AS w_v, {weights[1]} AS w_t, {weights[2]} AS w_a FROM tr)",
        "so AS (SELECT sc.*, w_v, w_t, w_a FROM sc JOIN ow USING (qid))",
        fused({"gated": GATED_SQL}, "so"), ranks(),
    ) + f"SELECT count(*) AS n_queries, {_R3}, {r6('avg(w_v)', 'w_v')}, {r6('avg(w_t)', 'w_t')}, {r6('avg(w_a)', 'w_a')} FROM ranks JOIN ow USING (qid)"


def _oracle_recall(spark, sf, weigh):
    g = X.gallery(spark, sf)
    q = weigh(X.queries(spark, sf), g)
    r = S.truth_ranks(q, g, systems=(G.GATED,), carry=list(G.WEIGHTS))
    return r.agg(
        F.count(F.lit(1)).alias("n_queries"), *[M.recall(k).alias(f"r{k}") for k in (1, 5, 10)],
        *[F.avg(w).alias(w) for w in G.WEIGHTS],
    )


_HARD = [
    "(tv >= tt AND tv >= ta)::INT::DOUBLE",
    "(NOT (tv >= tt AND tv >= ta) AND tt >= ta)::INT::DOUBLE",
    "(NOT (tv >= tt AND tv >= ta) AND tt < ta)::INT::DOUBLE",
]


@query("g6_hard_oracle", _oracle_query_sql(_HARD))
def _(spark, sf):
    return _oracle_recall(spark, sf, G.hard_oracle)


SOFT_SQL = softmax3("tv / 0.5::DOUBLE", "tt / 0.5::DOUBLE", "ta / 0.5::DOUBLE")


@query("g7_soft_oracle", _oracle_query_sql(SOFT_SQL))
def _(spark, sf):
    return _oracle_recall(spark, sf, G.soft_oracle)


# The kind of a query decides which modalities it can reach.
MASKED = """mk AS (SELECT qid, kind <> 'audio' AS clip, kind NOT IN ('image', 'video') AS clap, w_v, w_t, w_a FROM qry JOIN gw USING (qid)),
ms AS (SELECT qid, CASE WHEN clip THEN w_v ELSE 0 END AS v, CASE WHEN clip THEN w_t ELSE 0 END AS t,
  CASE WHEN clap THEN CASE WHEN clip THEN w_a ELSE 1.0::DOUBLE END ELSE 0 END AS a FROM mk),
mw AS (SELECT qid, v / (v + t + a) AS w_v, t / (v + t + a) AS w_t, a / (v + t + a) AS w_a FROM ms)"""


def masked_queries(spark, sf):
    gate = toy_gate(X.queries(spark, sf)).select("qid", *G.WEIGHTS)
    return G.mask_and_renormalize(X.queries_by_kind(spark, sf).join(gate, "qid"))


@query(
    "g8_mask_and_renormalize",
    with_(HALVES, GALLERY, QUERIES_SQL, GATE_SQL, MASKED) + f"SELECT qid, {r6('w_v', 'w_v')}, {r6('w_t', 'w_t')}, {r6('w_a', 'w_a')} FROM mw",
)
def _(spark, sf):
    return masked_queries(spark, sf).select("qid", *G.WEIGHTS)


@query(
    "g9_gated_no_audio",
    with_(*GATED_BASE, fused({"gated": GATED_SQL, "gated_no_audio": NO_AUDIO_SQL}, "scw"), ranks())
    + f"SELECT system, count(*) AS n_queries, {_R3} FROM ranks GROUP BY system",
)
def _(spark, sf):
    q = G.without_audio(toy_gate(X.queries(spark, sf)))
    return M.recall_at_k(S.truth_ranks(q, X.gallery(spark, sf), systems=(G.GATED, G.GATED_NO_AUDIO)))


@query("g10_gate_mlp")
def _(spark, sf):
    """Scoring of the query gate (seeded parameters), then its retrieval quality."""
    params = N.seeded_parameters(N.gate_shapes(32, 128), 0)
    q = N.gate_mlp(X.queries(spark, sf), params)
    r = S.truth_ranks(q, X.gallery(spark, sf), systems=(G.GATED,), carry=list(G.WEIGHTS))
    return r.select("qid", "rk", *G.WEIGHTS)


@query("g11_gate_per_candidate")
def _(spark, sf):
    """Weights per query and candidate, computed and reduced tile by tile."""
    params = N.seeded_parameters(N.candidate_gate_shapes(32, 64), 0)
    gate = N.CandidateGate("per_candidate", G.WEIGHTS, params, "q_clip", 0.05)
    return S.truth_ranks(X.queries(spark, sf), X.gallery(spark, sf), systems=(gate,)).select("qid", "rk", "s_truth")


_CG = softmax3("0.3::DOUBLE", "0.6::DOUBLE", "0.1::DOUBLE")
_CGW = f"cg AS (SELECT {_CG[0]} AS w_v, {_CG[1]} AS w_t, {_CG[2]} AS w_a)"


@query(
    "g12_gate_constant",
    with_(*BASE, _CGW, "sg AS (SELECT sc.*, w_v, w_t, w_a FROM sc, cg)", fused({"gated": GATED_SQL}, "sg"), ranks())
    + f"SELECT count(*) AS n_queries, {_R3}, {r6('max(w_v)', 'w_v')}, {r6('max(w_t)', 'w_t')}, {r6('max(w_a)', 'w_a')} FROM ranks, cg",
)
def _(spark, sf):
    return _oracle_recall(spark, sf, lambda q, g: G.constant_gate(q, (0.3, 0.6, 0.1)))


_LONGW = """lw AS (SELECT qid, 'visual' AS modality, w_v AS w FROM gw UNION ALL SELECT qid, 'caption', w_t FROM gw
  UNION ALL SELECT qid, 'audio', w_a FROM gw),
dm AS (SELECT CASE WHEN w_v >= w_t AND w_v >= w_a THEN 'visual' WHEN w_t >= w_a THEN 'caption' ELSE 'audio' END AS modality,
  count(*) AS times_dominant FROM gw GROUP BY ALL)"""


@query(
    "g13_weight_stats",
    with_(HALVES, GALLERY, QUERIES_SQL, GATE_SQL, _LONGW) + f"""SELECT modality, {r6('avg(w)', 'mean')}, {r6('stddev_samp(w)', 'std')},
      {r6('stddev_pop(w)', 'std_pop')}, {r6('min(w)', 'lo')}, {r6('max(w)', 'hi')}, {r6('quantile_cont(w, 0.5)', 'median')},
      {r6('avg((w > 0.9::DOUBLE)::INT)', 'above_90')}, {r6('avg((w < 0.5::DOUBLE)::INT)', 'below_50')},
      coalesce(max(times_dominant), 0) AS times_dominant FROM lw LEFT JOIN dm USING (modality) GROUP BY modality""",
)
def _(spark, sf):
    return G.weight_stats(toy_gate(X.queries(spark, sf)))


@query(
    "g13_weight_histogram",
    with_(HALVES, GALLERY, QUERIES_SQL, GATE_SQL, _LONGW, "en AS (SELECT modality, min(w) AS lo, max(w) AS hi FROM lw GROUP BY modality)")
    + """SELECT modality, least(4, floor((w - lo) / (hi - lo) * 5))::BIGINT AS bin, count(*) AS n FROM lw JOIN en USING (modality)
      GROUP BY ALL""",
)
def _(spark, sf):
    return G.weight_histogram(toy_gate(X.queries(spark, sf)))


def _grid_sql(name, a_list, v_lo, v_hi, t_hi):
    return f"""{name} AS (SELECT v / 1000.0::DOUBLE AS w_v, (1000 - v - a) / 1000.0::DOUBLE AS w_t, a / 1000.0::DOUBLE AS w_a
      FROM (SELECT unnest([{a_list}]) AS a), range({v_lo}, {v_hi}, 5) r(v) WHERE 1000 - v - a BETWEEN 400 AND {t_hi})"""


def _candidates_sql(name, source="sa"):
    """Rows not behind the truth in every modality: no other row can come before it."""
    return f"""{name} AS (SELECT x.qid, x.id < x.truth AS earlier, x.sim_v AS xv, x.sim_t AS xt, x.sim_a AS xa,
        y.sim_v AS yv, y.sim_t AS yt, y.sim_a AS ya FROM {source} x JOIN {source} y ON y.qid = x.qid AND y.id = y.truth
      WHERE x.id <> x.truth AND (x.sim_v >= y.sim_v OR x.sim_t >= y.sim_t OR x.sim_a >= y.sim_a)),
    {name}_n AS (SELECT count(DISTINCT qid) AS n FROM {source})"""


def _sweep_sql(name, grid, source="sa"):
    """Recall of every combination of ``grid``, over the scores of ``source``."""
    expr = "round(w_v * {p}v + w_t * {p}t + (w_a * 0.8::DOUBLE) * {p}a, 12)"
    s, t = expr.format(p="x"), expr.format(p="y")
    miss = lambda k: f"1 - count(*) FILTER (ahead >= {k}) / max(n)"
    return f"""{_candidates_sql(name + '_c', source)},
    {name}_r AS (SELECT w_v, w_t, w_a, qid, count(*) FILTER ({s} > {t} OR ({s} = {t} AND earlier)) AS ahead
      FROM {name}_c CROSS JOIN {grid} GROUP BY w_v, w_t, w_a, qid),
    {name} AS (SELECT w_v, w_t, w_a, {miss(1)} AS r1, {miss(5)} AS r5, {miss(10)} AS r10
      FROM {name}_r, {name}_c_n GROUP BY w_v, w_t, w_a)"""


_SW = f"{r6('w_v', 'w_v')}, {r6('w_t', 'w_t')}, {r6('w_a', 'w_a')}, {r6('r1', 'r1')}, {r6('r5', 'r5')}, {r6('r10', 'r10')}"


@query(
    "g14_weight_sweep_coarse",
    with_(*BASE, ANGULAR, _grid_sql("gr", "5, 10, 20", 280, 500, 700), _sweep_sql("sw", "gr")) + f"SELECT {_SW} FROM sw",
)
def _(spark, sf):
    return Z.sweep_recall(X.queries(spark, sf), X.gallery(spark, sf), Z.coarse_grid())


_FINE = """b3 AS (SELECT round(w_v * 1000)::BIGINT AS v0, round(w_a * 1000)::BIGINT AS a0 FROM sw ORDER BY r1 DESC, w_v, w_a LIMIT 3),
  fa AS (SELECT v0, unnest(range(greatest(0, a0 - 10), a0 + 11, 2)) AS a FROM b3),
  fv AS (SELECT a, unnest(range(v0 - 30, v0 + 31, 2)) AS v FROM fa),
  gf AS (SELECT DISTINCT v / 1000.0::DOUBLE AS w_v, (1000 - v - a) / 1000.0::DOUBLE AS w_t, a / 1000.0::DOUBLE AS w_a FROM fv
    WHERE 1000 - v - a BETWEEN 400 AND 720)"""


@query(
    "g14_weight_sweep",
    with_(*BASE, ANGULAR, _grid_sql("gr", "5, 10, 20", 280, 500, 700), _sweep_sql("sw", "gr"), _FINE, _sweep_sql("sf", "gf"))
    + f"SELECT 'coarse' AS stage, {_SW} FROM sw UNION ALL SELECT 'fine', {_SW} FROM sf",
)
def _(spark, sf):
    """Coarse grid, best three, fine grid: hundreds of combinations in two passes."""
    return Z.weight_sweep(X.queries(spark, sf), X.gallery(spark, sf))


@query(
    "q5_union_sweep_stages",
    with_(
        *BASE, ANGULAR, split_sql(), _grid_sql("gr", "5, 10, 20", 280, 500, 700),
        "s1 AS (SELECT sa.* FROM sa JOIN sq USING (qid) WHERE split = 'train')",
        "s2 AS (SELECT sa.* FROM sa JOIN sq USING (qid) WHERE split = 'test')",
        _sweep_sql("st", "gr", "s1"), _sweep_sql("se", "gr", "s2"),
    ) + f"SELECT 'train' AS stage, {_SW} FROM st UNION ALL SELECT 'test', {_SW} FROM se",
)
def _(spark, sf):
    q, g = split_queries(spark, sf), X.gallery(spark, sf)
    part = lambda s: Z.sweep_recall(q.filter(F.col("split") == s), g, Z.coarse_grid()).withColumn("stage", F.lit(s))
    return part("train").unionByName(part("test"))


@query(
    "g15_sweep_train_select",
    with_(
        *BASE, ANGULAR, split_sql(), _grid_sql("gt", "0, 2, 5, 8, 10, 15, 20", 280, 480, 720),
        "s1 AS (SELECT sa.* FROM sa JOIN sq USING (qid) WHERE split = 'train')",
        "s2 AS (SELECT sa.* FROM sa JOIN sq USING (qid) WHERE split = 'test')",
        _sweep_sql("st", "gt", "s1"), "tp AS (SELECT w_v, w_t, w_a, r1 AS train_r1 FROM st ORDER BY r1 DESC, w_v, w_a LIMIT 15)",
        _sweep_sql("se", "tp", "s2"),
    ) + f"SELECT {_SW}, {r6('train_r1', 'train_r1')} FROM se JOIN tp USING (w_v, w_t, w_a)",
)
def _(spark, sf):
    q = split_queries(spark, sf)
    return Z.sweep_train_select(
        q.filter("split = 'train'"), q.filter("split = 'test'"), X.gallery(spark, sf)
    )


@query(
    "g16_modality_temps_scales",
    with_(*BASE, f"""st AS (SELECT qid, truth, category, id, g_category, {ang('sim_v', 0.05)} * 2.0::DOUBLE AS sim_v, {ang('sim_t')} AS sim_t,
      {ang('sim_a', 0.5)} * 0.8::DOUBLE AS sim_a FROM sc)""", fused({"equal": EQUAL_SQL}, "st"), ranks())
    + f"SELECT count(*) AS n_queries, {_R3}, {r6('avg(s_truth)', 'mean_truth')} FROM ranks",
)
def _(spark, sf):
    """Temperature .01 is clamped to .05 and scale 3 to 2."""
    spaces = G.modality_scaling({"v": 0.01}, {"v": 3.0})
    r = S.truth_ranks(X.queries(spark, sf), X.gallery(spark, sf), spaces)
    return r.agg(
        F.count(F.lit(1)).alias("n_queries"), *[M.recall(k).alias(f"r{k}") for k in (1, 5, 10)],
        F.avg("s_truth").alias("mean_truth"),
    )


@query("g17_fit_constant_gate")
def _(spark, sf):
    """The loss of the first eight steps and the weights after them; the number of steps is fixed, without a convergence test."""
    neg = N.negatives_table(X.queries(spark, sf), X.gallery(spark, sf), 10)
    fit = N.fit_constant_gate(neg, steps=8, lr=2.0, reg=0.1, target=(0.30, 0.69, 0.01))
    rows = [(i, float(l)) for i, l in enumerate(fit["history"])]
    w = [float(x) for x in fit["weights"]]
    return spark.createDataFrame(rows, "step int, loss double").select(
        "step", "loss", *[F.lit(x).alias(n) for x, n in zip(w, G.WEIGHTS)]
    )


@query("g18_fit_linear_gate")
def _(spark, sf):
    """The loss of the first three steps, each a pass over all pairs; the number of steps is fixed, without a convergence test."""
    fit = N.fit_linear_gate(X.queries(spark, sf), X.gallery(spark, sf), lr=2.0, steps=3)
    rows = [(i, float(l)) for i, l in enumerate(fit["history"])]
    return spark.createDataFrame(rows, "step int, loss double")


_SEEDS = (0, 1, 42)
_SEED_SQL = " UNION ALL ".join(
    f"""SELECT {s} AS seed, qid FROM (SELECT qid, row_number() OVER (PARTITION BY category ORDER BY md5('{s}:' || qid), qid) - 1 AS p,
      greatest(1, floor(count(*) OVER (PARTITION BY category) * 0.85::DOUBLE)) AS t FROM qry) WHERE p >= t"""
    for s in _SEEDS
)
_MULTI = (
    *GATED_BASE, fused({"equal": EQUAL_SQL, "gated": GATED_SQL}, "scw"), ranks(), f"sd AS ({_SEED_SQL})",
    """mm AS (SELECT seed, system AS method, unnest([{'metric': 'r1', 'value': avg((rk <= 1)::INT)},
      {'metric': 'mrr', 'value': avg(1.0::DOUBLE / rk)}]) AS m FROM ranks JOIN sd USING (qid) GROUP BY seed, system)""",
    """ms AS (SELECT method, m.metric AS metric, avg(m.value) AS mean, stddev_samp(m.value) AS std, count(*) AS n FROM mm
      GROUP BY method, m.metric)""",
)


def _multi_seed(spark, sf):
    q = toy_gate(X.queries(spark, sf))
    r = S.truth_ranks(q, X.gallery(spark, sf), systems=(S.EQUAL, G.GATED), carry=["category"])
    r = materialize(r, "seed-ranks")
    queries = r.select("qid", "category").distinct()
    parts = None
    for seed in _SEEDS:
        test = W.stratified_split(queries, "category", "qid", 0.85, seed).filter("split = 'test'").select("qid")
        m = r.join(test, "qid").groupBy(F.col("system").alias("method")).agg(
            M.recall(1).alias("r1"), F.avg(1.0 / F.col("rk")).alias("mrr")
        )
        long = m.select("method", F.explode(F.create_map(F.lit("r1"), "r1", F.lit("mrr"), "mrr")).alias("metric", "value"))
        parts = long if parts is None else parts.unionByName(long)
    return G.multi_seed(parts)


@query(
    "g19_multi_seed",
    with_(*_MULTI) + f"SELECT method, metric, {r6('mean', 'mean')}, {r6('std', 'std')}, n FROM ms",
)
def _(spark, sf):
    return _multi_seed(spark, sf)


@query(
    "g19_compare_methods",
    with_(*_MULTI) + f"""SELECT metric, {r6('a.mean', 'a_mean')}, {r6('b.mean', 'b_mean')}, {r6('b.mean - a.mean', 'diff')},
      {r6('2.776::DOUBLE * sqrt(a.std * a.std / a.n + b.std * b.std / b.n)', 'half_width')},
      b.mean - a.mean - 2.776::DOUBLE * sqrt(a.std * a.std / a.n + b.std * b.std / b.n) > 0 AS strictly_better,
      a.mean - b.mean <= 2.776::DOUBLE * sqrt(a.std * a.std / a.n + b.std * b.std / b.n) AS within_noise
      FROM ms a JOIN ms b USING (metric) WHERE a.method = 'equal' AND b.method = 'gated'""",
)
def _(spark, sf):
    return G.compare_methods(materialize(_multi_seed(spark, sf), "seeds"), "equal", "gated")


_ROUTE = (
    *BASE, GATE_SQL, MASKED,
    """sk AS (SELECT sc.qid, sc.truth, sc.category, sc.kind, id, g_category, mw.w_v, mw.w_t, mw.w_a,
      CASE WHEN kind <> 'audio' THEN sim_v ELSE 0 END AS sim_v, CASE WHEN kind <> 'audio' THEN sim_t ELSE 0 END AS sim_t,
      CASE WHEN kind NOT IN ('image', 'video') THEN sim_a ELSE 0 END AS sim_a FROM sc JOIN mw USING (qid))""",
)
_DOM = "CASE WHEN w_v >= w_t AND w_v >= w_a THEN 'visual' WHEN w_t >= w_a THEN 'caption' ELSE 'audio' END"
_SPREAD = "greatest(w_v, w_t, w_a) - least(w_v, w_t, w_a)"


@query(
    "g20_routing_table",
    with_(*_ROUTE) + f"""SELECT qid, kind, {r6('max(w_v)', 'w_v')}, {r6('max(w_t)', 'w_t')}, {r6('max(w_a)', 'w_a')}, max({_DOM}) AS dominant,
      {r6(f'max({_SPREAD})', 'spread')}, {r6('max(sim_v)', 'max_sim_v')}, {r6('max(sim_t)', 'max_sim_t')}, {r6('max(sim_a)', 'max_sim_a')},
      {r6('max(' + GATED_SQL + ')', 'fused_top1')} FROM sk GROUP BY qid, kind""",
)
def _(spark, sf):
    return G.routing_table(masked_queries(spark, sf), X.gallery(spark, sf))


_EXPECT = "CASE WHEN kind = 'audio' THEN 'audio' WHEN kind = 'text' THEN 'caption' ELSE 'visual' END"


@query(
    "g20_routing_acceptance",
    with_(HALVES, GALLERY, QUERIES_SQL, GATE_SQL, MASKED) + f"""SELECT max({_SPREAD}) >= 0.15::DOUBLE AS clear_spread,
      count(DISTINCT {_DOM}) AS n_dominant, count(DISTINCT {_DOM}) > 1 AS varied,
      avg(({_DOM} = {_EXPECT})::INT) >= 0.5 AS as_expected FROM mw JOIN qry USING (qid)""",
)
def _(spark, sf):
    table = G.routing_table(masked_queries(spark, sf), X.gallery(spark, sf)).withColumn(
        "expected",
        F.when(F.col("kind") == "audio", "audio").when(F.col("kind") == "text", "caption").otherwise("visual"),
    )
    return G.routing_acceptance(table)


# ---------------------------------------------------------------- explanation

_TOPK = (*_ROUTE, """tk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(w_v * sim_v + w_t * sim_t + w_a * sim_a, 12) DESC, id) AS rk
  FROM sk QUALIFY rk <= 10)""",
  """ct AS (SELECT qid, id, rk, w_v, w_t, w_a, w_v * sim_v AS v, w_t * sim_t AS t, w_a * sim_a AS a,
  w_v * sim_v + w_t * sim_t + w_a * sim_a AS f FROM tk)""")


def explained(spark, sf, k=10):
    q = masked_queries(spark, sf)
    top = S.score_top_k(q, X.gallery(spark, sf), k, systems=(G.GATED,))
    return q, P.contributions(top, q)


def _pct(c):
    return r6(f"CASE WHEN f > 0 THEN 100.0::DOUBLE * {c} / f ELSE 0 END", {"v": "visual_pct", "t": "caption_pct", "a": "audio_pct"}[c])


_CONTRIB = f"""{r6('v', 'visual_score')}, {r6('t', 'caption_score')}, {r6('a', 'audio_score')}, {r6('f', 'fused_score')},
  {_pct('v')}, {_pct('t')}, {_pct('a')}"""


@query("x1_explain_contributions", with_(*_TOPK) + f"SELECT qid, id, rk, {_CONTRIB} FROM ct")
def _(spark, sf):
    return explained(spark, sf)[1].drop(*G.WEIGHTS)


@query(
    "x2_explain_gate",
    with_(HALVES, GALLERY, QUERIES_SQL, GATE_SQL, MASKED) + f"""SELECT qid, {r6('w_v', 'w_v')}, {r6('w_t', 'w_t')}, {r6('w_a', 'w_a')}, {_DOM} AS dominant,
      {r6('greatest(w_v, w_t, w_a)', 'dominant_weight')}, {r6(_SPREAD, 'spread')} FROM mw""",
)
def _(spark, sf):
    return P.gate_decision(masked_queries(spark, sf))


_DIFF = """df AS (SELECT qid, rk, id, lead(id) OVER w AS next_id, f - lead(f) OVER w AS fd, v - lead(v) OVER w AS vd,
  t - lead(t) OVER w AS td, a - lead(a) OVER w AS ad FROM ct WINDOW w AS (PARTITION BY qid ORDER BY rk)),
dd AS (SELECT *, CASE WHEN abs(vd) >= abs(td) AND abs(vd) >= abs(ad) THEN 'visual' WHEN abs(td) >= abs(ad) THEN 'caption'
  ELSE 'audio' END AS deciding FROM df WHERE next_id IS NOT NULL)"""


@query(
    "x3_explain_difference",
    with_(*_TOPK, _DIFF) + f"""SELECT qid, rk, id, next_id, {r6('fd', 'fused_delta')}, {r6('vd', 'visual_delta')}, {r6('td', 'caption_delta')},
      {r6('ad', 'audio_delta')}, deciding, {r6("CASE deciding WHEN 'visual' THEN vd WHEN 'caption' THEN td ELSE ad END", 'deciding_delta')} FROM dd""",
)
def _(spark, sf):
    return P.ranking_differences(explained(spark, sf)[1])


_LINE = """printf('  %d. %s  score=%.4f', rk, id::VARCHAR, f + 0.0) || chr(10) ||
  printf('       visual=%.4f (%.1f%%)', v + 0.0, CASE WHEN f > 0 THEN 100.0::DOUBLE * v / f ELSE 0 END + 0.0) || chr(10) ||
  printf('       caption=%.4f (%.1f%%)', t + 0.0, CASE WHEN f > 0 THEN 100.0::DOUBLE * t / f ELSE 0 END + 0.0) || chr(10) ||
  printf('       audio=%.4f (%.1f%%)', a + 0.0, CASE WHEN f > 0 THEN 100.0::DOUBLE * a / f ELSE 0 END + 0.0)"""


@query(
    "x4_format_explanation",
    with_(*_TOPK, _DIFF, f"bd AS (SELECT qid, w_v, w_t, w_a, string_agg({_LINE}, chr(10) ORDER BY rk) AS body FROM ct GROUP BY qid, w_v, w_t, w_a)")
    + f"""SELECT qid, printf('Gating weights: [visual=%.4f, caption=%.4f, audio=%.4f]', w_v, w_t, w_a) || chr(10) ||
      printf('Dominant modality: %s (%.2f, spread=%.2f)', {_DOM}, greatest(w_v, w_t, w_a), {_SPREAD}) || chr(10) || chr(10) ||
      'Top-10 results:' || chr(10) || body || chr(10) || printf('  Rank1 vs Rank2: deciding modality = %s (Δ=%.4f)', deciding,
        CASE deciding WHEN 'visual' THEN vd WHEN 'caption' THEN td ELSE ad END) AS text FROM bd JOIN dd USING (qid) WHERE dd.rk = 1""",
)
def _(spark, sf):
    return P.format_explanations(explained(spark, sf)[1], 10)


_SEARCH = (
    HALVES, GALLERY, QUERIES_SQL,
    """mk AS (SELECT qid, kind, CASE WHEN kind <> 'audio' THEN 1.0::DOUBLE / 3.0::DOUBLE ELSE 0 END AS v,
      CASE WHEN kind <> 'audio' THEN 1.0::DOUBLE / 3.0::DOUBLE ELSE 0 END AS t,
      CASE WHEN kind IN ('image', 'video') THEN 0 WHEN kind = 'audio' THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / 3.0::DOUBLE END AS a FROM qry)""",
    "mw AS (SELECT qid, v / (v + t + a) AS w_v, t / (v + t + a) AS w_t, a / (v + t + a) AS w_a FROM mk)",
    """sk AS (SELECT q.qid, q.kind, g.id, w_v, w_t, w_a,
      CASE WHEN kind <> 'audio' THEN list_dot_product(q_clip, visual) ELSE 0 END AS sim_v,
      CASE WHEN kind <> 'audio' THEN list_dot_product(q_clip, caption) ELSE 0 END AS sim_t,
      CASE WHEN kind NOT IN ('image', 'video') THEN list_dot_product(q_clap, audio) ELSE 0 END AS sim_a
      FROM qry q JOIN mw USING (qid) CROSS JOIN gal g WHERE g.energy >= 0.42::DOUBLE)""",
    """ct AS (SELECT qid, kind, id, w_v * sim_v AS v, w_t * sim_t AS t, w_a * sim_a AS a, w_v * sim_v + w_t * sim_t + w_a * sim_a AS f,
      row_number() OVER (PARTITION BY qid ORDER BY round(w_v * sim_v + w_t * sim_t + w_a * sim_a, 12) DESC, id) AS rk FROM sk QUALIFY rk <= 10)""",
)


@query("x5_search", with_(*_SEARCH) + f"SELECT qid, kind, id, rk, {_CONTRIB} FROM ct")
def _(spark, sf):
    """Queries of all five kinds against the index of complete ids."""
    queries = X.queries_by_kind(spark, sf)
    found = search(queries, search_index(X.stores(spark, sf)), k=10)
    return found["results"].join(queries.select("qid", "kind"), "qid").drop(*G.WEIGHTS)
