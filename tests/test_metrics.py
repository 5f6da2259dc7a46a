import numpy as np
import pytest
from pyspark.sql import functions as F

from modalweave.operators import errors as E
from modalweave.operators import fusion as G
from modalweave.operators import losses as O
from modalweave.operators import metrics as M
from modalweave.operators import scoring as S
from modalweave.operators.blocks import Space, System
from modalweave.plans.evaluate import evaluate, rank_table, standard_systems


@pytest.fixture(scope="module")
def ranks(spark):
    rng = np.random.default_rng(3)
    rows = [
        (s, q, q, int(r), 200, q % 4)
        for s, scale in (("visual", 3), ("text", 10), ("audio", 120), ("gated", 2))
        for q, r in enumerate(np.minimum(200, 1 + rng.geometric(1 / scale, 150) - 1))
    ]
    return spark.createDataFrame(rows, "system string, qid int, truth int, rk long, n long, category int").cache()


def of(ranks, system):
    return np.array([r["rk"] for r in ranks.filter(F.col("system") == system).orderBy("qid").collect()])


def test_recall_mrr_and_ranks(ranks):
    rk = of(ranks, "text")
    r = M.recall_at_k(ranks).filter("system = 'text'").first()
    assert [r[f"r{k}"] for k in (1, 5, 10)] == [pytest.approx((rk <= k).mean()) for k in (1, 5, 10)]
    assert r["r1"] <= r["r5"] <= r["r10"]
    assert M.mrr(ranks).filter("system = 'text'").first()["mrr"] == pytest.approx((1 / rk).mean())
    s = M.rank_summary(ranks).filter("system = 'text'").first()
    assert s["mean_rank"] == pytest.approx((rk - 1).mean()) and s["median_mid"] == np.median(rk - 1)
    assert s["median_low"] == np.sort(rk - 1)[(len(rk) - 1) // 2]


def test_ndcg_and_ap_follow_the_hit_rank(spark):
    one = spark.createDataFrame([("s", 3)], "system string, rk long")
    n = M.ndcg_at_k(one).first()
    assert (n["ndcg1"], n["ndcg3"]) == (0, pytest.approx(1 / np.log2(4)))
    a = M.ap_at_k(one, (2, 3)).first()
    assert (a["ap2"], a["ap3"]) == (0, pytest.approx(1 / 3))


def test_cmc_ends_at_one(ranks):
    rows = M.cmc(ranks).filter("system = 'audio'").orderBy("k").collect()
    values = [r["recall"] for r in rows]
    assert values == sorted(values) and rows[-1]["k"] == 200 and values[-1] == 1.0


def test_categories_add_up(ranks):
    rows = [r for r in M.by_category(ranks).collect() if r["system"] == "visual"]
    total = next(r for r in rows if r["category"] == "all")
    parts = [r for r in rows if r["category"] != "all"]
    assert sum(r["n_queries"] for r in parts) == total["n_queries"] == 150
    assert sum(r["r1"] * r["n_queries"] for r in parts) / 150 == pytest.approx(total["r1"])


def test_buckets_cover_every_rank(ranks):
    rk = of(ranks, "audio")
    got = {r["bucket"]: r["n"] for r in M.rank_buckets(ranks).collect() if r["system"] == "audio"}
    want = {"perfect": (rk == 1).sum(), "near": ((rk > 1) & (rk <= 10)).sum(), "far": ((rk > 10) & (rk <= 100)).sum(), "very_far": (rk > 100).sum()}
    assert got == {k: v for k, v in want.items() if v}


def test_bootstrap_interval(ranks):
    a = {(r["system"], r["k"]): r for r in M.bootstrap_ci(ranks, (1,), 400).collect()}
    b = {(r["system"], r["k"]): r for r in M.bootstrap_ci_large(ranks, (1,), 4000).collect()}
    for s in ("visual", "text", "audio"):
        p = (of(ranks, s) <= 1).mean()
        assert a[(s, 1)]["lo"] < p < a[(s, 1)]["hi"]
        assert a[(s, 1)]["lo"] == pytest.approx(b[(s, 1)]["lo"], abs=0.03)
        assert a[(s, 1)]["hi"] == pytest.approx(b[(s, 1)]["hi"], abs=0.03)


def test_binomial_draws_against_the_exact_distribution(spark):
    import hashlib
    import math

    cases = {"some": (150, 31), "few": (150, 1), "none": (150, 0), "all": (7, 7), "one": (1, 1), "many": (400_000, 123_456)}
    counts = spark.createDataFrame([(s, 5, n, h) for s, (n, h) in cases.items()], "system string, k int, n long, hits long")
    got = {(r["system"], r["b"]): r["hits"] for r in M.binomial_draws(counts, ["system", "k"], 200).collect()}
    assert len(got) == 200 * len(cases)
    for s, (n, h) in cases.items():
        total, j, cdf = 0.0, -1, []
        for j in range(n + 1):
            if 0 < h < n:
                p = h / n
                lp = math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)
                total += math.exp(lp)
            else:
                total = float(j >= h)
            cdf.append(total)
        cdf = np.array(cdf)
        for b in range(1, 201):
            u = (int(hashlib.md5(f"42:5:{b}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
            assert got[(s, b)] == int(np.searchsorted(cdf, u)), (s, b)


def test_large_bootstrap_does_not_grow_with_the_queries(spark):
    """A hundred million queries, known by their counts only."""
    counts = spark.createDataFrame([("a", 1, 100_000_000, 50_000_000)], "system string, k int, n long, hits long")
    rows = M.binomial_draws(counts, ["system", "k"], 500).collect()
    mean = np.mean([r["hits"] for r in rows])
    assert len(rows) == 500 and abs(mean - 5e7) < 5 * 5000 / np.sqrt(500)
    assert np.std([r["hits"] for r in rows]) == pytest.approx(5000, rel=0.15)


def test_agreement_and_change(ranks):
    v, t = of(ranks, "visual"), of(ranks, "text")
    got = {r["outcome"]: r["n"] for r in E.agreement(ranks, "visual", "text").collect()}
    assert got.get("both", 0) == ((v == 1) & (t == 1)).sum() and sum(got.values()) == 150
    ch = {r["change"]: r["n"] for r in E.rank_change(ranks, "text", "visual").collect()}
    assert ch.get("improved", 0) == (v < t).sum() and ch.get("degraded", 0) == (v > t).sum()
    p = {(r["s_visual"], r["s_text"], r["s_audio"]): r["n"] for r in E.success_patterns(ranks).collect()}
    assert p[(None, None, None)] == 150 and p.get((1, None, None), 0) == (v == 1).sum()


def test_standard_systems_against_numpy(world):
    q = G.without_audio(G.constant_gate(world["queries"], (0.2, 0.5, 0.1)))
    rows = rank_table(q, world["gallery"]).collect()
    assert {r["system"] for r in rows} == {s.name for s in standard_systems()}
    w = np.exp([0.2, 0.5, 0.1])
    w = w / w.sum()
    s = world["sims"]
    mats = {
        "text": s["t"], "visual+audio": (s["v"] + s["a"]) / 2,
        "gated": w[0] * s["v"] + w[1] * s["t"] + w[2] * s["a"],
        "gated_no_audio": (w[0] * s["v"] + w[1] * s["t"]) / (w[0] + w[1] + 1e-8),
    }
    for name, m in mats.items():
        want = {1000 + i: int((np.delete(m[i], i) > m[i, i]).sum()) + 1 for i in range(world["n"])}
        assert {r["qid"]: r["rk"] for r in rows if r["system"] == name} == want


def test_evaluate_reports_skipped(world):
    q = world["queries"].withColumn("truth", F.col("truth") + 5)
    out = evaluate(q, world["gallery"])
    assert out["skipped"].first()["n_skipped"] == 5
    assert out["systems"].first()["n_queries"] == world["n"] - 5


def test_oracle_weights_beat_or_match_singles(world):
    q = G.hard_oracle(world["queries"], world["gallery"])
    rows = q.select("qid", *G.WEIGHTS).collect()
    diag = np.stack([np.diag(world["sims"][m]) for m in "vta"], 1)
    for r in rows:
        assert [r[w] for w in G.WEIGHTS][int(diag[r["qid"] - 1000].argmax())] == 1.0


def test_confidence_weights(world):
    rows = G.max_confidence(world["queries"], world["gallery"], 0.5).collect()
    mean = {r["qid"]: r for r in G.mean_confidence(world["queries"], world["gallery"], 0.5).collect()}
    for r in rows:
        i = r["qid"] - 1000
        for got, fn in ((r, np.max), (mean[r["qid"]], np.mean)):
            z = np.exp(np.array([fn(world["sims"][m][i]) for m in "vta"]) / 0.5)
            assert [got[w] for w in G.WEIGHTS] == pytest.approx(list(z / z.sum()))


def test_multi_seed_rule(spark):
    rows = [("a", "r1", v) for v in (0.10, 0.11, 0.12)] + [("b", "r1", v) for v in (0.30, 0.31, 0.32)] + [("c", "r1", 0.2)]
    s = G.multi_seed(spark.createDataFrame(rows, "method string, metric string, value double"))
    assert s.filter("method = 'c'").first()["std"] == 0
    c = G.compare_methods(s, "a", "b").first()
    assert c["diff"] == pytest.approx(0.2) and c["half_width"] == pytest.approx(2.776 * np.sqrt(2 * 0.01**2 / 3))
    assert c["strictly_better"] and c["within_noise"]


# ------------------------------------------------------------- literal matrix


@pytest.fixture(scope="module")
def literal(spark):
    """Scores [[.1,.1,.9],[.9,.1,.1],[.1,.9,.1]] with truths [2, 0, 1]."""
    m = [[0.1, 0.1, 0.9], [0.9, 0.1, 0.1], [0.1, 0.9, 0.1]]
    q = spark.createDataFrame([(i, t, m[i]) for i, t in enumerate([2, 0, 1])], "qid long, truth long, q array<double>")
    g = spark.createDataFrame([(j, [float(j == k) for k in range(3)]) for j in range(3)], "id long, g array<double>")
    return q, g, (Space("s", "q", "g"),), (System("s", (1,)),)


def test_margin_uses_the_true_positive(literal):
    q, g, spaces, systems = literal
    right = O.margin_hard(q, g, 0.2, 2, spaces, systems).first()["loss"]
    wrong = O.margin_hard(q.withColumn("truth", F.col("qid")), g, 0.2, 2, spaces, systems).first()["loss"]
    assert right == 0.0 and wrong == pytest.approx(0.6)
    assert S.truth_ranks(q, g, spaces, systems).filter("rk = 1").count() == 3


def test_softmax_forms(literal):
    q, g, spaces, systems = literal
    for tau in (1.0, 0.1, 0.07):
        got = O.softmax_ce(q, g, tau, spaces, systems).first()["loss"]
        assert got == pytest.approx(np.log(1 + 2 * np.exp(-0.8 / tau)))
    assert O.SOFTMAX_TAUS["mnrl"] == O.SOFTMAX_TAUS["info_nce"]


def test_approx_ndcg_brute_force(world):
    s = sum(world["sims"].values()) / 3
    total = 0
    for i in range(world["n"]):
        neg = np.delete(s[i], i)
        w = 1 / np.log2(np.arange(2, len(neg) + 2))
        total += (w / (1 + np.exp((s[i, i] - neg) / 0.1))).sum() / w.sum()
    assert O.approx_ndcg(world["queries"], world["gallery"]).first()["loss"] == pytest.approx(total / world["n"])


def test_multi_positive_brute_force(world):
    s = sum(world["sims"].values()) / 3
    cat = np.arange(world["n"]) % 3
    e = np.exp(s / 0.05)
    want = np.mean([-np.log(e[i][cat == cat[i]].sum() / e[i].sum()) for i in range(world["n"])])
    assert O.multi_positive(world["queries"], world["gallery"]).first()["loss"] == pytest.approx(want)
