import numpy as np
import pytest

from modalweave.operators import align as L
from modalweave.operators import geometry as D
from modalweave.operators import scoring as S
from modalweave.operators.blocks import Limits

from helpers import unit

GRID = Limits(broadcast_rows=0, grid_rows=20)


@pytest.fixture(scope="module")
def stores(world):
    pick = lambda c: world["gallery"].selectExpr("id", f"{c} as vec")
    return pick("audio"), pick("caption")


def off_diagonal(m):
    s = m @ m.T
    return s[~np.eye(len(m), dtype=bool)]


def test_alignment_and_uniformity(world, stores):
    c = (world["a"] * world["t"]).sum(1)
    r = D.alignment(*stores).first()
    assert r["mean_cos"] == pytest.approx(c.mean()) and r["std_cos"] == pytest.approx(c.std(ddof=1))
    assert r["q05"] == pytest.approx(np.quantile(c, 0.05)) and r["alignment"] == pytest.approx((2 - 2 * c).mean())
    e = np.exp(-2 * (2 - 2 * world["a"] @ world["a"].T))
    assert D.uniformity(stores[0]).first()["uniformity"] == pytest.approx(np.log(e.mean()))
    n = world["n"]
    other = D.uniformity(stores[0], include_self=False, limits=GRID).first()["uniformity"]
    assert other == pytest.approx(np.log((e.sum() - n) / (n * (n - 1))))


def test_uniformity_of_more_pairs_than_an_integer_counts(spark):
    store = spark.range(46_400).selectExpr("id", "array(1.0D) as vec")
    row = D.uniformity(store).first()
    assert row["n"] == 46_400 and row["uniformity"] == pytest.approx(0.0)


def test_closed_forms_equal_pair_statistics(world):
    s = off_diagonal(world["a"])
    r = D.anisotropy(world["gallery"], ["audio"]).first()
    assert r["mean_cos"] == pytest.approx(s.mean()) and r["std_cos"] == pytest.approx(s.std())
    rows = {r["pairs"]: r for r in D.cross_vs_intra(world["gallery"], "audio", "caption").collect()}
    for name, m in (("cross", world["a"] @ world["t"].T), ("intra_audio", world["a"] @ world["a"].T)):
        assert rows[name]["mean"] == pytest.approx(m.mean()) and rows[name]["std"] == pytest.approx(m.std(ddof=1))


def test_overlap(world, stores):
    s = world["a"] @ world["t"].T
    pos, neg = np.diag(s), s[~np.eye(len(s), dtype=bool)]
    bins = np.linspace(s.min(), s.max(), 101)
    p, _ = np.histogram(pos, bins, density=True)
    q, _ = np.histogram(neg, bins, density=True)
    r = D.pos_neg_overlap(*stores).first()
    assert r["overlap"] == pytest.approx(np.minimum(p, q).sum() * (bins[1] - bins[0]))
    assert r["neg_mean"] == pytest.approx(neg.mean()) and r["neg_std"] == pytest.approx(neg.std())
    h = D.pos_neg_histograms(*stores, limits=GRID).agg({"n_pos": "sum", "n_neg": "sum"}).first()
    assert (h["sum(n_pos)"], h["sum(n_neg)"]) == (60, 60 * 59)


def test_margins(world, stores):
    s = world["a"] @ world["t"].T
    for r in D.margins(*stores).collect():
        neg = np.delete(s[r["id"]], r["id"])
        assert r["margin"] == pytest.approx(s[r["id"], r["id"]] - neg.max())
        assert r["mean_neg"] == pytest.approx(neg.mean())


def test_temperature_does_not_change_recall(world, stores):
    q, g = D.as_queries(stores[0]), D.as_gallery(stores[1])
    assert len({r["r1"] for r in D.temperature_sweep(q, g, D.PAIR).collect()}) == 1


def test_effective_dimension_and_pca(world):
    x = world["a"] - world["a"].mean(0)
    ev = np.linalg.eigvalsh(x.T @ x / len(x))[::-1]
    p = ev / ev.sum()
    got = D.effective_dim(world["gallery"], ["audio"]).first()["effective_dim"]
    assert got == pytest.approx(np.exp(-(p * np.log(p)).sum()))
    cum = [r["cumulative"] for r in D.pca_explained(world["gallery"], ["audio"], 4).orderBy("component").collect()]
    assert cum == pytest.approx(list(np.cumsum(p)[:4]))
    assert D.effective_dim_of(np.zeros((3, 3))) == 1.0


def test_whitening_raises_effective_dimension(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(200, 6)) * np.array([5, 1, 1, 0.3, 0.2, 0.1]) + 2
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(r.tolist(),) for r in m], "x array<double>")
    r = D.whitening_effect(df, ["x"]).first()
    assert r["dim_after"] > r["dim_before"] and abs(r["cos_after"]) < r["cos_before"]


def test_gap_and_spread(world):
    unit_mean = lambda m: m.mean(0) / np.linalg.norm(m.mean(0))
    r = D.modality_gap(world["gallery"], ["audio", "caption"]).first()
    a, t = unit_mean(world["a"]), unit_mean(world["t"])
    assert r["euclidean"] == pytest.approx(np.linalg.norm(a - t)) and r["cosine"] == pytest.approx(a @ t)
    s = D.component_spread(world["gallery"], ["audio"]).first()["spread"]
    assert s == pytest.approx(world["a"].std(0, ddof=1).mean())


def test_hubness(world, stores):
    q, g = D.as_queries(stores[1]), D.as_gallery(stores[0])
    top = S.score_top_k(q, g, 20, D.PAIR, (D.ONE,)).cache()
    occ = D.k_occurrence(top.filter("rk <= 5"), g)
    s = world["t"] @ world["a"].T
    want = np.zeros(60)
    for row in s:
        for j in sorted(range(60), key=lambda j: (-round(row[j], 12), j))[:5]:
            want[j] += 1
    got = np.zeros(60)
    for r in occ.collect():
        got[r["id"]] = r["occ"]
    assert (got == want).all() and got.sum() == 300
    z = (want - want.mean()) / want.std()
    assert D.occurrence_summary(occ).first()["skewness"] == pytest.approx((z**3).mean())
    assert D.skew_vs_k(top, g).filter("k = 5").first()["skewness"] == pytest.approx((z**3).mean())
    assert D.hub_threshold(occ) == 30
    o = D.hub_overlap(top.filter("rk = 1"), q, D.hubs(occ, 7)).first()
    hubs = {j for j in range(60) if want[j] > 7}
    assert o["gt_is_hub"] == len(hubs) and o["n"] == 60


def test_mutual_neighbours(world, stores):
    s = np.round(world["t"] @ world["a"].T, 12)
    fwd = np.argsort(-s, axis=1, kind="stable")[:, :4]
    back = np.argsort(-s, axis=0, kind="stable")[:4, :]
    edges = D.mutual_knn(stores[1], stores[0], 4)
    for r in edges.collect():
        assert r["id"] in fwd[r["qid"]]
        assert r["mutual"] == (r["qid"] in back[:, r["id"]])
        assert r["adjusted"] == pytest.approx(r["score"] - (0 if r["mutual"] else 1000))
    adj = s - 1000
    for i in range(60):
        for j in fwd[i]:
            if i in back[:, j]:
                adj[i, j] += 1000
    plain = S.truth_ranks(D.as_queries(stores[1]), D.as_gallery(stores[0]), D.PAIR, (D.ONE,))
    for r in D.mutual_knn_ranks(plain, edges).collect():
        i = r["qid"]
        before = sum(1 for j in range(60) if j != i and (adj[i, j], -j) > (adj[i, i], -i))
        assert r["rk"] == before + 1


def test_kth_neighbour_excludes_self(world, stores):
    s = off_diagonal(world["a"]).reshape(60, 59)
    for limits in (None, GRID):
        for r in D.kth_neighbor_sim(stores[0], 3, limits).collect():
            assert r["sigma"] == pytest.approx(np.sort(s[r["id"]])[-3])


def test_noisy_pairs(world, stores, spark):
    items = spark.createDataFrame([(i, i % 3, "t" * 100) for i in range(60)], "id long, category int, text string")
    rows = D.noisy_pairs(*stores, items).collect()
    c = (world["a"] * world["t"]).sum(1)
    assert {r["id"] for r in rows} == set(np.flatnonzero(c <= np.quantile(c, 0.1)).tolist())
    assert all(len(r["description"]) == 80 for r in rows)


# ------------------------------------------------------------------ alignment


@pytest.fixture(scope="module")
def rotated(spark):
    """y is a rotation of x plus noise; z lives in the space of x."""
    rng = np.random.default_rng(2)
    x = unit(rng, 300, 10) + 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rot = np.linalg.qr(rng.normal(size=(10, 10)))[0]
    y = x @ rot + 0.02 * rng.normal(size=x.shape)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(300)], "id long, x array<double>, y array<double>")
    return x, y, rot, df.repartition(5)


def test_gram(rotated):
    x, y, _, df = rotated
    g = L.gram(df, "x", "y")
    assert g.n == 300
    for got, want in ((g.sx, x.sum(0)), (g.sxx, x.T @ x), (g.syy, y.T @ y), (g.sxy, x.T @ y)):
        assert np.allclose(got, want)
    assert np.allclose(L.gram(df, "x").cov_x(1), np.cov(x.T))


def test_gram_of_different_widths(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0])], "x array<double>, y array<double>")
    g = L.gram(df, "x", "y")
    assert g.sxx.shape == (3, 3) and g.sxy.tolist() == [[1.0], [2.0], [3.0]]


@pytest.mark.parametrize("fit", [L.fit_ridge, lambda g: L.fit_ridge(g, bias=True), L.fit_procrustes])
def test_maps_are_applied_the_way_they_are_fitted(rotated, fit):
    _, _, _, df = rotated
    assert L.positive_cosine(df, "x", "y", fit(L.gram(df, "x", "y"))) > 0.99
    assert L.positive_cosine(df, "x", "y") < 0.9


def test_ridge_solution(rotated):
    x, y, _, df = rotated
    w = L.fit_ridge(L.gram(df, "x", "y"), 0.5).W
    assert np.allclose(w, np.linalg.solve(x.T @ x + 0.5 * np.eye(10), x.T @ y))


def test_procrustes_is_orthogonal(rotated):
    _, _, rot, df = rotated
    w = L.fit_procrustes(L.gram(df, "x", "y")).W
    assert np.allclose(w.T @ w, np.eye(10)) and np.abs(w - rot).max() < 0.05


def test_whitened_covariance(rotated):
    x, _, _, df = rotated
    g = L.gram(df, "x")
    z = L.fit_zca(g, 1e-9)
    white = L.affine(df.select("x"), "x", z, normalize_input=False, unit=False)
    gw = L.gram(white, "x")
    assert np.allclose(gw.cov_x(), np.eye(10), atol=1e-4) and np.allclose(gw.mean_x(), 0, atol=1e-9)


def test_cca_projects_both_views(rotated):
    x, y, _, df = rotated
    wx, wy, corr = L.fit_cca(L.gram(df, "x", "y"), 4, 1e-9)
    a, b = wx.apply(x), wy.apply(y)
    for i in range(4):
        assert np.corrcoef(a[:, i], b[:, i])[0, 1] == pytest.approx(corr[i], abs=1e-4)
    assert corr[0] > 0.95 and list(corr) == sorted(corr, reverse=True)


def test_whiten_then_ridge_equals_two_passes(rotated):
    x, y, _, df = rotated
    g = L.gram(df, "x", "y")
    wx, wy = L.fit_zca(g), L.fit_zca(g.swap())
    xw, yw = wx.apply(x), wy.apply(y)
    want = xw @ np.linalg.solve(xw.T @ xw + 1e-2 * np.eye(10), xw.T @ yw)
    assert np.allclose(L.fit_whiten_then_ridge(g).apply(x), want, atol=1e-6)


def test_select_save_and_export(rotated, spark, tmp_path):
    x, y, _, df = rotated
    g = L.gram(df, "x", "y")
    poor = L.LinearMap(np.eye(10), np.zeros(10), "identity")
    best, scores = L.select_map(df, "x", "y", [poor, L.fit_procrustes(g)])
    assert best.method == "procrustes" and scores["procrustes"] > scores["identity"]
    L.save_map(spark, best, str(tmp_path / "map"))
    back = L.load_map(spark, str(tmp_path / "map"))
    assert np.allclose(back.W, best.W) and np.allclose(back.b, best.b)
    store = L.export_store(df.selectExpr("id", "x as vec"), back)
    check = L.norm_check(store).first()
    assert check["n"] == 300 and check["mean_norm"] == pytest.approx(1.0) and check["std_norm"] < 1e-9


def test_shared_anchor_maps_a_third_view(rotated):
    x, y, rot, df = rotated
    fitted = L.fit_shared_anchor(L.gram(df, "x", "y"))
    z = unit(np.random.default_rng(9), 5, 10)
    assert np.abs(fitted.apply(z) - z @ rot).max() < 0.1


def test_local_scaling_changes_scores(world, stores):
    a, t = stores
    g, q = L.local_scaling(D.as_gallery(a), D.as_queries(t), "q", "g", 3)
    top = S.score_top_k(q, g, 60, D.PAIR, (D.ONE,)).collect()
    kth = lambda m: np.maximum(np.sort(off_diagonal(m).reshape(60, 59), axis=1)[:, -3], 1e-3)
    want = (world["t"] @ world["a"].T) / np.sqrt(np.outer(kth(world["t"]), kth(world["a"])))
    for r in top:
        assert r["score"] == pytest.approx(want[r["qid"], r["id"]], rel=1e-6)


def test_query_expansion(world, stores):
    a, t = stores
    q = L.query_expansion(D.as_queries(t), D.as_gallery(a), "q", "g", 3, 0.6)
    s = world["t"] @ world["a"].T
    for r in q.collect():
        near = np.argsort(-s[r["qid"]], kind="stable")[:3]
        want = 0.6 * world["t"][r["qid"]] + 0.4 * world["a"][near].mean(0)
        assert np.allclose(r["q"], want / np.linalg.norm(want))
