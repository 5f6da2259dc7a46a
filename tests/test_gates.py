import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from modalweave.operators import fusion as G
from modalweave.operators import gates as N
from modalweave.operators import scoring as S
from modalweave.operators import sweeps as Z
from modalweave.operators.blocks import Limits, angular_spaces

GRID = Limits(broadcast_rows=0, grid_rows=25)


def test_erf():
    x = np.linspace(-7, 7, 4001)
    assert np.abs(N.erf(x) - np.array([math.erf(v) for v in x])).max() < 1e-12


def slow_norm(x, w, b):
    m = sum(x) / len(x)
    v = sum((a - m) ** 2 for a in x) / len(x)
    return [(a - m) / math.sqrt(v + 1e-5) * wi + bi for a, wi, bi in zip(x, w, b)]


def slow_linear(x, w, b):
    return [sum(wi * xi for wi, xi in zip(row, x)) + bi for row, bi in zip(w, b)]


def slow_gelu(x):
    return [0.5 * a * (1 + math.erf(a / math.sqrt(2))) for a in x]


def slow_softmax(x):
    e = [math.exp(a - max(x)) for a in x]
    return [a / sum(e) for a in e]


@pytest.fixture(scope="module")
def params():
    rng = np.random.default_rng(0)
    p = N.seeded_parameters(N.gate_shapes(8, 6), 1)
    return {k: v + 0.1 * rng.normal(size=v.shape) for k, v in p.items()}


def test_query_gate_step_by_step(world, params):
    p = params
    rows = N.gate_mlp(world["queries"], p).collect()
    for r in rows[:10]:
        x = slow_norm(r["q_clip"], p["layer_norm_in.weight"], p["layer_norm_in.bias"])
        h = slow_norm(slow_gelu(slow_linear(x, p["fc1.weight"], p["fc1.bias"])), p["ln1.weight"], p["ln1.bias"])
        h = slow_norm(slow_gelu(slow_linear(h, p["fc2.weight"], p["fc2.bias"])), p["ln2.weight"], p["ln2.bias"])
        want = slow_softmax(slow_linear(h, p["fc3.weight"], p["fc3.bias"]))
        assert [r[w] for w in G.WEIGHTS] == pytest.approx(want)
    assert all(sum(r[w] for w in G.WEIGHTS) == pytest.approx(1.0) for r in rows)


def test_gate_leaves_null_vectors_null(world, params):
    q = world["queries"].withColumn("q_clip", F.when(F.col("qid") != 1003, F.col("q_clip")))
    rows = {r["qid"]: r for r in N.gate_mlp(q, params).collect()}
    assert rows[1003]["w_v"] is None and rows[1004]["w_v"] is not None


def test_candidate_gate_step_by_step(world):
    rng = np.random.default_rng(3)
    p = {k: v + 0.1 * rng.normal(size=v.shape) for k, v in N.seeded_parameters(N.candidate_gate_shapes(8, 4), 2).items()}
    gate = N.CandidateGate("pc", G.WEIGHTS, p, "q_clip", 0.2, pairs_at_once=70)
    n = world["n"]
    scores = np.zeros((n, n))
    for i in range(n):
        f = slow_gelu(slow_norm(slow_linear(world["qc"][i], p["query_fc.weight"], p["query_fc.bias"]), p["query_ln.weight"], p["query_ln.bias"]))
        for j in range(n):
            s = [world["sims"][m][i, j] for m in "vta"]
            h = slow_norm(s, p["sim_ln.weight"], p["sim_ln.bias"])
            h = slow_gelu(slow_norm(slow_linear(h, p["sim_fc1.weight"], p["sim_fc1.bias"]), p["sim_ln1.weight"], p["sim_ln1.bias"]))
            h = slow_gelu(slow_norm(slow_linear(h, p["sim_fc2.weight"], p["sim_fc2.bias"]), p["sim_ln2.weight"], p["sim_ln2.bias"]))
            w = [max(0.2, a) for a in slow_softmax(slow_linear(f + h, p["fusion_fc.weight"], p["fusion_fc.bias"]))]
            scores[i, j] = sum(a * b for a, b in zip(w, s)) / sum(w)
    for limits in (None, GRID):
        for r in S.truth_ranks(world["queries"], world["gallery"], systems=(gate,), limits=limits).collect():
            i = r["qid"] - 1000
            assert r["s_truth"] == pytest.approx(scores[i, i], abs=1e-9)
            assert r["rk"] == 1 + (np.delete(scores[i], i) > scores[i, i]).sum()


def test_candidate_gate_with_missing_vectors(spark):
    p = N.seeded_parameters(N.candidate_gate_shapes(2, 4), 5)
    gate = N.CandidateGate("pc", G.WEIGHTS, p, "q_clip", 0.1)
    gallery = spark.createDataFrame(
        [(0, [1.0, 0.0], [1.0, 0.0], [1.0, 0.0]), (1, [1.0, 0.0], [1.0, 0.0], None), (2, [0.0, 1.0], [0.0, 1.0], [0.0, 1.0])],
        "id long, visual array<double>, caption array<double>, audio array<double>",
    )
    asked = spark.createDataFrame(
        [(10, 0, [1.0, 0.0], [1.0, 0.0]), (11, 1, [1.0, 0.0], [1.0, 0.0]), (12, 1, [1.0, 0.0], None)],
        "qid long, truth long, q_clip array<double>, q_clap array<double>",
    )
    for limits in (None, GRID):
        got = {r["qid"]: r for r in S.truth_ranks(asked, gallery, systems=(gate,), limits=limits).collect()}
        assert got[10]["rk"] == 1
        assert got[11]["rk"] == 3 and got[11]["s_truth"] == -np.inf  # the query asks for sound, the truth has none
        assert np.isfinite(got[12]["s_truth"]) and got[12]["rk"] <= 2  # no sound asked for: the row competes


def test_mask_cases(spark):
    rows = [(1, [1.0], [1.0]), (2, [1.0], None), (3, None, [1.0])]
    q = spark.createDataFrame(rows, "qid int, q_clip array<double>, q_clap array<double>")
    q = q.select("*", F.lit(0.5).alias("w_v"), F.lit(0.3).alias("w_t"), F.lit(0.2).alias("w_a"))
    got = {r["qid"]: [r[w] for w in G.WEIGHTS] for r in G.mask_and_renormalize(q).collect()}
    assert got[1] == pytest.approx([0.5, 0.3, 0.2])
    assert got[2] == pytest.approx([0.625, 0.375, 0.0]) and got[3] == [0.0, 0.0, 1.0]


def test_negatives_and_constant_fit(world):
    neg = N.negatives_table(world["queries"], world["gallery"], 5)
    assert neg.count() == world["n"] * 5
    d = np.array([[r["d_v"], r["d_t"], r["d_a"]] for r in neg.collect()])
    fit = N.fit_constant_gate(neg, margin=0.2, steps=12, lr=2.0)
    loss = lambda w: np.maximum(0, 0.2 - d @ w).mean()
    assert fit["history"][0] == pytest.approx(loss(np.full(3, 1 / 3)), abs=1e-6)
    assert loss(fit["weights"]) < fit["history"][0] and fit["weights"].sum() == pytest.approx(1)
    pulled = N.fit_constant_gate(neg, steps=12, lr=2.0, reg=50.0, target=(0.30, 0.69, 0.01))
    assert np.abs(pulled["weights"] - [0.30, 0.69, 0.01]).max() < np.abs(fit["weights"] - [0.30, 0.69, 0.01]).max()
    soft = N.fit_constant_gate(neg, loss="mnrl", steps=6, lr=0.2)
    assert soft["history"][-1] < soft["history"][0]


def test_linear_fit_follows_the_gradient(world):
    fit = N.fit_linear_gate(world["queries"], world["gallery"], lr=0.5, steps=3)
    s = np.stack([world["sims"][m] for m in "vta"], 2)
    f = s.mean(1)

    def loss(w, b):
        z = f @ w + b
        e = np.exp(z - z.max(1, keepdims=True))
        g = e / e.sum(1, keepdims=True)
        fused = (s * g[:, None, :]).sum(2)
        return (np.log(np.exp(fused).sum(1)) - np.diag(fused)).mean()

    w, b = np.zeros((3, 3)), np.zeros(3)
    history = []
    for _ in range(3):
        history.append(loss(w, b))
        gw, gb, h = np.zeros((3, 3)), np.zeros(3), 1e-6
        for j in range(3):
            step = np.eye(3)[j] * h
            gb[j] = (loss(w, b + step) - loss(w, b - step)) / (2 * h)
            for i in range(3):
                m = np.zeros((3, 3))
                m[i, j] = h
                gw[i, j] = (loss(w + m, b) - loss(w - m, b)) / (2 * h)
        w, b = w - 0.5 * gw, b - 0.5 * gb
    assert fit["history"] == pytest.approx(history, abs=1e-8)
    assert np.allclose(fit["W"], w, atol=1e-6) and np.allclose(fit["b"], b, atol=1e-6)


@pytest.mark.parametrize("lr, passes", [(0.5, 1), (40.0, 3)])
def test_linear_fit_makes_few_passes(world, monkeypatch, lr, passes):
    """One pass serves the steps whose weights stay near; the figures are those of a pass per step."""
    plain, made = N.weight_expansion, []
    monkeypatch.setattr(N, "weight_expansion", lambda *a, **k: made.append(1) or plain(*a, **k))
    fit = N.fit_linear_gate(world["queries"], world["gallery"], lr=lr, steps=3)
    assert 1 <= len(made) <= passes and (passes == 1 or len(made) > 1)
    monkeypatch.setattr(N, "can_expand", lambda *a: False)
    made.clear()
    full = N.fit_linear_gate(world["queries"], world["gallery"], lr=lr, steps=3)
    assert not made and fit["history"] == pytest.approx(full["history"], abs=2e-8)
    assert np.allclose(fit["W"], full["W"], atol=1e-7 * lr) and np.allclose(fit["b"], full["b"], atol=1e-7 * lr)


def test_expansion_in_blocks(world):
    """Sums of e^s at and beside the weights, from queries and gallery in a grid of blocks."""
    q = N.linear_gate_weights(world["queries"].selectExpr("*", "0.1 AS f_v", "0.2 AS f_t", "0.3 AS f_a"), np.eye(3), np.zeros(3))
    for limits in (None, GRID):
        rows = N.weight_expansion(q, world["gallery"], limits=limits).join(q.select("qid", *G.WEIGHTS), "qid").orderBy("qid").collect()
        assert len(rows) == world["n"]
        for d in ((0.0, 0.0), (0.02, -0.03)):
            sums = [sum(r[n] * d[0] ** i * d[1] ** j / math.factorial(i) / math.factorial(j) for n, (i, j) in zip(N.Z_TERMS, N.TERMS)) for r in rows]
            w = np.array([[r[n] for n in G.WEIGHTS] for r in rows]) + [d[0], d[1], -d[0] - d[1]]
            s = sum(world["sims"][m] * w[:, i, None] for i, m in enumerate("vta"))
            assert sums == pytest.approx(np.exp(s).sum(axis=1), rel=3e-8)


def angular(world):
    a = {m: 1 - np.arccos(np.clip(s, -1, 1)) / np.pi for m, s in world["sims"].items()}
    a["a"] = a["a"] / 0.5
    return a


def brute_recall(world, combos, qs=None):
    a = angular(world)
    qs = range(world["n"]) if qs is None else qs
    out = {}
    for v, t, x in combos:
        f = np.round(v * a["v"] + t * a["t"] + (x * 0.8) * a["a"], 12)
        rk = np.array([1 + (np.delete(f[i], i) > f[i, i]).sum() for i in qs])
        out[(round(v, 4), round(x, 4))] = [(rk <= k).mean() for k in (1, 5, 10)]
    return out


def test_grids():
    coarse = Z.coarse_grid()
    assert all(0.4 <= t <= 0.7 and abs(v + t + a - 1) < 1e-9 for v, t, a in coarse)
    assert min(v for v, _, _ in coarse) == 0.28 and max(v for v, _, _ in coarse) == 0.495
    fine = Z.fine_grid([(0.3, 0.69, 0.01)])
    assert len(fine) == len(set(fine)) and all(0.4 <= t <= 0.72 for _, t, _ in fine)
    assert min(a for _, _, a in fine) == 0.0 and max(a for _, _, a in fine) == 0.02


def test_two_stage_sweep_against_brute_force(world):
    rows = Z.weight_sweep(world["queries"], world["gallery"]).collect()
    coarse = [r for r in rows if r["stage"] == "coarse"]
    assert len(coarse) == len(Z.coarse_grid())
    best = sorted(coarse, key=lambda r: (-r["r1"], r["w_v"], r["w_a"]))[:3]
    fine = Z.fine_grid([(r["w_v"], r["w_t"], r["w_a"]) for r in best])
    assert len(rows) == len(coarse) + len(fine)
    want = brute_recall(world, Z.coarse_grid() + fine)
    for r in rows:
        assert [r["r1"], r["r5"], r["r10"]] == pytest.approx(want[(round(r["w_v"], 4), round(r["w_a"], 4))])


def test_train_selection_never_looks_at_test(world):
    train = world["queries"].filter("qid < 1040")
    test = world["queries"].filter("qid >= 1040")
    rows = Z.sweep_train_select(train, test, world["gallery"], n=4).collect()
    on_train = brute_recall(world, Z.train_grid(), range(40))
    on_test = brute_recall(world, Z.train_grid(), range(40, 60))
    order = sorted(on_train, key=lambda k: (-on_train[k][0], k))[:4]
    assert {(round(r["w_v"], 4), round(r["w_a"], 4)) for r in rows} == set(order)
    for r in rows:
        k = (round(r["w_v"], 4), round(r["w_a"], 4))
        assert r["train_r1"] == pytest.approx(on_train[k][0]) and r["r1"] == pytest.approx(on_test[k][0])


def test_scaling_is_clamped():
    v, t, a = G.modality_scaling({"a": 9.0}, {"t": 0.01})
    assert (v.tau, t.tau, a.tau) == (1.0, 1.0, 5.0) and (v.scale, t.scale, a.scale) == (1.0, 0.1, 0.8)


def test_routing_criteria(spark):
    table = lambda rows: spark.createDataFrame(rows, "spread double, dominant string, expected string")
    good = G.routing_acceptance(table([(0.2, "visual", "visual"), (0.1, "audio", "caption")])).first()
    assert good["clear_spread"] and good["varied"] and good["as_expected"]
    bad = G.routing_acceptance(table([(0.1, "visual", "audio"), (0.1, "visual", "caption")])).first()
    assert not bad["clear_spread"] and not bad["varied"] and not bad["as_expected"]
