"""The sieve in single precision leaves the results of exact scoring as they are."""

import numpy as np
import pytest
from helpers import unit

from modalweave.operators import fusion as G
from modalweave.operators import losses as O
from modalweave.operators import scoring as S
from modalweave.operators import sieve
from modalweave.operators import sweeps as Z
from modalweave.operators.blocks import CLIP_CLAP, Space, System, angular_spaces
from modalweave.operators.gates import CandidateGate, candidate_gate_shapes, seeded_parameters
from modalweave.session import materialize

D = 8
SYSTEMS = (
    System("visual", (1, 0, 0)), System("pair", (0.5, 0, 0.5)), System("equal", (1 / 3, 1 / 3, 1 / 3)),
    System("own", ("w_v", "w_t", "w_a")), System("none", (0, 0, 0)),
)
GATE = CandidateGate("gate", ("w_v", "w_t", "w_a"), seeded_parameters(candidate_gate_shapes(D, 16), 3), "q_clip", 0.05)


def tile(n=300, m=700, gaps=False, seed=0):
    """Queries near their truths; gallery rows from 500 on are copies of earlier ones."""
    rng = np.random.default_rng(seed)
    g = {"_n": m, "id": rng.permutation(m).astype(np.int64)}
    for name in ("visual", "caption", "audio"):
        g[name] = unit(rng, m, D)
        g[name][500:] = g[name][: m - 500]
    own = rng.permutation(m)[:n]
    q = {"_n": n, "qid": np.arange(n), "truth": g["id"][own]}
    q["q_clip"] = g["visual"][own] + 0.7 * g["caption"][own] + 0.4 * unit(rng, n, D)
    q["q_clap"] = g["audio"][own] + 0.4 * unit(rng, n, D)
    weights = rng.dirichlet((1, 1, 1), n)
    weights[:5] = 0.0
    q |= dict(zip(("w_v", "w_t", "w_a"), weights.T.copy()))
    if gaps:
        empty, silent = rng.random(m) < 0.3, rng.random(n) < 0.3
        g["audio"][empty], g["_null_audio"] = 0.0, empty
        q["q_clap"][silent], q["_null_q_clap"] = 0.0, silent
        q["_null_gt_audio"] = empty[own]
    for name in ("visual", "caption", "audio"):
        q[f"gt_{name}"] = g[name][own]
    return q, g


@pytest.mark.parametrize("gaps", [False, True])
@pytest.mark.parametrize("spaces", [CLIP_CLAP, angular_spaces()], ids=["cosine", "angular"])
@pytest.mark.parametrize("systems", [SYSTEMS, (GATE,), (GATE, SYSTEMS[2])], ids=["sums", "gate", "both"])
def test_ranks_are_those_of_all_pairs(gaps, spaces, systems):
    q, g = tile(gaps=gaps)
    kernel = S.TruthRank(spaces, systems, [])
    found = kernel.update(kernel.start(q), q, g)
    every = kernel._all_pairs(kernel.start(q), q, g)
    assert found["bars"] is not None
    assert (found["better"] == every["better"]).all() and found["n"] == every["n"]


def test_weights_below_zero_and_vectors_that_are_not_finite_are_scored_in_full():
    q, g = tile()
    kernel = S.TruthRank(CLIP_CLAP, (System("minus", (1, -1, 0)),), [])
    assert kernel.start(q)["bars"] is None
    g["visual"][3] = np.inf
    kernel = S.TruthRank(CLIP_CLAP, SYSTEMS[:1], [])
    state = kernel.start(q)
    assert sieve.sift(q, g, CLIP_CLAP, state["bars"]) is None
    assert kernel.update(state, q, g)["n"] == 700


def test_few_pairs_are_fused(monkeypatch):
    q, g = tile(400, 8000)
    seen, fuse = [], System.fuse
    monkeypatch.setattr(System, "fuse", lambda self, q, sims, gaps=(): seen.append(sims[0].size) or fuse(self, q, sims, gaps))
    kernel = S.TruthRank(CLIP_CLAP, (SYSTEMS[2],), [])
    kernel.update(kernel.start(q), q, g)
    assert sum(seen) < 0.2 * 400 * 8000


@pytest.mark.parametrize("gaps", [False, True])
@pytest.mark.parametrize("spaces", [CLIP_CLAP, angular_spaces()], ids=["cosine", "angular"])
def test_sweeps_count_as_over_all_pairs(gaps, spaces):
    q, g = tile(gaps=gaps)
    combos = [(v, t, a * 0.8) for v, t, a in Z.coarse_grid()] + [(0, 0, 1), (0.5, 0.5, 0)]
    kernel = Z.SweepRank(spaces, combos)
    found = kernel.update(kernel.start(q), q, g)
    assert found["bars"] is not None
    rows, cols = np.nonzero(q["truth"][:, None] != g["id"][None, :])
    every = kernel.start(q)  # copies of the truth tie with it only by the same sums
    args = [f(spaces, q, g, rows, cols) for f in (sieve.exact, sieve.gaps_of)]
    kernel._compare(every, q, g, np.arange(len(combos)), rows, cols, *args)
    assert (found["ahead"] == every["ahead"]).all()


def test_a_sweep_compares_few_pairs_by_combination(monkeypatch):
    q, g = tile(400, 8000)
    seen, compare = [], Z.SweepRank._compare
    monkeypatch.setattr(Z.SweepRank, "_compare", lambda self, *a: seen.append(len(a[3]) * len(a[4])) or compare(self, *a))
    kernel = Z.SweepRank(angular_spaces(), Z.coarse_grid())
    kernel.update(kernel.start(q), q, g)
    assert sum(seen) < 0.02 * 400 * 8000 * len(kernel.combos)


METRICS = tuple(Space(m, "q_clap", "audio", m) for m in ("cosine", "angular", "neg_euclidean", "neg_manhattan"))
ALONE = tuple(System(s.name, tuple(float(i == j) for j in range(4))) for i, s in enumerate(METRICS))


@pytest.mark.parametrize("gaps", [False, True])
@pytest.mark.parametrize("spaces,systems", [(METRICS, ALONE), (CLIP_CLAP, SYSTEMS[:4])], ids=["metrics", "sums"])
def test_top_lists_are_those_of_all_pairs(gaps, spaces, systems):
    q, g = tile(m=2000, gaps=gaps)
    kernel = S.TopK(5, spaces, systems, "truth")
    found = kernel.finish(kernel.update(kernel.start(q), q, g), q)
    kept = [i for i, w in enumerate(found["system"]) if w != "own" or q["w_v"][found["qid"][i]] > 0]
    rows, cols = np.nonzero(q["truth"][:, None] != g["id"][None, :])
    sims, lost = (f(spaces, q, g, rows, cols) for f in (sieve.exact, sieve.gaps_of))
    want = []
    for system in systems:
        score = S.settle(system.fuse(system.pair_columns(q, rows), sims, lost))
        order = np.lexsort((g["id"][cols], -score, rows))
        order = order[score[order] > -np.inf]
        place = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
        want += [(system.name, rows[i], g["id"][cols[i]], score[i]) for i in order[place < 5]]
    want = [w for w in want if w[0] != "own" or q["w_v"][w[1]] > 0]
    got = [(found["system"][i], found["qid"][i], found["id"][i], found["score"][i]) for i in kept]
    assert [w[:3] for w in got] == [w[:3] for w in want]
    assert np.allclose([w[3] for w in got], [w[3] for w in want], atol=1e-11)


def test_top_lists_score_few_pairs_exactly(monkeypatch):
    q, g = tile(400, 8000)
    seen, fuse = [], System.fuse
    monkeypatch.setattr(System, "fuse", lambda self, q, sims, gaps=(): seen.append(sims[0].size) or fuse(self, q, sims, gaps))
    kernel = S.TopK(5, CLIP_CLAP, (SYSTEMS[2],))
    kernel.update(kernel.start(q), q, g)
    assert sum(seen) < 0.2 * 400 * 8000


@pytest.mark.parametrize("gaps", [False, True])
@pytest.mark.parametrize("spaces", [CLIP_CLAP, angular_spaces()], ids=["cosine", "angular"])
def test_best_scores_are_those_of_all_pairs(gaps, spaces):
    q, g = tile(m=2000, gaps=gaps)
    kernel = S.BestScore(spaces)
    found = kernel.update(kernel.start(q), q, g)
    every = kernel.start(q)
    kernel._all_pairs(every, q, g, spaces)
    assert np.allclose(found, every, atol=2e-12)


def test_confidences_are_made_once(spark, world, monkeypatch):
    made = []
    monkeypatch.setattr(G, "materialize", lambda df, name: made.append(name) or materialize(df, name))
    q = G.max_confidence(world["queries"], world["gallery"], 1.0, angular_spaces())
    q = G.mean_confidence(q.drop(*G.WEIGHTS), world["gallery"], 1.0, angular_spaces())
    assert made == ["best-scores", "mean-scores"]
    assert q.count() == world["n"] and q.filter("abs(w_v + w_t + w_a - 1) > 1e-9").count() == 0


@pytest.mark.parametrize("gaps", [False, True])
def test_exponential_sums_are_made_in_small_tiles(gaps, monkeypatch):
    q, g = tile(gaps=gaps)
    kernel = S.ExpSum(CLIP_CLAP, SYSTEMS[1:3], 0.1)
    whole = kernel.start(q)
    kernel._add(whole, q, g)
    sizes, add = [], S.ExpSum._add
    monkeypatch.setattr(S.ExpSum, "_add", lambda self, s, q, g: sizes.append(q["_n"] * g["_n"]) or add(self, s, q, g))
    found = kernel.update(kernel.start(q), q, g)
    assert max(sizes) <= sieve.ROWS * sieve.COLUMNS
    assert np.allclose(found["all"], whole["all"], rtol=1e-12)


def test_long_lists_gather_the_vectors_of_few_pairs_at_once(monkeypatch):
    q, g = tile(400, 8000)
    seen, paired = [], Space.paired
    monkeypatch.setattr(Space, "paired", lambda self, a, b: seen.append(len(a)) or paired(self, a, b))
    kernel = S.TopK(50, CLIP_CLAP, (S.EQUAL,))
    state = kernel.update(kernel.start(q), q, g)
    assert max(seen) <= 2**16 and sum(seen) < 3 * 0.1 * 400 * 8000
    every = kernel._all_pairs(kernel.start(q), q, g)
    assert all((a == b).all() for a, b in zip(state[0][0][:2], every[0][0][:2]))


@pytest.mark.parametrize("gaps", [False, True])
def test_truths_far_behind_are_ranked_without_scores_of_all_pairs(monkeypatch, gaps):
    q, g = tile(400, 8000, gaps=gaps)
    rng = np.random.default_rng(5)
    for name in ("q_clip", "q_clap"):  # queries that know nothing of their truth
        q[name] = np.where(q.get(f"_null_{name}", np.zeros(400, bool))[:, None], 0.0, unit(rng, 400, D))
    factors = (Space("v", "q_clip", "visual"), Space("f", "q_clip", "visual", factor="f"), Space("a", "q_clap", "audio"))
    g["f"] = rng.random(8000)
    q["gt_f"] = g["f"][[list(g["id"]).index(t) for t in q["truth"]]]
    for spaces in (CLIP_CLAP, factors):
        kernel = S.TruthRank(spaces, SYSTEMS[:4], [])
        every = kernel._all_pairs(kernel.start(q), q, g)
        seen, paired = [], Space.paired
        with monkeypatch.context() as m:
            m.setattr(Space, "paired", lambda self, a, b: seen.append(len(a)) or paired(self, a, b))
            m.setattr(Space, "scores", None)
            found = kernel.update(kernel.start(q), q, g)
        assert (found["better"] == every["better"]).all()
        assert sum(seen) < 0.1 * 400 * 8000


def test_exponential_sums_of_all_temperatures_come_from_one_pass_in_single_precision(monkeypatch):
    q, g = tile(300, 8000)
    taus = (0.07, 0.1, 1.0)
    every = []
    for tau in taus:
        kernel = S.ExpSum(CLIP_CLAP, SYSTEMS[:3], tau)
        whole = kernel.start(q)
        kernel._add(whole, q, g)
        every.append(np.log(whole["all"][0]))
    kernel = S.ExpSum(CLIP_CLAP, SYSTEMS[:3], taus)
    monkeypatch.setattr(S.ExpSum, "_add", None)
    found = np.log(kernel.update(kernel.start(q), q, g)["all"])
    off = found - every
    assert np.abs(off).max() < 5e-6 and np.abs(off.mean(axis=2)).max() < 3e-8, (np.abs(off).max(), off.mean(axis=2))


def test_smooth_ndcg_in_single_precision(monkeypatch):
    q, g = tile(300, 8000)
    rng = np.random.default_rng(2)
    places = rng.choice(20_000, 8000, replace=False)
    g["place"] = places
    at = dict(zip(g["id"], places))
    # some truths are rows of another tile
    q["truth_place"] = np.array([at[t] if i % 3 else 20_000 + i for i, t in enumerate(q["truth"])])
    kernel = O.ApproxNdcg(CLIP_CLAP, S.EQUAL, 0.1)
    every = kernel._all_pairs(kernel.start(q), q, g)
    monkeypatch.setattr(O, "_tile", None)
    found = kernel.update(kernel.start(q), q, g)
    assert np.allclose(found["den"], every["den"], rtol=1e-12)
    assert np.abs(found["num"] / every["num"] - 1).max() < 1e-6


@pytest.mark.parametrize("spaces, thresholds", [(CLIP_CLAP, (0.5, 0.1, -0.1)), (angular_spaces(), ())], ids=["cosine", "angular"])
def test_statistics_without_ends_score_few_pairs_in_double_precision(monkeypatch, spaces, thresholds):
    q, g = tile(300, 8000)
    q["q_clip"] /= np.linalg.norm(q["q_clip"], axis=1, keepdims=True)
    q["q_clip"][:3] = g["visual"][:3]  # the angle is steep at a cosine of one
    kernel = S.ScoreStats(spaces, None, thresholds, ends=False)
    every = kernel._all_pairs(kernel.start(q), q, g, range(3))
    monkeypatch.setattr(Space, "scores", None)
    found = kernel.update(kernel.start(q), q, g)
    assert (found["n"] == every["n"]).all() and (found["above"] == every["above"]).all()
    for name in ("s1", "s2"):
        assert np.abs(found[name] - every[name]).max() / 8000 < 3e-8


@pytest.mark.parametrize("gaps", [False, True])
def test_lists_by_manhattan_distance_are_sifted_in_integers(gaps, monkeypatch):
    q, g = tile(300, 6000, gaps=gaps)
    q["q_clap"][7] = 0.0
    kernel = S.TopK(5, (Space("m", "q_clap", "audio", "neg_manhattan"),), (System("m", (1,)),))
    every = kernel._all_pairs(kernel.start(q), q, g)
    sizes, scores = [], Space.scores
    monkeypatch.setattr(Space, "scores", lambda self, q, g, known=None: sizes.append(g["_n"]) or scores(self, q, g, known))
    monkeypatch.setattr(sieve, "single", lambda block, name, single=sieve.single: single(block, name) and (np.zeros((block["_n"], D), "f4"), single(block, name)[1]))
    found = kernel.update(kernel.start(q), q, g)
    assert sum(sizes) == 256  # single precision is not asked for the rest
    assert all((a == b).all() for a, b in zip(found[0][0][:3], every[0][0][:3]))


@pytest.mark.parametrize("gaps", [False, True])
def test_the_gate_sees_pairs_that_its_least_weights_let_through(monkeypatch, gaps):
    q, g = tile(200, 3000, gaps=gaps)
    kernel = S.TruthRank(CLIP_CLAP, (GATE,), [])
    every = kernel._all_pairs(kernel.start(q), q, g)
    state = kernel.start(q)
    weights, seen = CandidateGate._weights, []
    monkeypatch.setattr(CandidateGate, "_weights", lambda self, of, sims: seen.append(sims[..., 0].size) or weights(self, of, sims))
    bars = sieve.sift(q, g, CLIP_CLAP, state["bars"])
    found = kernel.update(state, q, g)
    assert (found["better"] == every["better"]).all()
    assert sum(seen) < (1.0 if gaps else 0.9) * len(bars[0])
