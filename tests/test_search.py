"""Search semantics: spaces, masks, exact matches, complete ids, gate loading."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from modalweave.operators import gates as N
from modalweave.plans.search import search, search_index, weigh

D = 16


@pytest.fixture(scope="module")
def index(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(3, 6, D))
    m /= np.linalg.norm(m, axis=2, keepdims=True)
    rows = [(f"v{i}", m[0, i].tolist(), m[1, i].tolist(), m[2, i].tolist()) for i in range(6)]
    df = spark.createDataFrame(
        rows, "id string, visual array<double>, caption array<double>, audio array<double>"
    )
    return m, df


@pytest.fixture(scope="module")
def gate():
    return N.seeded_parameters(N.gate_shapes(D, 32), 0)


def ask(spark, clip=None, clap=None):
    as_list = lambda x: None if x is None else [float(v) for v in x]
    return spark.createDataFrame(
        [(1, as_list(clip), as_list(clap))], "qid long, q_clip array<double>, q_clap array<double>"
    )


def test_each_modality_is_scored_in_its_own_space(spark, index):
    m, df = index
    rng = np.random.default_rng(1)
    clip, clap = rng.normal(size=(2, D))
    from modalweave.operators.scoring import score_top_k

    rows = score_top_k(ask(spark, clip, clap), df, 6).collect()
    assert len(rows) == 6
    for r in rows:
        i = int(r["id"][1:])
        assert r["sim_v"] == pytest.approx(clip @ m[0, i])
        assert r["sim_t"] == pytest.approx(clip @ m[1, i])
        assert r["sim_a"] == pytest.approx(clap @ m[2, i])


def test_exact_match_ranks_first(spark, index, gate):
    m, df = index
    out = search(ask(spark, m[1, 2], m[2, 2]), df, gate, k=3)
    assert out["results"].filter("rk = 1").first()["id"] == "v2"
    w = out["decisions"].first()
    assert w["w_v"] + w["w_t"] + w["w_a"] == pytest.approx(1.0)


def test_missing_branch_is_masked(spark, index, gate):
    m, df = index
    out = search(ask(spark, clip=m[0, 1]), df, gate)
    w = out["weights"].first()
    assert w["w_a"] == 0 and w["w_v"] + w["w_t"] == pytest.approx(1.0)
    assert all(r["audio_score"] == 0 for r in out["results"].collect())


def test_audio_only_query_bypasses_the_gate(spark, index, gate):
    m, df = index
    w = weigh(ask(spark, clap=m[2, 0]), gate).first()
    assert (w["w_v"], w["w_t"], w["w_a"]) == (0.0, 0.0, 1.0)


def test_empty_query_is_rejected(spark, gate):
    with pytest.raises(Exception, match="neither of its two vectors"):
        weigh(ask(spark), gate).collect()
    assert weigh(ask(spark), gate, on_empty="drop").count() == 0


def test_gate_round_trip_and_mismatch(spark, gate, tmp_path):
    shapes = N.gate_shapes(D, 32)
    N.save_gate(spark, gate, str(tmp_path / "gate"))
    loaded = N.load_gate(spark, str(tmp_path / "gate"), shapes)
    x = np.random.default_rng(2).normal(size=(3, D))
    assert np.allclose(N.gate_forward(loaded, x), N.gate_forward(gate, x))
    short = {k: v for k, v in gate.items() if k != "fc1.weight"}
    N.save_gate(spark, short, str(tmp_path / "short"))
    with pytest.raises(RuntimeError, match="fc1.weight"):
        N.load_gate(spark, str(tmp_path / "short"), shapes)
    N.save_gate(spark, {**gate, "fc9.weight": np.zeros(2)}, str(tmp_path / "extra"))
    with pytest.raises(RuntimeError, match="fc9.weight"):
        N.load_gate(spark, str(tmp_path / "extra"), shapes)
    N.save_gate(spark, {**gate, "tau_audio": np.array([0.5])}, str(tmp_path / "buffers"))
    assert set(N.load_gate(spark, str(tmp_path / "buffers"), shapes)) == set(shapes)


def test_index_keeps_complete_ids_with_unit_rows(spark):
    rng = np.random.default_rng(3)
    store = lambda ids: spark.createDataFrame(
        [(i, rng.normal(size=D).tolist()) for i in ids], "id string, vec array<double>"
    )
    built = search_index({"visual": store("abc"), "audio": store("ac"), "caption": store("abc")})
    rows = built.orderBy("id").collect()
    assert [r["id"] for r in rows] == ["a", "c"]
    for r in rows:
        for c in ("visual", "audio", "caption"):
            assert np.linalg.norm(r[c]) == pytest.approx(1.0)


def test_explanation_text(spark, index):
    m, df = index
    text = search(ask(spark, m[1, 2], m[2, 2]), df, k=2)["text"].first()["text"]
    lines = text.split("\n")
    assert lines[0] == "Gating weights: [visual=0.3333, caption=0.3333, audio=0.3333]"
    assert lines[3] == "Top-2 results:" and lines[4].startswith("  1. v2  score=")
    assert lines[-1].startswith("  Rank1 vs Rank2: deciding modality = ")


def test_non_positive_total_has_zero_percentages(spark):
    from modalweave.operators.explain import contributions

    top = spark.createDataFrame([(1, 5, 1, -0.5, 0.1, 0.1)], "qid long, id long, rk int, sim_v double, sim_t double, sim_a double")
    w = spark.createDataFrame([(1, 1.0, 0.0, 0.0)], "qid long, w_v double, w_t double, w_a double")
    r = contributions(top, w).first()
    assert r["fused_score"] == -0.5 and r["visual_pct"] == r["caption_pct"] == r["audio_pct"] == 0


def test_mixed_query_is_the_mean_of_its_parts(spark):
    from modalweave.functions import vectors as V

    df = spark.createDataFrame(
        [([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], None), (None, None)], "a array<double>, b array<double>"
    )
    got = [r[0] for r in df.select(V.mean_of_present(["a", "b"])).collect()]
    assert got[0] == pytest.approx([0.5**0.5] * 2) and got[1] == [1.0, 0.0] and got[2] is None
