import numpy as np
import pytest

from modalweave.operators import captions as K
from modalweave.operators import errors as E
from modalweave.operators.blocks import Limits

from helpers import unit

GRID = Limits(broadcast_rows=0, grid_rows=20, query_tile=5, gallery_tile=6)


@pytest.fixture(scope="module")
def captions(spark):
    """Seven videos; video 0 holds a third of all captions, video 6 only one."""
    rng = np.random.default_rng(11)
    videos = np.array([0] * 20 + [1] * 9 + [2] * 9 + [3] * 9 + [4] * 7 + [5] * 7 + [6])
    vec = unit(rng, len(videos), 6)
    rows = [(int(v), i, f"text {i}", vec[i].tolist()) for i, v in enumerate(videos)]
    caps = spark.createDataFrame(rows, "video long, pos long, text string, vec array<double>")
    qs = caps.selectExpr("pos as qid", "video as truth", "text", "vec")
    return videos, vec, caps, K.own_positions(qs, caps)


def brute(videos, vec, loo):
    s = vec @ vec.T
    out = {}
    for q in range(len(videos)):
        row = s[q].copy()
        if loo:
            row[q] = -np.inf
        best = {v: row[videos == v].max() for v in range(7)}
        order = sorted(best, key=lambda v: (-round(best[v], 12) if best[v] > -np.inf else np.inf, v))
        out[q] = [(v, best[v]) for v in order]
    return out


@pytest.mark.parametrize("loo", [False, True])
@pytest.mark.parametrize("limits", [None, GRID])
def test_max_over_captions(captions, loo, limits):
    videos, vec, caps, qs = captions
    want = brute(videos, vec, loo)
    got = {}
    for r in K.caption_top_k(qs, caps.repartition(5), 7, loo=loo, limits=limits).collect():
        got.setdefault(r["qid"], {})[r["rk"]] = (r["video"], r["score"])
    for q, ranked in got.items():
        assert [ranked[k][0] for k in sorted(ranked)] == [v for v, _ in want[q]]
        for k in ranked:
            assert ranked[k][1] == pytest.approx(want[q][k - 1][1])


def test_only_own_caption_scores_minus_infinity(captions):
    videos, vec, caps, qs = captions
    own = len(videos) - 1
    rows = K.caption_top_k(qs.filter(f"qid = {own}"), caps, 7, loo=True).filter("video = 6").collect()
    assert rows[0]["score"] == -np.inf and rows[0]["rk"] == 7


def test_other_videos_are_not_affected_by_loo(captions):
    _, _, caps, qs = captions
    std = {(r["qid"], r["video"]): r["score"] for r in K.caption_top_k(qs, caps, 7).collect()}
    loo = {(r["qid"], r["video"]): r["score"] for r in K.caption_top_k(qs, caps, 7, loo=True).collect()}
    truth = {r["qid"]: r["truth"] for r in qs.collect()}
    assert all(loo[k] == std[k] for k in std if truth[k[0]] != k[1])


def test_coordinate_wise_max_is_something_else(spark):
    from modalweave.functions import aggregates as A

    rng = np.random.default_rng(4)
    q, c = unit(rng, 3, 32), unit(rng, 4, 32)
    right = np.stack([(q @ c[:2].T).max(1), (q @ c[2:].T).max(1)], 1)
    df = spark.createDataFrame([(i // 2, c[i].tolist()) for i in range(4)], "video int, vec array<double>")
    pooled = A.max_pool(df, "video", "vec", renormalize=False).orderBy("video").collect()
    assert np.allclose(pooled[0]["vec"], c[:2].max(0))
    assert not np.allclose(q @ np.array([r["vec"] for r in pooled]).T, right)


def test_duplicate_text_counts_at_its_last_position(spark):
    caps = spark.createDataFrame(
        [(1, 0, "same", [1.0]), (1, 3, "same", [1.0]), (1, 5, "other", [1.0])],
        "video long, pos long, text string, vec array<double>",
    )
    qs = spark.createDataFrame([(9, 1, "same", [1.0]), (8, 1, "unknown", [1.0])], "qid long, truth long, text string, vec array<double>")
    own = {r["qid"]: r["own_pos"] for r in K.own_positions(qs, caps).collect()}
    assert own == {9: 3, 8: -1}


def test_fusion_with_video_scores(captions, spark):
    videos, vec, caps, qs = captions
    rng = np.random.default_rng(5)
    visual = unit(rng, 7, 6)
    vis = spark.createDataFrame([(v, visual[v].tolist()) for v in range(7)], "video long, visual array<double>")
    rows = K.caption_top_k(
        qs, caps.join(vis, "video"), 1, loo=True, caption_weight=0.5, fuse=[(0.5, "vec", "visual")], limits=GRID
    ).collect()
    s = vec @ vec.T
    np.fill_diagonal(s, -np.inf)
    for r in rows:
        q = r["qid"]
        fused = [0.5 * s[q][videos == v].max() + 0.5 * (vec[q] @ visual[v]) for v in range(7)]
        assert r["video"] == int(np.argmax(fused))


def test_recall_and_gap(captions):
    videos, vec, caps, qs = captions
    std = K.caption_top_k(qs, caps, 3)
    loo = K.caption_top_k(qs, caps, 3, loo=True)
    r = K.caption_recall(loo, qs, (1, 3)).first()
    want = brute(videos, vec, True)
    assert r["r3"] == pytest.approx(np.mean([videos[q] in [v for v, _ in want[q][:3]] for q in want]))
    gap = E.loo_gap(K.caption_success(std, qs), K.caption_success(loo, qs)).first()
    assert gap["r1_standard"] == 1.0 and gap["r1_loo"] == pytest.approx(r["r1"])
    assert gap["exact_share"] == pytest.approx(gap["standard_only"] / gap["n"])
