import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modalweave.functions import encode as U
from modalweave.functions import media as D
from modalweave.functions import text as T
from modalweave.operators import curate as C


def fold(text, budget):
    chunks, current, cost = [], [], 0
    for word in text.split():
        c = len(word) // 4 + 1
        if cost + c + 1 > budget and current:
            chunks.append(" ".join(current))
            current, cost = [word], c
        else:
            current.append(word)
            cost += c + 1
    return chunks + ([" ".join(current)] if current else [])


def test_chunk_text(spark):
    rng = np.random.default_rng(0)
    texts = [
        " ".join("x" * int(n) for n in rng.integers(1, 30, size=k)) for k in (1, 5, 40, 300)
    ] + ["", "   ", " lead and trail ", "a" * 2000 + " b", "one\ttwo\nthree"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for budget in (10, 72):
        got = [r[0] for r in df.select(T.chunk_text("t", budget)).collect()]
        assert got == [fold(t, budget) for t in texts]


def test_blank_and_keywords(spark):
    df = spark.createDataFrame([("",), (" \t",), (None,), ("A Dog BARKING",), ("nothing",)], "t string")
    assert T.non_blank(df, "t").count() == 2
    assert [bool(r[0]) for r in df.na.fill("").select(T.contains_any("t", T.AUDIO_KEYWORDS)).collect()] == [
        False, False, False, True, False]


def test_prompt_and_synonym_variants(spark):
    df = spark.createDataFrame([(1, "dog barking"), (2, "rain")], "id int, q string")
    p = {(r["id"], r["variant"]): r["prompt"] for r in T.prompt_variants(df, "q").collect()}
    assert len(p) == 10 and p[(1, "audio_context")] == "the sound of dog barking"
    s = [(r["id"], r["prompt"]) for r in T.synonym_variants(df, "q").collect()]
    assert len(s) == 6 and (2, "rain") in s and (1, "canine") in s


def test_augmented_targets(spark):
    df = spark.createDataFrame(
        [("v", "desc", ["q1", " "], ["a1"], None, ["t"], "cat", "")],
        """video_id string, text_description string, qa_questions array<string>, qa_answers array<string>,
        youtube_title string, youtube_tags array<string>, content_fine_category string, content_parent_category string""",
    )
    rows = T.augmented_targets(df).orderBy("pos").collect()
    assert [r["text"] for r in rows] == ["desc", "q1", "a1", "a video tagged t", "a video about cat"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab c", max_size=12), min_size=2, max_size=14))
def test_partial_match_both_ways(spark, texts):
    half = len(texts) // 2
    queries = [(i, i % 2, t) for i, t in enumerate(texts[:half])]
    captions = [(i, i % 2, t) for i, t in enumerate(texts[half:])]
    queries = [q for q in queries if q[2]]
    captions = [c for c in captions if c[2]]
    if not queries or not captions:
        return
    q = spark.createDataFrame(queries, "qid long, video long, text string")
    c = spark.createDataFrame(captions, "pos long, video long, text string")
    want = set()
    for qi, qv, qt in queries:
        if any(cv == qv and ct == qt for _, cv, ct in captions):
            continue
        for ci, cv, ct in captions:
            if cv == qv and (qt[:4] in ct or ct[:4] in qt):
                want.add((qi, ci))
    for bound in (0, 256):
        got = {(r["qid"], r["pos"]) for r in C.partial_match(q, c, 4, bound).collect()}
        assert got == want, bound


def test_encoder_hook_is_built_once_per_task_and_batched(spark):
    def build():
        seen = {"built": True}

        def encode(texts):
            assert len(texts) <= 3 and seen["built"]
            return np.array([[len(t), 1.0] for t in texts])

        return encode

    df = spark.createDataFrame([(i, "x" * i) for i in range(8)], "id int, t string").coalesce(1)
    rows = U.encode(df, "t", "v", build, batch=3).orderBy("id").collect()
    assert rows[0]["v"] is None and rows[5]["v"] == [5.0, 1.0]


def test_text_variants(spark):
    df = spark.createDataFrame(
        [("both", "a dog", "it barks loud"), ("desc", "a dog", " "), ("trans", "", "it barks"), ("none", None, None)],
        "video_id string, text_description string, text_transcript string",
    )
    get = lambda v: {r["video_id"]: np.array(r["vec"]) for r in U.text_variant(df, "video_id", v).collect()}
    d, t, f = get("description"), get("transcript"), get("fused")
    assert set(d) == {"both", "desc"} and set(t) == {"both", "trans"} and set(f) == {"both", "desc", "trans"}
    mean = 0.5 * d["both"] + 0.5 * t["both"]
    assert np.allclose(f["both"], mean / np.linalg.norm(mean))
    assert np.allclose(f["desc"], d["desc"]) and np.allclose(f["trans"], t["trans"])
    with pytest.raises(ValueError):
        U.text_variant(df, "video_id", "other")


def test_media_plans(spark):
    df = spark.createDataFrame([(160.0,), (0.0,), (-1.0,)], "d double")
    t = [r[0] for r in df.select(D.frame_times("d", 16)).collect()]
    assert t[0] == [(i + 0.5) * 10 for i in range(16)] and t[1] is None and t[2] is None
    idx = spark.createDataFrame([(100,)], "n long").select(D.frame_indices("n", 16)).first()[0]
    assert idx == [int(i * 100 / 16) for i in range(16)]
    seg = spark.createDataFrame([(30.0,), (50.0,)], "d double").select(D.segment_plan("d")).collect()
    assert [(s["start"], s["length"]) for s in seg[0][0]] == [(0.0, 30.0)]
    assert [(s["start"], s["length"]) for s in seg[1][0]] == [(0.0, 10.0), (20.0, 10.0), (40.0, 10.0)]
    off = spark.createDataFrame([(48_000 * 4,), (48_000 * 10,), (48_000 * 25,)], "n long").select(D.segment_offsets("n")).collect()
    assert [(s["offset"], s["padding"]) for s in off[0][0]] == [(0, 288_000)]
    assert [(s["offset"], s["padding"]) for s in off[1][0]] == [(0, 0)]
    assert [s["offset"] for s in off[2][0]] == [0, 360_000, 720_000]
    win = spark.createDataFrame([(10,), (32_000 * 3 + 5,)], "n long").select(D.window_offsets("n")).collect()
    assert win[0][0] == [0] and win[1][0] == [0, 32_000, 64_000]
