import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from modalweave.functions import vectors as V
from modalweave.operators import curate as C
from modalweave.sources import manifest as SM
from modalweave.sources import stores as SS


def record(description="A clip. ", questions=("what?",), **extra):
    return {
        "duration_seconds": 12,
        "text_to_speech": "spoken words",
        "content_metadata": {
            "description": description,
            "qAndA": [{"question": q, "answer": "yes"} for q in questions],
        },
        **extra,
    }


@pytest.fixture()
def raw_root(tmp_path):
    def put(cat, vid, text, media=True):
        os.makedirs(tmp_path / cat, exist_ok=True)
        (tmp_path / cat / f"{vid}.json").write_text(text, encoding="utf-8")
        if media:
            (tmp_path / cat / f"{vid}.mp4").write_bytes(b"0")

    put("pets", "ok1", json.dumps(record(), indent=2))
    put("pets", "ok2", json.dumps(record(youtube_tags=["a", "b"], questions=("q1", "", "q2"))))
    put("pets", "nomedia", "{broken", media=False)
    put("cars", "broken", '{"duration_seconds": 3')
    put("cars", "blank", json.dumps(record(description="  ")))
    put("cars", "noquestions", json.dumps(record(questions=())))
    put("cars", "null_meta", json.dumps({"content_metadata": None}))
    return str(tmp_path)


def test_raw_scan_validation_and_defaults(spark, raw_root, tmp_path):
    v = C.validate(C.parse_records(SM.scan_raw_records(spark, raw_root)))
    got = {r["video_id"]: (r["category"], r["reason"]) for r in v.collect()}
    assert got == {
        "ok1": ("pets", None), "ok2": ("pets", None),
        "nomedia": ("pets", C.MISSING_MEDIA),  # first failing reason wins over the parse error
        "broken": ("cars", C.PARSE_ERROR),
        "blank": ("cars", C.EMPTY_DESCRIPTION), "null_meta": ("cars", C.EMPTY_DESCRIPTION),
        "noquestions": ("cars", C.NO_QUESTIONS),
    }
    m = {r["video_id"]: r for r in C.project_manifest(v).collect()}
    assert set(m) == {"ok1", "ok2"} and len(m["ok1"].asDict()) == 23
    assert m["ok1"]["fps"] == 30.0 and m["ok1"]["youtube_tags"] == [] and m["ok1"]["resolution"] == ""
    assert m["ok2"]["qa_questions"] == ["q1", "q2"] and m["ok2"]["qa_answers"] == ["yes"] * 3
    assert m["ok2"]["video_path"].endswith("pets/ok2.mp4") and m["ok1"]["duration_seconds"] == 12.0

    path = str(tmp_path / "out" / "rejects")
    SM.write_rejects(C.rejects(v), path)
    counts = {r["reason"]: r["n"] for r in SM.reject_counts(SM.scan_rejects(spark, path)).collect()}
    assert counts[C.EMPTY_DESCRIPTION] == 2 and sum(counts.values()) == 5


def test_manifest_round_trip_and_array_file(spark, raw_root, tmp_path):
    m = C.build_manifest(SM.scan_raw_records(spark, raw_root))
    path = str(tmp_path / "out" / "manifest")
    SM.write_manifest(m, path)
    SM.write_manifest(m, path)  # replaces, does not append
    back = SM.scan_manifest(spark, path)
    assert back.count() == 2 and back.schema == SM.MANIFEST_SCHEMA
    rows = [r.asDict(recursive=True) for r in back.orderBy("video_id").collect()]
    array = tmp_path / "array.json"
    array.write_text(json.dumps(rows, indent=1), encoding="utf-8")
    legacy = SM.scan_manifest(spark, str(array), array_file=True)
    assert [r.asDict(recursive=True) for r in legacy.orderBy("video_id").collect()] == rows


def test_caption_rows(spark, tmp_path):
    rows = [{"video_id": "v1", "text": "a dog", "split": "test"}, {"video_id": "v1", "text": "it barks", "split": "test"}]
    (tmp_path / "captions.json").write_text(json.dumps(rows))
    got = SM.scan_captions(spark, str(tmp_path / "captions.json"), array_file=True)
    assert sorted(r["text"] for r in C.filter_by_split(got).collect()) == ["a dog", "it barks"]


def test_frame_inventory_and_resume(spark, tmp_path):
    for vid, n in (("full", 16), ("part", 9)):
        os.makedirs(tmp_path / vid)
        for i in range(n):
            (tmp_path / vid / f"frame_{i:04d}.jpg").write_bytes(b"x")
    (tmp_path / "full" / "notes.txt").write_text("no frame")
    paths = SM.list_files(spark, str(tmp_path), "*.jpg")
    inv = {r["video_id"]: r["reason"] for r in SM.frame_inventory(paths).collect()}
    assert inv == {"full": None, "part": "frame count 9"}
    todo = spark.createDataFrame([("full",), ("part",), ("new",)], "video_id string")
    left = SM.resume(todo, SM.frame_counts(paths), 16)
    assert {r[0] for r in left.collect()} == {"part", "new"}


def test_store_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id long, vec array<double>")
    path = str(tmp_path / "store")
    SS.write_store(df, path)
    rows = {r["id"]: r["vec"] for r in SS.scan_store(spark, path).collect()}
    assert rows[1] == pytest.approx([0.6, 0.8]) and rows[2] == [0.0, 0.0]
    assert SS.scan_store(spark, path).schema["vec"].dataType.elementType.typeName() == "double"
    many = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0])], "id long, vec array<double>")
    many.write.parquet(str(tmp_path / "many"))
    assert SS.scan_collapsed_store(spark, str(tmp_path / "many")).first()["vec"] == pytest.approx([0.5**0.5] * 2)


def test_bucketed_stores_join_without_shuffle(spark, tmp_path, capsys):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(50)], "id long, vec array<double>")
    for name in ("bucket_a", "bucket_b"):
        SS.write_bucketed_store(df, name, str(tmp_path / name), 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = C.complete_ids({n: SS.scan_bucketed_store(spark, n) for n in ("bucket_a", "bucket_b")})
        assert both.count() == 50
        both.explain()
        assert "Exchange" not in capsys.readouterr().out
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("drop table bucket_a")
        spark.sql("drop table bucket_b")


def test_reports(spark, tmp_path):
    m = spark.createDataFrame([("visual", "all", "r1", 0.5)], "system string, stratum string, metric string, value double")
    for fmt in ("json", "csv"):
        SS.write_report(m, str(tmp_path / fmt), fmt)
        assert SS.scan_report(spark, str(tmp_path / fmt), fmt).collect() == m.collect()
    with pytest.raises(ValueError):
        SS.write_report(m, str(tmp_path / "x"), "xml")


def test_complete_and_missing_ids(spark):
    s = lambda ids: spark.createDataFrame([(i, [1.0]) for i in ids], "id string, vec array<double>")
    stores = {"video": s("abc"), "audio": s("ac"), "caption": s("abc")}
    ids = s("abcd").select("id")
    assert sorted(r["id"] for r in C.complete_ids(stores, ids).collect()) == ["a", "c"]
    missing = sorted((r["store"], r["id"]) for r in C.missing_report(stores, ids).collect())
    assert missing == [("audio", "b"), ("audio", "d"), ("caption", "d"), ("video", "d")]


def test_non_finite_vectors_are_found(spark):
    df = spark.createDataFrame([([1.0, float("nan")],), ([float("inf")],), ([1.0],)], "v array<double>")
    assert [r[0] for r in df.select(V.is_non_finite("v")).collect()] == [True, True, False]


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, t string")
    first = {r["k"]: r["t"] for r in C.first_per_key(df, "k", "o").collect()}
    last = {r["k"]: r["t"] for r in C.first_per_key(df, "k", "o", last=True).collect()}
    assert first == {"a": "y", "b": "z"} and last == {"a": "x", "b": "z"}


def test_shared_folder_comes_from_the_session(spark):
    from modalweave.session import scratch_path

    assert scratch_path(spark, "t").startswith(spark.conf.get("spark.checkpoint.dir"))
