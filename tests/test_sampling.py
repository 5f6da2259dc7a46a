import hashlib

import pytest
from pyspark.sql import functions as F

from modalweave.operators import sampling as W


def md5(seed, x):
    return hashlib.md5(f"{seed}:{x}".encode()).hexdigest()


@pytest.fixture(scope="module")
def items(spark):
    """300 items; one category holds a third of them."""
    return spark.range(300).select(
        "id", F.when(F.col("id") < 100, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 7)).alias("cat")
    )


def test_position_is_the_plain_row_number(items):
    got = {r["id"]: r["position"] for r in W.shuffled_position(items, "id", 5).collect()}
    want = {i: p for p, i in enumerate(sorted(range(300), key=lambda i: (md5(5, i), i)))}
    assert got == want


def test_position_within_keys(items):
    rows = W.shuffled_position(items, "id", 5, ["cat"]).collect()
    for cat in {r["cat"] for r in rows}:
        mine = [r for r in rows if r["cat"] == cat]
        order = sorted((r["id"] for r in mine), key=lambda i: (md5(5, i), i))
        assert {r["id"]: r["position"] for r in mine} == {i: p for p, i in enumerate(order)}


def test_id_position(spark):
    df = spark.createDataFrame([(i,) for i in (5, 99, 70_000, 3, 200_000, 65_536)], "id long")
    rows = W.id_position(df, "id").orderBy("id").collect()
    assert [r["position"] for r in rows] == list(range(6))


def test_stratified_split(items):
    rows = W.stratified_split(items, "cat", "id").collect()
    for cat in {r["cat"] for r in rows}:
        mine = [r for r in rows if r["cat"] == cat]
        train = [r for r in mine if r["split"] == "train"]
        assert len(train) == max(1, int(0.85 * len(mine)))


def test_single_item_category_goes_to_train(spark):
    df = spark.createDataFrame([(1, "only")], "id long, cat string")
    assert W.stratified_split(df, "cat", "id").first()["split"] == "train"


def test_pilot(items):
    counts = W.pilot_sample(items, "cat", "id", 10).groupBy("cat").count().collect()
    assert all(r["count"] == 10 for r in counts)


def test_group_split_keeps_groups_whole(spark):
    rows = spark.range(2000).select(F.concat(F.lit("vid_"), (F.col("id") / 20).cast("int")).alias("video"), "id")
    parts = W.group_split(rows, "video")
    assert parts.count() == 2000 and W.leakage(parts, "video").isEmpty()
    sizes = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.countDistinct("video").alias("n")).collect()}
    assert sizes == {"val": 15, "train": 85}


def test_random_negatives_belong_to_their_query(spark):
    gallery = spark.range(40)
    queries = spark.range(40).select(F.col("id").alias("qid"), F.col("id").alias("truth"))
    rows = W.random_negatives(queries, gallery, 6, 3).collect()
    by_q = {}
    for r in rows:
        by_q.setdefault(r["qid"], []).append(r["id"])
    assert len(by_q) == 40
    for q, ids in by_q.items():
        assert len(ids) == 6 and len(set(ids)) == 6 and q not in ids
    used = [i for ids in by_q.values() for i in ids]
    assert max(used.count(i) for i in range(40)) < 20


def test_pick_subset(items):
    picked = W.pick_subset(items.select("id"), items.filter("id < 20").select("id"), 50, 1).collect()
    assert len(picked) == 50 and {r["id"] for r in picked if r["relevant"]} == set(range(20))


def test_sample_is_repeatable(items):
    pick = lambda df: [r["id"] for r in W.sample(df, 10, 9).collect()]
    assert pick(items) == pick(items.repartition(6))


def test_null_keys_stay_in_splits(spark):
    from modalweave.operators import sampling as W

    df = spark.createDataFrame([(i, None if i % 4 == 0 else f"c{i % 2}") for i in range(40)], "id long, label string")
    split = W.stratified_split(df, "label", "id")
    assert split.count() == 40 and split.filter("label is null").select("split").distinct().count() == 2
    assert W.group_split(df, "label").columns == ["id", "label", "part"] and W.group_split(df, "label").count() == 40


def test_places_of_scattered_ids(spark):
    import random

    from modalweave.operators import sampling as W

    ids = random.Random(1).sample(range(-(1 << 60), 1 << 60), 300)
    got = W.id_position(spark.createDataFrame([(i,) for i in ids], "id long"), "id", width=20).collect()
    assert {r["id"]: r["position"] for r in got} == {x: k for k, x in enumerate(sorted(ids))}


def test_sample_takes_the_first_of_the_seeded_order(spark):
    import hashlib

    from modalweave.operators import sampling as W

    got = sorted(r["id"] for r in W.sample(spark.range(100), 7, 42).collect())
    assert got == sorted(sorted(range(100), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())[:7])
