"""The three placements of the block join agree with each other and with numpy."""

import numpy as np
import pytest

from modalweave.operators import blocks as B
from modalweave.operators import scoring as S
from modalweave.operators.blocks import CLIP_CLAP, Limits, Space, System, angular_spaces

PLACEMENTS = {
    "queries_broadcast": Limits(query_tile=17, gallery_tile=13),
    "gallery_broadcast": Limits(broadcast_rows=60, query_tile=17, gallery_tile=13),
    "grid": Limits(broadcast_rows=0, grid_rows=16, query_tile=7, gallery_tile=9),
}


def plenty(queries, rows):
    """Repeat queries under new ids so that they exceed a broadcast bound."""
    from pyspark.sql import functions as F

    extra = queries.withColumn("qid", F.col("qid") + 100_000)
    return queries.unionByName(extra)


def top_k(sims, k):
    order = [sorted(range(len(r)), key=lambda j: (-round(r[j], 12), j))[:k] for r in sims]
    return {1000 + i: o for i, o in enumerate(order)}


@pytest.mark.parametrize("name", PLACEMENTS)
def test_top_k(world, name):
    queries = world["queries"] if name != "gallery_broadcast" else plenty(world["queries"], 60)
    fused = sum(world["sims"].values()) / 3
    want = top_k(fused, 5)
    got = {}
    for r in S.score_top_k(queries, world["gallery"], 5, limits=PLACEMENTS[name]).collect():
        if r["qid"] < 100_000:
            got.setdefault(r["qid"], {})[r["rk"]] = r["id"]
            i = r["qid"] - 1000
            assert r["score"] == pytest.approx(fused[i, r["id"]], abs=1e-9)
            assert r["sim_a"] == pytest.approx(world["sims"]["a"][i, r["id"]], abs=1e-9)
    assert {q: [m[k] for k in sorted(m)] for q, m in got.items()} == want


@pytest.mark.parametrize("name", PLACEMENTS)
def test_truth_ranks(world, name):
    queries = world["queries"] if name != "gallery_broadcast" else plenty(world["queries"], 60)
    fused = np.round(sum(world["sims"].values()) / 3, 12)
    rows = S.truth_ranks(queries, world["gallery"], carry=["category"], limits=PLACEMENTS[name]).collect()
    rows = [r for r in rows if r["qid"] < 100_000]
    assert len(rows) == world["n"]
    for r in rows:
        i = r["qid"] - 1000
        better = sum(
            1 for j in range(world["n"])
            if j != i and (fused[i, j] > fused[i, i] or (fused[i, j] == fused[i, i] and j < i))
        )
        assert (r["rk"], r["n"], r["category"]) == (better + 1, world["n"], i % 3)


@pytest.mark.parametrize("name", PLACEMENTS)
def test_score_stats(world, name):
    queries = world["queries"] if name != "gallery_broadcast" else plenty(world["queries"], 60)
    rows = S.score_stats(
        queries, world["gallery"], exclude="truth", thresholds=(0.2,), limits=PLACEMENTS[name]
    ).collect()
    for r in rows:
        if r["qid"] >= 100_000:
            continue
        i = r["qid"] - 1000
        s = np.delete(world["sims"][r["space"]][i], i)
        assert r["n"] == world["n"] - 1
        assert r["s1"] == pytest.approx(s.sum(), abs=1e-9)
        assert r["s2"] == pytest.approx((s * s).sum(), abs=1e-9)
        assert (r["lo"], r["hi"]) == (pytest.approx(s.min()), pytest.approx(s.max()))
        assert r["above_0"] == (s > 0.2).sum()


def test_partitioning_does_not_change_results(world):
    base = S.score_top_k(world["queries"], world["gallery"], 3).collect()
    other = S.score_top_k(world["queries"].repartition(7), world["gallery"].repartition(5), 3).collect()
    key = lambda rows: sorted((r["qid"], r["rk"], r["id"], r["score"]) for r in rows)
    assert key(base) == key(other)


def test_exact_copies_tie_by_id(spark):
    v = [0.6, 0.8]
    gallery = spark.createDataFrame(
        [(i, v) for i in (9, 4, 7, 1)], "id long, g array<double>"
    ).repartition(3)
    queries = spark.createDataFrame([(1, 7, v)], "qid long, truth long, q array<double>")
    space, system = (Space("s", "q", "g"),), (System("s", (1,)),)
    top = S.score_top_k(queries, gallery, 2, space, system).orderBy("rk").collect()
    assert [r["id"] for r in top] == [1, 4]
    assert S.truth_ranks(queries, gallery, space, system).first()["rk"] == 3


def test_string_ids(spark):
    gallery = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [0.0, 1.0])], "id string, g array<double>")
    queries = spark.createDataFrame([("q", "a", [0.0, 1.0])], "qid string, truth string, q array<double>")
    space, system = (Space("s", "q", "g"),), (System("s", (1,)),)
    for limits in (None, Limits(broadcast_rows=0, grid_rows=1)):
        assert S.truth_ranks(queries, gallery, space, system, limits=limits).first()["rk"] == 1


def test_null_vector_scores_zero(world):
    from pyspark.sql import functions as F

    queries = world["queries"].withColumn("q_clap", F.lit(None).cast("array<double>"))
    top = S.score_top_k(queries, world["gallery"], 3).collect()
    assert all(r["sim_a"] == 0 for r in top)


@pytest.mark.parametrize("limits", [None, PLACEMENTS["grid"]])
def test_missing_vectors_under_angular(world, limits):
    from pyspark.sql import functions as F

    some = F.when(F.col("qid") >= 1030, F.col("q_clap"))
    queries = world["queries"].withColumn("q_clap", some)
    gallery = world["gallery"].withColumn("audio", F.when(F.col("id") != 3, F.col("audio")))
    rows = S.score_top_k(queries, gallery, 60, angular_spaces(), limits=limits).collect()
    assert all((r["sim_a"] == 0) == (r["qid"] < 1030) for r in rows)
    assert {r["qid"] < 1030 for r in rows if r["id"] == 3} == {True}
    truth = S.truth_ranks(queries, gallery, angular_spaces(), limits=limits).collect()
    assert all((r["gt_sim_a"] == 0) == (r["qid"] < 1030) for r in truth) and len(truth) == 60


GAPS = [(1, [0.9, 0.1]), (2, None), (3, [-1.0, 1.0])]


@pytest.mark.parametrize("metric", ["cosine", "angular", "neg_manhattan", "neg_euclidean"])
@pytest.mark.parametrize("limits", [None, Limits(broadcast_rows=2), Limits(broadcast_rows=0, grid_rows=1)])
def test_missing_gallery_vectors_do_not_compete(spark, metric, limits):
    gallery = spark.createDataFrame(GAPS, "id long, g array<double>").repartition(2)
    away = [(q, t, [-1.0, 0.0]) for q, t in ((10, 1), (11, 2), (12, 3))]
    queries = spark.createDataFrame(away, "qid long, truth long, q array<double>")
    space, system = (Space("s", "q", "g", metric),), (System("s", (1,)),)
    top = S.score_top_k(queries, gallery, 3, space, system, limits=limits).collect()
    assert sorted((r["qid"], r["rk"], r["id"]) for r in top) == [(q, k, i) for q in (10, 11, 12) for k, i in ((1, 3), (2, 1))]
    ranks = {r["truth"]: r for r in S.truth_ranks(queries, gallery, space, system, limits=limits).collect()}
    assert {t: r["rk"] for t, r in ranks.items()} == {3: 1, 1: 2, 2: 3} and ranks[2]["s_truth"] == -np.inf
    want = {r["qid"]: r["s_truth"] for r in ranks.values()}
    assert {r["qid"]: r["s_truth"] for r in S.truth_scores(queries, gallery, space, system).collect()} == want
    stats = S.score_stats(queries, gallery, space, limits=limits).collect()
    assert all(r["n"] == 2 and r["hi"] == want[12] and r["lo"] == want[10] for r in stats)
    none = S.score_stats(queries, gallery.filter("id = 2"), space, limits=limits).first()
    assert (none["n"], none["lo"], none["hi"]) == (0, None, None)


def test_gaps_matter_only_where_they_weigh(world):
    from pyspark.sql import functions as F

    from modalweave.operators.sweeps import sweep_recall

    gallery = world["gallery"].withColumn("audio", F.when(F.col("id") % 3 != 0, F.col("audio")))
    queries = world["queries"].withColumn("w", F.when(F.col("qid") % 2 == 0, 1.0).otherwise(0.0))
    system = (System("half", (1, 0, "w")),)
    lists = S.score_top_k(queries, gallery, 60, systems=system).groupBy("qid").count().collect()
    assert all(r["count"] == (40 if r["qid"] % 2 == 0 else 60) for r in lists)
    combos = [(1.0, 0.0, 0.0), (0.5, 0.0, 0.5), (0.0, 0.0, 1.0)]
    got = {(r["w_v"], r["w_a"]): r["r10"] for r in sweep_recall(queries, gallery, combos, spaces=CLIP_CLAP, scale_a=1.0).collect()}
    for v, t, a in combos:
        ranks = S.truth_ranks(queries, gallery, systems=(System("s", (v, t, a)),))
        want = ranks.select(F.avg((F.col("rk") <= 10).cast("int"))).first()[0]
        assert got[(v, a)] == pytest.approx(want)


def test_unanswerable_queries_drop_out(world, spark):
    lost = world["queries"].withColumn("truth", world["queries"]["truth"] + 40)
    for limits in (None, PLACEMENTS["grid"]):
        assert S.truth_ranks(lost, world["gallery"], limits=limits).count() == 20


def test_angular_keeps_the_order_of_cosine(world):
    audio = (System("audio", (0, 0, 1)),)
    a = S.truth_ranks(world["queries"], world["gallery"], CLIP_CLAP, audio)
    b = S.truth_ranks(world["queries"], world["gallery"], angular_spaces(), audio)
    pick = lambda df: sorted((r["qid"], r["rk"]) for r in df.collect())
    assert pick(a) == pick(b)


@pytest.mark.parametrize("metric", ["neg_manhattan", "neg_euclidean"])
def test_distance_metrics(world, metric):
    space = (Space("s", "q_clip", "visual", metric),)
    row = S.score_top_k(world["queries"], world["gallery"], 1, space, (System("s", (1,)),)).orderBy("qid").first()
    diff = world["qc"][0][None, :] - world["v"]
    want = -np.abs(diff).sum(1) if metric == "neg_manhattan" else -np.sqrt((diff**2).sum(1))
    assert row["score"] == pytest.approx(want.max(), abs=1e-9)


def test_no_pairs_in_the_plan(world, capsys):
    S.truth_ranks(world["queries"], world["gallery"]).explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_pair_scores_match_tiles(world, spark):
    top = S.score_top_k(world["queries"], world["gallery"], 4)
    pairs = S.score_pairs(top.select("qid", "id"), world["queries"], world["gallery"])
    j = pairs.join(top.select("qid", "id", top["sim_v"].alias("w")), ["qid", "id"]).collect()
    assert len(j) == 240 and all(abs(r["sim_v"] - r["w"]) < 1e-9 for r in j)


def test_partial_rows_grow_with_tasks_not_with_splits(world):
    from pyspark.sql.types import LongType, StructField, StructType

    from modalweave.operators.blocks import block_join

    class CountRows:
        """One row per query and task."""

        def start(self, q):
            return 0

        def update(self, state, q, g):
            return state + g["_n"]

        def finish(self, state, q):
            return {"qid": q["qid"], "n": np.full(q["_n"], state)}

    gallery = world["gallery"].repartition(30, "id").select("id", "visual")
    schema = StructType([StructField("qid", LongType()), StructField("n", LongType())])
    run = lambda tasks: block_join(
        world["queries"].select("qid", "q_clip"), gallery, CountRows(), schema,
        q_key=["qid"], g_key=["id"], limits=Limits(partials=tasks),
    ).collect()
    for tasks in (1, 3):
        rows = run(tasks)
        assert len(rows) == tasks * world["n"]
        seen = {}
        for r in rows:
            seen[r["qid"]] = seen.get(r["qid"], 0) + r["n"]
        assert set(seen.values()) == {world["n"]} and len(seen) == world["n"]


def test_carried_columns_join_the_merged_rows(spark, world):
    """Nulls in them and repeated (qid, truth) rows with other carried values included."""
    from pyspark.sql import functions as F

    queries = world["queries"].withColumn("tags", F.when(F.col("truth") % 2 == 0, F.concat(F.lit("t"), "truth")))
    other = queries.filter("truth < 3").withColumn("tags", F.lit("other"))
    both = queries.unionByName(other)
    gallery = world["gallery"].repartition(12, "id")
    want = {r["qid"]: (r["rk"], r["n"]) for r in S.truth_ranks(world["queries"], world["gallery"]).collect()}
    got = S.truth_ranks(both, gallery, carry=["tags"], limits=Limits(partials=5, query_tile=7))
    assert got.columns[:4] == ["system", "qid", "truth", "tags"]
    rows = got.collect()
    assert len(rows) == world["n"] + 3
    for r in rows:
        assert (r["rk"], r["n"]) == want[r["qid"]]
        t = r["truth"]
        assert r["tags"] in [f"t{t}" if t % 2 == 0 else None] + (["other"] if t < 3 else [])


def test_partial_rows_hold_no_carried_column():
    from pyspark.sql.types import StringType, StructField, StructType

    from modalweave.operators.blocks import Merge

    names = ["system", "qid", "truth", "category", "better"]
    schema = StructType([StructField(n, StringType()) for n in names])
    partial = Merge(("system",), ("qid", "truth", "category"), {"better": "sum"}).partial(schema)
    assert partial.names == ["system", "better", "_row"]


def test_every_cell_has_a_task_of_its_own(spark):
    from pyspark.sql import functions as F

    cells = spark.range(16).withColumn("_cell", B._cell_of(spark, 16, F.col("id").cast("int")))
    dealt = cells.repartition(16, "_cell").groupBy(F.spark_partition_id()).count()
    assert [r["count"] for r in dealt.collect()] == [1] * 16
