"""Toxicity by held-out accuracy, the registered queries, the pipeline stage by stage."""

import os
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_helpers import SF, texts_of
from test_groups import repeats_brute, similar_brute
from test_texts import base_pii

from modalweave.llm import toxicity
from modalweave.llm.queries import QUERIES

BIG = "/root/testdata/sf0.1"


def test_label_model_recovers_rates():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.2
    rates = np.array([[0.7, 0.02], [0.5, 0.05], [0.6, 0.01], [0.3, 0.03]])
    votes = (rng.random((4000, 4)) < np.where(truth[:, None], rates[:, 0], rates[:, 1])).astype(float)
    posterior, learnt = toxicity.label_model(votes, rates * 0.5 + 0.1, 0.3)
    assert ((posterior > 0.5) == truth).mean() > 0.95
    assert np.abs(learnt - rates).max() < 0.1


def test_dependent_voters_are_found_and_not_counted_twice():
    """Voter 1 repeats voter 0 in most rows of either class: its rates given voter 0 are found, the posterior is that of the true model."""
    rng = np.random.default_rng(2)
    n = 20_000
    truth = rng.random(n) < 0.3
    draw = lambda yes, no: rng.random(n) < np.where(truth, yes, no)
    votes = np.stack([draw(0.6, 0.2), draw(0, 0), draw(0.5, 0.1), draw(0.7, 0.15), draw(0.6, 0.1)], axis=1)
    votes[:, 1] = rng.random(n) < np.where(votes[:, 0], 0.8, 0.05)  # says nothing about the class that voter 0 did not
    votes = votes.astype(float)
    rates = np.array([[0.6, 0.2], [0.5, 0.2], [0.5, 0.1], [0.7, 0.15], [0.6, 0.1]])
    alone, _ = toxicity.label_model(votes, rates, 0.3)
    parents = toxicity.strongest_tree(toxicity.dependence(votes, truth.astype(float), np.ones(n)))
    assert parents == [-1, 0, -1, -1, -1]
    first, _ = toxicity.label_model(votes, rates, 0.3, rounds=1)
    posterior, learnt = toxicity.correlated_model(votes, first, parents, rounds=300)
    assert np.abs(learnt[:, 1, 1] - 0.8).max() < 0.05 and np.abs(learnt[:, 0, 1] - 0.05).max() < 0.03
    odds = np.log(0.3 / 0.7) + sum(
        np.where(votes[:, i] > 0, np.log(rates[i, 0] / rates[i, 1]), np.log((1 - rates[i, 0]) / (1 - rates[i, 1]))) for i in (0, 2, 3, 4)
    )
    true = 1 / (1 + np.exp(-odds))
    assert np.abs(posterior - true).mean() < np.abs(alone - true).mean() / 2
    # with labels the rounds end where the posterior is nearest to them, and never behind the start
    label = truth.astype(float)
    held, _ = toxicity.correlated_model(votes, first, parents, marked=label)
    assert toxicity.log_loss(held, label, np.ones(n)) <= toxicity.log_loss(first, label, np.ones(n))
    # independent voters: no tree, and the same posterior as without correlations
    lone = np.stack([draw(0.6, 0.2), draw(0.5, 0.1), draw(0.7, 0.15)], axis=1).astype(float)
    assert toxicity.strongest_tree(toxicity.dependence(lone, truth.astype(float), np.ones(n))) == [-1, -1, -1]
    # a row that stands for three equals three rows
    few, three = votes[:50], np.repeat(votes[:50], 3, axis=0)
    one, _ = toxicity.correlated_model(few, alone[:50], parents, np.full(50, 3.0))
    many, _ = toxicity.correlated_model(three, np.repeat(alone[:50], 3), parents)
    assert np.allclose(np.repeat(one, 3), many)


def test_tree_is_the_strongest_of_all():
    """Against every forest over four voters."""
    from itertools import combinations

    rng = np.random.default_rng(3)
    for _ in range(20):
        s = np.triu(rng.integers(0, 60, (4, 4)).astype(float), 1)
        s = s + s.T
        least = 2 * np.log(6 / 0.05)
        edges = [(i, j) for i, j in combinations(range(4), 2) if s[i, j] >= least]
        best = 0
        for k in range(4):
            for chosen in combinations(edges, k):
                group = list(range(4))
                for i, j in chosen:
                    group = [group[i] if g == group[j] else g for g in group]
                if len(set(group)) == 4 - k:
                    best = max(best, sum(s[e] for e in chosen))
        parents = toxicity.strongest_tree(s)
        assert sum(s[i, p] for i, p in enumerate(parents) if p >= 0) == best


def test_voters_that_agree_are_joined():
    votes = np.zeros((100, 3))
    votes[:20, 0] = votes[:19, 1] = 1
    votes[50:60, 2] = 1
    assert toxicity.independent(votes) == [[0, 1], [2]]


@pytest.mark.skipif(not os.path.isdir(BIG), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    rows = QUERIES["op10_toxicity"](spark, BIG).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    right = Counter((r["toxic"], r["predicted"]) for r in rows)
    assert right[1, 1] / (right[1, 0] + right[1, 1]) > 0.8, right
    assert right[0, 1] <= 0.01 * (right[0, 0] + right[0, 1]), right
    assert docs.count() > len(rows)


def test_scores_of_odd_documents(spark, odd, none, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    scored = toxicity.score(odd, model).collect()
    assert Counter(r["doc_id"] for r in scored) == Counter(i for i, _ in texts_of(odd))
    assert all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.train(none, labels).weights == {} and toxicity.train(docs, labels.limit(0)).weights == {}
    kept = toxicity.reject(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_queries_return_their_contract(spark):
    columns = {
        "op1_packing": ["doc_id"],
        "op2_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op3_chat": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        "op4_imatch": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        "op5_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op6_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        "op7_simhash": ["doc_id", "fingerprint", "component_id"],
        "op8_embeddings": ["vec_id", "n_links", "component_id", "kept"],
        "op9_suffix": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op11_crosstok": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
        "op12_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op13_audit": ["lang", "source", "part", "item", "value", "rank"],
    }
    assert set(columns) == set(QUERIES)
    for name, wanted in columns.items():
        df = QUERIES[name](spark, SF)
        assert set(wanted) <= set(df.columns), name
        n = spark.read.parquet(f"{SF}/{'embeddings' if name.startswith('op8') else 'documents'}.parquet").count()
        assert df.count() == n or name in ("op3_chat", "op13_audit")


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    toxic, near, repeated, private, packed = (f for _, f in pipeline.STAGES)

    def rows(df):
        return {r["doc_id"]: r for r in df.collect()}

    one = toxic(spark, docs, SF)
    score = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet")).scorer()
    assert one.columns == columns and set(rows(one)) == {i for i, r in rows(docs).items() if score(r["text"] or "") < 0.5}
    two = near(spark, one, SF)
    least = dict(list(similar_brute([(i, r["text"] or "") for i, r in rows(one).items()])))
    assert two.columns == columns and set(rows(two)) == {i for i, c in least.items() if i == c}
    three = repeated(spark, two, SF)
    before, after = rows(two), rows(three)
    assert three.columns == columns and set(after) == set(before)
    left = {k[0]: k[2] for k in repeats_brute([(i, r["text"]) for i, r in before.items()])}
    for i, r in after.items():
        gone = len(before[i]["text"].encode()) - len(r["text"].encode())
        assert left[i] <= gone <= left[i] + 8 * (left[i] > 0) * 20
    four = private(spark, three, SF)
    final = rows(four)
    assert four.columns == columns and set(final) == set(after)
    assert all((r["text"] == after[i]["text"]) == (not base_pii(after[i]["text"])) for i, r in final.items())
    five = packed(spark, four, SF)
    assert Counter(r["doc_id"] for r in five.collect()) == Counter(list(final))
    assert sorted(map(tuple, pipeline.run(spark, SF).collect())) == sorted(map(tuple, five.collect()))


def test_rest_works_without_these_folders(tmp_path):
    """The entry module imports when corpus_pipeline.py and the subpackage are gone."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in ("__spark_entry__.py", "modalweave"):
        source = os.path.join(root, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "modalweave" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-1500:]


def test_executors_need_no_installed_package(tmp_path):
    """Every operator and the pipeline run from a folder that cannot import the package."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import importlib.util
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spec = importlib.util.spec_from_file_location("entry", {os.path.join(root, '__spark_entry__.py')!r})
m = importlib.util.module_from_spec(spec)
spec.loader.exec_module(m)
for name, query in m.queries().items():
    if name == "pipeline" or name.startswith("op"):
        query(spark, {SF!r}).write.format("noop").mode("overwrite").save()
print("done")
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=900)
    assert done.stdout.strip().endswith("done"), done.stderr[-2000:]


def test_stages_leave_other_columns_alone(spark):
    """Columns named like what the stages use inside, or differing in case only."""
    import corpus_pipeline as pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, _spans string, bucket int, Text string, kept string, _null int, _stay long"
    rows = [(i, t, "en", "s", n, "a", 1, "b", "c", 2, 3) for i, t, n in ((1, "mail a@b.co now", 15), (2, None, None), (3, "", 0))]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    got = sorted(map(tuple, docs.collect()))
    assert [r[0] for r in got] == [1, 2] and got[0][1] == "mail <EMAIL> now" and got[1][1] is None
    assert {r[5:] for r in got} == {("a", 1, "b", "c", 2, 3)}
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() == 2
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
