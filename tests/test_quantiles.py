import numpy as np
import pytest

from modalweave.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("bins,fetch", [(4096, 20_000), (7, 5), (3, 1)])
def test_quantiles_of_groups(spark, bins, fetch):
    rng = np.random.default_rng(0)
    data = {
        "wide": np.exp(rng.normal(0, 5, 400)),
        "ties": rng.integers(0, 4, 301).astype(float),
        "same": np.full(50, 2.5),
        "one": np.array([7.0]),
        "hot": np.concatenate([np.full(500, 0.25), rng.random(7)]),
    }
    rows = [(g, float(x)) for g, xs in data.items() for x in xs]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = exact_quantiles(df, "x", [0.0, 0.1, 0.5, 0.975, 1.0], "g", bins, fetch)
    for g, xs in data.items():
        for p, (mid, low) in got[g].items():
            assert mid == pytest.approx(np.quantile(xs, p), rel=1e-12)
            assert low == np.sort(xs)[max(0, int(np.ceil(p * len(xs))) - 1)]


def test_without_groups(spark):
    df = spark.range(101).selectExpr("cast(id as double) as x")
    assert exact_quantiles(df, "x", [0.25])[None][0.25] == (25.0, 25.0)


@pytest.mark.parametrize("fetch", [20_000, 5])
def test_values_that_are_not_finite_are_ordered_ends(spark, fetch):
    rng = np.random.default_rng(1)
    inf, nan = float("inf"), float("nan")
    data = {
        "inf": [*rng.random(200), inf], "nan": [*rng.random(200), nan], "both": [-inf, -inf, *rng.random(200), inf, nan],
        "none": [inf, nan, -inf], "huge": [*(1.7e308 * rng.uniform(-1, 1, 100)), 1.7e308, -1.7e308], "tiny": [0.0] * 30 + [5e-324] * 30,
    }
    df = spark.createDataFrame([(g, float(x)) for g, xs in data.items() for x in xs], "g string, x double").repartition(3)
    got = exact_quantiles(df, "x", [0.0, 0.25, 0.5, 1.0], "g", fetch=fetch)
    for g, xs in data.items():
        ordered = sorted([x for x in xs if x == x]) + [x for x in xs if x != x]
        for p, (_, low) in got[g].items():
            want = ordered[max(0, int(np.ceil(p * len(xs))) - 1)]
            assert low == want or (low != low and want != want)
