"""Exact quantiles by refinement against numpy, and what their plan does not do."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bellwether.operators import quantiles as Q

PROBS = [0.0, 0.001, 0.1, 0.25, 0.5, 0.9, 0.975, 1.0]


def same(spark, groups, few, steps, monkeypatch):
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "STEPS", steps)
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs]
    got = {(r.g, r.prob): r.q for r in Q.exact_quantiles(spark.createDataFrame(rows, "g string, x double").repartition(5), "x", PROBS, ["g"]).collect()}
    assert len(got) == len(groups) * len(PROBS)
    for g, xs in groups.items():
        for p in PROBS:
            assert got[g, p] == pytest.approx(np.quantile(np.array(xs, dtype=float), p), rel=1e-12, abs=0), (g, p)


@pytest.mark.parametrize(("few", "steps"), [(4096, 4096), (3, 8), (1, 2)])
def test_against_numpy(spark, monkeypatch, few, steps):
    rng = np.random.default_rng(few)
    same(spark, {
        "wide": np.exp(rng.normal(0, 40, 700)) * rng.choice([-1, 1], 700), "ties": rng.integers(-2, 3, 900), "hot": [7.25] * 3000 + [1.0, 9.0],
        "close": 1 + np.arange(200) * 2.0**-52, "zeros": [0.0, -0.0] * 40 + [5e-324, -5e-324], "one": [-3.0], None: rng.normal(size=50), "ends": [8e307, -8e307, 7e307],
    } if few > 1 else {"ties": rng.integers(-2, 3, 90), "close": 1 + np.arange(12) * 2.0**-52, "one": [-3.0]}, few, steps, monkeypatch)


def test_nulls_nan_and_infinities(spark):
    rows = [(None,), (float("nan"),), (float("inf"),), (float("-inf"),), (1.0,), (2.0,)]
    got = {r.prob: r.q for r in Q.exact_quantiles(spark.createDataFrame(rows, "x double"), "x", [0.0, 0.25, 0.5, 0.75, 1.0]).collect()}
    assert (got[0.0], got[0.25], got[0.5], got[0.75]) == (float("-inf"), 1.0, 2.0, float("inf")) and np.isnan(got[1.0])
    assert Q.exact_quantiles(spark.createDataFrame([], "x double"), "x", [0.5]).count() == 0
    assert Q.exact_quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]).count() == 0


def test_code_never_falls(spark):
    xs = sorted([0.0, 5e-324, 2.2e-308, 1.7e308, float("inf"), *np.exp2(np.arange(-40, 40, 0.01)), *np.nextafter(2.0 ** np.arange(-9, 9), 0)])
    xs = [-x for x in reversed(xs)] + xs + [float("nan")]
    codes = [r[0] for r in spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(Q.monotone_code(F.col("x"))).collect()]
    assert codes == sorted(codes)


def test_no_range_exchange_and_no_sort_of_the_table(spark):
    seen = []
    plain = Q._kept

    def watched(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df)

    Q._kept = watched
    try:
        rows = spark.range(100_000).selectExpr("id % 3 AS g", "cast(hash(id) AS double) AS x")
        Q.exact_quantiles(rows, "x", [0.5], ["g"]).collect()
    finally:
        Q._kept = plain
    assert len(seen) >= 3 and not any("rangepartitioning" in plan for plan in seen)
