"""Merged window states against numpy on short, tied, missing and huge values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bellwether.operators import windowstates as S


def brute(xs, at, span):
    got = [x for x in xs[max(0, at - span):at] if x is not None]
    if not got:
        return 0, None, None, None, None, None
    a = np.array(got)
    return len(got), a.mean(), a.std(), a.std(ddof=1) if len(got) > 1 else None, a.min(), a.max()


@pytest.mark.parametrize("spans", [(5, 10, 30), (1, 2, 3), (4, 7, 60), (6,)])
def test_against_numpy(spark, spans):
    rng = np.random.default_rng(len(spans))
    series = {
        "wide": list(rng.normal(size=90) * 10.0 ** rng.integers(-3, 4, 90)), "shifted": list(1e9 + rng.normal(size=70)),
        "ties": [float(x) for x in rng.integers(0, 2, 40)], "gaps": [None if k % 3 else float(k) for k in range(45)], "none": [None] * 12, "one": [2.5],
    }
    series = {t: [None if x is None else float(x) for x in xs] for t, xs in series.items()}
    rows = [(t, k, x, -x if x is not None else None) for t, xs in series.items() for k, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "ticker string, date int, x double, y double").repartition(3)
    out = S.rolling_states(df, ["x", "y"], list(spans))
    cols = [f(f"{s}__{k}").alias(f"{s}{k}{n}") for s in "xy" for k in spans
            for n, f in (("n", lambda c: F.col(f"{c}.n")), ("mean", S.mean), ("pop", S.std_pop), ("samp", S.std_samp), ("low", S.low), ("high", S.high))]
    got = {(r.ticker, r.date): r for r in out.select("ticker", "date", *cols).collect()}
    assert len(got) == len(rows)
    for t, xs in series.items():
        for at in range(len(xs)):
            for s in "xy":
                ys = xs if s == "x" else [-x if x is not None else None for x in xs]
                for k in spans:
                    r = [got[t, at][f"{s}{k}{n}"] for n in ("n", "mean", "pop", "samp", "low", "high")]
                    want = brute(ys, at, k)
                    assert [x is None for x in r] == [x is None for x in want], (t, at, s, k)
                    assert [x or 0 for x in r] == pytest.approx([x or 0 for x in want], rel=1e-9, abs=1e-6 if t == "shifted" else 1e-9), (t, at, s, k)


def test_only_the_shortest_span_is_a_frame_and_one_sort_serves_all(spark):
    df = spark.range(3000).selectExpr("cast(id % 7 as string) ticker", "id date", "rand(1) x")
    plan = S.rolling_states(df, ["x"], [5, 10, 30])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1
    assert "RowFrame, -5, -1)" in plan and "RowFrame, -10, -1)" not in plan and "RowFrame, -30, -1)" not in plan


def test_empty_table_and_wrong_spans(spark):
    df = spark.createDataFrame([], "ticker string, date int, x double")
    assert S.rolling_states(df, ["x"], [2, 4]).count() == 0
    with pytest.raises(ValueError):
        S.rolling_states(df, ["x"], [])
