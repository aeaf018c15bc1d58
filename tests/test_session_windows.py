"""Session windows by running vector sums against sums taken window by window."""

import datetime as dt

import numpy as np
import pytest

from bellwether.operators import calendar as C

DIM, MID, LONG = 3, 2, 5


def made(spark):
    rng = np.random.default_rng(5)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(25)]
    bars = [(t, days[k]) for t in ("a", "b", "none") for k in range(25) if t != "b" or k % 3 != 1]
    info = [(t, k, [float(x) for x in rng.normal(size=DIM) * 10.0 ** (k % 5)]) for t in ("a", "b", "nobar") for k in range(25) if rng.random() < 0.5]
    over = [(t, k, v) for t, k, v in info if k % 2]
    return days, bars, info, over


def frames(spark, bars, info, over):
    cal = C.calendar(spark.createDataFrame(bars or [("a", None)], "ticker string, date date").dropna())
    kind = "ticker string, pos int, vec array<double>"
    return spark.createDataFrame(bars, "ticker string, date date"), cal, spark.createDataFrame(over, kind), spark.createDataFrame(info, kind)


def test_against_windows_one_by_one(spark):
    days, bars, info, over = made(spark)
    got = {(r.ticker, r.date): r for r in C.session_windows(*frames(spark, bars, info, over), DIM, MID, LONG, items=True).collect()}
    held, fresh = ({(t, k): np.array(v) for t, k, v in x} for x in (info, over))
    first = {t: min(d for u, d in bars if u == t) for t, _ in bars}
    assert set(got) == {(t, d) for t, d in bars if d > first[t]}
    for (t, d), r in got.items():
        p = days.index(d)
        last = max(days.index(x) for u, x in bars if u == t and x < d)
        for n, mean, back in ((r.n_mid, r.mid_mean, MID), (r.n_long, r.long_mean, LONG)):
            inside = [held[t, k] for k in range(p - back, p) if (t, k) in held]
            assert n == len(inside)
            assert mean == pytest.approx(list(sum(inside, np.zeros(DIM)) / back), rel=1e-9, abs=1e-9)
        near = [fresh[t, k] for k in range(last + 1, p + 1) if (t, k) in fresh]
        assert r.short == pytest.approx(list(np.mean(near, axis=0)) if near else [0.0] * DIM)
        assert r.has_short == bool(near) and r.has_any == (bool(near) or r.n_long > 0)
        assert sorted(i.pos for i in r["items"]) == [k for k in range(p - LONG, p) if (t, k) in held]


def test_no_vectors_are_collected_and_news_may_be_missing(spark):
    _, bars, info, over = made(spark)
    plan = C.session_windows(*frames(spark, bars, info, over), DIM)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    rows = C.session_windows(*frames(spark, bars, [], []), DIM).collect()
    assert len(rows) == len(bars) - 3 and not any(r.has_any or any(r.mid_mean) or r.n_long for r in rows)
    assert C.session_windows(*frames(spark, [], info, over), DIM).count() == 0
