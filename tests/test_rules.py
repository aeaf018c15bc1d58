"""Edge cases, brute-force comparisons and plan shapes."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bellwether.functions import text as X
from bellwether.operators import aggregates as A
from bellwether.operators import calendar as C
from bellwether.operators import joins as J
from bellwether.operators import linking as L
from bellwether.operators import outcomes as O
from bellwether.operators import ranks as R
from bellwether.operators import selection as S
from bellwether.operators import similarity as M
from bellwether.operators import stats as T
from bellwether.operators import windows as W
from bellwether.sources import sinks as SK

D, TS = dt.date, dt.datetime


def plan(df):
    return df._jdf.queryExecution().toString()


# ------------------------------------------------------------------ sessions


@pytest.fixture(scope="module")
def cal(spark):
    # Thursday, Friday, Tuesday (Monday is a holiday)
    bars = spark.createDataFrame([(D(2024, 1, 4),), (D(2024, 1, 5),), (D(2024, 1, 9),)], "date date")
    return C.calendar(bars)


@pytest.mark.parametrize("ts, eff, info", [
    ("2024-01-04 08:59:59", D(2024, 1, 4), D(2024, 1, 4)),
    ("2024-01-04 09:00:00", D(2024, 1, 4), D(2024, 1, 4)),   # exactly at the open counts
    ("2024-01-04 09:00:01", D(2024, 1, 5), D(2024, 1, 4)),
    ("2024-01-04 15:30:00", D(2024, 1, 5), D(2024, 1, 4)),   # exactly at the close counts
    ("2024-01-04 15:30:01", D(2024, 1, 5), D(2024, 1, 5)),
    ("2024-01-06 12:00:00", D(2024, 1, 9), D(2024, 1, 9)),   # weekend
    ("2024-01-08 10:00:00", D(2024, 1, 9), D(2024, 1, 9)),   # holiday
    ("2024-01-09 10:00:00", None, D(2024, 1, 9)),            # after the last open
    ("2024-01-09 16:00:00", None, None),                     # after the last close
    ("2023-12-01 16:00:00", D(2024, 1, 4), D(2024, 1, 4)),   # before the first session
])
def test_session_edges(spark, cal, ts, eff, info):
    n = spark.sql(f"select 1 as news_id, timestamp_ntz'{ts}' as published_at")
    r = C.assign_session(n, cal).first()
    assert (r.eff, r.info) == (eff, info)
    assert r.fresh == (None if eff is None or info is None else eff == info)


def test_session_stream(spark, views, tmp_path):
    from bellwether.streaming import session_stream

    src = str(tmp_path / "news")
    views.scored_news.write.parquet(src)
    q = (session_stream(spark, src, "news_id long, ticker string, published_at timestamp_ntz, sent double", views.calendar)
         .writeStream.format("memory").queryName("sessions_out").option("checkpointLocation", str(tmp_path / "cp"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    pick = ["news_id", "eff", "info"]
    got = sorted(map(tuple, spark.table("sessions_out").select(*pick).collect()), key=str)
    assert got == sorted(map(tuple, views.sessioned.select(*pick).collect()), key=str)


# ------------------------------------------------------------------ as-of


def test_asof_edges(spark):
    bars = spark.createDataFrame([("a", TS(2024, 1, 1, 10), 1.0), ("a", TS(2024, 1, 3, 10), 2.0), ("b", TS(2024, 1, 1, 10), 9.0)],
                                 "ticker string, ts timestamp_ntz, close double")
    at = [TS(2024, 1, 1, 9), TS(2024, 1, 1, 10), TS(2024, 1, 2, 0), TS(2024, 1, 3, 10), TS(2024, 1, 4, 0)]
    probes = spark.createDataFrame([(i, "a", t) for i, t in enumerate(at)], "id int, ticker string, t timestamp_ntz")

    def run(direction):
        d = J.asof_join(probes, bars, "t", "ts", ["close"], direction, prefix="bar_")
        return [r.bar_close for r in d.orderBy("id").collect()]

    assert run("backward") == [None, 1.0, 1.0, 2.0, 2.0]
    assert run("forward") == [1.0, 1.0, 2.0, 2.0, None]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 200)), min_size=1, max_size=30, unique=True),
       st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 200)), min_size=1, max_size=30))
def test_asof_matches_pandas(spark, bars, probes):
    t0 = TS(2024, 1, 1)
    b = pd.DataFrame([(k, t0 + dt.timedelta(hours=h), float(i)) for i, (k, h) in enumerate(bars)], columns=["ticker", "ts", "close"])
    p = pd.DataFrame([(i, k, t0 + dt.timedelta(hours=h)) for i, (k, h) in enumerate(probes)], columns=["id", "ticker", "t"])
    sb = spark.createDataFrame(b, "ticker string, ts timestamp_ntz, close double")
    sp = spark.createDataFrame(p, "id int, ticker string, t timestamp_ntz")
    for direction in ("backward", "forward"):
        want = pd.merge_asof(p.sort_values("t"), b.sort_values("ts"), left_on="t", right_on="ts", by="ticker", direction=direction)
        want = {r.id: None if math.isnan(r.close) else r.close for r in want.itertuples()}
        got = {r.id: r.bar_close for r in J.asof_join(sp, sb, "t", "ts", ["close"], direction, prefix="bar_").collect()}
        assert got == want


def test_no_pair_joins(views):
    for df in (views.sessioned,
               J.asof_join(views.scored_news, views.bars_intraday, "published_at", "ts", ["close"], prefix="bar_"),
               J.prior_week_counts(views.scored_news), M.novelty(views.vector_scored), L.link_simple(views.news, views.aliases)):
        p = plan(df)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


# ------------------------------------------------------------------ outcomes


def bars5(spark, bars):
    return spark.createDataFrame([("t", D(2024, 1, 1), i + 1, TS(2024, 1, 1, 9 + i), *map(float, b)) for i, b in enumerate(bars)],
                                 "ticker string, day date, bar_ix int, ts timestamp_ntz, open double, high double, low double, close double")


@pytest.mark.parametrize("path, reason, bar, ret", [
    ([(100, 101, 99, 100), (100, 106, 99, 104)], 1, 2, 0.05),
    ([(100, 101, 99, 100), (100, 104, 96, 97), (97, 110, 97, 110)], 0, 2, -0.03),
    ([(100, 101, 99, 100), (100, 106, 96, 100)], 3, 2, -0.03),     # both in one bar: the stop
    ([(100, 101, 99, 100), (100, 102, 98, 102)], 2, 2, 0.02),      # neither: last close
])
def test_first_touch(spark, path, reason, bar, ret):
    r = O.first_touch_intraday(bars5(spark, path), 0.05, [0.03]).first()
    assert (r.reason, r.bar_hit) == (reason, bar) and r.ret_gross == pytest.approx(ret)


# (open, high, low, close) per day; entry at the first open. Stop -3 %, target +5 %, three days, no trailing stop.
HAND_WORKED = [
    ("closes out after three days", [(100, 102, 99, 101), (101, 103, 100, 102), (102, 104, 98, 99), (99, 120, 50, 60)], None, (-0.01, -0.01, 3, 2)),
    ("target on day one", [(100, 106, 99, 105)], None, (0.05, 0.05, 1, 1)),
    ("stop on day two", [(100, 101, 99, 100), (100, 101, 96, 98)], None, (-0.03, -0.03, 2, 0)),
    ("both levels in one bar", [(100, 106, 96, 100)], None, (-0.03, 0.05, 1, 3)),
    ("an open beyond the stop fills there", [(100, 101, 99, 100), (90, 110, 89, 100)], None, (-0.10, -0.10, 2, 0)),
    ("the series ends first", [(100, 101, 99, 100), (100, 102, 99, 101)], None, (0.01, 0.01, 2, 2)),
    ("a trailing stop rises to 2 % below the high", [(100, 104, 99, 103), (103, 103, 101, 102)], -0.02, (0.0192, 0.0192, 2, 0)),
    ("it is raised after the bar", [(100, 104, 98, 103), (103, 104, 102, 103)], -0.02, (0.03, 0.03, 2, 2)),
]


@pytest.mark.parametrize(("case", "path", "trail", "want"), HAND_WORKED, ids=[c[0] for c in HAND_WORKED])
def test_multi_day_exit_by_hand(spark, case, path, trail, want):
    rows = [("t", dt.date(2024, 1, 1 + i), *map(float, bar)) for i, bar in enumerate(path)]
    df = spark.createDataFrame(rows, "ticker string, date date, o double, h double, l double, c double")
    r = O.multi_day_exit(df, [(-0.03, 0.05, trail, 3)]).orderBy("date").first()
    assert (round(r.ret_pess, 9), round(r.ret_opt, 9), r.held, r.reason) == want


def test_multi_day_exit_invariants(views):
    configs = [(-0.03, 0.05, None, 4), (-0.05, 0.10, -0.04, 6)]
    r = O.multi_day_exit(views.scores, configs)
    limit = F.when(F.col("config") == 0, 4).otherwise(6)
    bad = r.filter((F.col("ret_pess") > F.col("ret_opt") + 1e-12) | (F.col("held") > limit) | (F.col("held") < 1))
    assert bad.count() == 0 and r.count() == 2 * views.scores.count()
    # only a bar that touches both levels tells the two apart
    assert r.filter("reason <> 3 and abs(ret_pess - ret_opt) > 1e-12").count() == 0


def test_equity_stays_lost(spark):
    d = spark.createDataFrame([("b", D(2024, 1, i + 1), r) for i, r in enumerate([0.1, -1.0, 0.5])], "book string, date date, r double")
    assert [round(r.equity, 9) for r in W.equity_curve(d, "r", "book").orderBy("date").collect()] == [1.1, 0.0, 0.0]


# ------------------------------------------------------------------ ranks and statistics


def test_degenerate_mcc(spark):
    d = spark.createDataFrame([(True, True), (False, True)], "y boolean, p boolean")
    assert A.confusion(d, F.col("y"), F.col("p")).first().mcc == 0.0


def test_exact_quantiles_with_one_hot_group(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=900), 1)  # many ties
    g = np.where(rng.uniform(size=900) < 0.6, "hot", rng.choice(list("abc"), 900))
    d = spark.createDataFrame(pd.DataFrame({"g": g, "x": x}))
    for r in R.exact_quantiles(d, "x", [0.0, 0.1, 0.5, 0.975, 1.0], by=["g"]).collect():
        assert r.q == pytest.approx(np.quantile(x[g == r.g], r.prob))


def test_running_totals(spark):
    d = spark.range(1000).select("id", (F.col("id") % 7).alias("v")).repartition(5)
    got = R.running_totals(d, [F.asc("v"), F.desc("id")], {"s": "v"}).orderBy("rank").toPandas()
    want = d.toPandas().sort_values(["v", "id"], ascending=[True, False])
    assert got["id"].tolist() == want["id"].tolist() and got["s"].tolist() == want["v"].cumsum().tolist()


@pytest.mark.parametrize("hits, n, p", [(0, 5, 0.3), (5, 5, 0.3), (3, 10, 0.5), (40, 200, 0.15)])
def test_binomial_tail(spark, hits, n, p):
    want = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(hits, n + 1))
    d = spark.createDataFrame([(hits, n, p)], "h int, n int, p double")
    assert d.select(T.binomial_tail(F.col("h"), F.col("n"), F.col("p"))).first()[0] == pytest.approx(want)


def test_first_per_key(spark):
    d = spark.createDataFrame([("a", 2, 1), ("a", 1, 5), ("b", 3, 9), (None, 4, 4)], "k string, o int, id int")
    assert sorted(r.id for r in S.first_per_key(d, ["k"], ["o", "id"]).collect()) == [4, 5, 9]


# ------------------------------------------------------------------ similarity and linking


def test_novelty_blocks_agree_with_brute_force(views):
    items = views.vector_scored.filter("ticker = 'click'").toPandas().sort_values(["published_at", "news_id"]).reset_index(drop=True)
    V = np.array(items.vec.tolist(), dtype=float)
    V /= np.linalg.norm(V, axis=1, keepdims=True)
    want = {}
    for i, r in items.iterrows():
        near = [j for j in range(i) if items.published_at[j] >= r.published_at - pd.Timedelta(days=7)]
        s = V[near] @ V[i]
        want[r.news_id] = (round(1 - s.max(), 6), len(near), round(float((s > 0.8).mean()), 6)) if near else (1.0, 0, 0.0)
    for block in (2, 2048):  # tiny blocks split every day into several tasks
        got = M.novelty(views.vector_scored.filter("ticker = 'click'"), block=block).collect()
        assert {r.news_id: (round(r.nov, 6), r.n7, round(r.simfrac, 6)) for r in got} == want


def test_nearest_agrees_with_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    text = [f"t{i % 25}" for i in range(60)]
    c = spark.createDataFrame([(i, text[i], v[i].tolist()) for i in range(60)], "id int, text string, vec array<double>").repartition(6)
    got = {(r.query_id, r["rank"]): r.id for r in M.nearest(c, c.filter("id < 3"), 4).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(3):
        seen, want = {text[q]}, []
        for i in np.argsort(-(u @ u[q]), kind="stable"):
            if i != q and text[i] not in seen:
                seen.add(text[i])
                want.append(int(i))
        assert [got[(q, k + 1)] for k in range(4)] == want[:4]


def test_mentions_agree_with_contains(views, spark):
    # short names, and one of two words
    two = spark.sql("select 'no such' as alias").unionByName(spark.sql("select 'th' as alias")).unionByName(
        views.news.selectExpr("array_join(slice(split(trim(title), ' +'), 1, 2), ' ') as alias").filter("length(alias) > 4 and alias not like '%\\n%'").limit(3))
    got = {tuple(r) for r in L.mentions(views.news, two).collect()}
    names = [r.alias for r in two.distinct().collect()]
    want = {(r.news_id, a) for r in views.news.collect() for a in names if a in r.title}
    assert got == want and want


def test_run_and_boundary(spark):
    d = spark.createDataFrame([(["ab", "cd", "ef"],)], "t array<string>")
    names = ["abcd", "cdef", "bcd", "abcdef", "ef", "efab"]
    got = d.select(*[X.is_run("t", F.lit(n)).alias(n) for n in names]).first()
    runs = set(d.select(X.token_runs("t")).first()[0])
    assert [got[n] for n in names] == [n in runs for n in names] == [True, True, False, True, True, False]
    t = spark.createDataFrame([("a cat.", True), ("concat", False), ("cat&dog", False)], "s string, want boolean")
    assert all(r[0] == r.want for r in t.select(X.word_match("s", F.lit("cat")), "want").collect())


def test_append_is_idempotent(spark, tmp_path):
    p = str(tmp_path / "t")
    d = spark.range(10).withColumn("v", F.col("id") * 2)
    for part in (d.filter("id < 6"), d, d):
        SK.append_missing(part, p, ["id"])
    assert spark.read.parquet(p).count() == 10


def test_top_k_is_cut_before_the_exchange(views):
    assert "WindowGroupLimit" in plan(S.top_per_day(views.scores, 3))


def test_scan_reads_needed_columns_only(views):
    p = plan(views.bars.select("ticker", "date", "close"))
    assert "l_tax" not in p.split("ReadSchema")[-1]
    p = plan(views.table("lineitem").filter("l_suppkey = 3").select("l_tax"))
    assert "EqualTo(l_suppkey,3)" in p
