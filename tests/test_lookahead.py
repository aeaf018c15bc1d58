"""Changing rows after a date must not move any feature up to that date."""

import pytest
from pyspark.sql import functions as F

from bellwether.operators import calendar as C
from bellwether.operators import joins as J
from bellwether.operators import similarity as M
from bellwether.operators import windows as W
from bellwether.plans.sessions import DIM

CUT = "1999-06-01"

FEATURES = {
    "lagged_returns": (W.lagged_returns, ["lagret_1", "lagret_10"]),
    "momentum": (W.momentum, ["mom_5", "mom_20"]),
    "volatility": (W.volatility, ["vol_5", "vol_20"]),
    "average_ratio": (W.average_ratio, ["maratio_5"]),
    "relative_strength": (W.relative_strength, ["rsi"]),
    "range_distance": (W.range_distance, ["dist_hi", "dist_lo"]),
    "volume_score": (W.volume_score, ["logvol", "volz"]),
    "sign_streak": (W.sign_streak, ["streak"]),
    "volatility_target": (W.volatility_target, ["med"]),
    "hit_priors": (W.hit_priors, ["u20", "d20", "u120"]),
    "liquidity": (W.liquidity, ["turn20"]),
    "range_features": (W.range_features, ["hl20", "std20", "hl_prev", "absr1_prev"]),
    "price_window_aggregates": (W.price_window_aggregates, ["r1_mean5", "vol_std30", "hit_last", "gap_max10"]),
}


def shaken(bars):
    """The same bars with every price and volume from the cut on changed."""
    late = F.col("date") >= F.lit(CUT).cast("date")
    return bars.withColumns({c: F.when(late, F.col(c) * 3 + 1).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume")})


def rows(df, cols, until, op="<="):
    d = df.filter(f"date {op} date'{until}'").select("ticker", "date", *cols)
    return sorted(map(tuple, d.collect()), key=str)


@pytest.mark.parametrize("name", sorted(FEATURES))
def test_window_features(views, name):
    fn, cols = FEATURES[name]
    a = rows(fn(W.price_panel(views.bars)), cols, CUT)
    b = rows(fn(W.price_panel(shaken(views.bars))), cols, CUT)
    assert a and a == b  # the row at the cut itself sees only earlier rows


def test_session_windows(views, spark):
    cut = "2024-01-17"
    s = C.assign_session(views.vector_scored, views.calendar)

    def run(src):
        s = C.assign_session(src, views.calendar)
        day = lambda d: s.filter(F.col(d).isNotNull()).withColumn("pos", F.col(f"{d}_pos")).groupBy("ticker", "pos").agg(F.first("vec").alias("vec"))
        w = C.session_windows(views.daily, views.calendar, day("eff"), day("info"), DIM)
        return rows(w, ["has_short", "n_mid", "n_long"], cut)

    later = F.col("published_at") > F.expr(f"timestamp_ntz'{cut} 09:00:00'")
    assert run(views.vector_scored) == run(views.vector_scored.filter(~later))
    assert s.count() == views.vector_scored.count()


def test_news_features(views):
    cut = "2024-01-17"

    def run(src):
        d = src.withColumn("date", F.to_date("published_at")).groupBy("ticker", "date").agg(
            F.count(F.lit(1)).alias("n"), F.avg("sent").alias("sent"), F.min("vec").alias("vec"))
        return rows(C.news_features(views.daily, d, DIM), ["cnt_short", "cnt_week", "cnt_month", "sent_week", "novelty"], cut)

    early = F.to_date("published_at") < F.lit(cut).cast("date")
    a, b = run(views.vector_scored), run(views.vector_scored.filter(early))
    assert a and a == b


def test_novelty_and_counts(views):
    early = F.to_date("published_at") < F.lit("2024-01-17").cast("date")

    def nov(src):
        d = M.novelty(src).filter(early)
        return sorted((r.news_id, round(r.nov, 9), r.n7, round(r.simfrac, 9)) for r in d.collect())

    assert nov(views.vector_scored) == nov(views.vector_scored.filter(early))

    def n7(src):
        return {r.news_id: r.n7 for r in J.prior_week_counts(src.select("news_id", "ticker", "published_at")).collect()}

    part = n7(views.scored_news.filter(early))
    whole = n7(views.scored_news)
    assert all(whole[k] == x for k, x in part.items())
