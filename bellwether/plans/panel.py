"""Projections, filters and window features of the bar panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from bellwether.operators import projections as P
from bellwether.operators import windows as W
from bellwether.plans.registry import query

# ------------------------------------------------------------------ projections


@query("score_table", "PRJ1", "ticker:s date:d o:f h:f l:f c:f gap:f vol:f score:f",
       "SELECT * FROM scores", "scores")
def _(v):
    return v.scores


@query("split_tag", "PRJ2", "ticker:s date:d split:s", """
SELECT ticker, date, CASE WHEN date < DATE '1999-01-01' THEN 'train'
  WHEN date < DATE '2000-01-01' THEN 'dev' ELSE 'test' END AS split FROM bars""", "bars")
def _(v):
    return v.bars.withColumn("split", P.split_tag("date", "1999-01-01", "2000-01-01"))


@query("direction_label", "PRJ3", "ticker:s date:d ret:f label:i", """
SELECT ticker, date, ret, CASE WHEN ret > 0 THEN 1 ELSE -1 END AS label
FROM panel WHERE ret IS NOT NULL AND ret <> 0""", "panel")
def _(v):
    return P.direction_label(v.panel)


@query("eligibility_flag", "PRJ4", "news_id:i emb_eligible:b", """
SELECT news_id, published_at < DATE '2024-01-20' AS emb_eligible FROM news""", "news")
def _(v):
    return P.eligible(v.news, "published_at", "2024-01-20")


@query("valid_session", "PRJ5", "ticker:s date:d gap:f rn:i", """
SELECT ticker, date, gap, rn FROM panel
WHERE open > 0 AND volume > 0 AND prev_close > 0 AND gap < 0.295 AND rn > 31""", "panel")
def _(v):
    return P.valid_session(v.panel)


@query("date_range_filter", "PRJ6", "ticker:s date:d close:f", """
SELECT * FROM bars WHERE date >= DATE '1997-03-01' AND date < DATE '1999-06-01'""", "bars")
def _(v):
    return P.date_range(v.bars, "date", "1997-03-01", "1999-06-01")


@query("legal_notice_filter", "PRJ7", "news_id:i", """
SELECT news_id FROM news WHERE NOT regexp_matches(title, '(?i)license|copyright|permission|warrant(y|ies)|all rights reserved')
""", "news")
def _(v):
    # the phrase list is a parameter; these phrases are the ones the given texts contain
    return P.drop_legal_notices(
        v.news, pattern="license|copyright|permission|warrant(y|ies)|all rights reserved")


@query("clock_filter", "PRJ8", "news_id:i published_at:t", """
SELECT news_id, published_at FROM news
WHERE strftime(published_at, '%H:%M:%S') BETWEEN '09:35:00' AND '13:55:00'""", "news")
def _(v):
    return P.clock_between(v.news, "published_at", 9 * 3600 + 35 * 60, 13 * 3600 + 55 * 60)


@query("prefix_columns", "PRJ9", "ticker:s date:d lagret_1:f lagret_2:f lagret_3:f lagret_5:f lagret_10:f", """
SELECT ticker, date, lag(ret, 1) OVER w AS lagret_1, lag(ret, 2) OVER w AS lagret_2,
  lag(ret, 3) OVER w AS lagret_3, lag(ret, 5) OVER w AS lagret_5, lag(ret, 10) OVER w AS lagret_10
FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date)""", "panel")
def _(v):
    return P.columns_with_prefix(W.lagged_returns(v.panel), ("lagret",), ("ticker", "date"))


@query("every_fifth_row", "PRJ10", "ticker:s date:d k:i", """
SELECT ticker, date, rn - 1 AS k FROM panel WHERE (rn - 1) % 5 = 0""", "panel")
def _(v):
    return W.every_hth(v.bars, 5)


@query("gap_neutralised_score", "PRJ11", "ticker:s date:d gap:f score:f", """
SELECT ticker, date, gap, CASE WHEN gap > 0.02 THEN -1.0 ELSE score END AS score FROM scores""", "scores")
def _(v):
    return P.neutralise(v.scores, 0.02)


# ------------------------------------------------------------------ windows

_W = "WINDOW w AS (PARTITION BY ticker ORDER BY date)"


def _prior(k: int) -> str:
    return f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


def _roll(fn: str, col: str, k: int, need: int | None = None) -> str:
    n = k if need is None else need
    return f"CASE WHEN count({col}) OVER {_prior(k)} >= {n} THEN {fn}({col}) OVER {_prior(k)} END"


@query("lag_lead", "WN1", "ticker:s date:d close_lag1:f close_lead1:f", f"""
SELECT ticker, date, lag(close) OVER w AS close_lag1, lead(close) OVER w AS close_lead1 FROM bars {_W}""", "bars")
def _(v):
    return W.shift_lead(v.bars)


@query("lagged_returns", "WN2", "ticker:s date:d lagret_1:f lagret_5:f lagret_10:f", f"""
SELECT ticker, date, lag(ret, 1) OVER w AS lagret_1, lag(ret, 5) OVER w AS lagret_5,
  lag(ret, 10) OVER w AS lagret_10 FROM panel {_W}""", "panel")
def _(v):
    return W.lagged_returns(v.panel)


@query("momentum", "WN3", "ticker:s date:d mom_5:f mom_10:f mom_20:f", f"""
SELECT ticker, date, lag(close, 1) OVER w / lag(close, 6) OVER w - 1 AS mom_5,
  lag(close, 1) OVER w / lag(close, 11) OVER w - 1 AS mom_10,
  lag(close, 1) OVER w / lag(close, 21) OVER w - 1 AS mom_20 FROM bars {_W}""", "bars")
def _(v):
    return W.momentum(v.bars)


@query("rolling_volatility", "WN4", "ticker:s date:d vol_5:f vol_10:f vol_20:f", f"""
SELECT ticker, date, {_roll('stddev_samp', 'ret', 5)} AS vol_5,
  {_roll('stddev_samp', 'ret', 10)} AS vol_10, {_roll('stddev_samp', 'ret', 20)} AS vol_20 FROM panel""", "panel")
def _(v):
    return W.volatility(v.panel)


@query("price_to_average", "WN5", "ticker:s date:d maratio_5:f maratio_20:f", f"""
SELECT ticker, date, prev_close / ({_roll('avg', 'close', 5)}) - 1 AS maratio_5,
  prev_close / ({_roll('avg', 'close', 20)}) - 1 AS maratio_20 FROM panel""", "panel")
def _(v):
    return W.average_ratio(v.panel)


@query("relative_strength", "WN6", "ticker:s date:d rsi:f", f"""
d AS (SELECT ticker, date, greatest(close - prev_close, 0) * 1 AS up, greatest(prev_close - close, 0) AS dn,
      close - prev_close AS diff FROM panel)
---
d2 AS (SELECT ticker, date, CASE WHEN diff IS NOT NULL THEN up END AS up,
       CASE WHEN diff IS NOT NULL THEN dn END AS dn FROM d)
---
SELECT ticker, date, 100 - 100 / (1 + ({_roll('avg', 'up', 14)}) / (({_roll('avg', 'dn', 14)}) + 1e-9)) AS rsi
FROM d2""", "panel")
def _(v):
    return W.relative_strength(v.panel)


@query("range_distance", "WN7", "ticker:s date:d dist_hi:f dist_lo:f", f"""
SELECT ticker, date, prev_close / ({_roll('max', 'close', 20)}) - 1 AS dist_hi,
  prev_close / ({_roll('min', 'close', 20)}) - 1 AS dist_lo FROM panel""", "panel")
def _(v):
    return W.range_distance(v.panel)


@query("volume_score", "WN8", "ticker:s date:d logvol:f volz:f", f"""
SELECT ticker, date, ln(lag(volume) OVER w + 1) AS logvol,
  (lag(volume) OVER w - ({_roll('avg', 'volume', 20)})) / (({_roll('stddev_samp', 'volume', 20)}) + 1e-9) AS volz
FROM panel {_W}""", "panel")
def _(v):
    return W.volume_score(v.panel)


@query("sign_streak", "WN9", "ticker:s date:d streak:f", f"""
s AS (SELECT ticker, date, sign(ret) AS sg FROM panel)
---
SELECT ticker, date, {_roll('sum', 'sg', 3)} AS streak FROM s""", "panel")
def _(v):
    return W.sign_streak(v.panel)


@query("buy_streak", "WN9", "ticker:s date:d streak_5:i streak_10:i", f"""
p AS (SELECT ticker, date, CASE WHEN buy - sell > 0 THEN 1 ELSE 0 END AS pos,
      row_number() OVER w AS rn FROM flows {_W})
---
SELECT ticker, date,
  CASE WHEN rn >= 5 THEN coalesce(sum(pos) OVER {_prior(5)}, 0) END AS streak_5,
  CASE WHEN rn >= 10 THEN coalesce(sum(pos) OVER {_prior(10)}, 0) END AS streak_10 FROM p""", "flows")
def _(v):
    return W.buy_streak(v.flows.withColumn("net", F.col("buy") - F.col("sell")), "net")


@query("flow_features", "WN10 FN8", "ticker:s date:d net_l1:f imb_l1:f net_5:f net_20:f imb_5:f imb_sd5:f", f"""
f AS (SELECT ticker, date, buy - sell AS net, (buy - sell) / (buy + sell + 1) AS imb FROM flows)
---
SELECT ticker, date, lag(net) OVER w AS net_l1, lag(imb) OVER w AS imb_l1,
  {_roll('sum', 'net', 5)} AS net_5, {_roll('sum', 'net', 20)} AS net_20,
  {_roll('avg', 'imb', 5)} AS imb_5, {_roll('stddev_samp', 'imb', 5)} AS imb_sd5 FROM f {_W}""", "flows")
def _(v):
    return W.flow_features(v.flows)


@query("market_lags", "WN11 AG13", "date:d mkt:f mkt_lag1:f mkt_lag2:f mkt_mom5:f", """
m AS (SELECT date, avg(ret) AS mkt FROM panel WHERE ret IS NOT NULL GROUP BY date)
---
SELECT date, mkt, lag(mkt, 1) OVER w AS mkt_lag1, lag(mkt, 2) OVER w AS mkt_lag2,
  CASE WHEN count(mkt) OVER f = 5 THEN avg(mkt) OVER f END AS mkt_mom5
FROM m WINDOW w AS (ORDER BY date), f AS (ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""", "panel")
def _(v):
    return W.market_lags(v.panel)


@query("volatility_target", "WN12", "ticker:s date:d med:f big:b", f"""
a AS (SELECT ticker, date, abs(ret) AS ar FROM panel)
---
m AS (SELECT *, {_roll('median', 'ar', 20)} AS med FROM a)
---
SELECT ticker, date, med, CASE WHEN med IS NOT NULL THEN ar > med END AS big FROM m""", "panel")
def _(v):
    return W.volatility_target(v.panel)


@query("rolling_median_volume", "WN13", "ticker:s date:d vmed:f", """
SELECT ticker, date, CASE WHEN count(volume) OVER f >= 10 THEN median(volume) OVER f END AS vmed
FROM bars WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""", "bars")
def _(v):
    return W.rolling_median_volume(v.bars)


@query("forward_log_return", "WN14", "ticker:s date:d logp:f fwd:f", """
l AS (SELECT ticker, date, CASE WHEN ret IS NOT NULL THEN sum(ln(1 + ret)) OVER
      (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) END AS logp FROM panel)
---
SELECT ticker, date, logp, lead(logp, 5) OVER (PARTITION BY ticker ORDER BY date) - logp AS fwd FROM l""", "panel")
def _(v):
    return W.forward_return(v.panel, 5)


@query("hit_priors", "WN15", "ticker:s date:d u20:f d20:f u120:f d120:f", f"""
h AS (SELECT ticker, date, CASE WHEN high >= open * 1.05::DOUBLE AND open > 0 THEN 1 ELSE 0 END AS up5,
      CASE WHEN low <= open * 0.95::DOUBLE AND open > 0 THEN 1 ELSE 0 END AS dn5 FROM bars)
---
SELECT ticker, date, {_roll('avg', 'up5', 20, 10)} AS u20, {_roll('avg', 'dn5', 20, 10)} AS d20,
  {_roll('avg', 'up5', 120, 40)} AS u120, {_roll('avg', 'dn5', 120, 40)} AS d120 FROM h""", "bars")
def _(v):
    return W.hit_priors(v.bars)


@query("liquidity", "WN16", "ticker:s date:d ln_turn20:f", f"""
t AS (SELECT ticker, date, volume * close AS tv FROM bars)
---
SELECT ticker, date, ln(1 + ({_roll('avg', 'tv', 20, 10)})) AS ln_turn20 FROM t""", "bars")
def _(v):
    return W.liquidity(v.bars).withColumn("ln_turn20", F.log1p("turn20"))


@query("range_features", "WN17", "ticker:s date:d hl20:f std20:f hl_prev:f absr1_prev:f", f"""
r AS (SELECT *, coalesce(ret, 0) AS r1 FROM panel)
---
SELECT ticker, date, avg(hl) OVER {_prior(20)} AS hl20,
  CASE WHEN rn > 3 THEN stddev_pop(r1) OVER {_prior(20)} ELSE 0 END AS std20,
  coalesce(lag(hl) OVER w, 0) AS hl_prev, abs(lag(r1) OVER w) AS absr1_prev FROM r {_W}""", "panel")
def _(v):
    return W.range_features(v.panel)


@query("candle_shape", "WN18", "ticker:s date:d open_pos:f body:f upper:f lower:f", f"""
p AS (SELECT ticker, date, open, lag(open) OVER w AS po, lag(high) OVER w AS ph, lag(low) OVER w AS pl,
      lag(close) OVER w AS pc FROM bars {_W})
---
SELECT ticker, date,
  greatest(least(CASE WHEN ph - pl > 0 THEN (open - pl) / (ph - pl) ELSE 0.5 END, 2.0), -1.0) AS open_pos,
  CASE WHEN po > 0 THEN (pc - po) / po ELSE 0 END AS body,
  CASE WHEN pc > 0 THEN (ph - greatest(po, pc)) / pc ELSE 0 END AS upper,
  CASE WHEN pc > 0 THEN (least(po, pc) - pl) / pc ELSE 0 END AS lower
FROM p WHERE pc IS NOT NULL""", "bars")
def _(v):
    return W.candle_shape(v.bars)


_SERIES = ("r1", "hl", "gap", "vol", "hit")
_AGGS = (("mean", "avg"), ("std", "stddev_pop"), ("max", "max"), ("min", "min"))


@query("price_window_aggregates", "WN19",
       "ticker:s date:d " + " ".join(
           [f"{s}_{a}{k}:f" for s in _SERIES for k in (5, 10, 30) for a, _ in _AGGS]
           + [f"{s}_last:f" for s in _SERIES]), """
m AS (SELECT *, CASE WHEN count(volume) OVER f >= 10 THEN median(volume) OVER f END AS vmed FROM panel
      WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
---
s AS (SELECT ticker, date, rn, coalesce(ret, 0) AS r1, coalesce(hl, 0) AS hl, coalesce(gap, 0) AS gap,
      greatest(least(CASE WHEN volume > 0 AND vmed > 0 THEN ln(volume / vmed) ELSE 0 END, 3), -3) AS vol,
      CASE WHEN high >= open * 1.02 AND open > 0 THEN 1.0 ELSE 0.0 END AS hit FROM m)
---
a AS (SELECT ticker, date, rn, """ + ", ".join(
           [f"{fn}({s}) OVER w{k} AS {s}_{a}{k}" for s in _SERIES for k in (5, 10, 30) for a, fn in _AGGS]
           + [f"lag({s}) OVER w0 AS {s}_last" for s in _SERIES]) + """
  FROM s WINDOW w0 AS (PARTITION BY ticker ORDER BY date),
  w5 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
  w10 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
  w30 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
---
SELECT * FROM a WHERE rn > 30""", "panel")
def _(v):
    return W.price_window_aggregates(v.panel)


@query("expanding_gate", "WN23", "ticker:s date:d tau:f act:b", """
c AS (SELECT ticker, date, abs(score - 0.6::DOUBLE) AS conf FROM scores)
---
g AS (SELECT *, quantile_cont(conf, 0.7) OVER f AS tau, row_number() OVER w > 12 AS ready FROM c
      WINDOW w AS (PARTITION BY ticker ORDER BY date),
      f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
---
SELECT ticker, date, tau, coalesce(ready AND conf >= tau, false) AS act FROM g""", "scores")
def _(v):
    pred = v.scores.withColumn("conf", F.abs(F.col("score") - 0.6))
    return W.expanding_gate(pred, "conf", 0.3, 12)


@query("expanding_double_gate", "WN24", "ticker:s date:d tau:f tau2:f act:b", """
c AS (SELECT ticker, date, abs(score - 0.6::DOUBLE) AS conf, vol FROM scores)
---
g AS (SELECT *, quantile_cont(conf, 0.7) OVER f AS tau, coalesce(quantile_cont(vol, 0.5) OVER f, 0.5) AS tau2,
      row_number() OVER w > 12 AS ready FROM c
      WINDOW w AS (PARTITION BY ticker ORDER BY date),
      f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
---
SELECT ticker, date, tau, tau2, coalesce(ready AND conf >= tau AND coalesce(vol >= tau2, false), false) AS act
FROM g""", "scores")
def _(v):
    pred = v.scores.withColumn("conf", F.abs(F.col("score") - 0.6))
    return W.expanding_gate(pred, "conf", 0.3, 12, second="vol")


@query("equity_curve", "WN25", "ticker:s date:d equity:f peak:f drawdown:f", """
r AS (SELECT ticker, date, coalesce(ret, 0) AS r FROM panel)
---
e AS (SELECT ticker, date, CASE WHEN max(CASE WHEN r <= -1 THEN 1 ELSE 0 END) OVER u = 1 THEN 0
      ELSE exp(sum(CASE WHEN r > -1 THEN ln(1 + r) ELSE 0 END) OVER u) END AS equity FROM r
      WINDOW u AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING))
---
p AS (SELECT *, max(equity) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM e)
---
SELECT ticker, date, equity, peak, equity / peak - 1 AS drawdown FROM p""", "panel")
def _(v):
    return W.equity_curve(v.panel.withColumn("r", F.coalesce("ret", F.lit(0.0))), "r", "ticker")


@query("cumulative_profit", "WN26", "ticker:s date:d running:f", """
SELECT ticker, date, sum(10000 * (close / open - 1)) OVER
  (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS running FROM bars""", "bars")
def _(v):
    return W.cumulative(v.bars.withColumn("pnl", 10000 * (F.col("close") / F.col("open") - 1)), "pnl", "ticker")


@query("session_close", "WN27", "ticker:s day:d last_close:f", """
SELECT ticker, day, arg_max(close, ts) AS last_close FROM bars_intraday GROUP BY 1, 2""", "bars_intraday")
def _(v):
    return W.session_close(v.bars_intraday)


@query("bar_index", "WN28", "ticker:s day:d ts:t bar_ix:i open:f high:f low:f close:f volume:i",
       "SELECT * FROM bars_intraday", "bars_intraday")
def _(v):
    return v.bars_intraday
