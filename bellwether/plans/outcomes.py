"""Outcome labels, trading rules, equity and parameter grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from bellwether.operators import outcomes as O
from bellwether.operators import projections as P
from bellwether.operators.selection import top_per_day
from bellwether.plans.registry import query

_LABELS = ", ".join(f"high >= open * (1 + {k}::DOUBLE) AND open > 0 AS UP{p}, low <= open * (1 - {k}::DOUBLE) AND open > 0 AS DN{p}"
                    for k, p in ((0.02, 2), (0.03, 3), (0.05, 5)))


@query("hit_labels", "OC1", "ticker:s date:d UP2:b DN2:b UP3:b DN3:b UP5:b DN5:b",
       f"SELECT ticker, date, {_LABELS} FROM bars", "bars")
def _(v):
    return O.hit_labels(v.bars)


_PROFITS = """
pr AS (SELECT *, score AS prob,
  10000 * (CASE WHEN h >= o * (1 + 0.02::DOUBLE) THEN o * (1 + 0.02::DOUBLE) ELSE c END / o - 1) AS lp,
  10000 * (1 - CASE WHEN l <= o * (1 - 0.01::DOUBLE) THEN o * (1 - 0.01::DOUBLE) ELSE c END / o) AS sp FROM scores)
---
"""


def probabilities(v):
    return v.scores.withColumn("prob", F.col("score"))


@query("long_short_pnl", "OC2", "ticker:s date:d side:i profit:f", _PROFITS + """
SELECT ticker, date, CASE WHEN prob > 0.5 THEN 1 ELSE -1 END AS side, CASE WHEN prob > 0.5 THEN lp ELSE sp END AS profit FROM pr""", "scores")
def _(v):
    return O.long_short_pnl(probabilities(v))


@query("banded_pnl", "OC2", "ticker:s date:d side:i profit:f", _PROFITS + """
SELECT ticker, date, CASE WHEN prob > 0.7 THEN 1 WHEN prob < 0.3 THEN -1 ELSE 0 END AS side,
  CASE WHEN prob > 0.7 THEN lp WHEN prob < 0.3 THEN sp ELSE 0 END AS profit FROM pr""", "scores")
def _(v):
    return O.long_short_pnl(probabilities(v), threshold=0.7)


_PICKS = """
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS rk FROM scores
  WHERE score >= 0.6 AND gap <= 0.05) WHERE rk <= 3)
---
"""


def picks(v):
    return top_per_day(v.scores, 3, floor=0.6, gap_cap=0.05)


@query("tp_or_close", "OC3", "ticker:s date:d hit:b eod:f next_open:f strict:f", _PICKS + """
SELECT ticker, date, h >= o * (1 + 0.05::DOUBLE) AS hit,
  CASE WHEN h >= o * (1 + 0.05::DOUBLE) THEN 0.05 ELSE c / o - 1 END - 0.003::DOUBLE AS eod,
  CASE WHEN h >= o * (1 + 0.05::DOUBLE) THEN 0.05 ELSE coalesce(next_o / o - 1, c / o - 1) END - 0.003::DOUBLE AS next_open,
  CASE WHEN h >= o * (1 + 0.05::DOUBLE) * 1.002::DOUBLE THEN 0.05 ELSE c / o - 1 END - 0.003::DOUBLE AS strict FROM pk""", "scores")
def _(v):
    p = O.tp_or_close(picks(v), strict=True).withColumnRenamed("net", "strict")
    p = O.tp_or_close(p, exit_mode="NO").withColumnRenamed("net", "next_open")
    return O.tp_or_close(p).withColumnRenamed("net", "eod")


_STOP = """
ts AS (SELECT *, l <= o * (1 - 0.03::DOUBLE) AS stopped, h >= o * (1 + 0.05::DOUBLE) AND NOT (l <= o * (1 - 0.03::DOUBLE)) AS tp,
  CASE WHEN l <= o * (1 - 0.03::DOUBLE) THEN o * (1 - 0.03::DOUBLE) WHEN h >= o * (1 + 0.05::DOUBLE) THEN o * (1 + 0.05::DOUBLE)
  ELSE c END / o - 1 - 0.003::DOUBLE AS net, l / o - 1 AS mae FROM pk)
---
"""


@query("tp_sl_pessimistic", "OC4", "ticker:s date:d stopped:b tp:b net:f mae:f", _PICKS + _STOP + "SELECT * FROM ts", "scores")
def _(v):
    return O.tp_sl_pessimistic(picks(v))


def _touch_sql(frame: str, keys: str) -> str:
    """From rows with entry bar e, entry price px, target tp and stop sl to outcomes."""
    return f"""
t AS (SELECT {keys}, any_value(e) AS e, any_value(px) AS px, any_value(tp) AS tp, any_value(sl_px) AS sl_px,
  min(bar_ix) FILTER (WHERE bar_ix >= e AND low <= sl_px) AS s, min(bar_ix) FILTER (WHERE bar_ix >= e AND high >= tp) AS t,
  arg_max(close, bar_ix) AS c, max(bar_ix) AS n FROM {frame} GROUP BY ALL)
---
r AS (SELECT *, CASE WHEN e IS NULL THEN 4 WHEN s IS NULL AND t IS NULL THEN 2 WHEN s = t THEN 3
  WHEN t IS NULL OR s < t THEN 0 ELSE 1 END AS reason FROM t)
---
SELECT {keys}, px AS entry_px, reason, CASE reason WHEN 4 THEN 0 WHEN 2 THEN n - e + 1 ELSE least(s, t) - e + 1 END AS bar_hit,
  CASE WHEN reason = 4 THEN 0 ELSE CASE WHEN reason IN (0, 3) THEN sl_px WHEN reason = 1 THEN tp ELSE c END / px - 1 END AS ret_gross FROM r"""


@query("first_touch_intraday", "OC5", "ticker:s day:d sl:f entry_px:f reason:i bar_hit:i ret_gross:f", """
f AS (SELECT *, first_value(open) OVER (PARTITION BY ticker, day ORDER BY bar_ix) AS px, count(*) OVER (PARTITION BY ticker, day) AS k, 1 AS e
  FROM bars_intraday)
---
g AS (SELECT *, px * (1 + 0.05::DOUBLE) AS tp, px * (1 - sl) AS sl_px FROM f, (SELECT unnest([0.02, 0.03, 0.04, 0.05]::DOUBLE[]) AS sl)
  WHERE k >= 2 AND px > 0)
---""" + _touch_sql("g", "ticker, day, sl"), "bars_intraday")
def _(v):
    return O.first_touch_intraday(v.bars_intraday, 0.05, [0.02, 0.03, 0.04, 0.05])


@query("entry_rules", "OC6", "ticker:s day:d rule:s entry_px:f reason:i bar_hit:i ret_gross:f", """
f AS (SELECT *, hour(ts) * 60 + minute(ts) AS m, first_value(open) OVER w AS op, first_value(close) OVER w AS c0,
  min(hour(ts) * 60 + minute(ts)) OVER (PARTITION BY ticker, day) AS m0 FROM bars_intraday WINDOW w AS (PARTITION BY ticker, day ORDER BY bar_ix))
---
g AS (SELECT ticker, day, any_value(op) AS op, any_value(c0) AS c0, max(high) FILTER (WHERE m < m0 + 120) AS rh,
  min(bar_ix) FILTER (WHERE m >= 600) AS de, arg_min(open, bar_ix) FILTER (WHERE m >= 600) AS dp,
  min(bar_ix) FILTER (WHERE low <= op * (1 - 0.01::DOUBLE)) AS di FROM f GROUP BY 1, 2)
---
h AS (SELECT f.ticker, f.day, min(bar_ix) FILTER (WHERE m >= m0 + 120 AND high >= rh) AS ob,
  min(bar_ix) FILTER (WHERE bar_ix >= di AND high >= f.op) AS rc FROM f JOIN g USING (ticker, day) GROUP BY 1, 2)
---
u AS (SELECT ticker, day, unnest([row('open', 1, op), row('firstclose', 1, c0), row('delay', de, dp), row('dip', di, op * (1 - 0.01::DOUBLE)),
  row('orb', ob, rh), row('dipreclaim', rc, op)]) AS x, op FROM g JOIN h USING (ticker, day))
---
q AS (SELECT b.*, x[1] AS rule, x[2] AS e, CASE WHEN x[2] IS NOT NULL THEN x[3] END AS px, op * (1 + 0.05::DOUBLE) AS tp,
  CASE WHEN x[2] IS NOT NULL THEN x[3] END * (1 - 0.03::DOUBLE) AS sl_px FROM bars_intraday b JOIN u USING (ticker, day))
---""" + _touch_sql("q", "ticker, day, rule"), "bars_intraday")
def _(v):
    return O.entry_rules(v.bars_intraday, 0.05, 0.03)


@query("multi_day_exit", "OC7", "ticker:s date:d config:i ret_pess:f ret_opt:f held:i reason:i", """
i AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM scores)
---
cf AS (SELECT * FROM (VALUES (0, -0.03::DOUBLE, 0.05::DOUBLE, NULL::DOUBLE, 5), (1, -0.06::DOUBLE, 0.08::DOUBLE, -0.04::DOUBLE, 8)) AS t(config, sl, tp, trail, hz))
---
p AS (SELECT a.ticker, a.date, a.o AS entry, config, sl, tp, trail, hz, b.rn - a.rn + 1 AS hd, b.o, b.h, b.l, b.c,
  max(b.h) OVER (PARTITION BY a.ticker, a.date, config ORDER BY b.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ph
  FROM i a, cf JOIN i b ON b.ticker = a.ticker AND b.rn BETWEEN a.rn AND a.rn + hz - 1)
---
s AS (SELECT *, CASE WHEN trail IS NULL OR ph IS NULL THEN entry * (1 + sl) ELSE greatest(entry * (1 + sl), ph * (1 + trail)) END AS stop FROM p)
---
x AS (SELECT *, hd > 1 AND o <= stop AS gapped, l <= stop AS st, h >= entry * (1 + tp) AS tt,
  (hd > 1 AND o <= stop) OR l <= stop OR h >= entry * (1 + tp) OR hd >= hz AS done FROM s)
---
f AS (SELECT *, row_number() OVER (PARTITION BY ticker, date, config ORDER BY done DESC, CASE WHEN done THEN hd ELSE -hd END) AS k FROM x)
---
SELECT ticker, date, config, CASE WHEN gapped THEN o WHEN st THEN stop WHEN tt THEN entry * (1 + tp) ELSE c END / entry - 1 AS ret_pess,
  CASE WHEN gapped THEN o WHEN tt THEN entry * (1 + tp) WHEN st THEN stop ELSE c END / entry - 1 AS ret_opt, hd AS held,
  CASE WHEN gapped THEN 0 WHEN st AND tt THEN 3 WHEN st THEN 0 WHEN tt THEN 1 ELSE 2 END AS reason FROM f WHERE k = 1""", "scores")
def _(v):
    return O.multi_day_exit(v.scores, [(-0.03, 0.05, None, 5), (-0.06, 0.08, -0.04, 8)])


_CURVE = """
e AS (SELECT *, exp(sum(ln(1 + r)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS equity FROM dr)
---
eq AS (SELECT *, max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak, equity / max(equity) OVER
  (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM e)
---
"""
_RISK = """
fr AS (SELECT *, greatest(least(0.2, 1.0 - (rk - 1) * 0.2::DOUBLE), 0) AS fraction FROM ts)
---
dr AS (SELECT date, sum(fraction * net) AS r, count(*) AS n FROM fr WHERE fraction > 1e-6 GROUP BY date)
---
""" + _CURVE


@query("risk_sized_equity", "OC8", "date:d n:i r:f equity:f drawdown:f", _PICKS + _STOP + _RISK + "SELECT * FROM eq", "scores")
def _(v):
    return O.risk_sized_equity(O.tp_sl_pessimistic(picks(v)), stop=0.03, risk=0.01, cap=0.2)


_DAILY_SCORES = """
ds AS (SELECT ticker, date, open AS o, high AS h, low AS l, close AS c, gap, phl / (1 + phl) AS score FROM (
  SELECT *, lag(hl) OVER (PARTITION BY ticker ORDER BY date) AS phl FROM daily_panel) WHERE phl IS NOT NULL)
---
"""


def daily_scores(v):
    from pyspark.sql import Window

    from bellwether.operators.windows import price_panel
    w = Window.partitionBy("ticker").orderBy("date")
    p = price_panel(v.daily).withColumn("phl", F.lag("hl").over(w)).filter("phl is not null")
    return p.select("ticker", "date", F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"),
                    F.col("close").alias("c"), "gap", (F.col("phl") / (1 + F.col("phl"))).alias("score"))


@query("equal_slot_equity", "OC9", "date:d r:f equity:f peak:f drawdown:f", _DAILY_SCORES + """
pk AS (SELECT *, CASE WHEN h >= o * (1 + 0.05::DOUBLE) THEN 0.05 ELSE c / o - 1 END - 0.003::DOUBLE AS net FROM (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS rk FROM ds WHERE gap <= 0.02) WHERE rk <= 2)
---
g AS (SELECT date, sum(net) / 2 * 0.5 AS r FROM pk GROUP BY date)
---
sp AS (SELECT CAST(unnest(range(min(date), max(date) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM g)
---
dr AS (SELECT sp.date, coalesce(r, 0) AS r FROM sp LEFT JOIN g USING (date) WHERE isodow(sp.date) < 6)
---""" + _CURVE + "SELECT * FROM eq", "daily_panel")
def _(v):
    p = O.tp_or_close(top_per_day(daily_scores(v), 2, gap_cap=0.02))
    return O.equal_slot_equity(p, 2, 0.5)


@query("performance", "OC10", "n:i win:f profit_factor:f stop_share:f tp_share:f mae_median:f cagr:f sharpe:f mdd:f worst_day:f",
       _PICKS + _STOP + _RISK + """
t AS (SELECT count(*) AS n, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS win,
  sum(greatest(net, 0)) / greatest(-sum(least(net, 0)), 1e-9) AS profit_factor, avg(CASE WHEN stopped THEN 1.0 ELSE 0.0 END) AS stop_share,
  avg(CASE WHEN tp THEN 1.0 ELSE 0.0 END) AS tp_share, median(mae) AS mae_median FROM ts)
---
c AS (SELECT pow(arg_max(equity, date), 1 / greatest((max(date) - min(date)) / 365.25::DOUBLE, 0.1)) - 1 AS cagr,
  CASE WHEN stddev_samp(r) > 1e-9 THEN avg(r) / (stddev_samp(r) + 1e-12) * sqrt(248) END AS sharpe, min(drawdown) AS mdd, min(r) AS worst_day FROM eq)
---
SELECT * FROM t, c""", "scores")
def _(v):
    t = O.tp_sl_pessimistic(picks(v))
    return O.performance(t, O.risk_sized_equity(t, stop=0.03, risk=0.01, cap=0.2))


@query("parameter_grid", "OC11",
       "exit:s k:i floor:f gap_cap:f train_n:i train_hit:f train_ev:f train_sharpe:f test_n:i test_hit:f test_ev:f test_sharpe:f best:b", """
a AS (SELECT * FROM (SELECT s.*, gap_cap, row_number() OVER (PARTITION BY gap_cap, date ORDER BY score DESC, ticker) AS rk
  FROM scores s, (SELECT unnest([0.02, 0.05, 9.9]::DOUBLE[]) AS gap_cap) WHERE gap <= gap_cap) WHERE rk <= 3)
---
b AS (SELECT a.*, x AS exit, k, fl AS floor, CASE WHEN h >= o * (1 + 0.05::DOUBLE) THEN 1 ELSE 0 END AS hit,
  CASE WHEN h >= o * (1 + 0.05::DOUBLE) THEN 0.05 WHEN x = 'NO' THEN coalesce(next_o / o - 1, c / o - 1) ELSE c / o - 1 END - 0.003::DOUBLE AS net,
  CASE WHEN date < DATE '1999-06-01' THEN 'train' ELSE 'test' END AS part
  FROM a, (SELECT unnest(['EOD', 'NO']) AS x), (SELECT unnest([1, 2, 3]) AS k), (SELECT unnest([0.0, 0.65, 0.74]::DOUBLE[]) AS fl)
  WHERE rk <= k AND score >= fl)
---
d AS (SELECT exit, k, floor, gap_cap, part, date, sum(net) / k AS r, count(*) AS n, sum(hit) AS hits, sum(net) AS net FROM b
  GROUP BY exit, k, floor, gap_cap, part, date)
---
m AS (SELECT exit, k, floor, gap_cap, part, sum(n) AS n, sum(hits) / sum(n) AS hit, sum(net) / sum(n) AS ev,
  CASE WHEN stddev_samp(r) > 1e-9 THEN avg(r) / (stddev_samp(r) + 1e-12) * sqrt(248) END AS sharpe FROM d GROUP BY ALL)
---
g AS (SELECT exit, k, floor, gap_cap, """ + ", ".join(
           f"max({c}) FILTER (WHERE part = '{p}') AS {p}_{c}" for p in ("train", "test") for c in ("n", "hit", "ev", "sharpe")) + """
  FROM m GROUP BY ALL)
---
SELECT *, row_number() OVER (ORDER BY CASE WHEN train_n >= 20 THEN round(train_sharpe, 9) END DESC NULLS LAST, exit, k, floor, gap_cap) = 1 AS best FROM g""",
       "scores")
def _(v):
    return O.parameter_grid(v.scores, [1, 2, 3], [0.0, 0.65, 0.74], [0.02, 0.05, 9.9], ["EOD", "NO"], "1999-06-01", 20)


# The swept thresholds, 0.50 to 0.95.
THRESHOLDS = [round(0.5 + 0.01 * i, 2) for i in range(46)]
_SWEEP = _PROFITS + """
sw AS (SELECT CASE WHEN date < DATE '1999-01-01' THEN 'train' WHEN date < DATE '2000-01-01' THEN 'dev' ELSE 'test' END AS split, t AS threshold,
  sum(CASE WHEN prob > t THEN lp WHEN prob < 1 - t THEN sp END) AS profit, count(*) AS trades
  FROM pr, (SELECT unnest([""" + ", ".join(map(str, THRESHOLDS)) + """]::DOUBLE[]) AS t) WHERE prob > t OR prob < 1 - t GROUP BY 1, 2)
---
"""


def sweep(v):
    p = probabilities(v).withColumn("split", P.split_tag("date", "1999-01-01", "2000-01-01"))
    return O.threshold_sweep(p, THRESHOLDS)


@query("threshold_sweep", "OC12", "split:s threshold:f profit:f trades:i", _SWEEP + "SELECT * FROM sw", "scores")
def _(v):
    return sweep(v)


@query("frozen_sweep", "OC12", "threshold:f fit_profit:f test_profit:f test_trades:i", _SWEEP + """
b AS (SELECT threshold, profit FROM sw WHERE split = 'dev' ORDER BY round(profit, 6) DESC, threshold LIMIT 1)
---
SELECT b.threshold, b.profit AS fit_profit, t.profit AS test_profit, t.trades AS test_trades FROM b JOIN sw t ON t.threshold = b.threshold AND split = 'test'""", "scores")
def _(v):
    return O.frozen_sweep(sweep(v))


@query("daily_topk_hit", "OC13", "k:i tp:f hit_rate:f base_rate:f n_days:i n_picks:i", """
d AS (SELECT *, CASE WHEN h >= o * (1 + 0.05::DOUBLE) THEN 1 ELSE 0 END AS hit FROM scores WHERE o > 0 AND h > 0)
---
p AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS rk FROM d)
---
SELECT 1 AS k, 0.05 AS tp, avg(hit) AS hit_rate, (SELECT avg(hit) FROM d) AS base_rate, count(DISTINCT date) AS n_days, count(*) AS n_picks
FROM p WHERE rk <= 1""", "scores")
def _(v):
    return O.daily_topk_hit(v.scores)


@query("gap_cells", "OC14", "gap_lo:f gap_hi:f k:i n:i hit:f ev:f ev_miss:f days:i", """
p AS (SELECT s.*, lo, hi, row_number() OVER (PARTITION BY lo, hi, date ORDER BY score DESC, ticker) AS rk
  FROM scores s, (VALUES (-1.0::DOUBLE, 0.0::DOUBLE), (-1.0, -0.02), (-1.0, -0.04), (-1.0, 9.9)) AS c(lo, hi) WHERE score >= 0.6 AND gap > lo AND gap <= hi)
---
q AS (SELECT p.*, k, h >= o * (1 + 0.05::DOUBLE) AS ht, CASE WHEN h >= o * (1 + 0.05::DOUBLE) THEN 0.05 ELSE c / o - 1 END - 0.003::DOUBLE AS net
  FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE rk <= k)
---
SELECT lo AS gap_lo, hi AS gap_hi, k, count(*) AS n, avg(CASE WHEN ht THEN 1.0 ELSE 0.0 END) AS hit, avg(net) AS ev,
  avg(net) FILTER (WHERE NOT ht) AS ev_miss, count(DISTINCT date) AS days FROM q GROUP BY 1, 2, 3 HAVING count(*) >= 30""", "scores")
def _(v):
    return O.gap_cells(v.scores, [(-1, 0.0), (-1, -0.02), (-1, -0.04), (-1, 9.9)], [1, 2, 3], 0.6)
