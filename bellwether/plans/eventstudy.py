"""Event studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from bellwether.operators import aggregates as A
from bellwether.operators import eventstudy as E
from bellwether.operators.windows import price_panel
from bellwether.plans.registry import query
from bellwether.plans.sessions import _OVERNIGHT, overnight_table

_NB = "scored_news bars_intraday"


@query("forward_return", "EV1 JN6", "horizon:s n:i acc:f corr:g", """
n AS (SELECT * FROM scored_news WHERE abs(sent) > 1e-6)
---
e AS (SELECT n.*, b.ts AS ets, b.close AS epx FROM n ASOF JOIN bars_intraday b ON n.ticker = b.ticker AND n.published_at + INTERVAL 1 SECOND <= b.ts)
---
x AS (SELECT e.*, hz, m, e.published_at + to_minutes(m) AS xt FROM e, (VALUES ('1h', 60), ('2h', 120), ('4h', 240)) AS h(hz, m))
---
r AS (SELECT hz AS horizon, sent, b.close / epx - 1 AS r FROM x ASOF JOIN bars_intraday b ON x.ticker = b.ticker AND x.xt <= b.ts
  WHERE CAST(ets AS DATE) = CAST(xt AS DATE)
  UNION ALL SELECT 'to_close', sent, c.close / epx - 1 FROM e JOIN (SELECT ticker, day, arg_max(close, ts) AS close FROM bars_intraday GROUP BY 1, 2) c
  ON c.ticker = e.ticker AND c.day = CAST(ets AS DATE))
---
SELECT horizon, count(*) AS n, avg(CASE WHEN sign(sent) = sign(r) THEN 1.0 ELSE 0.0 END) AS acc, corr(sent, r) AS corr FROM r GROUP BY 1""", _NB)
def _(v):
    return E.forward_return(v.scored_news, v.bars_intraday, {"1h": 60, "2h": 120, "4h": 240})


@query("before_after", "EV2 JN7", "zone:s n:i corr_before:g corr_after:g", """
n AS (SELECT s.*, zone, published_at + to_hours(hrs) AS t FROM scored_news s, (VALUES ('raw', 0), ('edt', -4), ('est', -5)) AS z(zone, hrs)
  WHERE abs(sent) > 1e-6 AND hour(published_at + to_hours(hrs)) BETWEEN 10 AND 14)
---
k AS (SELECT *, t + INTERVAL 1 SECOND AS t0, t + INTERVAL 60 MINUTE AS t1, t - INTERVAL 60 MINUTE AS tb FROM n)
---
a AS (SELECT k.*, b.close AS p0 FROM k ASOF JOIN bars_intraday b ON k.ticker = b.ticker AND k.t0 <= b.ts)
---
c AS (SELECT a.*, b.close AS pf FROM a ASOF JOIN bars_intraday b ON a.ticker = b.ticker AND a.t1 <= b.ts)
---
d AS (SELECT c.*, b.close AS pb FROM c ASOF JOIN bars_intraday b ON c.ticker = b.ticker AND c.tb >= b.ts)
---
SELECT zone, count(*) AS n, nullif(corr(sent, p0 / pb - 1), 'nan'::DOUBLE) AS corr_before,
  nullif(corr(sent, pf / p0 - 1), 'nan'::DOUBLE) AS corr_after FROM d GROUP BY 1""", _NB)
def _(v):
    return E.before_after(v.scored_news, v.bars_intraday, {"raw": 0, "edt": -4, "est": -5})


_CONTAIN = """
n AS (SELECT * FROM scored_news WHERE strftime(published_at, '%H:%M:%S') BETWEEN '09:35:00' AND '{last}')
---
j AS (SELECT n.*, b.day, b.bar_ix, b.open, b.close, b.ts FROM n ASOF JOIN bars_intraday b ON n.ticker = b.ticker AND n.published_at >= b.ts
  WHERE b.day = CAST(n.published_at AS DATE))
---
"""


@query("bar_window", "EV3 JN8", "bars:i n:i acc:f corr:g pre_acc:f n_strong:i acc_strong:f", _CONTAIN.format(last="13:55:00") + """
r AS (SELECT h AS bars, sent, x.close / j.close - 1 AS fwd, j.close / p.close - 1 AS pre FROM j, (SELECT unnest([1, 2, 4]) AS h)
  LEFT JOIN bars_intraday x ON x.ticker = j.ticker AND x.day = j.day AND x.bar_ix = j.bar_ix + h
  LEFT JOIN bars_intraday p ON p.ticker = j.ticker AND p.day = j.day AND p.bar_ix = j.bar_ix - h)
---
SELECT bars, count(*) AS n, avg(CASE WHEN sign(sent) = sign(fwd) THEN 1.0 ELSE 0.0 END) AS acc, corr(sent, fwd) AS corr,
  avg(CASE WHEN sign(sent) = sign(pre) THEN 1.0 ELSE 0.0 END) AS pre_acc, count(*) FILTER (WHERE abs(sent) >= 0.6) AS n_strong,
  avg(CASE WHEN sign(sent) = sign(fwd) THEN 1.0 ELSE 0.0 END) FILTER (WHERE abs(sent) >= 0.6) AS acc_strong
FROM r WHERE abs(sent) > 1e-6 AND fwd <> 0 GROUP BY bars""", _NB)
def _(v):
    return E.bar_window(v.scored_news, v.bars_intraday, [1, 2, 4])


@query("volume_spike", "EV4 WN13", "bars:i n:i acc:f n_spike:i acc_spike:f", """
vm AS (SELECT *, CASE WHEN count(volume) OVER f >= 12 THEN median(volume) OVER f END AS vmed FROM bars_intraday
  WINDOW f AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 71 PRECEDING AND CURRENT ROW))
---
""" + _CONTAIN.format(last="15:00:00") + """
r AS (SELECT h AS bars, sent, x.close / j.open - 1 AS fwd, coalesce(m.volume > 1.5 * m.vmed, false) AS spike FROM j, (SELECT unnest([0, 2, 5]) AS h)
  JOIN vm m ON m.ticker = j.ticker AND m.ts = j.ts LEFT JOIN bars_intraday x ON x.ticker = j.ticker AND x.day = j.day AND x.bar_ix = j.bar_ix + h)
---
SELECT bars, count(*) AS n, avg(CASE WHEN sign(sent) = sign(fwd) THEN 1.0 ELSE 0.0 END) AS acc, count(*) FILTER (WHERE spike) AS n_spike,
  avg(CASE WHEN sign(sent) = sign(fwd) THEN 1.0 ELSE 0.0 END) FILTER (WHERE spike) AS acc_spike
FROM r WHERE abs(sent) > 1e-6 AND fwd <> 0 GROUP BY bars""", _NB)
def _(v):
    return E.volume_spike(v.scored_news, v.bars_intraday, [0, 2, 5], 72, 12, 1.5)


@query("lead_lag", "EV5", "test:s n:i corr:g acc:f", """
s AS (SELECT ticker, CAST(published_at AS DATE) AS date, avg(sent) AS sent FROM scored_news GROUP BY 1, 2)
---
d AS (SELECT p.ticker, p.date, ret, sent, lag(sent) OVER w AS sp, lead(ret) OVER w AS rn FROM daily_panel p LEFT JOIN s USING (ticker, date)
  WINDOW w AS (PARTITION BY p.ticker ORDER BY p.date))
---
r AS (SELECT 'same_day' AS test, sent AS s, ret AS r FROM d UNION ALL SELECT 'next_day', sent, rn FROM d UNION ALL SELECT 'prev_sent', sp, ret FROM d
  UNION ALL SELECT CASE WHEN abs(ret) < 0.01 THEN 'size_0-1%' WHEN abs(ret) < 0.03 THEN 'size_1-3%' WHEN abs(ret) < 0.06 THEN 'size_3-6%' ELSE 'size_6%+' END,
  sp, sign(ret) FROM d)
---
SELECT test, count(*) AS n, CASE WHEN count(*) > 30 THEN corr(s, r) END AS corr,
  avg(CASE WHEN sign(s) = sign(r) THEN 1.0 ELSE 0.0 END) FILTER (WHERE r <> 0) AS acc FROM r WHERE s IS NOT NULL AND r IS NOT NULL GROUP BY 1""",
       "scored_news daily_panel")
def _(v):
    return E.lead_lag(price_panel(v.daily), A.daily_news_mean(v.scored_news, F.to_date("published_at")))


@query("preopen_test", "EV6", "move:s n:i corr:g acc:f", _OVERNIGHT + """
r AS (SELECT 'open_close' AS move, on_sent, close / open - 1 AS r FROM f WHERE on_cnt > 0 UNION ALL SELECT 'gap', on_sent, gap FROM f WHERE on_cnt > 0)
---
SELECT move, count(*) AS n, corr(on_sent, r) AS corr, avg(CASE WHEN sign(on_sent) = sign(r) THEN 1.0 ELSE 0.0 END) AS acc
FROM r WHERE r IS NOT NULL AND r <> 0 GROUP BY 1""", "scored_news calendar daily_panel")
def _(v):
    return E.preopen_test(overnight_table(v))


@query("magnitude_test", "EV7", "n:i corr_gap:g corr_intraday:g sd_gap:g sd_intraday:g gap_busy:f gap_quiet:f", _OVERNIGHT + """
q AS (SELECT quantile_cont(on_cnt, 0.5) AS q50, quantile_cont(on_cnt, 0.9) AS q90 FROM f WHERE gap IS NOT NULL)
---
SELECT count(*) AS n, corr(on_cnt, abs(gap)) AS corr_gap, corr(on_cnt, abs(close / open - 1)) AS corr_intraday, stddev_samp(gap) AS sd_gap,
  stddev_samp(close / open - 1) AS sd_intraday, avg(abs(gap)) FILTER (WHERE on_cnt >= q90) AS gap_busy,
  avg(abs(gap)) FILTER (WHERE on_cnt <= q50) AS gap_quiet FROM f, q WHERE gap IS NOT NULL""", "scored_news calendar daily_panel")
def _(v):
    return E.magnitude_test(overnight_table(v))


def _flow_sql(c: str) -> str:
    return f"""SELECT '{c}' AS flow, count(*) AS n, avg(CASE WHEN sign({c}) = CASE WHEN ret > 0 THEN 1 ELSE -1 END THEN 1.0 ELSE 0.0 END) AS acc,
  avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE dec = 9) AS up_top, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE dec = 0) AS up_bottom,
  avg(CASE WHEN sign({c}) = CASE WHEN ret > 0 THEN 1 ELSE -1 END THEN 1.0 ELSE 0.0 END) FILTER (WHERE dec IN (0, 9)) AS acc_extreme FROM (
  SELECT *, greatest(ceil((rk - 1) * 10 / (n - 1)), 1) - 1 AS dec FROM (
    SELECT *, row_number() OVER (ORDER BY {c}, ticker, date) AS rk, count(*) OVER () AS n FROM d WHERE {c} IS NOT NULL))"""


@query("flow_event", "EV8 WN22", "flow:s n:i acc:f up_top:f up_bottom:f acc_extreme:f", """
l AS (SELECT ticker, date, lag(buy - sell) OVER w AS f1, CASE WHEN count(*) OVER f = 5 THEN sum(buy - sell) OVER f END AS f5 FROM flows
  WINDOW w AS (PARTITION BY ticker ORDER BY date), f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
---
d AS (SELECT l.*, ret FROM l JOIN panel USING (ticker, date) WHERE ret IS NOT NULL)
---
""" + _flow_sql("f1") + " UNION ALL " + _flow_sql("f5"), "flows panel")
def _(v):
    return E.flow_event(v.flows, v.panel)
