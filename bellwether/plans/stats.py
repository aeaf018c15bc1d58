"""Resampling, significance tests and threshold choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from bellwether.operators import aggregates as A
from bellwether.operators import outcomes as O
from bellwether.operators import projections as P
from bellwether.operators import stats as S
from bellwether.operators.selection import top_per_day
from bellwether.operators.windows import numbered
from bellwether.plans.outcomes import _PROFITS, probabilities
from bellwether.plans.registry import query

_MIX = "(({b} * 7919 + {i} * 104729 + {seed}) % 2147483647 * 48271) % 2147483647"
_CI = """count(*) AS draws, avg(v) AS mean, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi,
  avg(CASE WHEN v <= 0 THEN 1.0 ELSE 0.0 END) AS p_nonpos"""


def _resample(table: str, draws: int, seed: int) -> str:
    """Rows of ``table`` (numbered by ix from 0) drawn with replacement, per draw b."""
    return f"""SELECT b, t.* FROM (SELECT b, {_MIX.format(b='b', i='ix', seed=seed)} % (SELECT count(*) FROM {table}) AS pick
  FROM {table}, (SELECT unnest(range({draws})) AS b)) JOIN {table} t ON t.ix = pick"""


_PICKS = """
k AS (SELECT *, row_number() OVER (ORDER BY date) AS item FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS rk FROM pr) WHERE rk = 1)
---
"""


@query("randomization_totals", "ST1 JN15", "trial:i total:g", _PROFITS + _PICKS + """
SELECT b AS trial, sum(CASE WHEN """ + _MIX.format(b="b", i="item", seed=13) + """ % 2 = 1 THEN lp ELSE sp END) AS total
FROM k, (SELECT unnest(range(1000)) AS b) GROUP BY b""", "scores")
def _(v):
    return S.randomization_totals(numbered(top_per_day(probabilities(v), 1), [F.asc("date")], "item"), 1000, 13)


@query("randomization_test", "ST1 JN15", "trials:i mean:f sd:g model:f p:f", _PROFITS + """
k AS (SELECT *, row_number() OVER (ORDER BY date) AS item FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS rk FROM pr) WHERE rk = 1)
---
t AS (SELECT b, sum(CASE WHEN """ + _MIX.format(b="b", i="item", seed=13) + """ % 2 = 1 THEN lp ELSE sp END) AS total
  FROM k, (SELECT unnest(range(1000)) AS b) GROUP BY b)
---
m AS (SELECT sum(CASE WHEN prob > 0.5 THEN lp ELSE sp END) AS model FROM k)
---
SELECT count(*) AS trials, avg(total) AS mean, stddev_samp(total) AS sd, max(model) AS model,
  avg(CASE WHEN round(total, 6) >= round(model, 6) THEN 1.0 ELSE 0.0 END) AS p FROM t, m""", "scores")
def _(v):
    # one pick per date, so the series is as long as the calendar
    k = numbered(top_per_day(probabilities(v), 1), [F.asc("date")], "item")
    m = O.long_short_pnl(k).agg(F.sum("profit").alias("model"))
    return S.randomization(k, m, 1000, 13)


@query("bootstrap_trades", "ST2", "stat:s draws:i mean:f lo:f hi:f p_nonpos:f", """
p AS (SELECT date, ticker, CASE WHEN h >= o * (1 + 0.05::DOUBLE) THEN 0.05 ELSE c / o - 1 END - 0.003::DOUBLE AS net,
  row_number() OVER (ORDER BY date, ticker) - 1 AS ix FROM (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS rk FROM scores WHERE gap <= 0.02) WHERE rk <= 3)
---
d AS (""" + _resample("p", 500, 14) + """)
---
g AS (SELECT b, sum(net) AS total, avg(net) AS a, avg(net) / (stddev_pop(net) + 1e-12) * sqrt(248) AS sh FROM d GROUP BY b)
---
l AS (SELECT 'total' AS stat, total AS v FROM g UNION ALL SELECT 'mean', a FROM g UNION ALL SELECT 'sharpe', sh FROM g)
---
SELECT stat, """ + _CI + " FROM l GROUP BY stat", "scores")
def _(v):
    p = O.tp_or_close(top_per_day(v.scores, 3, gap_cap=0.02)).select("date", "ticker", "net")
    return S.bootstrap(p, "net", [F.asc("date"), F.asc("ticker")], 500, 14)


_DATES = """
k AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS ix FROM dy)
---
d AS ("""


@query("cluster_bootstrap_mcc", "ST3", "draws:i mean:f lo:f hi:f p_nonpos:f point:f", """
dy AS (SELECT date, count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp, count(*) FILTER (WHERE y AND NOT p) AS fn,
  count(*) FILTER (WHERE NOT y AND NOT p) AS tn FROM (SELECT date, h >= o * 1.05::DOUBLE AS y, score > 0.7 AS p FROM scores) GROUP BY date)
---""" + _DATES + _resample("k", 2000, 15) + """)
---
s AS (SELECT CAST(b AS VARCHAR) AS b, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM d GROUP BY 1
  UNION ALL SELECT 'point', sum(tp), sum(fp), sum(fn), sum(tn) FROM dy)
---
m AS (SELECT b, CASE WHEN tp + fp = 0 OR tp + fn = 0 OR tn + fp = 0 OR tn + fn = 0 THEN 0 ELSE (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn)
  / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) END AS v FROM s)
---
SELECT """ + _CI + ", (SELECT v FROM m WHERE b = 'point') AS point FROM m WHERE b <> 'point'", "scores")
def _(v):
    return S.cluster_bootstrap_mcc(v.scores, F.col("h") >= F.col("o") * 1.05, F.col("score") > 0.7, 2000, 15)


@query("cluster_bootstrap_rate", "ST4", "draws:i mean:f lo:f hi:f p_nonpos:f point:f", """
dy AS (SELECT date, sum(CASE WHEN score > 0.74 AND h >= o * 1.05::DOUBLE THEN 1 ELSE 0 END) AS num, sum(CASE WHEN score > 0.74 THEN 1 ELSE 0 END) AS den
  FROM scores GROUP BY date)
---""" + _DATES + _resample("k", 2000, 16) + """)
---
m AS (SELECT b, sum(num) / greatest(sum(den), 1) AS v FROM d GROUP BY b)
---
SELECT """ + _CI + ", (SELECT sum(num) / greatest(sum(den), 1) FROM dy) AS point FROM m", "scores")
def _(v):
    return S.cluster_bootstrap_rate(v.scores, F.col("h") >= F.col("o") * 1.05, F.col("score") > 0.74, 2000, 16)


@query("binomial_tail", "ST5 ST6", "date:d n:i hits:i p:f p_adj:f", """
a AS (SELECT avg(CASE WHEN h >= o * 1.05::DOUBLE THEN 1.0 ELSE 0.0 END) AS base, count(DISTINCT date) AS m FROM scores)
---
d AS (SELECT date, count(*) AS n, count(*) FILTER (WHERE h >= o * 1.05::DOUBLE) AS hits FROM scores GROUP BY date)
---
t AS (SELECT date, n, hits, base, m, unnest(range(hits, n + 1)) AS k FROM d, a)
---
s AS (SELECT date, n, hits, m, least(1, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(base) + (n - k) * ln(1 - base)))) AS p
  FROM t GROUP BY 1, 2, 3, 4)
---
SELECT date, n, hits, p, least(1, p * m) AS p_adj FROM s""", "scores")
def _(v):
    from bellwether.operators.ranks import with_scalars
    hit = F.col("h") >= F.col("o") * 1.05
    a = v.scores.agg(A.share(hit).alias("base"), F.count_distinct("date").alias("m"))
    d = v.scores.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(hit, 1)).alias("hits"))
    p = with_scalars(d, a).withColumn("p", S.binomial_tail(F.col("hits"), F.col("n"), F.col("base")))
    return p.withColumn("p_adj", S.bonferroni(F.col("p"), F.col("m")))


@query("stability", "ST7", "chunk:i n:i acc:f mcc:f", """
c AS (SELECT date, ntile(4) OVER (ORDER BY date) AS chunk FROM (SELECT DISTINCT date FROM scores))
---
r AS (SELECT chunk, count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp, count(*) FILTER (WHERE y AND NOT p) AS fn,
  count(*) FILTER (WHERE NOT y AND NOT p) AS tn FROM (SELECT date, h >= o * 1.05::DOUBLE AS y, score > 0.7 AS p FROM scores) JOIN c USING (date) GROUP BY chunk)
---
SELECT chunk, tp + fp + fn + tn AS n, (tp + tn) / (tp + fp + fn + tn) AS acc, CASE WHEN tp + fp = 0 OR tp + fn = 0 OR tn + fp = 0 OR tn + fn = 0 THEN 0
  ELSE (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc FROM r""", "scores")
def _(v):
    return S.stability(v.scores, F.col("h") >= F.col("o") * 1.05, F.col("score") > 0.7)


_GRID = "[" + ", ".join(str(round(0.02 + 0.02 * i, 2)) for i in range(49)) + "]::DOUBLE[]"
_PROBS = "[" + ", ".join(repr(0.5 + (0.995 - 0.5) * i / 79) for i in range(80)) + "]::DOUBLE[]"


def _best(rows: str, keys: str) -> str:
    """Candidates, confusion counts and the best threshold per key (w) of rows (w, s, y)."""
    return f"""
c AS (SELECT w, unnest(list_distinct(list_concat({_GRID}, quantile_cont(s, {_PROBS})))) AS t FROM {rows} GROUP BY w)
---
k AS (SELECT r.w, t, count(*) FILTER (WHERE s >= t AND y) AS tp, count(*) FILTER (WHERE s >= t AND NOT y) AS fp,
  count(*) FILTER (WHERE s < t AND y) AS fn, count(*) FILTER (WHERE s < t AND NOT y) AS tn FROM {rows} r JOIN c ON c.w = r.w GROUP BY 1, 2)
---
m AS (SELECT w, t, CASE WHEN tp + fp = 0 OR tp + fn = 0 OR tn + fp = 0 OR tn + fn = 0 THEN 0 ELSE (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn)
  / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc FROM k WHERE tp + fp > 0 AND fn + tn > 0)
---
b AS (SELECT w, t AS threshold, mcc FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY round(mcc, 9) DESC, t) AS rk FROM m) WHERE rk = 1)
---
"""


@query("best_threshold", "ST8", "threshold:f mcc:f", """
r AS (SELECT 0 AS w, score AS s, h >= o * 1.05::DOUBLE AS y FROM scores WHERE date < DATE '2000-01-01')
---""" + _best("r", "w") + "SELECT threshold, mcc FROM b", "scores")
def _(v):
    d = P.date_range(v.scores, "date", "1900-01-01", "2000-01-01").withColumn("y", F.col("h") >= F.col("o") * 1.05)
    return S.best_threshold(d, "score", "y")


@query("blend_weight", "ST9", "w:f threshold:f mcc:f best:b", """
x AS (SELECT w0 / 10.0::DOUBLE AS w, score, vol / 500.0::DOUBLE AS v2, h >= o * 1.05::DOUBLE AS y FROM scores, (SELECT unnest(range(11)) AS w0) WHERE date < DATE '2000-01-01')
---
r AS (SELECT w, w * score + (1 - w) * v2 AS s, y FROM x)
---""" + _best("r", "w") + "SELECT *, row_number() OVER (ORDER BY round(mcc, 9) DESC, w) = 1 AS best FROM b", "scores")
def _(v):
    d = P.date_range(v.scores, "date", "1900-01-01", "2000-01-01").select(
        "score", (F.col("vol") / 500.0).alias("v2"), (F.col("h") >= F.col("o") * 1.05).alias("y"))
    return S.blend_weight(d, "score", "v2", "y")


@query("tp_fp_profile", "ST10", "grp:s n:i gap:f hl20:f std20:f hl_prev:f", """
r AS (SELECT *, row_number() OVER (ORDER BY hl_prev DESC, ticker, date) AS rk, count(*) OVER () AS nn FROM hit_rows)
---
SELECT CASE WHEN rk > floor(nn * 0.1) THEN 'rest' WHEN up5 = 1 THEN 'tp' ELSE 'fp' END AS grp, count(*) AS n, avg(gap) AS gap, avg(hl20) AS hl20,
  avg(std20) AS std20, avg(hl_prev) AS hl_prev FROM r GROUP BY 1""", "hit_rows")
def _(v):
    return S.tp_fp_profile(A.hit_rows(v.panel), "hl_prev", F.col("up5") == 1, ["gap", "hl20", "std20", "hl_prev"])
