"""Calendar, session assignment and news windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from bellwether.functions import vectors as V
from bellwether.operators import aggregates as A
from bellwether.operators import calendar as C
from bellwether.operators import similarity as M
from bellwether.operators import text as T
from bellwether.operators import windows as W
from bellwether.plans.registry import query

DIM = 64  # length of the given embeddings


def day_vectors(v):
    return V.vector_mean(v.vector_news.withColumn("date", F.to_date("published_at")), ["ticker", "date"], "vec", "vec")


def sessioned_vectors(v):
    return C.assign_session(v.vector_scored, v.calendar)


def buckets(s, day: str):
    return V.vector_mean(s.filter(F.col(day).isNotNull()).withColumn("pos", F.col(f"{day}_pos")), ["ticker", "pos"], "vec", "vec")


@query("trading_calendar", "CAL1", "td:d pos:i open_ts:t close_ts:t", "SELECT * FROM calendar", "calendar")
def _(v):
    return v.calendar


_S = "news_id:i ticker:s published_at:t eff:d info:d"


@query("assign_session", "CAL2 CAL3", _S + " fresh:b", "SELECT * FROM sessioned", "sessioned")
def _(v):
    return v.sessioned


@query("session_split", "CAL4", "ticker:s day:d n_session:i n_overnight:i", """
SELECT ticker, info AS day, count(*) FILTER (WHERE in_session) AS n_session,
  count(*) FILTER (WHERE NOT in_session) AS n_overnight FROM sessioned WHERE info IS NOT NULL GROUP BY 1, 2""", "sessioned")
def _(v):
    return v.sessioned.filter("info is not null").groupBy("ticker", F.col("info").alias("day")).agg(
        F.count(F.when(F.col("in_session"), 1)).alias("n_session"),
        F.count(F.when(~F.col("in_session"), 1)).alias("n_overnight"))


_DAYVEC = """
dv AS (SELECT ticker, date, dim, avg(CAST(x AS DOUBLE)) AS x FROM (
  SELECT ticker, CAST(published_at AS DATE) AS date, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM vector_news)
  GROUP BY 1, 2, 3)
---"""


@query("calendar_windows", "CAL5", "ticker:s date:d dim:i n_short:i n_long:i short:f mid:f long:f", _DAYVEC + """
k AS (SELECT ticker, date, prev_date AS a, pp_date AS pp, unnest(range(1, 65)) AS dim FROM daily_panel WHERE pp_date IS NOT NULL)
---
SELECT k.ticker, k.date, k.dim, count(x) FILTER (WHERE d.date > pp) AS n_short, count(x) AS n_long,
  coalesce(avg(x) FILTER (WHERE d.date > pp), 0) AS short,
  coalesce(sum(x * (7 - (a - d.date))) FILTER (WHERE d.date > a - 7), 0) AS mid,
  coalesce(sum(x * (30 - (a - d.date))), 0) AS long
FROM k LEFT JOIN dv d ON d.ticker = k.ticker AND d.dim = k.dim AND d.date BETWEEN k.a - 29 AND k.a
GROUP BY 1, 2, 3""", "vector_news daily_panel")
def _(v):
    # the two sequences are summarised with their slot number as weight, which shows their order
    w = C.calendar_windows(v.daily, day_vectors(v), DIM)
    def slot_sum(seq: str):
        return V.fold_sum(F.transform(F.col(seq), lambda v, i: F.transform(v, lambda x: x * (i + 1))), DIM)

    w = w.withColumns({"mid": slot_sum("mid"), "long": slot_sum("long")})
    return w.select("ticker", "date", "n_short", "n_long",
                    F.posexplode(F.arrays_zip("short", "mid", "long")).alias("p", "z")).select(
        "ticker", "date", "n_short", "n_long", (F.col("p") + 1).alias("dim"), "z.short", "z.mid", "z.long")


_SESSVEC = """
sv AS (SELECT v.*, eff.pos AS eff_pos, info.pos AS info_pos, eff.td = info.td AS fresh, published_at >= info.open_ts AS in_session
  FROM vector_scored v ASOF LEFT JOIN calendar eff ON published_at <= eff.open_ts
  ASOF LEFT JOIN calendar info ON published_at <= info.close_ts)
---
ov AS (SELECT ticker, pos, dim, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT ticker, eff_pos AS pos, unnest(vec) AS x,
  generate_subscripts(vec, 1) AS dim FROM sv WHERE fresh AND eff_pos IS NOT NULL) GROUP BY 1, 2, 3)
---
inf AS (SELECT ticker, pos, dim, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT ticker, info_pos AS pos, unnest(vec) AS x,
  generate_subscripts(vec, 1) AS dim FROM sv WHERE info_pos IS NOT NULL) GROUP BY 1, 2, 3)
---
k AS (SELECT ticker, date, pos, lag(pos) OVER (PARTITION BY ticker ORDER BY date) AS ppos FROM daily JOIN calendar ON td = date)
---
kk AS (SELECT *, unnest(range(1, 65)) AS dim FROM k WHERE ppos IS NOT NULL)
---
sh AS (SELECT kk.ticker, kk.date, kk.dim, avg(x) AS x FROM kk JOIN ov o ON o.ticker = kk.ticker AND o.dim = kk.dim
  AND o.pos > ppos AND o.pos <= kk.pos GROUP BY 1, 2, 3)
---
ml AS (SELECT kk.ticker, kk.date, kk.dim, count(x) FILTER (WHERE i.pos >= kk.pos - 7) AS n_mid, count(x) AS n_long,
  coalesce(sum(x) FILTER (WHERE i.pos >= kk.pos - 7), 0) / 7 AS mid_mean, coalesce(sum(x), 0) / 30 AS long_mean
  FROM kk LEFT JOIN inf i ON i.ticker = kk.ticker AND i.dim = kk.dim AND i.pos BETWEEN kk.pos - 30 AND kk.pos - 1 GROUP BY 1, 2, 3)
---
"""


def session_window_table(v):
    s = sessioned_vectors(v)
    return C.session_windows(v.daily, v.calendar, buckets(s.filter("fresh"), "eff"), buckets(s, "info"), DIM)


@query("session_windows", "CAL6", "ticker:s date:d n_mid:i n_long:i has_short:b has_any:b", _SESSVEC + """
SELECT m.ticker, m.date, n_mid, n_long, s.x IS NOT NULL AS has_short, s.x IS NOT NULL OR n_long > 0 AS has_any
FROM ml m LEFT JOIN sh s USING (ticker, date, dim) WHERE dim = 1""", "vector_scored calendar daily")
def _(v):
    return session_window_table(v)


@query("session_window_means", "CAL7", "ticker:s date:d dim:i short:f mid_mean:f long_mean:f", _SESSVEC + """
SELECT m.ticker, m.date, dim, coalesce(s.x, 0) AS short, mid_mean, long_mean
FROM ml m LEFT JOIN sh s USING (ticker, date, dim)""", "vector_scored calendar daily")
def _(v):
    z = F.posexplode(F.arrays_zip("short", "mid_mean", "long_mean"))
    return session_window_table(v).select("ticker", "date", z.alias("p", "z")).select(
        "ticker", "date", (F.col("p") + 1).alias("dim"), "z.short", "z.mid_mean", "z.long_mean")


@query("event_id_windows", "CAL8 TX6", "ticker:s date:d short_ids:s mid_ids:s", """
ec AS (SELECT key, row_number() OVER (ORDER BY count(*) DESC, key) AS event_id FROM triples
  WHERE CAST(published_at AS DATE) < DATE '2024-01-20' GROUP BY key)
---
ei AS (SELECT e.ticker, CAST(published_at AS DATE) AS date, published_at, news_id, coalesce(event_id, 0) AS event_id
  FROM triples e LEFT JOIN ec USING (key))
---
k AS (SELECT ticker, date, prev_date AS a, pp_date AS pp FROM daily_panel WHERE pp_date IS NOT NULL)
---
s AS (SELECT k.ticker, k.date, list(event_id ORDER BY published_at, news_id) FILTER (WHERE event_id IS NOT NULL) AS ids
  FROM k LEFT JOIN ei e ON e.ticker = k.ticker AND e.date > pp AND e.date <= a GROUP BY 1, 2)
---
kd AS (SELECT ticker, date, a - CAST(unnest(range(0, 7)) AS INTEGER) AS d FROM k)
---
dl AS (SELECT kd.ticker, kd.date, d, list(event_id ORDER BY published_at, news_id) FILTER (WHERE event_id IS NOT NULL) AS ids
  FROM kd LEFT JOIN ei e ON e.ticker = kd.ticker AND e.date = d GROUP BY 1, 2, 3)
---
m AS (SELECT ticker, date, string_agg(array_to_string(list_concat(coalesce(ids, []), [0 for x in range(64)])[1:64], ','), ';' ORDER BY d) AS mid_ids
  FROM dl GROUP BY 1, 2)
---
SELECT ticker, date, array_to_string(list_concat(coalesce(ids, []), [0 for x in range(64)])[1:64], ',') AS short_ids, mid_ids
FROM s JOIN m USING (ticker, date)""", "triples daily_panel")
def _(v):
    vocab = T.event_vocabulary(v.events, F.to_date("published_at") < F.lit("2024-01-20").cast("date"))
    w = C.event_id_windows(v.daily, T.event_ids(v.events, vocab))
    return w.select("ticker", "date", F.array_join(F.col("short_ids").cast("array<string>"), ",").alias("short_ids"),
                    F.array_join(F.transform("mid_ids", lambda x: F.array_join(x.cast("array<string>"), ",")), ";").alias("mid_ids"))


_OVERNIGHT = """
c AS (SELECT td, td + INTERVAL 570 MINUTE AS o, lag(td) OVER (ORDER BY td) + INTERVAL 960 MINUTE AS pc FROM calendar)
---
g AS (SELECT ticker, td AS date, avg(sent) AS s, count(*) AS n FROM scored_news JOIN c ON published_at > pc AND published_at <= o GROUP BY 1, 2)
---
f AS (SELECT d.*, coalesce(s, 0) AS on_sent, coalesce(n, 0) AS on_cnt, ln(1 + coalesce(n, 0)) AS on_ln
  FROM daily_panel d LEFT JOIN g USING (ticker, date))
---
"""


def overnight_table(v):
    cal = C.calendar(v.daily, 570, 960)
    return C.overnight_features(C.decompose_move(W.price_panel(v.daily)), cal, v.scored_news)


@query("overnight_features", "CAL9 JN9", "ticker:s date:d on_sent:f on_cnt:i on_ln:f",
       _OVERNIGHT + "SELECT * FROM f", "scored_news calendar daily_panel")
def _(v):
    return overnight_table(v)


@query("decompose_move", "CAL10", "ticker:s date:d cc:f gap:f oc:f", """
SELECT ticker, date, ret AS cc, gap, close / open - 1 AS oc FROM panel""", "panel")
def _(v):
    return C.decompose_move(v.panel)


@query("news_novelty", "TX14 FN9", "ticker:s news_id:i nov:f n7:i simfrac:f", "SELECT * FROM novelty", "novelty")
def _(v):
    return M.novelty(v.vector_scored)


_BUCKET = """
s AS (SELECT n.*, info.td AS info, eff.td AS eff FROM novelty n
  ASOF LEFT JOIN calendar info ON published_at <= info.close_ts ASOF LEFT JOIN calendar eff ON published_at <= eff.open_ts)
---
b AS (SELECT ticker, info AS date, avg(sent) AS sent_mean, max(abs(sent)) AS sent_absmax, avg(nov) AS nov_mean, max(nov) AS nov_max,
  count(*) AS n, avg(ln(1 + n7)) AS ln_n7, avg(simfrac) AS simfrac, min(sent) AS sent_min, max(sent) AS sent_max
  FROM s WHERE info IS NOT NULL GROUP BY 1, 2)
---
"""


def info_bucket_stats(v):
    s = C.assign_session(M.novelty(v.vector_scored), v.calendar)
    return A.bucket_stats(s.filter("info is not null").withColumn("date", F.col("info")), ["ticker", "date"])


@query("bucket_stats", "AG8",
       "ticker:s date:d sent_mean:f sent_absmax:f nov_mean:f nov_max:f n:i ln_n7:f simfrac:f sent_min:f sent_max:f",
       _BUCKET + "SELECT * FROM b", "novelty calendar")
def _(v):
    return info_bucket_stats(v)


@query("weekday_news_rates", "AG19", "slice:s n:i up5:f dn5:f", _BUCKET + """
h AS (SELECT ticker, date, CASE WHEN high >= open * 1.05::DOUBLE THEN 1 ELSE 0 END AS up5,
  CASE WHEN low <= open * 0.95::DOUBLE THEN 1 ELSE 0 END AS dn5, coalesce(n, 0) AS n, nov_mean FROM daily LEFT JOIN b USING (ticker, date))
---
q AS (SELECT quantile_cont(nov_mean, [0.25, 0.5, 0.75]) AS e FROM h WHERE n > 0)
---
x AS (SELECT 'weekday_' || (isodow(date) - 1) AS slice, up5, dn5 FROM h UNION ALL
  SELECT CASE WHEN n > 0 THEN 'news' ELSE 'no_news' END, up5, dn5 FROM h UNION ALL
  SELECT 'novelty_' || len([y for y in (SELECT e FROM q) if nov_mean >= y]), up5, dn5 FROM h WHERE n > 0)
---
SELECT slice, count(*) AS n, avg(up5) AS up5, avg(dn5) AS dn5 FROM x GROUP BY slice""", "novelty calendar daily")
def _(v):
    d = v.daily.withColumns({"up5": (F.col("high") >= F.col("open") * 1.05).cast("int"),
                             "dn5": (F.col("low") <= F.col("open") * 0.95).cast("int")})
    rows = d.join(info_bucket_stats(v), ["ticker", "date"], "left").fillna(0, ["n"])
    return A.weekday_news_rates(rows)


@query("news_features", "TX15", "ticker:s date:d cnt_short:i cnt_week:i cnt_month:i abn_vol:f sent_short:f sent_week:f novelty:f", """
k AS (SELECT ticker, date, prev_date AS a, pp_date AS pp FROM daily_panel WHERE pp_date IS NOT NULL)
---
j AS (SELECT k.ticker, k.date, v.news_id, v.sent, v.vec, CAST(published_at AS DATE) > pp AS is_s, CAST(published_at AS DATE) > a - 7 AS is_w
  FROM k LEFT JOIN vector_scored v ON v.ticker = k.ticker AND CAST(published_at AS DATE) BETWEEN a - 29 AND a)
---
c AS (SELECT ticker, date, count(news_id) FILTER (WHERE is_s) AS s, count(news_id) FILTER (WHERE is_w) AS w, count(news_id) AS m,
  coalesce(avg(sent) FILTER (WHERE is_s), 0) AS ss, coalesce(avg(sent) FILTER (WHERE is_w), 0) AS ws FROM j GROUP BY 1, 2)
---
e AS (SELECT ticker, date, is_s, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM j WHERE news_id IS NOT NULL)
---
d AS (SELECT ticker, date, dim, sum(CAST(x AS DOUBLE)) FILTER (WHERE is_s) AS xs, sum(CAST(x AS DOUBLE)) AS xm FROM e GROUP BY 1, 2, 3)
---
n AS (SELECT ticker, date, 1 - sum(xs * xm) / (sqrt(sum(xs * xs)) * sqrt(sum(xm * xm)) + 1e-9) AS nov FROM d GROUP BY 1, 2)
---
SELECT ticker, date, s AS cnt_short, w AS cnt_week, m AS cnt_month, s / (m / 30.0::DOUBLE * 2 + 1) AS abn_vol,
  ss AS sent_short, ws AS sent_week, CASE WHEN s > 0 AND m > 0 THEN nov ELSE 0 END AS novelty
FROM c LEFT JOIN n USING (ticker, date)""", "daily_panel vector_scored")
def _(v):
    d = v.vector_scored.withColumn("date", F.to_date("published_at")).groupBy("ticker", "date").agg(
        F.count(F.lit(1)).alias("n"), F.avg("sent").alias("sent"), V.mean_of("vec").alias("vec"))
    return C.news_features(v.daily, d, DIM)
