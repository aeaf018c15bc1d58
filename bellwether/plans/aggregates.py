"""Grouped statistics, bins, correlations and classification counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from bellwether.functions import vectors as V
from bellwether.functions.scalar import month_key
from bellwether.operators import aggregates as A
from bellwether.operators import projections as P
from bellwether.operators import ranks as R
from bellwether.operators import windows as W
from bellwether.plans.registry import query
from bellwether.sources.views import TICKERS


def _day():
    return F.to_date("published_at")


@query("daily_news_mean", "AG1", "ticker:s date:d sent:f cnt:i", """
SELECT ticker, CAST(published_at AS DATE) AS date, avg(sent) AS sent, count(*) AS cnt
FROM scored_news GROUP BY 1, 2""", "scored_news")
def _(v):
    return A.daily_news_mean(v.scored_news, _day())


@query("news_stats", "AG2", "n:i tickers:i first_day:d last_day:d tok_mean:f tok_p50:f tok_max:i eligible:f", """
t AS (SELECT doc_id AS news_id, len([x for x in regexp_extract_all(lower(text), '[a-z][a-z0-9''\\-]*') if length(x) >= 2]) AS n_tok FROM documents)
---
SELECT count(*) AS n, count(DISTINCT ticker) AS tickers, min(published_at) AS first_day, max(published_at) AS last_day,
  avg(n_tok) AS tok_mean, median(n_tok) AS tok_p50, max(n_tok) AS tok_max,
  avg(CASE WHEN CAST(published_at AS DATE) < DATE '2024-01-20' THEN 1.0 ELSE 0.0 END) AS eligible
FROM news JOIN t USING (news_id)""", "news")
def _(v):
    return A.news_stats(v.news, v.titles_tokens, "2024-01-20")


@query("news_per_ticker", "AG2", "ticker:s n:i", "SELECT ticker, count(*) AS n FROM news GROUP BY 1", "news")
def _(v):
    return v.news.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query("split_stats", "AG3", "split:s days:i first_day:d last_day:d up_rate:f ret_std:g", """
SELECT CASE WHEN date < DATE '1999-01-01' THEN 'train' WHEN date < DATE '2000-01-01' THEN 'dev' ELSE 'test' END AS split,
  count(*) AS days, min(date) AS first_day, max(date) AS last_day,
  avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS up_rate, stddev_samp(ret) AS ret_std
FROM panel WHERE ret IS NOT NULL AND ret <> 0 GROUP BY 1""", "panel")
def _(v):
    return A.split_stats(P.direction_label(v.panel).withColumn(
        "split", P.split_tag("date", "1999-01-01", "2000-01-01")))


@query("vector_mean", "AG5", "ticker:s date:d dim:i val:f", """
e AS (SELECT ticker, CAST(published_at AS DATE) AS date, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM vector_news)
---
SELECT ticker, date, dim, avg(CAST(x AS DOUBLE)) AS val FROM e GROUP BY 1, 2, 3""", "vector_news")
def _(v):
    m = V.vector_mean(v.vector_news.withColumn("date", _day()), ["ticker", "date"], "vec", "m")
    return m.select("ticker", "date", F.posexplode("m").alias("p", "val")).withColumn("dim", F.col("p") + 1)


@query("token_pooled_vector_mean", "AG6", "ticker:s date:d dim:i val:f", """
t AS (SELECT n.ticker, CAST(n.published_at AS DATE) AS date, form FROM tokens JOIN news n USING (news_id))
---
c AS (SELECT ticker, date, form, count(*) AS w FROM t GROUP BY ALL)
---
e AS (SELECT ticker, date, w, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM c JOIN words USING (form))
---
SELECT ticker, date, dim, sum(CAST(x AS DOUBLE) * w) / sum(w) AS val FROM e GROUP BY 1, 2, 3""", "news tokens words")
def _(v):
    t = v.news_tokens.select("ticker", _day().alias("date"), F.explode("toks").alias("form"))
    m = A.token_vector_mean(t, v.words, ["ticker", "date"])
    return m.select("ticker", "date", F.posexplode("vec").alias("p", "val")).withColumn("dim", F.col("p") + 1)


@query("weighted_sentiment", "AG7 JN3", "ticker:s wmean:f weight:i", """
d AS (SELECT ticker, CAST(published_at AS DATE) AS date, avg(coalesce(sent, 0)) AS sent, count(*) AS cnt FROM scored_news GROUP BY 1, 2)
---
SELECT ticker, sum(sent * cnt) / nullif(sum(cnt), 0) AS wmean, sum(cnt) AS weight FROM d GROUP BY 1""", "scored_news")
def _(v):
    d = A.daily_news_mean(v.scored_news.fillna(0.0, ["sent"]), _day())
    return A.weighted_mean(d, ["ticker"], "sent", "cnt")


@query("weighted_vector_mean", "AG7", "ticker:s dim:i val:f", """
d AS (SELECT ticker, CAST(published_at AS DATE) AS date, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim, news_id FROM vector_news)
---
m AS (SELECT ticker, date, dim, avg(CAST(x AS DOUBLE)) AS x, count(*) AS w FROM d GROUP BY 1, 2, 3)
---
SELECT ticker, dim, sum(x * w) / sum(w) AS val FROM m GROUP BY 1, 2""", "vector_news")
def _(v):
    d = v.vector_news.withColumn("date", _day()).groupBy("ticker", "date").agg(
        V.mean_of("vec").alias("m"), F.count(F.lit(1)).alias("w"))
    r = V.vector_mean(d, ["ticker"], "m", "r", weight="w")
    return r.select("ticker", F.posexplode("r").alias("p", "val")).withColumn("dim", F.col("p") + 1)


@query("joined_day_text", "AG9", "ticker:s date:d part:i n:i chars:i digest:s", f"""
r AS (SELECT *, CAST(published_at AS DATE) AS date, CAST(coalesce(sum(length(title) + 3) OVER (PARTITION BY ticker, CAST(published_at AS DATE)
      ORDER BY published_at, news_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // {A.DAY_TEXT_CHARS} AS part FROM news)
---
j AS (SELECT ticker, date, part, count(*) AS n, string_agg(title, ' . ' ORDER BY published_at, news_id) AS doc FROM r GROUP BY ALL)
---
SELECT ticker, date, part, n, length(doc) AS chars, md5(doc) AS digest FROM j""", "news")
def _(v):
    return A.joined_text(v.news, _day()).withColumns(
        {"chars": F.char_length("doc_text"), "digest": F.md5("doc_text")})


@query("small_cap_flag", "AG10", "ticker:s medcap:f small:b", """
m AS (SELECT ticker, median(market_cap) AS medcap FROM caps GROUP BY 1)
---
SELECT ticker, medcap, medcap <= (SELECT median(medcap) FROM m) AS small FROM m""", "caps")
def _(v):
    return A.small_caps(v.caps)


@query("point_in_time_small_cap", "AG11", "ticker:s month:s small:b", """
s AS (SELECT ticker, median(market_cap / close) AS shares FROM caps JOIN bars USING (ticker, date)
      WHERE market_cap > 0 AND close > 0 GROUP BY 1)
---
m AS (SELECT ticker, strftime(date, '%Y-%m') AS month, median(close * shares) AS pcap
      FROM bars JOIN s USING (ticker) GROUP BY 1, 2)
---
SELECT ticker, month, pcap <= median(pcap) OVER (PARTITION BY month) AS small FROM m""", "bars caps")
def _(v):
    return A.point_in_time_small(v.bars, v.caps)


@query("peer_pivot", "AG12", "date:d click:f error:f purchase:f signup:f view:f", """
SELECT date, """ + ", ".join(f"avg(close) FILTER (WHERE ticker = '{t}') AS {t}" for t in TICKERS) + """
FROM daily GROUP BY date""", "daily")
def _(v):
    return A.pivot_mean(v.daily, "date", "ticker", TICKERS, "close")


@query("market_day_context", "AG14", "date:d u:f d:f mv:f mg:f mr:f fg:f", """
SELECT date, avg(up5) AS u, avg(dn5) AS d, avg(hl20) AS mv, avg(gap) AS mg, avg(absr1_prev) AS mr,
  avg(CASE WHEN abs(gap) > 0.02 THEN 1.0 ELSE 0.0 END) AS fg FROM hit_rows GROUP BY date""", "hit_rows")
def _(v):
    return A.market_day_context(A.hit_rows(v.panel))


@query("market_context_lags", "WN20", "date:d ur1:f dr1:f ur5:f dr5:f breadth1:f mvol1:f mret1:f mgap_t:f fgap2_t:f", """
m AS (SELECT date, avg(up5) AS u, avg(dn5) AS d, avg(hl20) AS mv, avg(gap) AS mg, avg(absr1_prev) AS mr,
  avg(CASE WHEN abs(gap) > 0.02 THEN 1.0 ELSE 0.0 END) AS fg FROM hit_rows GROUP BY date)
---
SELECT date, coalesce(lag(u) OVER w, 0) AS ur1, coalesce(lag(d) OVER w, 0) AS dr1,
  coalesce(CASE WHEN count(u) OVER f >= 2 THEN avg(u) OVER f END, 0) AS ur5,
  coalesce(CASE WHEN count(d) OVER f >= 2 THEN avg(d) OVER f END, 0) AS dr5,
  coalesce(avg(u) OVER b, 0) AS breadth1, coalesce(lag(mv) OVER w, 0) AS mvol1,
  coalesce(lag(mr) OVER w, 0) AS mret1, mg AS mgap_t, fg AS fgap2_t
FROM m WINDOW w AS (ORDER BY date), f AS (ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
  b AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""", "hit_rows")
def _(v):
    return W.market_context(A.market_day_context(A.hit_rows(v.panel)))


@query("excess_return", "AG15", "ticker:s date:d mkt:f excess:f", """
SELECT ticker, date, avg(ret) OVER (PARTITION BY date) AS mkt, ret - avg(ret) OVER (PARTITION BY date) AS excess
FROM panel""", "panel")
def _(v):
    return A.excess_return(v.panel)


@query("period_tables", "AG16", "period:s n:i mean:f total:f", """
d AS (SELECT date, avg(close / open - 1) AS r FROM bars GROUP BY date)
---
n AS (SELECT *, row_number() OVER (ORDER BY date) AS rn, count(*) OVER () AS nn FROM d)
---
p AS (SELECT r, unnest([CAST(year(date) AS VARCHAR), CASE WHEN rn <= nn // 2 THEN 'first_half' ELSE 'second_half' END,
      year(date) || 'Q' || quarter(date)]) AS period FROM n)
---
SELECT period, count(*) AS n, avg(r) AS mean, sum(r) AS total FROM p GROUP BY period""", "bars")
def _(v):
    d = v.bars.groupBy("date").agg(F.avg(F.col("close") / F.col("open") - 1).alias("r"))
    return A.period_tables(d, "r")


@query("gap_bins", "AG17", "bin:s digit:i n:i mean_score:f", """
b AS (SELECT CASE WHEN gap > -1 AND gap <= -0.02 THEN '<-2%' WHEN gap > -0.02 AND gap <= 0 THEN '-2..0'
      WHEN gap > 0 AND gap <= 0.02 THEN '0..2%' WHEN gap > 0.02 AND gap <= 0.05 THEN '2..5%'
      WHEN gap > 0.05 AND gap <= 1 THEN '>5%' END AS bin,
      CASE WHEN gap >= 0.02 THEN 3 WHEN gap >= 0 THEN 2 WHEN gap >= -0.02 THEN 1 ELSE 0 END AS digit, score FROM scores)
---
SELECT bin, digit, count(*) AS n, avg(score) AS mean_score FROM b GROUP BY 1, 2""", "scores")
def _(v):
    b = v.scores.withColumns({
        "bin": A.cut("gap", [-1, -0.02, 0.0, 0.02, 0.05, 1], ["<-2%", "-2..0", "0..2%", "2..5%", ">5%"]),
        "digit": A.digitize("gap", [-0.02, 0.0, 0.02])})
    return b.groupBy("bin", "digit").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))


@query("conditional_rates", "AG18", "gb:i vq:i n:i up5:f dn5:f", """
q AS (SELECT quantile_cont(std20, [0.2, 0.4, 0.6, 0.8]) AS e FROM hit_rows)
---
b AS (SELECT CASE WHEN gap >= 0.02 THEN 3 WHEN gap >= 0 THEN 2 WHEN gap >= -0.02 THEN 1 ELSE 0 END AS gb,
      len([x for x in (SELECT e FROM q) if std20 >= x]) AS vq, up5, dn5 FROM hit_rows)
---
SELECT gb, vq, count(*) AS n, avg(up5) AS up5, avg(dn5) AS dn5 FROM b GROUP BY 1, 2 HAVING count(*) > 50""", "hit_rows")
def _(v):
    return A.conditional_rates(A.hit_rows(v.panel))


@query("exact_quantiles", "AG20", "prob:f q:f", """
SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS prob,
  unnest((SELECT quantile_cont(ret, [0.05, 0.25, 0.5, 0.75, 0.95]) FROM panel)) AS q""", "panel")
def _(v):
    return R.exact_quantiles(v.panel, "ret", [0.05, 0.25, 0.5, 0.75, 0.95])


@query("exact_quantiles_by_month", "AG20", "month:s prob:f q:f", """
m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, quantile_cont(o_totalprice, [0.1, 0.9]) AS q FROM orders GROUP BY 1)
---
SELECT month, unnest([0.1, 0.9]) AS prob, unnest(q) AS q FROM m""")
def _(v):
    o = v.table("orders").select(month_key("o_orderdate").alias("month"), "o_totalprice")
    return R.exact_quantiles(o, "o_totalprice", [0.1, 0.9], by=["month"])


@query("guarded_correlation", "AG21", "date:d corr:g", """
SELECT date, CASE WHEN count(*) FILTER (WHERE gap IS NOT NULL AND ret IS NOT NULL) > 30
  THEN corr(gap, ret) END AS corr FROM panel GROUP BY date""", "panel")
def _(v):
    return v.panel.groupBy("date").agg(A.guarded_corr("gap", "ret", 30).alias("corr"))


@query("rank_correlation", "AG22", "n:i ic:f", """
r AS (SELECT row_number() OVER (ORDER BY score, ticker, date) AS ra,
      row_number() OVER (ORDER BY c / o - 1, ticker, date) AS rb FROM scores)
---
SELECT count(*) AS n, corr(ra, rb) AS ic FROM r""", "scores")
def _(v):
    s = v.scores.withColumn("oc", F.col("c") / F.col("o") - 1)
    return R.rank_correlation(s, "score", "oc", ["ticker", "date"])


@query("rate_autocorrelation", "AG23", "n:i autocorr:f", """
m AS (SELECT date, avg(up5) AS u FROM hit_rows GROUP BY date)
---
p AS (SELECT u, lag(u) OVER (ORDER BY date) AS pu FROM m)
---
SELECT count(*) AS n, corr(pu, u) AS autocorr FROM p WHERE pu IS NOT NULL""", "hit_rows")
def _(v):
    return A.autocorrelation(A.market_day_context(A.hit_rows(v.panel)), "u")


_CONF = """
c AS (SELECT k, count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp,
      count(*) FILTER (WHERE y AND NOT p) AS fn, count(*) FILTER (WHERE NOT y AND NOT p) AS tn FROM r GROUP BY k)
---
SELECT k AS month, tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn) AS acc,
  greatest((tp + fn) / (tp + fp + fn + tn), 1 - (tp + fn) / (tp + fp + fn + tn)) AS base,
  CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn)
    / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END AS mcc FROM c"""


@query("confusion_counts", "AG24", "month:s tp:i fp:i fn:i tn:i acc:f base:f mcc:f", """
r AS (SELECT strftime(date, '%Y-%m') AS k, h >= o * 1.05::DOUBLE AS y, score > 0.7 AS p FROM scores)
---""" + _CONF, "scores")
def _(v):
    s = v.scores.withColumn("month", month_key("date"))
    return A.confusion(s, F.col("h") >= F.col("o") * 1.05, F.col("score") > 0.7, ["month"])


@query("average_precision", "AG25", "ap:f n:i positives:i", """
g AS (SELECT score, count(*) AS n, count(*) FILTER (WHERE h >= o * 1.05::DOUBLE) AS h FROM scores GROUP BY score)
---
c AS (SELECT n, h, sum(n) OVER w AS cn, sum(h) OVER w AS ch FROM g WINDOW w AS (ORDER BY score DESC))
---
SELECT sum(h * ch / cn) / sum(h) AS ap, sum(n) AS n, sum(h) AS positives FROM c""", "scores")
def _(v):
    return R.average_precision(v.scores.withColumn("y", F.col("h") >= F.col("o") * 1.05), "score", "y")


@query("exceedance_rates", "AG26", "UP2:f DN2:f UP3:f DN3:f UP5:f DN5:f", "SELECT " + ", ".join(
    f"avg(CASE WHEN high >= open * (1 + {k}::DOUBLE) THEN 1.0 ELSE 0.0 END) AS UP{p}, "
    f"avg(CASE WHEN low <= open * (1 - {k}::DOUBLE) THEN 1.0 ELSE 0.0 END) AS DN{p}"
    for k, p in ((0.02, 2), (0.03, 3), (0.05, 5))) + " FROM bars WHERE open > 0 AND high > 0 AND low > 0", "bars")
def _(v):
    return A.exceedance_rates(v.bars)


@query("hit_cooccurrence", "AG27", "p_up:f p_dn:f p_both:f p_both_given_up:f", """
SELECT avg(up5) AS p_up, avg(dn5) AS p_dn, avg(up5 * dn5) AS p_both,
  avg(CASE WHEN up5 = 1 THEN up5 * dn5 END) AS p_both_given_up FROM hit_rows""", "hit_rows")
def _(v):
    return A.cooccurrence(A.hit_rows(v.panel))


@query("monthly_news_counts", "AG28", "month:s ticker:s n:i", """
SELECT strftime(published_at, '%Y-%m') AS month, ticker, count(*) AS n FROM news GROUP BY 1, 2""", "news")
def _(v):
    return A.monthly_counts(v.news)


@query("title_length_histogram", "AG28", "bin:i n:i", """
t AS (SELECT len([x for x in regexp_extract_all(lower(text), '[a-z][a-z0-9''\\-]*') if length(x) >= 2]) AS k FROM documents)
---
SELECT k // 50 * 50 AS bin, count(*) AS n FROM t GROUP BY 1""")
def _(v):
    return A.length_histogram(v.titles_tokens)


@query("timestamp_granularity", "AG29", "probe:s n:i share:f", """
p AS (SELECT unnest([row('second_zero', CASE WHEN second(published_at) = 0 THEN 1 ELSE 0 END),
  row('minute_fifth', CASE WHEN minute(published_at) % 5 = 0 THEN 1 ELSE 0 END),
  row('hour_' || hour(published_at), 1), row('minute_' || minute(published_at), 1),
  row('weekday_' || (isodow(published_at) - 1), 1)]) AS x FROM news)
---
SELECT x[1] AS probe, count(*) AS n, avg(x[2]) AS share FROM p GROUP BY 1""", "news")
def _(v):
    return A.granularity(v.news)


@query("noise_floor", "AG30", "threshold:f share:f", """
SELECT t AS threshold, avg(CASE WHEN abs(ret) < t THEN 1.0 ELSE 0.0 END) AS share
FROM panel, (SELECT unnest([0.005, 0.01, 0.02, 0.03, 0.1]::DOUBLE[]) AS t) WHERE ret IS NOT NULL GROUP BY t""", "panel")
def _(v):
    return A.noise_floor(v.panel)


@query("random_rows", "AG31", "news_id:i", """
SELECT news_id FROM news
ORDER BY ((7919 + news_id * 104729 + 13) % 2147483647 * 48271) % 2147483647, news_id LIMIT 100""", "news")
def _(v):
    return A.random_rows(v.news.select("news_id"), "news_id", 100, 13)


@query("ticker_persistence", "JN14 ST10", "tickers:i corr_up:f corr_dn:f", """
g AS (SELECT ticker, avg(up5) FILTER (WHERE date < DATE '2000-01-01') AS ua, avg(up5) FILTER (WHERE date >= DATE '2000-01-01') AS ub,
  avg(dn5) FILTER (WHERE date < DATE '2000-01-01') AS da, avg(dn5) FILTER (WHERE date >= DATE '2000-01-01') AS db,
  count(*) AS n FROM hit_rows GROUP BY ticker)
---
SELECT count(*) AS tickers, corr(ua, ub) AS corr_up, corr(da, db) AS corr_dn
FROM g WHERE n > 20 AND ua IS NOT NULL AND ub IS NOT NULL""", "hit_rows")
def _(v):
    return A.persistence(A.hit_rows(v.panel), "2000-01-01", 20)
