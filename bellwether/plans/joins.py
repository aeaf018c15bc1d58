"""Joins, as-of lookups, set operations, ranking and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from bellwether.functions import vectors as V
from bellwether.operators import aggregates as A
from bellwether.operators import joins as J
from bellwether.operators import ranks as R
from bellwether.operators import selection as S
from bellwether.operators import similarity as M
from bellwether.plans.registry import query

# ------------------------------------------------------------------ joins


@query("bars_with_flows", "JN1", "ticker:s date:d close:f buy:f market_cap:f", """
SELECT b.ticker, b.date, close, buy, market_cap FROM bars b LEFT JOIN flows USING (ticker, date)
LEFT JOIN caps USING (ticker, date)""", "bars flows caps")
def _(v):
    return v.bars.join(v.flows, ["ticker", "date"], "left").join(v.caps, ["ticker", "date"], "left")


@query("scores_with_caps", "JN2", "ticker:s date:d score:f market_cap:f", """
SELECT ticker, date, score, market_cap FROM scores JOIN caps USING (ticker, date)""", "scores caps")
def _(v):
    return v.scores.join(v.caps, ["ticker", "date"], "inner")


@query("sentiment_lookup", "JN3", "news_id:i sent:f", """
SELECT n.news_id, coalesce(sent, 0) AS sent FROM news n LEFT JOIN sentiment USING (news_id)""", "news sentiment")
def _(v):
    return J.enrich(v.news.select("news_id"), v.sentiment, ["news_id"], "sent", 0.0)


@query("news_with_vectors", "JN4", "news_id:i ticker:s", """
SELECT news_id, ticker FROM news WHERE news_id IN (SELECT news_id FROM news_vec)""", "news news_vec")
def _(v):
    return v.news.select("news_id", "ticker").join(v.news_vec.select("news_id"), "news_id", "left_semi")


@query("news_without_sentiment", "JN5", "news_id:i ticker:s", """
SELECT news_id, ticker FROM news WHERE news_id NOT IN (SELECT news_id FROM sentiment)""", "news sentiment")
def _(v):
    return v.news.select("news_id", "ticker").join(v.sentiment.select("news_id"), "news_id", "left_anti")


@query("asof_forward", "JN6", "news_id:i ticker:s bar_ts:t bar_close:f", """
SELECT n.news_id, n.ticker, b.ts AS bar_ts, b.close AS bar_close FROM news n
ASOF LEFT JOIN bars_intraday b ON n.ticker = b.ticker AND n.published_at + INTERVAL 1 SECOND <= b.ts""",
       "news bars_intraday")
def _(v):
    n = v.news.select("news_id", "ticker", (F.col("published_at") + F.expr("interval 1 second")).alias("t"))
    return J.asof_join(n, v.bars_intraday, "t", "ts", ["close"], "forward", prefix="bar_")


@query("asof_backward", "JN7", "news_id:i ticker:s bar_ts:t bar_close:f", """
SELECT n.news_id, n.ticker, b.ts AS bar_ts, b.close AS bar_close FROM news n
ASOF LEFT JOIN bars_intraday b ON n.ticker = b.ticker AND n.published_at >= b.ts""", "news bars_intraday")
def _(v):
    n = v.news.select("news_id", "ticker", "published_at")
    return J.asof_join(n, v.bars_intraday, "published_at", "ts", ["close"], "backward", prefix="bar_")


@query("bar_offsets", "JN8", "ticker:s day:d bar_ix:i close_p1:f close_p3:f close_m2:f", """
SELECT b.ticker, b.day, b.bar_ix, p1.close AS close_p1, p3.close AS close_p3, m2.close AS close_m2 FROM bars_intraday b
LEFT JOIN bars_intraday p1 ON p1.ticker = b.ticker AND p1.day = b.day AND p1.bar_ix = b.bar_ix + 1
LEFT JOIN bars_intraday p3 ON p3.ticker = b.ticker AND p3.day = b.day AND p3.bar_ix = b.bar_ix + 3
LEFT JOIN bars_intraday m2 ON m2.ticker = b.ticker AND m2.day = b.day AND m2.bar_ix = b.bar_ix - 2""", "bars_intraday")
def _(v):
    return J.bar_offsets(v.bars_intraday, [1, 3, -2])


@query("prior_week_counts", "JN10", "ticker:s news_id:i n7:i", """
SELECT a.ticker, a.news_id, count(b.news_id) AS n7 FROM news a LEFT JOIN news b
ON a.ticker = b.ticker AND b.published_at >= a.published_at - INTERVAL 7 DAY
AND (b.published_at < a.published_at OR (b.published_at = a.published_at AND b.news_id < a.news_id))
GROUP BY 1, 2""", "news")
def _(v):
    return J.prior_week_counts(v.news.select("news_id", "ticker", "published_at"))


@query("alignment_report", "JN12", "matched:i left_only:i right_only:i differ:i", """
SELECT count(*) FILTER (WHERE a.news_id IS NOT NULL AND b.news_id IS NOT NULL) AS matched,
  count(*) FILTER (WHERE b.news_id IS NULL) AS left_only, count(*) FILTER (WHERE a.news_id IS NULL) AS right_only,
  count(*) FILTER (WHERE a.q <> b.q) AS differ
FROM (SELECT doc_id AS news_id, quality AS q FROM labels) a
FULL JOIN (SELECT vec_id AS news_id, label AS q FROM embeddings) b USING (news_id)""")
def _(v):
    a = v.table("labels").select(F.col("doc_id").alias("news_id"), F.col("quality").alias("q"))
    b = v.table("embeddings").select(F.col("vec_id").alias("news_id"), F.col("label").alias("q"))
    return J.alignment_report(a, b, ["news_id"], "q")


@query("calendar_fill", "JN13", "ticker:s date:d sent:f", """
d AS (SELECT ticker, CAST(published_at AS DATE) AS date, avg(sent) AS sent FROM scored_news WHERE sent IS NOT NULL GROUP BY 1, 2)
---
s AS (SELECT ticker, CAST(unnest(range(min(date), max(date) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM d GROUP BY ticker)
---
SELECT s.ticker, s.date, coalesce(sent, 0) AS sent FROM s LEFT JOIN d USING (ticker, date) WHERE isodow(s.date) < 6""", "scored_news")
def _(v):
    d = A.daily_news_mean(v.scored_news.filter("sent is not null"), F.to_date("published_at"))
    return J.calendar_fill(d, "ticker", "sent")


@query("resampling_trials", "JN15", "ticker:s trials:i checksum:i", """
SELECT ticker, count(*) AS trials, sum(t) AS checksum FROM daily, (SELECT unnest(range(100)) AS t) GROUP BY ticker""", "daily")
def _(v):
    return J.trials(v.daily, 100).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("trials"), F.sum("trial").alias("checksum"))


# ------------------------------------------------------------------ set operations


@query("union_of_sources", "SET1", "source:s n:i chars:i", """
SELECT source, count(*) AS n, sum(length(text)) AS chars FROM (
  SELECT 'documents' AS source, text FROM documents UNION ALL SELECT 'conversations', text FROM conversations
  UNION ALL SELECT 'benchmark', text FROM benchmark) GROUP BY source""")
def _(v):
    parts = [v.table(t).select(F.lit(t).alias("source"), "text") for t in ("documents", "conversations", "benchmark")]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))


@query("first_per_title", "SET2", "news_id:i ticker:s", """
SELECT news_id, ticker FROM (SELECT *, row_number() OVER (PARTITION BY ticker, title ORDER BY published_at, news_id) AS rn FROM news)
WHERE rn = 1""", "news")
def _(v):
    return S.first_per_key(v.news, ["ticker", "title"], ["published_at", "news_id"])


@query("cue_word_overlap", "SET3", "news_id:i has_cue:b n_cue:i", """
t AS (SELECT news_id, list_distinct(list(form)) AS toks FROM tokens GROUP BY news_id)
---
SELECT news_id, len(list_intersect(toks, ['that', 'with', 'license', 'elle', 'sich'])) > 0 AS has_cue,
  len(list_intersect(toks, ['that', 'with', 'license', 'elle', 'sich'])) AS n_cue FROM t""", "tokens")
def _(v):
    cue = F.array(*[F.lit(c) for c in ("that", "with", "license", "elle", "sich")])
    t = v.titles_tokens.filter(F.size("toks") > 0)
    return t.select("news_id", F.arrays_overlap("toks", cue).alias("has_cue"),
                    F.size(F.array_intersect("toks", cue)).alias("n_cue"))


@query("name_set_difference", "SET4", "form:s", """
SELECT form FROM tokens EXCEPT SELECT t FROM (
  SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9''\\-]*')) AS t FROM conversations)""", "tokens")
def _(v):
    from bellwether.functions.text import tokenize
    other = v.table("conversations").select(F.explode(tokenize("text")).alias("form"))
    return v.tokens.select("form").distinct().join(other.distinct(), "form", "left_anti")


# ------------------------------------------------------------------ sorts, ranks, selection


@query("panel_order", "TK1", "pos:i ticker:s date:d", """
SELECT row_number() OVER (ORDER BY ticker, date) AS pos, ticker, date FROM bars""", "bars")
def _(v):
    return R.global_rank(v.bars.select("ticker", "date"), [F.asc("ticker"), F.asc("date")], "pos")


_TOP = """SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS rk FROM scores"""


@query("rank_in_day", "WN21", "date:d ticker:s score:f rk:i", f"SELECT date, ticker, score, rk FROM ({_TOP}) WHERE rk <= 5", "scores")
def _(v):
    return S.top_per_day(v.scores, 5)


@query("daily_top_picks", "TK2", "date:d ticker:s score:f gap:f rk:i", f"""
SELECT date, ticker, score, gap, rk FROM ({_TOP} WHERE score >= 0.6 AND gap > -0.1 AND gap <= 0.02) WHERE rk <= 3""", "scores")
def _(v):
    return S.top_per_day(v.scores, 3, floor=0.6, gap_above=-0.1, gap_cap=0.02)


@query("coverage_selection", "TK3", "fraction:f n:i hit:f", """
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, ticker, date) AS rk, count(*) OVER () AS nn FROM scores)
---
SELECT k AS fraction, count(*) AS n, avg(CASE WHEN h >= o * 1.05::DOUBLE THEN 1.0 ELSE 0.0 END) AS hit
FROM r, (SELECT unnest([0.3, 0.2, 0.1, 0.05]::DOUBLE[]) AS k) WHERE rk <= greatest(floor(nn * k), 20) GROUP BY k""", "scores")
def _(v):
    t = R.top_fraction(v.scores, "score", [0.3, 0.2, 0.1, 0.05], 20, ["ticker", "date"])
    return t.groupBy("fraction").agg(F.count(F.lit(1)).alias("n"),
                                     A.share(F.col("h") >= F.col("o") * 1.05).alias("hit"))


@query("threshold_selection", "TK4", "prob:f q:f n:i hit:f", """
q AS (SELECT unnest([0.5, 0.8, 0.9, 0.95]) AS prob, unnest((SELECT quantile_cont(score, [0.5, 0.8, 0.9, 0.95]) FROM scores)) AS q)
---
SELECT prob, q, count(*) AS n, avg(CASE WHEN h >= o * 1.05::DOUBLE THEN 1.0 ELSE 0.0 END) AS hit
FROM scores, q WHERE score >= q GROUP BY 1, 2""", "scores")
def _(v):
    return S.threshold_table(v.scores, v.scores, [0.5, 0.8, 0.9, 0.95])


@query("frozen_threshold", "TK5", "prob:f q:f n:i hit:f", """
q AS (SELECT unnest([0.5, 0.8, 0.9]) AS prob,
      unnest((SELECT quantile_cont(score, [0.5, 0.8, 0.9]) FROM scores WHERE date < DATE '2000-01-01')) AS q)
---
SELECT prob, q, count(*) AS n, avg(CASE WHEN h >= o * 1.05::DOUBLE THEN 1.0 ELSE 0.0 END) AS hit
FROM scores, q WHERE score >= q AND date >= DATE '2000-01-01' GROUP BY 1, 2""", "scores")
def _(v):
    cut = F.lit("2000-01-01").cast("date")
    return S.threshold_table(v.scores.filter(F.col("date") < cut), v.scores.filter(F.col("date") >= cut), [0.5, 0.8, 0.9])


@query("top_frequency", "TK6", "form:s n:i", """
SELECT form, count(*) AS n FROM tokens GROUP BY form ORDER BY n DESC, form LIMIT 20""", "tokens")
def _(v):
    return S.most_frequent(v.tokens, "form", 20)


@query("nearest_words", "TK7", "query_id:s rank:i id:s sim:f", """
q AS (SELECT form, vec FROM words WHERE form IN (SELECT alias FROM aliases))
---
s AS (SELECT q.form AS query_id, w.form AS id, list_cosine_similarity(CAST(q.vec AS DOUBLE[]), CAST(w.vec AS DOUBLE[])) AS sim
      FROM q JOIN words w ON w.form <> q.form)
---
SELECT query_id, rank, id, sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s)
WHERE rank <= 8""", "words aliases")
def _(v):
    w = v.words.select(F.col("form").alias("id"), F.col("form").alias("text"), "vec")
    return M.nearest(w, w.join(v.aliases.select(F.col("alias").alias("id")), "id", "left_semi"), 8)


@query("nearest_news_to_ticker", "TK7", "query_id:s rank:i id:i sim:f", """
e AS (SELECT ticker, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM vector_news)
---
m AS (SELECT ticker, dim, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY 1, 2)
---
q AS (SELECT ticker, list(x ORDER BY dim) AS vec FROM m GROUP BY 1)
---
s AS (SELECT q.ticker AS query_id, n.news_id AS id, d.text AS t, list_cosine_similarity(q.vec, CAST(n.vec AS DOUBLE[])) AS sim
      FROM q, vector_news n JOIN documents d ON d.doc_id = n.news_id)
---
u AS (SELECT *, row_number() OVER (PARTITION BY query_id, t ORDER BY sim DESC, id) AS c FROM s)
---
SELECT query_id, rank, id, sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM u WHERE c = 1)
WHERE rank <= 5""", "vector_news")
def _(v):
    q = V.vector_mean(v.vector_news, ["ticker"], "vec", "m").select(
        F.col("ticker").alias("id"), F.lit("").alias("text"), F.col("m").alias("vec"))
    c = v.news.select("news_id", F.md5("title").alias("text")).join(v.news_vec, "news_id").select(
        F.col("news_id").alias("id"), "text", "vec")
    return M.nearest(c, q, 5)


@query("directional_selector", "TK8", "fraction:f n:i hit:f long_frac:f", """
m AS (SELECT ticker, date, u20, d20, up5, dn5, greatest(u20 - 0.4, d20 - 0.4) AS margin FROM (
  SELECT *, CASE WHEN high >= open * 1.05::DOUBLE THEN 1 ELSE 0 END AS up5, CASE WHEN low <= open * 0.95::DOUBLE THEN 1 ELSE 0 END AS dn5,
    avg(CASE WHEN high >= open * 1.05::DOUBLE AND open > 0 THEN 1 ELSE 0 END) OVER f AS u20,
    avg(CASE WHEN low <= open * 0.95::DOUBLE AND open > 0 THEN 1 ELSE 0 END) OVER f AS d20, count(*) OVER f AS k FROM bars
  WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) WHERE k >= 10)
---
r AS (SELECT *, row_number() OVER (ORDER BY round(margin, 9) DESC, ticker, date) AS rk, count(*) OVER () AS nn FROM m)
---
SELECT k AS fraction, count(*) AS n, avg(CASE WHEN u20 >= d20 THEN up5 ELSE dn5 END) AS hit,
  avg(CASE WHEN u20 >= d20 THEN 1.0 ELSE 0.0 END) AS long_frac
FROM r, (SELECT unnest([0.1, 0.05]::DOUBLE[]) AS k) WHERE rk <= greatest(floor(nn * k), 20) GROUP BY k""", "bars")
def _(v):
    from bellwether.operators.windows import hit_priors
    p = hit_priors(v.bars).filter("u20 is not null")
    return S.directional_selector(p, "u20", "d20", 0.4, 0.4, [0.1, 0.05], 20)


@query("rank_deciles", "WN22", "ticker:s date:d decile:i", """
r AS (SELECT ticker, date, row_number() OVER (ORDER BY buy - sell, ticker, date) AS rk, count(*) OVER () AS n FROM flows)
---
SELECT ticker, date, greatest(ceil((rk - 1) * 10 / (n - 1)), 1) - 1 AS decile FROM r""", "flows")
def _(v):
    return R.rank_deciles(v.flows.withColumn("net", F.col("buy") - F.col("sell")), "net", ["ticker", "date"])
