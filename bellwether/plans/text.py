"""Scalar and text functions, name linking, event triples and training inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from bellwether.functions import scalar as N
from bellwether.functions import text as X
from bellwether.functions import vectors as V
from bellwether.operators import calendar as C
from bellwether.operators import linking as L
from bellwether.operators import text as T
from bellwether.operators import zones as Z
from bellwether.plans.registry import query
from bellwether.plans.sessions import overnight_table, sessioned_vectors

_TOKS = "[x for x in regexp_extract_all(lower(text), '[a-z][a-z0-9''\\-]*') if length(x) >= 2]"

# ------------------------------------------------------------------ functions


@query("clean_title", "FN1", "page_id:i chars:i digest:s", """
c AS (SELECT page_id, trim(regexp_replace(coalesce(html, ''), '[ \\t\\r\\n\\f\\v]+', ' ', 'g')) AS t FROM pages)
---
SELECT page_id, length(t) AS chars, md5(t) AS digest FROM c""")
def _(v):
    return v.table("pages").select("page_id", X.clean_title("html").alias("t")).select(
        "page_id", F.char_length("t").alias("chars"), F.md5("t").alias("digest"))


@query("tokenize", "FN2", "news_id:i n:i digest:s", f"""
t AS (SELECT doc_id AS news_id, {_TOKS} AS toks FROM documents)
---
SELECT news_id, len(toks) AS n, md5(array_to_string(toks, ' ')) AS digest FROM t""")
def _(v):
    return v.titles_tokens.select("news_id", F.size("toks").alias("n"), F.md5(F.array_join("toks", " ")).alias("digest"))


@query("array_parts", "FN3", "news_id:i n:i head:s tail:s", f"""
t AS (SELECT doc_id AS news_id, {_TOKS} AS toks FROM documents)
---
SELECT news_id, len(toks) AS n, coalesce(toks[1], '') AS head, coalesce(toks[-1], '') AS tail FROM t""")
def _(v):
    return v.titles_tokens.select("news_id", F.size("toks").alias("n"), X.at("toks", 1).alias("head"), X.at("toks", -1).alias("tail"))


@query("zone_conversion", "FN4", "news_id:i et:t et_date:d", """
SELECT news_id, published_at - INTERVAL 5 HOUR AS et, CAST(published_at - INTERVAL 5 HOUR AS DATE) AS et_date FROM news""", "news")
def _(v):
    # the given times all lie in January, when New York is five hours behind UTC
    return v.news.select("news_id", N.to_zone("published_at").alias("et")).withColumn("et_date", F.to_date("et"))


# fixed values: clocks of New York went forward on the first Sunday of April and back on the last one of October in these years
_CHANGES = """
ch AS (SELECT y, a + CAST((7 - dayofweek(a)) % 7 AS INTEGER) AS sp, o - CAST(dayofweek(o) AS INTEGER) AS au
  FROM (SELECT y, make_date(y, 4, 1) AS a, make_date(y, 10, 31) AS o FROM (SELECT unnest(range(1987, 2007)) AS y)))
---
"""


def _zones(v):
    return Z.offset_intervals(v.spark, 1987, 2006)


@query("zone_intervals", "FN4", "o_orderkey:i local:t local_date:d utc:t kind:s", _CHANGES + """
t AS (SELECT o_orderkey, year(o_orderdate) AS y, CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST((o_orderkey * 7919) % 480 AS BIGINT)) AS ts FROM orders)
---
l AS (SELECT t.*, ts + to_minutes(CASE WHEN ts >= sp + INTERVAL 7 HOUR AND ts < au + INTERVAL 6 HOUR THEN -240 ELSE -300 END) AS local,
  CASE WHEN ts >= sp + INTERVAL 2 HOUR AND ts < sp + INTERVAL 3 HOUR THEN 'missing'
    WHEN ts >= au + INTERVAL 1 HOUR AND ts < au + INTERVAL 2 HOUR THEN 'double' ELSE 'single' END AS kind,
  ts + to_minutes(CASE WHEN ts >= sp + INTERVAL 3 HOUR AND ts < au + INTERVAL 2 HOUR THEN 240 ELSE 300 END) AS utc FROM t JOIN ch USING (y))
---
SELECT *, CAST(local AS DATE) AS local_date FROM l""")
def _(v):
    # each order at a minute of the first eight hours of its day, in which all clock changes fall
    at = F.expr("timestampadd(MINUTE, (o_orderkey * 7919) % 480, cast(o_orderdate as timestamp_ntz))")
    t = v.table("orders").select("o_orderkey", at.alias("ts"))
    t = Z.to_utc(Z.from_utc(t, "ts", _zones(v)), "ts", _zones(v), "utc", "kind")
    return t.withColumn("local_date", F.to_date("local"))


@query("utc_sessions", "CAL1 CAL2 FN4", "td:d pos:i open_utc:t close_utc:t", _CHANGES + """
d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS td FROM orders)
---
m AS (SELECT td, row_number() OVER (ORDER BY td) - 1 AS pos, CASE WHEN td >= sp AND td < au THEN 240 ELSE 300 END AS ahead
  FROM d JOIN ch ON y = year(td))
---
SELECT td, pos, CAST(td AS TIMESTAMP) + to_minutes(570 + ahead) AS open_utc, CAST(td AS TIMESTAMP) + to_minutes(960 + ahead) AS close_utc FROM m""")
def _(v):
    days = v.table("orders").select(F.to_date("o_orderdate").alias("date"))
    return Z.utc_sessions(C.calendar(days, 570, 960), _zones(v))


@query("date_parts", "FN5", "o_orderkey:i month:s quarter:i weekday:i later:d session_open:t hours:f", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, quarter(o_orderdate) AS quarter, isodow(o_orderdate) - 1 AS weekday,
  CAST(o_orderdate + INTERVAL 7 DAY AS DATE) AS later, date_trunc('day', o_orderdate) + INTERVAL 540 MINUTE AS session_open,
  hour(o_orderdate) + minute(o_orderdate) / 60.0::DOUBLE AS hours FROM orders""")
def _(v):
    return v.table("orders").select(
        "o_orderkey", N.month_key("o_orderdate").alias("month"), F.quarter("o_orderdate").alias("quarter"),
        F.weekday("o_orderdate").alias("weekday"), F.date_add(F.to_date("o_orderdate"), 7).alias("later"),
        F.expr("timestampadd(MINUTE, 540, cast(to_date(o_orderdate) as timestamp_ntz))").alias("session_open"),
        N.fractional_hour("o_orderdate").alias("hours"))


@query("numeric_functions", "FN6 FN7 FN11", "ticker:s date:d lg:f l1:f ex:f ab:f sg:f sq:f cl:f zero:f div:f sig:f", """
SELECT ticker, date, ln(close) AS lg, ln(1 + volume) AS l1, exp(gap) AS ex, abs(gap) AS ab, sign(gap) AS sg, sqrt(volume) AS sq,
  greatest(least(gap, 0.1), -0.1) AS cl, coalesce(ret, 0) AS zero, (high - low) / nullif(high - open, 0) AS div,
  1 / (1 + exp(-gap)) AS sig FROM panel WHERE gap IS NOT NULL""", "panel")
def _(v):
    return v.panel.filter("gap is not null").select(
        "ticker", "date", F.log("close").alias("lg"), F.log1p("volume").alias("l1"), F.exp("gap").alias("ex"),
        F.abs("gap").alias("ab"), F.signum("gap").alias("sg"), F.sqrt("volume").alias("sq"),
        N.clip("gap", -0.1, 0.1).alias("cl"), F.coalesce("ret", F.lit(0.0)).alias("zero"),
        N.safe_div(F.col("high") - F.col("low"), F.col("high") - F.col("open")).alias("div"), N.sigmoid("gap").alias("sig"))


@query("flow_ratios", "FN8", "ticker:s date:d imbalance:f turnover:f net_to_cap:f", """
SELECT ticker, date, (buy - sell) / (buy + sell + 1) AS imbalance, (buy + sell) / nullif(market_cap, 0) AS turnover,
  (buy - sell) / nullif(market_cap, 0) AS net_to_cap FROM flows JOIN caps USING (ticker, date)""", "flows caps")
def _(v):
    j = v.flows.join(v.caps, ["ticker", "date"])
    return j.select("ticker", "date", N.flow_imbalance("buy", "sell").alias("imbalance"),
                    N.safe_div(F.col("buy") + F.col("sell"), "market_cap").alias("turnover"),
                    N.safe_div(F.col("buy") - F.col("sell"), "market_cap").alias("net_to_cap"))


@query("vector_functions", "FN9", "news_id:i norm:f dot:f cosine:f novelty:f", """
p AS (SELECT a.news_id, CAST(a.vec AS DOUBLE[]) AS a, CAST(b.vec AS DOUBLE[]) AS b FROM news_vec a JOIN news_vec b ON b.news_id = a.news_id + 1)
---
SELECT news_id, sqrt(list_dot_product(a, a)) AS norm, list_dot_product(a, b) AS dot, list_cosine_similarity(a, b) AS cosine,
  1 - list_cosine_similarity(a, b) AS novelty FROM p""", "news_vec")
def _(v):
    b = v.news_vec.select((F.col("news_id") - 1).alias("news_id"), F.col("vec").alias("b"))
    return v.news_vec.join(b, "news_id").select(
        "news_id", V.norm("vec").alias("norm"), V.dot("vec", "b").alias("dot"), V.cosine("vec", "b").alias("cosine"),
        V.novelty("vec", "b").alias("novelty"))


@query("vector_parts", "FN10", "news_id:i n:i third:f zero:b", """
SELECT news_id, len(list_concat(vec, vec[1:4])) AS n, vec[3:5][1] AS third,
  len([x for x in vec if x <> 0]) = 0 AS zero FROM news_vec""", "news_vec")
def _(v):
    return v.news_vec.select("news_id", F.size(F.concat("vec", F.slice("vec", 1, 4))).alias("n"),
                             F.slice("vec", 3, 3)[0].alias("third"), V.is_zero("vec").alias("zero"))


@query("word_boundary_match", "FN12", "news_id:i alias:s", """
SELECT news_id, alias FROM news, aliases
WHERE regexp_matches(title, '(^|[^0-9A-Za-z&])' || alias || '($|[^0-9A-Za-z&])')""", "news aliases")
def _(v):
    return L.bounded_mentions(v.news, v.aliases)


@query("token_runs", "FN13", "news_id:i n_runs:i", f"""
t AS (SELECT doc_id AS news_id, unnest(toks) AS a, unnest(list_concat(toks[2:], [NULL])) AS b,
  unnest(list_concat(toks[3:], [NULL, NULL])) AS c, unnest(list_concat(toks[4:], [NULL, NULL, NULL])) AS d
  FROM (SELECT doc_id, {_TOKS} AS toks FROM documents))
---
SELECT doc_id AS news_id, coalesce(n, 0) AS n_runs FROM documents LEFT JOIN (
  SELECT news_id, count(DISTINCT r) AS n FROM (SELECT news_id, unnest([a, a || b, a || b || c, a || b || c || d]) AS r FROM t)
  WHERE r IS NOT NULL GROUP BY 1) ON news_id = doc_id""")
def _(v):
    return v.titles_tokens.select("news_id", F.size(X.token_runs("toks", 4)).alias("n_runs"))


@query("strip_suffix", "FN14", "s_suppkey:i symbol:s ticker:s", """
SELECT s_suppkey, s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.KS' ELSE '.KQ' END AS symbol, CAST(s_suppkey AS VARCHAR) AS ticker FROM supplier""")
def _(v):
    suffix = F.when(F.col("s_suppkey") % 2 == 0, ".KS").otherwise(".KQ")
    s = v.table("supplier").select("s_suppkey", F.concat(F.col("s_suppkey").cast("string"), suffix).alias("symbol"))
    return s.withColumn("ticker", X.strip_suffix("symbol"))


@query("training_weights", "FN15", "ticker:s date:d recency:f by_return:f by_class:f", """
m AS (SELECT max(date) AS last, avg(CASE WHEN ret > 0.03 THEN 1.0 ELSE 0.0 END) AS p FROM panel WHERE ret IS NOT NULL)
---
SELECT ticker, date, pow(0.5, (last - date) / 252.0::DOUBLE) AS recency, 1 + 5 * abs(ret) AS by_return,
  CASE WHEN ret > 0.03 THEN least(greatest((1 - p) / greatest(p, 1e-4), 1), 25) ELSE 1 END AS by_class FROM panel, m WHERE ret IS NOT NULL""", "panel")
def _(v):
    from bellwether.operators.ranks import with_scalars
    p = v.panel.filter("ret is not null")
    hit = F.col("ret") > 0.03
    m = p.agg(F.max("date").alias("last"), F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("p"))
    return with_scalars(p, m).select(
        "ticker", "date", N.half_life_weight("date", "last").alias("recency"), N.return_weight("ret").alias("by_return"),
        F.when(hit, N.class_weight("p")).otherwise(1.0).alias("by_class"))


# ------------------------------------------------------------------ linking


@query("alias_table", "TX1", "ticker:s alias:s", """
u AS (SELECT ticker, max(alias) FILTER (WHERE rk <= 5) AS name, list(alias) FILTER (WHERE rk > 5) AS more FROM aliases GROUP BY 1)
---
SELECT ticker, name AS alias FROM u WHERE length(name) >= 2 UNION
SELECT ticker, a FROM (SELECT ticker, unnest(more) AS a FROM u) WHERE length(a) >= 3""", "aliases")
def _(v):
    u = v.aliases.groupBy("ticker").agg(
        F.max(F.when(F.col("rk") <= 5, F.col("alias"))).alias("name"),
        F.collect_list(F.when(F.col("rk") > 5, F.col("alias"))).alias("aliases"))
    return L.alias_table(u)


@query("name_mentions", "JN11", "news_id:i alias:s", """
SELECT news_id, alias FROM news JOIN aliases ON contains(title, alias)""", "news aliases")
def _(v):
    return L.mentions(v.news, v.aliases)


@query("link_simple", "TX2 JN11", "ticker:s news_id:i", "SELECT * FROM links", "links")
def _(v):
    return L.link_simple(v.news, v.aliases)


_CUES = ["with", "license", "elle"]
_PRECISE = """
r AS (SELECT alias, ticker, CASE WHEN rk % 2 = 0 THEN 'run' ELSE 'word' END AS kind, rk % 3 = 0 AS ambiguous,
  CASE WHEN rk = 4 THEN '(^| )' || alias || ' [a-z]+[.]' END AS tight FROM aliases)
---
tk AS (SELECT news_id, form AS a, lead(form, 1) OVER w AS b, lead(form, 2) OVER w AS c, lead(form, 3) OVER w AS d
  FROM tokens WINDOW w AS (PARTITION BY news_id ORDER BY pos))
---
runs AS (SELECT DISTINCT news_id, run FROM (SELECT news_id, unnest([a, a || b, a || b || c, a || b || c || d]) AS run FROM tk)
  WHERE run IN (SELECT alias FROM r))
---
cue AS (SELECT DISTINCT news_id FROM tokens WHERE form IN ('with', 'license', 'elle'))
---
lx AS (SELECT DISTINCT news_id, unnest(regexp_extract_all(title, (SELECT string_agg(alias, '|' ORDER BY length(alias) DESC, alias) FROM r))) AS alias FROM news)
---
m AS (SELECT n.news_id, r.alias, r.ticker, CASE
  WHEN tight IS NOT NULL THEN CASE WHEN regexp_matches(title, tight) THEN 'linked' ELSE 'ambiguous' END
  WHEN kind = 'word' AND NOT regexp_matches(title, '(^|[^0-9A-Za-z&])' || r.alias || '($|[^0-9A-Za-z&])') THEN 'boundary'
  WHEN kind = 'run' AND (n.news_id, r.alias) NOT IN (SELECT (news_id, run) FROM runs) THEN 'boundary'
  WHEN ambiguous AND n.news_id NOT IN (SELECT news_id FROM cue) THEN 'ambiguous' ELSE 'linked' END AS status
  FROM news n JOIN lx USING (news_id) JOIN r USING (alias))
---
"""


@query("link_precise", "TX3 FN12 FN13 SET3", "ticker:s news_id:i",
       _PRECISE + "SELECT DISTINCT ticker, news_id FROM m WHERE status = 'linked'", "news aliases tokens")
def _(v):
    return L.link_precise(v.news, v.aliases, v.rules, _CUES)


@query("link_reject_counts", "TX3", "alias:s status:s n:i",
       _PRECISE + "SELECT alias, status, count(*) AS n FROM m GROUP BY 1, 2", "news aliases tokens")
def _(v):
    return L.classify_mentions(v.news, v.rules, _CUES).groupBy("alias", "status").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ events and training inputs


@query("event_triples", "TX4", "news_id:i o1:l p:l o2:l", "SELECT news_id, o1, p, o2 FROM triples", "triples")
def _(v):
    return T.triples_from_tags(v.tagged)


@query("event_keys", "TX5 FN3", "news_id:i key:s", "SELECT news_id, key FROM triples", "triples")
def _(v):
    return v.events


@query("event_vocabulary", "TX6", "key:s n:i event_id:i", """
SELECT key, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, key) AS event_id FROM triples
WHERE CAST(published_at AS DATE) < DATE '2024-01-20' GROUP BY key""", "triples")
def _(v):
    return T.event_vocabulary(v.events, F.to_date("published_at") < F.lit("2024-01-20").cast("date"))


@query("vocabulary", "TX7", "form:s n:i word_id:i", "SELECT * FROM vocab", "vocab")
def _(v):
    return v.vocab


@query("skipgram_pairs", "TX8", "center:i context:i n:i", """
k AS (SELECT t.news_id, t.pos, word_id, n / sum(n) OVER () AS z0, n FROM tokens t JOIN vocab USING (form))
---
z AS (SELECT word_id, n / (SELECT sum(n) FROM vocab) AS z FROM vocab)
---
kept AS (SELECT news_id, pos, t.word_id, row_number() OVER (PARTITION BY news_id ORDER BY pos) AS i,
  ((pos * 7919 + news_id * 104729 + 14) % 2147483647 * 48271) % 2147483647 % 5 + 1 AS reach
  FROM (SELECT news_id, pos, word_id FROM tokens JOIN vocab USING (form)) t JOIN z USING (word_id)
  WHERE ((news_id * 7919 + pos * 104729 + 13) % 2147483647 * 48271) % 2147483647 / 2147483647.0::DOUBLE
    < least(1, (sqrt(z / 0.001::DOUBLE) + 1) * (0.001::DOUBLE / z)))
---
SELECT a.word_id AS center, b.word_id AS context, count(*) AS n FROM kept a JOIN kept b
ON a.news_id = b.news_id AND b.i <> a.i AND b.i BETWEEN a.i - a.reach AND a.i + a.reach GROUP BY 1, 2""", "tokens vocab")
def _(v):
    return T.skipgram_pairs(v.spread_tokens, T.vocabulary(v.spread_tokens.select(F.explode("toks").alias("form")), 5))


@query("argument_vectors", "TX10", "news_id:i arg:s dim:i val:f", """
l AS (SELECT news_id, 'o1' AS arg, unnest(o1) AS form FROM triples UNION ALL SELECT news_id, 'p', unnest(p) FROM triples
  UNION ALL SELECT news_id, 'o2', unnest(o2) FROM triples)
---
e AS (SELECT news_id, arg, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM l JOIN words USING (form))
---
m AS (SELECT news_id, arg, dim, avg(CAST(x AS DOUBLE)) AS val FROM e GROUP BY 1, 2, 3)
---
SELECT * FROM m WHERE news_id IN (SELECT news_id FROM m GROUP BY 1 HAVING count(DISTINCT arg) = 3)""", "triples words")
def _(v):
    a = T.argument_vectors(v.events, v.words)
    long = F.inline(F.array(*[F.struct(F.lit(c).alias("arg"), F.col(f"v_{c}").alias("vec")) for c in ("o1", "p", "o2")]))
    return a.select("news_id", long).select("news_id", "arg", F.posexplode("vec").alias("q", "val")).withColumn("dim", F.col("q") + 1)


@query("event_stats", "AG4", "texts:i rows:i in_vocab:i in_vocab_ratio:f eligible:f", """
l AS (SELECT news_id, 'o1' AS arg, unnest(o1) AS form FROM triples UNION ALL SELECT news_id, 'p', unnest(p) FROM triples
  UNION ALL SELECT news_id, 'o2', unnest(o2) FROM triples)
---
k AS (SELECT news_id FROM l JOIN words USING (form) GROUP BY 1 HAVING count(DISTINCT arg) = 3)
---
SELECT (SELECT count(*) FROM documents) AS texts, count(*) AS rows, count(k.news_id) AS in_vocab, count(k.news_id) / count(*) AS in_vocab_ratio,
  avg(CASE WHEN CAST(published_at AS DATE) < DATE '2024-01-20' THEN 1.0 ELSE 0.0 END) AS eligible
FROM triples t LEFT JOIN k USING (news_id)""", "triples words")
def _(v):
    return T.event_stats(v.table("documents"), v.events, T.known_events(v.events, v.words), "2024-01-20")


@query("corrupted_events", "TX11", "news_id:i which:i o1:l p:l o2:l", """
e AS (SELECT *, ((news_id * 104729 * 0 + news_id * 7919 + 13) % 2147483647 * 48271) % 2147483647 % 2 AS which FROM triples)
---
d AS (SELECT news_id, unnest(range(0, greatest(CASE WHEN which = 0 THEN len(o1) ELSE len(o2) END, 1))) AS i FROM e)
---
w AS (SELECT news_id, list(form ORDER BY i) AS ws FROM d JOIN vocab
  ON word_id = ((news_id * 7919 + (i + 1) * 104729 + 13) % 2147483647 * 48271) % 2147483647 % (SELECT count(*) FROM vocab) + 1 GROUP BY 1)
---
SELECT news_id, which, CASE WHEN which = 0 THEN ws ELSE o1 END AS o1, p, CASE WHEN which = 1 THEN ws ELSE o2 END AS o2
FROM e JOIN w USING (news_id)""", "triples vocab")
def _(v):
    return T.corrupt_events(v.events, v.vocab)


@query("standardised_vectors", "TX12", "news_id:i dim:i z:f", """
e AS (SELECT news_id, CAST(published_at AS DATE) < DATE '2024-01-20' AS fit, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM vector_news)
---
s AS (SELECT dim, avg(CAST(x AS DOUBLE)) AS m, stddev_pop(CAST(x AS DOUBLE)) + 1e-6 AS sd FROM e WHERE fit GROUP BY dim)
---
SELECT news_id, dim, (x - m) / sd AS z FROM e JOIN s USING (dim)""", "vector_news")
def _(v):
    z = T.standardise(v.vector_news, "vec", F.to_date("published_at") < F.lit("2024-01-20").cast("date"))
    return z.select("news_id", F.posexplode("z").alias("p", "z")).withColumn("dim", F.col("p") + 1)


@query("top_contributions", "TX17", "ticker:s date:d gap:f correct:b n:i rk:i news_id:i contrib:f", """
sv AS (SELECT v.*, eff.td AS eff FROM vector_scored v ASOF LEFT JOIN calendar eff ON published_at <= eff.open_ts
  ASOF LEFT JOIN calendar info ON published_at <= info.close_ts WHERE eff.td = info.td)
---
w AS (SELECT dim, avg(CAST(x AS DOUBLE)) AS w FROM (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM vector_scored) GROUP BY 1)
---
d AS (SELECT ticker, date, gap, (lag(ret) OVER (PARTITION BY ticker ORDER BY date) > 0) = (gap > 0) AS correct FROM daily_panel)
---
c AS (SELECT s.ticker, s.eff AS date, s.news_id, sum(CAST(x AS DOUBLE) * w) AS dot FROM
  (SELECT *, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM sv) s JOIN w USING (dim) GROUP BY 1, 2, 3)
---
j AS (SELECT c.*, gap, correct, count(*) OVER (PARTITION BY c.ticker, c.date) AS n FROM c JOIN d USING (ticker, date)
  WHERE correct IS NOT NULL AND abs(gap) >= 0.03)
---
k AS (SELECT *, dot / n AS contrib FROM j)
---
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY abs(round(contrib, 9)) DESC, news_id) AS rk FROM k) WHERE rk <= 6""",
       "vector_scored calendar daily_panel")
def _(v):
    from pyspark.sql import Window
    s = sessioned_vectors(v).filter("fresh").select("ticker", F.col("eff").alias("date"), "news_id", "vec")
    w = v.vector_scored.agg(V.mean_of("vec").alias("w"))
    pw = Window.partitionBy("ticker").orderBy("date")
    d = overnight_table(v).withColumn("pred_up", F.lag("ret").over(pw) > 0).filter("pred_up is not null")
    return T.top_contributions(s, d.select("ticker", "date", "gap", "pred_up"), w)
