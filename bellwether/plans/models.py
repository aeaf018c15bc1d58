"""Models on Spark ML. Fitted results have no SQL form and are checked by invariants in the
tests; splits, baselines and comparison tables are checked against SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bellwether.operators import models as M
from bellwether.operators import projections as P
from bellwether.operators import windows as W
from bellwether.operators.aggregates import corr
from bellwether.operators.calendar import assign_session
from bellwether.operators.ranks import with_scalars
from bellwether.plans.registry import query
from bellwether.plans.sessions import DIM, buckets, sessioned_vectors
from bellwether.session import frozen

_METRICS = "n:i tp:i fp:i fn:i tn:i acc:f base:f mcc:f"
STEP = 12  # sessions of the monthly panel per walk-forward block


def features(v, cols=None):
    """Features are used by several fits, so they are written once; of ``cols`` only these and what else fits and reports need."""
    rows = M.feature_table(v.panel)
    return frozen(rows.select("ticker", "date", "ret", "label", "weight", *cols) if cols else rows)


def parts(v):
    s = M.time_split(features(v))
    return s.filter("split = 'train'"), s.filter("split = 'dev'"), s.filter("split = 'test'")


_SPLIT = """
d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM scores))
---
sp AS (SELECT date, CASE WHEN i >= floor(n * 0.6::DOUBLE) THEN 'test' WHEN i >= floor(floor(n * 0.6::DOUBLE) * (1 - 0.15::DOUBLE)) THEN 'dev' ELSE 'train' END AS split FROM d)
---
"""


@query("time_split", "ML1", "split:s n:i days:i first_day:d last_day:d", _SPLIT + """
SELECT split, count(*) AS n, count(DISTINCT date) AS days, min(date) AS first_day, max(date) AS last_day FROM scores JOIN sp USING (date) GROUP BY split""", "scores")
def _(v):
    return M.time_split(v.scores).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@query("boosted_trees", "ML2 ML9", _METRICS)
def _(v):
    train, _dev, test = parts(v)
    return M.metrics(M.score(M.boosted(M.FEATURES["all"]).fit(M.weighted(train)), test))


@query("logistic_model", "ML3", _METRICS)
def _(v):
    train, _dev, test = parts(v)
    return M.metrics(M.score(M.logistic(M.FEATURES["all"]).fit(train), test))


@query("size_regression", "ML3", "n:i corr:f dir_acc:f")
def _(v):
    train, _dev, test = parts(v)
    s = M.linear(M.FEATURES["all"], "ret").fit(train).transform(test)
    return s.agg(F.count(F.lit(1)).alias("n"), corr("size", "ret").alias("corr"),
                 F.avg(((F.col("size") > 0) == (F.col("ret") > 0)).cast("int")).alias("dir_acc"))


@query("random_forest", "ML4", _METRICS)
def _(v):
    train, _dev, test = parts(v)
    return M.metrics(M.score(M.forest(M.FEATURES["all"]).fit(train), test))


@query("size_regression_line", "ML3", "n:i slope:g intercept:g", """
f AS (SELECT ret, lag(ret) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM panel WHERE ret IS NOT NULL)
---
SELECT count(*) AS n, regr_slope(ret, prev) AS slope, regr_intercept(ret, prev) AS intercept FROM f WHERE prev IS NOT NULL""", "panel")
def _(v):
    # one feature and no penalty: the regression is a line
    d = v.panel.filter("ret is not null").withColumn("prev", F.lag("ret").over(W.by_ticker())).filter("prev is not null")
    d = frozen(d.select("prev", "ret", F.lit(1.0).alias("weight")))
    line = M.linear(["prev"], "ret", reg=0.0).fit(d)
    at = line.transform(d.sparkSession.createDataFrame([(0.0, 1.0), (1.0, 1.0)], "prev double, weight double")).select("prev", "size")
    ends = at.agg(F.max_by("size", "prev").alias("one"), F.min_by("size", "prev").alias("intercept"))
    return with_scalars(d.agg(F.count(F.lit(1)).alias("n")), ends).withColumn("slope", F.col("one") - F.col("intercept"))


def walk(v, **kw):
    cols = M.FEATURES["trend"]
    return M.walk_forward(features(v, cols), lambda: M.logistic(cols), step=STEP, **kw)


@query("walk_forward_folds", "ML5", "block:d rows:i train_rows:i used:b", """
d AS (SELECT date, count(*) AS n, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS days FROM scores GROUP BY date)
---
f AS (SELECT *, (i - CAST(floor(days * 0.4::DOUBLE) AS BIGINT)) // 12 AS b FROM d WHERE i >= floor(days * 0.4::DOUBLE))
---
g AS (SELECT min(date) AS block, min(i) AS i, sum(n) AS rows FROM f GROUP BY b)
---
SELECT block, rows, coalesce((SELECT sum(n) FROM d WHERE d.i < g.i - 1), 0) AS train_rows,
  coalesce((SELECT sum(n) FROM d WHERE d.i < g.i - 1), 0) >= 200 AND g.i >= 2 AS used FROM g""", "scores")
def _(v):
    return M.fold_table(v.scores, step=STEP)


@query("walk_forward", "ML5", "block:d " + _METRICS)
def _(v):
    return M.metrics(walk(v), by=["block"])


@query("bagged_logistic", "ML6", _METRICS)
def _(v):
    train, _dev, test = parts(v)
    return M.metrics(M.bagging(train, test, lambda: M.logistic(M.FEATURES["trend"])))


@query("bag_weights", "ML6", "bag:i weight:i n:i label_sum:i first_key:s", """
k AS (SELECT bag, t.* FROM scores t, (SELECT unnest(range(0, 3)) AS bag))
---
u AS (SELECT *, CAST(CAST('0x' || substr(md5('13|' || bag || '|' || ticker || '|' || strftime(date, '%Y-%m-%d')), 1, 13) AS BIGINT) AS DOUBLE)
  / 4503599627370496 AS u FROM k)
---
c AS (SELECT k AS w, sum(exp(-1) / gamma(k + 1)) OVER (ORDER BY k) AS upto FROM (SELECT unnest(range(0, 19)) AS k))
---
w AS (SELECT *, (SELECT count(*) FROM c WHERE u >= upto) AS weight FROM u)
---
SELECT bag, weight, count(*) AS n, sum(CAST(score > 0.6 AS INTEGER)) AS label_sum, min(ticker || ' ' || strftime(date, '%Y-%m-%d')) AS first_key
FROM w GROUP BY 1, 2""", "scores")
def _(v):
    # one pass: the three draws of a row travel as an array
    draws = F.array(*[F.struct(F.lit(b).alias("bag"), M.poisson_weight(["ticker", "date"], b).alias("weight")) for b in range(3)])
    d = v.scores.withColumn("date", F.to_date("date")).select("ticker", "date", "score", F.explode(draws).alias("b"))
    return d.groupBy("b.bag", "b.weight").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("score") > 0.6).cast("int")).alias("label_sum"),
        F.min(F.concat_ws(" ", "ticker", F.col("date").cast("string"))).alias("first_key"))


@query("meta_label", "ML7", "n:i candidates:i hit_first:f hit_meta:f")
def _(v):
    cols = M.FEATURES["trend"]
    # narrowed after features are written: their partitions, from which trees sample their splits, stay as they are
    train, _dev, test = (d.select("ticker", "date", "label", "weight", *cols) for d in parts(v))
    s = M.meta_label(train, test, lambda: M.boosted(cols, iters=5), lambda: M.boosted([*cols, "p"], iters=5))
    cand = F.col("p_meta") > 0
    return s.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(cand, 1)).alias("candidates"),
                 F.avg(F.when(cand, F.col("label"))).alias("hit_first"),
                 F.avg(F.when(F.col("p_meta") > 0.5, F.col("label"))).alias("hit_meta"))


@query("meta_correct", "ML7", "n:i acc_all:f acc_kept:f kept:i")
def _(v):
    oos = frozen(walk(v))
    cols = [*M.FEATURES["trend"], "p", "conf"]
    s = M.meta_correct(oos, lambda: M.logistic(cols, label="right"), STEP, 150)
    keep = F.col("p_right") > 0.5
    return s.agg(F.count(F.lit(1)).alias("n"), F.avg("right").alias("acc_all"),
                 F.avg(F.when(keep, F.col("right"))).alias("acc_kept"), F.count(F.when(keep, 1)).alias("kept"))


@query("isotonic_calibration", "ML8", "block:d calibrated:b n:i mean_p:f mean_cal:f rate:f")
def _(v):
    c = M.calibrate(frozen(walk(v)))
    return c.groupBy("block", "calibrated").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"),
                                  F.avg("p_cal").alias("mean_cal"), F.avg("label").alias("rate"))


@query("weighted_training", "ML9 FN15", "scheme:s " + _METRICS)
def _(v):
    d = features(v)
    out = None
    for name, w in (("recency", M.recency()), ("by_return", M.by_return)):
        p = M.walk_forward(d, lambda: M.logistic(M.FEATURES["trend"]), step=2 * STEP, weights=w)
        m = M.metrics(p).withColumn("scheme", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


@query("probability_ensemble", "ML10", _METRICS)
def _(v):
    train, _dev, test = parts(v)
    cols = M.FEATURES["all"]
    return M.metrics(M.ensemble(test, {"lr": M.logistic(cols).fit(train), "rf": M.forest(cols).fit(train)}))


@query("feature_set_comparison", "ML11", "model:s split:s " + _METRICS)
def _(v):
    return M.compare(M.time_split(features(v)), {n: M.logistic(c) for n, c in M.FEATURES.items()})


@query("capacity_ladder", "ML11", "model:s split:s " + _METRICS)
def _(v):
    cols = M.FEATURES["trend"]
    return M.compare(M.time_split(features(v)), {f"dense{h}": M.dense_net(cols, [h]) for h in (4, 16)})


@query("permutation_importance", "ML12", "feature:s auc:f drop:f")
def _(v):
    train, dev, _test = parts(v)
    cols = M.FEATURES["returns"]
    return M.permutation_importance(M.boosted(cols, iters=5).fit(train), dev, cols, ["ticker", "date"])


@query("stacked_model", "ML13", _METRICS)
def _(v):
    train, dev, test = parts(v)
    m = M.boosted(M.FEATURES["all"], iters=10).fit(train)
    return M.metrics(M.stack(M.score(m, dev), M.score(m, test), M.FEATURES["returns"]), p="p_stack")


_CONFUSION = """CASE WHEN tp + fp = 0 OR tp + fn = 0 OR tn + fp = 0 OR tn + fn = 0 THEN 0 ELSE (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn)
  / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc"""
_RULES = """
d AS (SELECT ret > 0 AS y, prev > 0 AS p FROM (SELECT ret, lag(ret) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM panel)
  WHERE ret IS NOT NULL AND prev IS NOT NULL)
---
u AS (SELECT 'momentum' AS model, y, p FROM d UNION ALL SELECT 'majority', y, (SELECT avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) > 0.5 FROM d) FROM d)
---
c AS (SELECT model, count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp, count(*) FILTER (WHERE y AND NOT p) AS fn,
  count(*) FILTER (WHERE NOT y AND NOT p) AS tn FROM u GROUP BY model)
---
t AS (SELECT *, tp + fp + fn + tn AS n, (tp + tn) / (tp + fp + fn + tn) AS acc,
  greatest((tp + fn) / (tp + fp + fn + tn), 1 - (tp + fn) / (tp + fp + fn + tn)) AS base, """ + _CONFUSION + """ FROM c)
---
"""


@query("rule_baselines", "ML14", "model:s " + _METRICS, _RULES + "SELECT * FROM t", "panel")
def _(v):
    return M.rule_baselines(v.panel)


@query("claim_checks", "ML15", "better:s worse:s a:f b:f holds:b best:s", _RULES + """
k AS (SELECT * FROM (VALUES ('momentum', 'majority'), ('majority', 'momentum')) AS x(better, worse))
---
SELECT better, worse, a.mcc AS a, b.mcc AS b, a.mcc > b.mcc AS holds, (SELECT arg_max(model, row(mcc, model)) FROM t) AS best
FROM k JOIN t a ON a.model = better JOIN t b ON b.model = worse""", "panel")
def _(v):
    return M.claim_checks(M.rule_baselines(v.panel), [("momentum", "majority"), ("majority", "momentum")])


def training_texts(v):
    return P.eligible(v.spread_tokens, "published_at", "2024-01-20").filter("emb_eligible").select("toks")


def trained_words(v):
    return M.word_vectors(training_texts(v))


@query("word_vectors", "TX9", "form:s dims:i", """
SELECT form, 100 AS dims FROM tokens JOIN news USING (news_id) WHERE CAST(published_at AS DATE) < DATE '2024-01-20'
GROUP BY form HAVING count(*) >= 5""", "tokens news")
def _(v):
    return trained_words(v).select("form", F.size("vec").alias("dims"))


@query("word_vector_values", "TX9", "form:s dim:i val:f")
def _(v):
    return trained_words(v).select("form", F.posexplode("vec").alias("p", "val")).withColumn("dim", F.col("p") + 1)


def _before(v):
    return F.to_date("published_at") < F.lit("2024-01-20").cast("date")


@query("principal_components", "TX13", "news_id:i pc1:f pc2:f")
def _(v):
    pc = M.principal_components(v.vector_news, "vec", 2, _before(v))
    return pc.select("news_id", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"))


@query("principal_variance", "TX13", "n:i k:i total:f", """
e AS (SELECT news_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM vector_news WHERE CAST(published_at AS DATE) < DATE '2024-01-20')
---
d AS (SELECT dim, count(*) AS n, var_pop(CAST(x AS DOUBLE)) AS s FROM e GROUP BY dim)
---
SELECT max(n) AS n, count(*) AS k, sum(s) AS total FROM d""", "vector_news")
def _(v):
    # all components together hold the whole variance of the rows they are fitted on
    pc = M.principal_components(v.vector_news, "vec", DIM, _before(v)).filter(_before(v))
    per = pc.select(F.posexplode("pc").alias("dim", "x")).groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("s"))
    return per.agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("s").alias("total"))


def session_texts(v):
    """Token lists with the session they inform."""
    s = assign_session(v.news_tokens, v.calendar).filter("eff is not null")
    return s.select("news_id", "ticker", F.col("eff").alias("date"), "published_at", "toks")


@query("tfidf_svm", "TX16", "split:s cost:f " + _METRICS)
def _(v):
    # the texts that inform one session of a ticker are one document, labelled with its direction
    texts = session_texts(v)
    y = v.daily.select("ticker", "date", (F.col("close") > F.col("open")).cast("double").alias("label"))
    days = frozen(M.time_split(texts.select("ticker", "date").distinct().join(y, ["ticker", "date"])))
    pred = M.tfidf_svm(texts, days)
    return M.metrics(pred, by=["split", "cost"])


@query("news_gap_variants", "EV9", "variant:s scope:s " + _METRICS + " size_corr:f size_dir_acc:f")
def _(v):
    from bellwether.functions.vectors import zeros
    from bellwether.operators.calendar import session_windows
    s = sessioned_vectors(v)
    w = session_windows(v.daily, v.calendar, buckets(s.filter("not in_session"), "info"), buckets(s, "info"), DIM)
    sess = buckets(s.filter("in_session"), "info").select("ticker", F.col("pos").alias("_p"), F.col("vec").alias("_sess"))
    by = Window.partitionBy("ticker").orderBy("date")
    w = w.withColumn("_p", F.coalesce(F.lag("pos").over(by), F.col("pos") - 1)).join(sess, ["ticker", "_p"], "left")
    gap = W.price_panel(v.daily).select("ticker", "date", "gap")
    d = w.join(gap, ["ticker", "date"]).filter("gap is not null and has_any").select(
        "ticker", "date", "gap", F.col("has_short").alias("has_over"), F.col("short").alias("over"), F.col("mid_mean").alias("mid"),
        F.col("long_mean").alias("long"), F.coalesce("_sess", zeros(DIM)).alias("sess"))
    d = frozen(M.time_split(d))
    return M.news_gap_variants(d, {"session": ["sess", "mid", "long"], "overnight": ["over", "mid", "long"],
                                   "split": ["sess", "over", "mid", "long"]})
