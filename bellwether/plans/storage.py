"""Sources and sinks, each as a round trip of a table derived from the given ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from bellwether.operators.aggregates import corr
from bellwether.plans.registry import query
from bellwether.sources import readers as RD
from bellwether.sources import sinks as SK


@query("bars_round_trip", "SRC1 SNK1", "ticker:s date:d open:f high:f low:f close:f volume:f", "SELECT * FROM bars", "bars")
def _(v):
    p = SK.scratch(v.spark, "bars")
    SK.write_table(v.bars.withColumn("year", F.year("date")), p, by=["year"])
    return RD.read_bars(v.spark, p)


@query("news_from_date", "SRC2 SNK1", "news_id:i published_at:t chars:i", """
SELECT news_id, published_at, length(title) AS chars FROM news WHERE CAST(published_at AS DATE) >= DATE '2024-01-15'""", "news")
def _(v):
    p = SK.scratch(v.spark, "news")
    SK.write_table(v.news.withColumn("dt", F.to_date("published_at")), p, by=["dt"])
    return RD.read_news(v.spark, p, "2024-01-15", ["news_id", "published_at", "title"]).withColumn("chars", F.char_length("title"))


@query("intraday_directory", "SRC3 FN14", "ticker:s day:d ts:t open:f high:f low:f close:f volume:f", """
SELECT ticker, day, ts, open, high, low, close, volume FROM bars_intraday""", "bars_intraday")
def _(v):
    p = SK.scratch(v.spark, "bars5m")
    sym = v.bars_intraday.select(F.concat("ticker", F.lit(".KS")).alias("symbol"), F.col("ts").alias("datetime"),
                                 "open", "high", "low", "close", "volume")
    SK.write_table(sym, p + "/full")
    SK.write_table(sym.select("symbol", "datetime", "open"), p + "/partial")  # lacks columns: must be skipped
    return RD.read_bars_5m(v.spark, p)


@query("id_time", "SRC4", "news_id:s ts:t", """
SELECT lpad(CAST(news_id AS VARCHAR), 9, '0') || strftime(published_at, '%Y%m%d%H%M%S') AS news_id, published_at AS ts
FROM news WHERE news_id % 7 <> 0""", "news")
def _(v):
    # every seventh id is malformed
    stamp = F.regexp_replace(F.substring(F.col("published_at").cast("string"), 1, 19), "[^0-9]", "")
    stamp = F.when(F.col("news_id") % 7 == 0, F.concat(F.lit("x"), stamp)).otherwise(stamp)
    ids = v.news.select(F.concat(F.lpad(F.col("news_id").cast("string"), 9, "0"), stamp).alias("news_id"))
    return RD.parse_id_time(ids)


@query("equity_csv", "SRC5 SNK2", "date:d equity:f", """
m AS (SELECT date, avg(ret) AS r FROM panel WHERE ret IS NOT NULL GROUP BY date)
---
SELECT date, exp(sum(ln(1 + r)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS equity FROM m""", "panel")
def _(v):
    from bellwether.operators.windows import equity_curve
    day = v.panel.filter("ret is not null").groupBy("date").agg(F.avg("ret").alias("r")).withColumn("book", F.lit("all"))
    p = SK.scratch(v.spark, "equity")
    SK.write_curve(equity_curve(day, "r", "book").select(F.col("date").alias("_c0"), F.col("equity").alias("net")), p)
    return RD.read_equity(v.spark, p)


@query("metrics_json", "SRC6 SNK3", "model:s n_test:i test_acc:f test_mcc:f always_profit:f p_value:f", """
SELECT ticker AS model, (SELECT count(*) FROM news) AS n_test, avg(CASE WHEN close > open THEN 1.0 ELSE 0.0 END) AS test_acc,
  corr(open, close) AS test_mcc, sum(close - open) AS always_profit, min(close / open) AS p_value FROM daily GROUP BY ticker""", "daily news")
def _(v):
    from bellwether.operators.ranks import with_scalars
    g = v.daily.groupBy("ticker").agg(
        F.avg(F.when(F.col("close") > F.col("open"), 1.0).otherwise(0.0)).alias("test_acc"), corr("open", "close").alias("test_mcc"),
        F.sum(F.col("close") - F.col("open")).alias("always_profit"), F.min(F.col("close") / F.col("open")).alias("p_value"))
    one = g.agg(F.collect_list(F.struct(F.col("ticker").alias("model"), "test_acc", "test_mcc")).alias("metrics"),
                F.collect_list(F.struct(F.col("ticker").alias("model"), "always_profit", "p_value")).alias("simulation"))
    one = with_scalars(one, v.news.agg(F.count(F.lit(1)).alias("n_test")))
    p = SK.scratch(v.spark, "metrics")
    SK.write_metrics(one, p)
    return RD.read_result_json(v.spark, p)


@query("append_missing", "SNK4 JN5", "ticker:s date:d close:f", "SELECT ticker, date, close FROM bars", "bars")
def _(v):
    # two loads that overlap, the second one run twice
    p = SK.scratch(v.spark, "append")
    b = v.bars.select("ticker", "date", "close")
    SK.append_missing(b.filter("date < date'1999-01-01'"), p, ["ticker", "date"])
    for _i in range(2):
        SK.append_missing(b.filter("date >= date'1998-01-01'"), p, ["ticker", "date"])
    return v.spark.read.parquet(p)


@query("stage_cached", "SNK5", "ticker:s date:d score:f", "SELECT ticker, date, score FROM scores", "scores")
def _(v):
    p = SK.scratch(v.spark, "stage")
    SK.stage_cached(v.spark, p, lambda: v.scores)
    return SK.stage_cached(v.spark, p, lambda: v.scores.limit(0))
