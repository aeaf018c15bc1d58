"""Readers with explicit columns: pruning and filters reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bellwether.functions.text import id_time, strip_suffix

OHLCV = ("open", "high", "low", "close", "volume")


def read_bars(spark: SparkSession, path: str, date: str = "date", tickers: list[str] | None = None) -> DataFrame:
    """Daily bars as doubles; a ticker list becomes a pushed-down filter."""
    d = spark.read.parquet(path)
    if tickers is not None:
        d = d.filter(F.col("ticker").isin(tickers))
    return d.select("ticker", F.to_date(date).alias("date"), *[F.col(c).cast("double").alias(c) for c in OHLCV])


def read_news(spark: SparkSession, path: str, date_from: str, columns: list[str]) -> DataFrame:
    """News files whose path carries a date at or after ``date_from``; others are not opened."""
    day = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2})", 1)
    return spark.read.parquet(path).filter(day >= date_from).select(*columns)


def read_bars_5m(spark: SparkSession, path: str) -> DataFrame:
    """Intraday bars of a directory. Files without the needed columns read as null there and
    drop out; exchange suffixes are cut; the session day is added."""
    need = ["symbol", "datetime", "open", "high", "low", "close"]
    d = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(path)
    return d.dropna(subset=need).select(
        strip_suffix("symbol").alias("ticker"), F.col("datetime").alias("ts"), F.to_date("datetime").alias("day"),
        *[F.col(c).cast("double").alias(c) for c in OHLCV])


def parse_id_time(df: DataFrame, key: str = "news_id") -> DataFrame:
    """Time coded in the id; rows with a malformed id are dropped."""
    return df.withColumn("ts", id_time(key)).filter("ts is not null")


def read_equity(spark: SparkSession, path: str) -> DataFrame:
    """An equity CSV with two columns under any header, possibly an unnamed first one."""
    d = spark.read.csv(path, header=True, schema="day string, equity double", enforceSchema=True)
    return d.select(F.col("day").try_cast("date").alias("date"), "equity").dropna()


def read_result_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested result files (metrics[], simulation[]) as one row per model."""
    m = "struct<model:string,test_acc:double,test_mcc:double>"
    s = "struct<model:string,always_profit:double,p_value:double>"
    d = spark.read.json(path, schema=f"n_test long, metrics array<{m}>, simulation array<{s}>")
    metrics = d.select("n_test", F.inline("metrics"))
    return metrics.join(d.select(F.inline("simulation")), "model", "left")
