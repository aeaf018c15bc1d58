"""Joins: as-of, bar offsets, calendar fill, alignment checks and keyed enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enrich(df: DataFrame, lookup: DataFrame, on: list[str], value: str, default) -> DataFrame:
    """Left lookup with a default for missing keys; Spark picks the join by measured sizes."""
    return df.join(lookup.select(*on, value), on, "left").withColumn(
        value, F.coalesce(F.col(value), F.lit(default)))


def asof_join(probes: DataFrame, bars: DataFrame, at: str, bar_ts: str, values: list[str],
              direction: str = "backward", by: str = "ticker", prefix: str = "") -> DataFrame:
    """Attach to each probe the last bar with ``bar_ts <= at`` (or the first with ``>=``).

    Work is keyed by (ticker, day), not by ticker, so a ticker with a third of all rows is
    spread over its days; inside a day only distinct probe times are sorted. What must
    cross midnight is one bar per (ticker, day), carried by a small second window.
    """
    back = direction == "backward"
    cols = [bar_ts] + [c for c in values if c != bar_ts]
    b = bars.select(by, F.col(bar_ts).alias("_t"), F.struct(*cols).alias("_v"), F.lit(0).alias("_side"))
    q = probes.select(by, F.col(at).alias("_t")).filter("_t is not null").distinct().select(
        by, "_t", F.lit(None).cast(b.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_side"))
    u = q.unionByName(b).withColumn("_d", F.to_date("_t"))

    def order(c: str) -> Column:
        return F.asc(c) if back else F.desc(c)

    inside = Window.partitionBy(by, "_d").orderBy(order("_t"), "_side").rowsBetween(
        Window.unboundedPreceding, 0)
    hits = u.withColumn("_in", F.last("_v", ignorenulls=True).over(inside)).filter("_side = 1")
    edge = F.max_by if back else F.min_by
    days = u.groupBy(by, "_d").agg(edge("_v", F.when(F.col("_v").isNotNull(), F.col("_t"))).alias("_e"))
    across = Window.partitionBy(by).orderBy(order("_d")).rowsBetween(Window.unboundedPreceding, -1)
    carry = days.select(by, "_d", F.last("_e", ignorenulls=True).over(across).alias("_c"))
    hits = hits.join(carry, [by, "_d"]).select(
        F.col(by).alias("_by"), "_t", F.coalesce("_in", "_c").alias("_hit"))
    out = probes.join(hits, (F.col(by) == F.col("_by")) & (F.col(at) == F.col("_t")), "left")
    return out.withColumns({prefix + c: F.col(f"_hit.{c}") for c in cols if prefix + c not in probes.columns}
                           ).drop("_by", "_t", "_hit")


def bar_offsets(bars: DataFrame, offsets: list[int], value: str = "close") -> DataFrame:
    """Value at bar number + h of the same (ticker, day), one column per offset; null across
    the day's edge. Lag and lead over the day replace one self-join per offset."""
    w = Window.partitionBy("ticker", "day").orderBy("bar_ix")
    return bars.withColumns({
        f"{value}_{'p' if h >= 0 else 'm'}{abs(h)}": F.lead(value, h).over(w) if h >= 0 else F.lag(value, -h).over(w)
        for h in offsets})


def alignment_report(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer join on keys: how many rows match, miss a side, or differ in value."""
    x = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_ia"))
    y = b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_ib"))
    j = x.join(y, keys, "full_outer")
    return j.agg(
        F.count(F.when(F.col("_ia").isNotNull() & F.col("_ib").isNotNull(), 1)).alias("matched"),
        F.count(F.when(F.col("_ib").isNull(), 1)).alias("left_only"),
        F.count(F.when(F.col("_ia").isNull(), 1)).alias("right_only"),
        F.count(F.when(F.col("_a") != F.col("_b"), 1)).alias("differ"))


def calendar_fill(daily: DataFrame, by: str, value: str, weekdays_only: bool = True) -> DataFrame:
    """One row per natural day between a key's first and last date; missing days get 0."""
    span = daily.groupBy(by).agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    spine = span.select(by, F.explode(F.sequence("_a", "_b")).alias("date"))
    if weekdays_only:
        spine = spine.filter(F.weekday("date") < 5)
    return spine.join(daily.select(by, "date", value), [by, "date"], "left").fillna(0.0, [value])


def trials(rows: DataFrame, n: int) -> DataFrame:
    """n numbered copies of each row, for resampling."""
    return rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def prior_week_counts(items: DataFrame, days: int = 7) -> DataFrame:
    """How many items of the same ticker came in the ``days`` before each item.

    The lower bound is inclusive and earlier means earlier in (time, id) order. Counting
    needs no pairs: the answer is the number of items before this one minus the number
    before its lower bound. Items are counted per (ticker, time) first; running totals go
    over those counts within a day and over days, and only equal times are ranked by id.
    """
    key = items.select("ticker", F.col("published_at").alias("_t"), "news_id")
    back = F.col("_t") - F.expr(f"interval {days} days")
    counts = key.groupBy("ticker", "_t").agg(F.count(F.lit(1)).alias("_n"))
    marks = counts.unionByName(counts.select("ticker", back.alias("_t"), F.lit(0).cast("bigint").alias("_n")))
    marks = marks.groupBy("ticker", "_t").agg(F.sum("_n").alias("_n")).withColumn("_d", F.to_date("_t"))
    inside = Window.partitionBy("ticker", "_d").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("ticker").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    per_day = marks.groupBy("ticker", "_d").agg(F.sum("_n").alias("_m")).select(
        "ticker", "_d", F.coalesce(F.sum("_m").over(across), F.lit(0)).alias("_before"))
    at = marks.withColumn("_p", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(per_day, ["ticker", "_d"]).select(
        "ticker", "_t", (F.col("_p") + F.col("_before")).alias("_pos"))
    low = at.withColumnRenamed("_pos", "_low").withColumnRenamed("_t", "_from")
    span = counts.withColumn("_from", back).join(at, ["ticker", "_t"]).join(low, ["ticker", "_from"]).select(
        "ticker", "_t", (F.col("_pos") - F.col("_low")).alias("_earlier"))
    same = Window.partitionBy("ticker", "_t").orderBy("news_id")
    ranked = key.withColumn("_r", F.row_number().over(same) - 1)
    return ranked.join(span, ["ticker", "_t"]).select("ticker", "news_id", (F.col("_earlier") + F.col("_r")).alias("n7"))
