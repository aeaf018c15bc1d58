"""Trading calendar and session alignment.

The calendar has one row per trading date, so it is bounded by time and not by data
volume: the day map below holds one row per natural date (about 37,000 per century) and
is broadcast. News rows are never shuffled to find their session.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calendar(bars: DataFrame, open_minute: int = 540, close_minute: int = 930) -> DataFrame:
    """Distinct dates with dense position and session open and close times."""
    days = bars.select(F.col("date").alias("td")).distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("td")
    at = "timestampadd(MINUTE, {}, cast(td as timestamp_ntz))"
    return days.select(
        "td", (F.row_number().over(w) - 1).alias("pos"),
        F.expr(at.format(open_minute)).alias("open_ts"),
        F.expr(at.format(close_minute)).alias("close_ts"))


def day_map(cal: DataFrame, first_day: str = "1970-01-01") -> DataFrame:
    """Each natural date with the first session on or after it (``s0``) and the first one
    after it (``s1``): every session covers the dates since the session before."""
    w = Window.partitionBy(F.lit(0)).orderBy("td")
    session = F.struct("td", "pos", "open_ts", "close_ts")
    c = cal.select("td", session.alias("s0"), F.lead(session).over(w).alias("next"),
                   F.coalesce(F.date_add(F.lag("td").over(w), 1), F.lit(first_day).cast("date")).alias("since"))
    c = c.select("td", "s0", "next", F.explode(F.sequence("since", "td")).alias("d"))
    return c.select("d", "s0", F.when(F.col("d") == F.col("td"), F.col("next")).otherwise(F.col("s0")).alias("s1"))


def assign_session(news: DataFrame, cal: DataFrame, ts: str = "published_at") -> DataFrame:
    """``eff``: first session whose open is at or after the item. ``info``: first session
    whose close is. Null after the last one. ``fresh``: both are the same session, so the
    item is not yet in any close. ``in_session``: published at or after the open of ``info``."""
    m = F.broadcast(day_map(cal))
    j = news.join(m, F.to_date(ts) == F.col("d"), "left")
    eff: Column = F.when(F.col(ts) <= F.col("s0.open_ts"), F.col("s0")).otherwise(F.col("s1"))
    info: Column = F.when(F.col(ts) <= F.col("s0.close_ts"), F.col("s0")).otherwise(F.col("s1"))
    j = j.withColumns({"_e": eff, "_i": info})
    return j.withColumns({
        "eff": F.col("_e.td"), "info": F.col("_i.td"),
        "fresh": F.col("_e.td") == F.col("_i.td"),
        "eff_pos": F.col("_e.pos"), "info_pos": F.col("_i.pos"),
        "in_session": F.col(ts) >= F.col("_i.open_ts"),
    }).drop("d", "s0", "s1", "_e", "_i")


def lookback(prices: DataFrame, daily: DataFrame, item: Column, days: int) -> DataFrame:
    """For each price row, the daily items of the ``days`` natural days ending at its
    previous session, as an array ``items`` of structs with a day number ``dn``.

    Items and price rows of a ticker meet in one range frame, so each item crosses the
    network once, not once per day of every window. Both are at most one row per
    (ticker, day).
    """
    w = Window.partitionBy("ticker").orderBy("date")
    p = prices.select("ticker", "date", F.lag("date", 1).over(w).alias("a"), F.lag("date", 2).over(w).alias("pp"))
    p = p.filter("pp is not null").select(
        "ticker", F.unix_date("a").alias("dn"), F.struct("date", "a", "pp").alias("_row"))
    d = daily.select("ticker", F.unix_date("date").alias("dn"), item.alias("_item"))
    u = d.unionByName(p, allowMissingColumns=True)
    f = Window.partitionBy("ticker").orderBy("dn").rangeBetween(-(days - 1), 0)
    # collect_list skips the nulls that price rows carry
    return u.withColumn("items", F.collect_list("_item").over(f)).filter("_row is not null").select(
        "ticker", "_row.*", "dn", "items")


def _slots(items: str, dn: str, days: int, empty: Column) -> Column:
    """The vectors of the last ``days`` days, oldest first, empty where a day has none."""
    m = F.map_from_entries(F.transform(items, lambda x: F.struct(x["dn"], x["vec"])))
    return F.transform(F.sequence(F.col(dn) - (days - 1), F.col(dn)),
                       lambda d: F.coalesce(F.try_element_at(m, d), empty))


def calendar_windows(prices: DataFrame, daily: DataFrame, dim: int, mid: int = 7, long: int = 30) -> DataFrame:
    """Natural-day windows before each session D with previous sessions a and pp: ``short``
    is the mean of day means over (pp, a], ``mid`` and ``long`` the day vectors ending at a."""
    from bellwether.functions.vectors import fold_sum, zeros

    w = lookback(prices, daily, F.struct(F.unix_date("date").alias("dn"), "vec"), long)
    recent = F.filter("items", lambda x: x["dn"] > F.unix_date("pp"))
    w = w.withColumn("_s", F.transform(recent, lambda x: x["vec"]))
    n = F.size("_s")
    return w.withColumns({
        "short": F.when(n > 0, F.transform(fold_sum(F.col("_s"), dim), lambda x: x / n)).otherwise(zeros(dim)),
        "n_short": n, "n_long": F.size("items"),
        "mid": _slots("items", "dn", mid, zeros(dim)), "long": _slots("items", "dn", long, zeros(dim)),
    }).drop("_s", "items", "dn")


def _with_positions(bars: DataFrame, cal: DataFrame) -> DataFrame:
    """Bars with their calendar position; the calendar is one row per date."""
    return bars.join(F.broadcast(cal.select(F.col("td").alias("date"), "pos")), "date")


def overnight_buckets(bars: DataFrame, cal: DataFrame, over: DataFrame) -> DataFrame:
    """Give each (ticker, position) bucket to the first bar of its ticker at or after it,
    which is the bar whose window (previous bar, bar] contains it."""
    b = _with_positions(bars, cal).select("ticker", "pos", F.col("date").alias("_bar"))
    u = over.unionByName(b, allowMissingColumns=True)
    # from the last position backwards, so that the frame only grows
    ahead = Window.partitionBy("ticker").orderBy(F.desc("pos")).rangeBetween(Window.unboundedPreceding, 0)
    return u.withColumn("date", F.max_by("_bar", F.when(F.col("_bar").isNotNull(), -F.col("pos"))).over(ahead)).filter(
        F.col("_bar").isNull() & F.col("date").isNotNull()).drop("_bar")


def running_sums(rows: DataFrame, dim: int, vec: str = "vec") -> DataFrame:
    """Rows (ticker, pos, ...) with ``upto``: the element-wise sum of the vectors of the ticker at this position and all
    before it. A null vector adds nothing. Each vector is added once, whatever is asked of the sums later."""
    from bellwether.functions.vectors import as_dense, zeros

    w = Window.partitionBy("ticker").orderBy("pos").rangeBetween(Window.unboundedPreceding, 0)
    v = as_dense(F.coalesce(F.col(vec).cast("array<double>"), zeros(dim)))
    return rows.withColumn("upto", vector_to_array(Summarizer.metrics("sum").summary(v).over(w)["sum"]))


def session_windows(bars: DataFrame, cal: DataFrame, over: DataFrame, info: DataFrame, dim: int,
                    mid: int = 7, long: int = 30, items: bool = False) -> DataFrame:
    """Session-count windows: ``short`` is the mean of the overnight buckets since the
    ticker's previous bar, ``mid`` and ``long`` the info buckets of the sessions before,
    with ``mid_mean`` and ``long_mean`` dividing by all slots (empty ones count as zero).

    ``over`` and ``info`` are (ticker, pos, vec), one row per position. A window is the difference of two running sums,
    so no vectors are collected; with ``items`` the buckets of the long window are returned as well.
    """
    from bellwether.functions.vectors import mean_of, zeros

    short = overnight_buckets(bars, cal, over).groupBy("ticker", "date").agg(mean_of("vec").alias("_short"))
    b = _with_positions(bars, cal).select("ticker", "pos", F.struct("date").alias("_row"))
    by = Window.partitionBy("ticker").orderBy("pos")
    u = running_sums(info.select("ticker", "pos", "vec").unionByName(b, allowMissingColumns=True), dim)

    def before(c: Column, back: int) -> Column:
        """A running value as it stood ``back`` positions ago; the frame only grows."""
        return F.last(c).over(by.rangeBetween(Window.unboundedPreceding, -back))

    count = F.count("vec").over(by.rangeBetween(Window.unboundedPreceding, 0))
    u = u.withColumn("_n", count)
    # counts and sums apart, so that who asks for counts alone adds no vectors
    u = u.withColumns({f"{name}{c}": before(F.col(c), back) for name, back in (("_end_", 1), ("_mid_", mid + 1), ("_long_", long + 1)) for c in ("_n", "upto")})
    u = u.withColumn("_first", F.min("_row.date").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    if items:
        item = F.when(F.col("vec").isNotNull(), F.struct("pos", "vec"))
        u = u.withColumn("items", F.collect_list(item).over(by.rangeBetween(-long, -1)))
    w = u.filter("_row is not null and _row.date > _first").withColumn("date", F.col("_row.date")).join(short, ["ticker", "date"], "left")

    def count_since(start: str) -> Column:
        return F.coalesce(F.col("_end__n"), F.lit(0)) - F.coalesce(F.col(f"{start}__n"), F.lit(0))

    def mean(start: str, slots: int) -> Column:
        apart = F.zip_with("_end_upto", F.coalesce(F.col(f"{start}_upto"), zeros(dim)), lambda x, y: (x - y) / slots)
        return F.when(count_since(start) > 0, apart).otherwise(zeros(dim))

    return w.select(
        "ticker", "date", "pos", F.coalesce("_short", zeros(dim)).alias("short"),
        F.col("_short").isNotNull().alias("has_short"),
        (F.col("_short").isNotNull() | (count_since("_long") > 0)).alias("has_any"),
        count_since("_mid").alias("n_mid"), count_since("_long").alias("n_long"), *(["items"] if items else []),
        mean("_mid", mid).alias("mid_mean"), mean("_long", long).alias("long_mean"))


def event_id_windows(prices: DataFrame, events: DataFrame, mid: int = 7, width: int = 64) -> DataFrame:
    """Event numbers of the short window and of each of the last ``mid`` days, cut or padded
    with 0 to ``width``. Only the first ``width`` events of a day can appear, so each task
    drops the rest before the exchange."""
    d = events.withColumn("date", F.to_date("published_at"))
    w = Window.partitionBy("ticker", "date").orderBy("published_at", "news_id")
    d = d.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= width)
    day = d.groupBy("ticker", "date").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_k", "event_id"))), lambda x: x["event_id"].cast("long")).alias("ids"))
    lb = lookback(prices, day, F.struct(F.unix_date("date").alias("dn"), "ids"), mid)

    def fit(ids: Column) -> Column:
        return F.slice(F.concat(ids, F.array_repeat(F.lit(0).cast("long"), width)), 1, width)

    ordered = F.sort_array("items")
    recent = F.filter(ordered, lambda x: x["dn"] > F.unix_date("pp"))
    m = F.map_from_entries(F.transform("items", lambda x: F.struct(x["dn"], x["ids"])))
    none = F.array().cast("array<long>")
    return lb.select(
        "ticker", "date", fit(F.flatten(F.transform(recent, lambda x: x["ids"]))).alias("short_ids"),
        F.transform(F.sequence(F.col("dn") - (mid - 1), F.col("dn")),
                    lambda q: fit(F.coalesce(F.try_element_at(m, q), none))).alias("mid_ids"))


def overnight_features(bars: DataFrame, cal: DataFrame, news: DataFrame) -> DataFrame:
    """Mean sentiment and counts of the news between the previous close and the open of each
    session; 0 without news. Such news has its first open and first close in the same session."""
    s = assign_session(news, cal).filter("fresh and eff_pos > 0")
    g = s.groupBy("ticker", F.col("eff").alias("date")).agg(
        F.avg("sent").alias("_s"), F.count(F.lit(1)).alias("_n"))
    return bars.join(g, ["ticker", "date"], "left").withColumns({
        "on_sent": F.coalesce("_s", F.lit(0.0)), "on_cnt": F.coalesce("_n", F.lit(0)),
    }).withColumn("on_ln", F.log1p("on_cnt")).drop("_s", "_n")


def decompose_move(panel: DataFrame) -> DataFrame:
    """Close to close, overnight gap, open to close."""
    return panel.withColumns({"cc": F.col("ret"), "oc": F.col("close") / F.col("open") - 1})


def news_features(prices: DataFrame, daily: DataFrame, dim: int) -> DataFrame:
    """Counts, sentiment and novelty of the news before each session.

    ``daily`` is (ticker, date, n, sent, vec) with day means; means over longer windows
    weigh days by their counts.
    """
    from bellwether.functions.vectors import cosine, zeros

    lb = lookback(prices, daily, F.struct(F.unix_date("date").alias("dn"), "n", "sent", "vec"), 30)
    lb = lb.withColumns({
        "_short": F.filter("items", lambda x: x["dn"] > F.unix_date("pp")),
        "_week": F.filter("items", lambda x: x["dn"] > F.col("dn") - 7), "_month": F.col("items")})

    def total(c: str) -> Column:
        return F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["n"])

    def sent(c: str, n: str) -> Column:
        s = F.aggregate(c, F.lit(0.0), lambda s, x: s + x["n"] * x["sent"])
        return F.when(F.col(n) > 0, s / F.col(n)).otherwise(0.0)

    def vec(c: str) -> Column:
        return F.aggregate(c, zeros(dim), lambda s, x: F.zip_with(s, x["vec"], lambda a, b: a + b * x["n"]))

    lb = lb.withColumns({"cnt_short": total("_short"), "cnt_week": total("_week"), "cnt_month": total("_month"),
                         "_vs": vec("_short"), "_vm": vec("_month")})
    both = (F.col("cnt_short") > 0) & (F.col("cnt_month") > 0)
    return lb.select(
        "ticker", "date", "cnt_short", "cnt_week", "cnt_month",
        (F.col("cnt_short") / (F.col("cnt_month") / 30.0 * 2 + 1.0)).alias("abn_vol"),
        sent("_short", "cnt_short").alias("sent_short"), sent("_week", "cnt_week").alias("sent_week"),
        # cosine ignores scale, so sums serve as well as means
        F.when(both, 1.0 - cosine("_vs", "_vm")).otherwise(0.0).alias("novelty"))
