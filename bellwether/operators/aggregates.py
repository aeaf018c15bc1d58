"""Grouped statistics. Plain aggregates combine map-side, so a hot group costs one partial
row per task; whole-table and large-group medians go through ``ranks``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bellwether.functions import vectors as V
from bellwether.functions.scalar import clock, month_key
from bellwether.operators import ranks as R


def share(cond: Column) -> Column:
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def daily_news_mean(scored: DataFrame, day: Column) -> DataFrame:
    """Mean score and row count per (ticker, date); rows without a score are counted too."""
    return scored.groupBy("ticker", day.alias("date")).agg(
        F.avg("sent").alias("sent"), F.count(F.lit(1)).alias("cnt"))


def news_stats(news: DataFrame, tokens: DataFrame, cutoff: str) -> DataFrame:
    """One row: counts, span, token-count mean / median / max, eligible share."""
    d = news.select("news_id", "ticker", F.to_date("published_at").alias("date")).join(
        tokens.select("news_id", F.size("toks").alias("n_tok")), "news_id")
    return d.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("tickers"),
        F.min("date").alias("first_day"), F.max("date").alias("last_day"),
        F.avg("n_tok").alias("tok_mean"),
        F.percentile("n_tok", F.lit(0.5)).alias("tok_p50"),  # few distinct values: text lengths
        F.max("n_tok").alias("tok_max"),
        share(F.col("date") < F.lit(cutoff).cast("date")).alias("eligible"))


def split_stats(panel: DataFrame) -> DataFrame:
    """Days, span, up rate and return deviation per split."""
    return panel.groupBy("split").agg(
        F.count(F.lit(1)).alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
        share(F.col("ret") > 0).alias("up_rate"), F.stddev_samp("ret").alias("ret_std"))


def bucket_stats(items: DataFrame, keys: list[str]) -> DataFrame:
    """Ten statistics of the news in each (ticker, session) bucket."""
    s = F.coalesce("sent", F.lit(0.0))
    return items.groupBy(*keys).agg(
        F.avg(s).alias("sent_mean"), F.max(F.abs(s)).alias("sent_absmax"),
        F.avg("nov").alias("nov_mean"), F.max("nov").alias("nov_max"),
        F.count(F.lit(1)).alias("n"), F.avg(F.log1p("n7")).alias("ln_n7"),
        F.avg("simfrac").alias("simfrac"), F.min(s).alias("sent_min"), F.max(s).alias("sent_max"))


DAY_TEXT_CHARS = 1_000_000


def joined_text(news: DataFrame, day: Column, sep: str = " . ", part_chars: int = DAY_TEXT_CHARS) -> DataFrame:
    """Texts of a (ticker, date) in time order, joined into one document.

    A document is kept whole as numbered parts: a part has the texts that begin within one
    stretch of ``part_chars`` characters of it, so that a very busy day is neither one row nor one
    task. Parts put together with ``sep`` are the whole document. Only keys and lengths are summed
    up; each text is moved once.
    """
    size = F.char_length(F.coalesce("title", F.lit(""))) + len(sep)
    keys = news.select("news_id", "ticker", day.alias("date"), "published_at", size.alias("_size"))
    r = R.running_totals(keys, [F.asc(c) for c in ("ticker", "date", "published_at", "news_id")], {"_upto": "_size"})
    r = r.withColumn("_from", F.col("_upto") - F.col("_size"))
    first = r.groupBy("ticker", "date").agg(F.min("_from").alias("_first"))
    r = r.join(first, ["ticker", "date"]).withColumn("part", F.floor((F.col("_from") - F.col("_first")) / part_chars))
    item = F.struct("rank", F.coalesce("title", F.lit("")).alias("title"))
    return r.join(news.select("news_id", "title"), "news_id").groupBy("ticker", "date", "part").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["title"]), sep).alias("doc_text"))


def small_caps(caps: DataFrame) -> DataFrame:
    """Median cap per ticker (one value per session, so bounded) against the cross-section median."""
    m = caps.groupBy("ticker").agg(F.percentile("market_cap", F.lit(0.5)).alias("medcap"))
    x = R.exact_quantiles(m, "medcap", [0.5]).select(F.col("q").alias("xmed"))
    return R.with_scalars(m, x).withColumn("small", F.col("medcap") <= F.col("xmed"))


def point_in_time_small(bars: DataFrame, caps: DataFrame) -> DataFrame:
    """Cap membership per (ticker, month) without look-ahead in the price: median share count
    times close, monthly median, compared with that month's cross-section median."""
    ov = caps.join(bars.select("ticker", "date", "close"), ["ticker", "date"]).filter(
        "market_cap > 0 and close > 0")
    shares = ov.groupBy("ticker").agg(
        F.percentile(F.col("market_cap") / F.col("close"), F.lit(0.5)).alias("shares"))
    m = (bars.join(shares, "ticker").groupBy("ticker", month_key("date").alias("month"))
         .agg(F.percentile(F.col("close") * F.col("shares"), F.lit(0.5)).alias("pcap")))
    x = R.exact_quantiles(m, "pcap", [0.5], by=["month"]).select("month", F.col("q").alias("xmed"))
    return m.join(F.broadcast(x), "month").withColumn("small", F.col("pcap") <= F.col("xmed"))


def pivot_mean(df: DataFrame, index: str, column: str, values: list[str], value: str) -> DataFrame:
    return df.groupBy(index).pivot(column, values).agg(F.avg(value))


def market_day_context(rows: DataFrame) -> DataFrame:
    """Per-date means over the cross-section and the share of gaps above 2 %."""
    return rows.groupBy("date").agg(
        F.avg("up5").alias("u"), F.avg("dn5").alias("d"), F.avg("hl20").alias("mv"),
        F.avg("gap").alias("mg"), F.avg("absr1_prev").alias("mr"),
        share(F.abs("gap") > 0.02).alias("fg"))


def excess_return(panel: DataFrame) -> DataFrame:
    """Return minus the cross-section mean of its date. The mean is joined back from one
    row per date, so the panel itself is not shuffled by date."""
    m = panel.groupBy("date").agg(F.avg("ret").alias("mkt"))
    return panel.join(F.broadcast(m), "date").withColumn("excess", F.col("ret") - F.col("mkt"))


def period_tables(daily: DataFrame, value: str) -> DataFrame:
    """Year, half (by row count of the daily table) and quarter: size and mean."""
    n = daily.agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    d = R.with_scalars(daily.withColumn("_r", F.row_number().over(w)), n)
    half = F.when(F.col("_r") <= F.floor(F.col("_n") / 2), "first_half").otherwise("second_half")
    quarter = F.concat(F.year("date").cast("string"), F.lit("Q"), F.quarter("date").cast("string"))
    keys = F.array(F.year("date").cast("string"), half, quarter)
    return d.withColumn("period", F.explode(keys)).groupBy("period").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total"))


def cut(c: Column | str, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins (lo, hi]; null outside."""
    x = F.col(c) if isinstance(c, str) else c
    out = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        cond = (x > lo) & (x <= hi)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def digitize(c: Column | str, edges: list[float]) -> Column:
    """Left-closed bin number: how many edges are at or below the value."""
    x = F.col(c) if isinstance(c, str) else c
    return sum(((x >= e).cast("int") for e in edges[1:]), (x >= edges[0]).cast("int"))


def conditional_rates(rows: DataFrame, more_than: int = 50) -> DataFrame:
    """UP5 / DN5 rates by gap bucket and deviation quintile, for cells with enough rows."""
    b = R.quantile_bins(rows, "std20", [0.2, 0.4, 0.6, 0.8], "vq")
    return b.withColumn("gb", digitize("gap", [-0.02, 0.0, 0.02])).groupBy("gb", "vq").agg(
        F.count(F.lit(1)).alias("n"), F.avg("up5").alias("up5"), F.avg("dn5").alias("dn5")
    ).filter(F.col("n") > more_than)


def weekday_news_rates(rows: DataFrame) -> DataFrame:
    """Hit rates by weekday (Monday 0), by news presence, and by novelty quartile."""
    w = F.concat(F.lit("weekday_"), F.weekday("date").cast("string"))
    p = F.when(F.col("n") > 0, "news").otherwise("no_news")
    base = rows.select(F.explode(F.array(w, p)).alias("slice"), "up5", "dn5")
    q = R.quantile_bins(rows.filter("n > 0"), "nov_mean", [0.25, 0.5, 0.75], "q").select(
        F.concat(F.lit("novelty_"), F.col("q").cast("string")).alias("slice"), "up5", "dn5")
    return base.unionByName(q).groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"), F.avg("up5").alias("up5"), F.avg("dn5").alias("dn5"))


def corr(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation of the rows where both exist; null when one side does not vary."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def guarded_corr(a: str, b: str, at_least: int) -> Column:
    """The same, and null when there are too few rows."""
    n = F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1))
    return F.when(n > at_least, corr(a, b))


def autocorrelation(daily: DataFrame, value: str) -> DataFrame:
    """Lag-1 correlation of a per-date series."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    return daily.withColumn("_p", F.lag(value).over(w)).filter("_p is not null").agg(
        F.count(F.lit(1)).alias("n"), corr("_p", value).alias("autocorr"))


def mcc_of(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Matthews correlation from counts; 0 when any margin is empty."""
    a, b, c, d = (x.cast("double") for x in (tp, fp, fn, tn))
    den = F.sqrt(a + b) * F.sqrt(a + c) * F.sqrt(d + b) * F.sqrt(d + c)
    return F.when(den > 0, (a * d - b * c) / F.nullif(den, F.lit(0.0))).otherwise(0.0)


def confusion(pred: DataFrame, y: Column, p: Column, by: list[str] | None = None) -> DataFrame:
    """Counts, accuracy, MCC and the majority baseline."""
    d = pred.withColumns({"_y": y, "_p": p})

    def n(a: bool, b: bool) -> Column:
        return F.count(F.when((F.col("_y") == a) & (F.col("_p") == b), 1))

    c = d.groupBy(*(by or [])).agg(n(True, True).alias("tp"), n(False, True).alias("fp"),
                                   n(True, False).alias("fn"), n(False, False).alias("tn"))
    count = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    total = F.nullif(count, F.lit(0).cast("bigint"))
    up = (F.col("tp") + F.col("fn")) / total
    return c.withColumns({"n": count, "acc": (F.col("tp") + F.col("tn")) / total,
                          "base": F.greatest(up, 1 - up),
                          "mcc": mcc_of(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))})


def exceedance_rates(bars: DataFrame, ks=(0.02, 0.03, 0.05)) -> DataFrame:
    """Share of bars whose high (low) is at least k above (below) the open."""
    d = bars.filter("open > 0 and high > 0 and low > 0")
    cols = []
    for k in ks:
        pct = int(round(k * 100))
        cols += [share(F.col("high") >= F.col("open") * (1 + k)).alias(f"UP{pct}"),
                 share(F.col("low") <= F.col("open") * (1 - k)).alias(f"DN{pct}")]
    return d.agg(*cols)


def cooccurrence(rows: DataFrame) -> DataFrame:
    both = F.col("up5") * F.col("dn5")
    return rows.agg(F.avg("up5").alias("p_up"), F.avg("dn5").alias("p_dn"), F.avg(both).alias("p_both"),
                    F.avg(F.when(F.col("up5") == 1, both)).alias("p_both_given_up"))


def monthly_counts(news: DataFrame) -> DataFrame:
    return news.groupBy(month_key("published_at").alias("month"), "ticker").count().withColumnRenamed("count", "n")


def length_histogram(tokens: DataFrame, width: int = 50) -> DataFrame:
    return tokens.groupBy((F.floor(F.size("toks") / width) * width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def granularity(news: DataFrame, ts: str = "published_at") -> DataFrame:
    """Timestamp probe: share of whole minutes and five-minute marks, and histograms."""
    t = F.col(ts)
    def one(name: Column, v: Column) -> Column:
        return F.struct(name.alias("probe"), v.cast("int").alias("v"))

    probe = F.array(
        one(F.lit("second_zero"), clock(t) % 60 == 0), one(F.lit("minute_fifth"), F.minute(t) % 5 == 0),
        *[one(F.concat(F.lit(f"{n}_"), f(t).cast("string")), F.lit(1))
          for n, f in (("hour", F.hour), ("minute", F.minute), ("weekday", F.weekday))])
    return news.select(F.inline(probe)).groupBy("probe").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("share"))


def noise_floor(panel: DataFrame, thresholds=(0.005, 0.01, 0.02, 0.03, 0.1)) -> DataFrame:
    """Share of moves smaller than each threshold: one pass, one output row per threshold."""
    r = panel.filter("ret is not null").agg(
        *[share(F.abs("ret") < t).alias(f"s{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"s{i}").alias("share"))
                     for i, t in enumerate(thresholds)])
    return r.select(F.inline(rows))


def random_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A repeatable choice of at most n rows by hashed key.

    Each partition keeps its own n best before they are merged.
    """
    from bellwether.functions.scalar import mix
    return df.withColumn("_h", mix(F.lit(1), F.col(key), seed)).orderBy("_h", key).limit(n).drop("_h")


def weighted_mean(df: DataFrame, keys: list, value: str, weight: str) -> DataFrame:
    """Scalar mean weighted by counts; null when the weights sum to zero."""
    w = F.col(weight)
    return df.groupBy(*keys).agg(
        (F.sum(F.col(value) * w) / F.nullif(F.sum(w).cast("double"), F.lit(0.0))).alias("wmean"),
        F.sum(w).alias("weight"))


def token_vector_mean(tokens: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over all tokens of a key of their word vectors (long texts weigh more).

    Counts per (key, word) come first, so the vector join sees each word once per key.
    """
    c = tokens.groupBy(*keys, "form").agg(F.count(F.lit(1)).alias("_w"))
    return V.vector_mean(c.join(words, "form"), keys, "vec", "vec", weight="_w")


def hit_rows(panel: DataFrame) -> DataFrame:
    """Tradable rows with labels and volatility features, the base of several rate tables."""
    from bellwether.operators.projections import valid_session
    from bellwether.operators.windows import range_features
    p = range_features(panel).withColumns({
        "up5": ((F.col("high") >= F.col("open") * 1.05) & (F.col("open") > 0)).cast("int"),
        "dn5": ((F.col("low") <= F.col("open") * 0.95) & (F.col("open") > 0)).cast("int")})
    return valid_session(p)


def persistence(rows: DataFrame, boundary: str, more_than: int) -> DataFrame:
    """Do tickers that hit often early also hit often late? One aggregation, both halves."""
    early = F.col("date") < F.lit(boundary).cast("date")
    g = rows.groupBy("ticker").agg(
        F.avg(F.when(early, F.col("up5"))).alias("ua"), F.avg(F.when(~early, F.col("up5"))).alias("ub"),
        F.avg(F.when(early, F.col("dn5"))).alias("da"), F.avg(F.when(~early, F.col("dn5"))).alias("db"),
        F.count(F.lit(1)).alias("n")).filter((F.col("n") > more_than) & F.col("ua").isNotNull() & F.col("ub").isNotNull())
    return g.agg(F.count(F.lit(1)).alias("tickers"), corr("ua", "ub").alias("corr_up"), corr("da", "db").alias("corr_dn"))


