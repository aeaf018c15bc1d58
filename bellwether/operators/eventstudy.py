"""Event studies: does news lead or follow the price?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bellwether.functions.scalar import clock
from bellwether.operators import ranks as R
from bellwether.operators.aggregates import corr, guarded_corr, share
from bellwether.operators.joins import asof_join, bar_offsets
from bellwether.operators.windows import by_ticker, rolling_median_volume, session_close

TINY = 1e-6  # weaker sentiment counts as none


def same_sign(a: Column, b: Column) -> Column:
    return F.signum(a) == F.signum(b)


def _prices_at(news: DataFrame, bars: DataFrame, offsets: dict[str, int], direction: str) -> DataFrame:
    """Bar time and close at several second offsets from each item, in one as-of join."""
    o = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("secs")) for n, s in offsets.items()])
    p = news.select("item", "ticker", "t", F.inline(o)).withColumn("at", F.expr("timestampadd(SECOND, secs, t)"))
    hit = asof_join(p.select("item", "ticker", "name", "at"), bars, "at", "ts", ["close"], direction, prefix="bar_")
    aggs = []
    for n in offsets:
        here = F.col("name") == n
        aggs += [F.max(F.when(here, F.col("bar_close"))).alias(f"px_{n}"), F.max(F.when(here, F.col("bar_ts"))).alias(f"ts_{n}")]
    return hit.groupBy("item").agg(*aggs)


def forward_return(news: DataFrame, bars: DataFrame, horizons: dict[str, int]) -> DataFrame:
    """Strictly forward test: enter at the first bar one second after the item, leave at the
    first bar at each horizon (minutes) or at the session close, on the same day."""
    n = news.filter(F.abs("sent") > TINY).select(F.col("news_id").alias("item"), "ticker", "sent", F.col("published_at").alias("t"))
    px = _prices_at(n, bars, {"entry": 1, **{h: m * 60 for h, m in horizons.items()}}, "forward")
    close = session_close(bars).select(F.col("ticker").alias("_t"), F.col("day").alias("_d"), "last_close")
    j = n.join(px, "item").withColumn("_day", F.to_date("ts_entry"))
    j = j.join(close, (F.col("ticker") == F.col("_t")) & (F.col("_day") == F.col("_d")), "left")
    outs = [F.struct(F.lit(h).alias("horizon"), F.when(
        F.to_date("ts_entry") == F.to_date(F.expr(f"timestampadd(MINUTE, {m}, t)")),
        F.col(f"px_{h}") / F.col("px_entry") - 1).alias("r")) for h, m in horizons.items()]
    outs.append(F.struct(F.lit("to_close").alias("horizon"), (F.col("last_close") / F.col("px_entry") - 1).alias("r")))
    return j.select("sent", F.inline(F.array(*outs))).filter("r is not null").groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), share(same_sign(F.col("sent"), F.col("r"))).alias("acc"),
        corr("sent", "r").alias("corr"))


def before_after(news: DataFrame, bars: DataFrame, shifts: dict[str, int]) -> DataFrame:
    """Correlation of sentiment with the hour before and the hour after, under several guesses
    of the time zone (hours); a stronger 'before' means the news follows the price."""
    z = F.array(*[F.struct(F.lit(n).alias("zone"), F.lit(h).alias("hrs")) for n, h in shifts.items()])
    n = news.filter(F.abs("sent") > TINY).select("news_id", "ticker", "sent", "published_at", F.inline(z))
    n = n.withColumns({"t": F.expr("timestampadd(HOUR, hrs, published_at)"),
                       "item": F.concat_ws("|", F.col("news_id").cast("string"), "zone")})
    n = n.filter(F.hour("t").between(10, 14))
    after = _prices_at(n, bars, {"now": 1, "after": 3600}, "forward")
    before = _prices_at(n, bars, {"before": -3600}, "backward")
    j = n.join(after, "item").join(before, "item").withColumns({
        "rb": F.col("px_now") / F.col("px_before") - 1, "rf": F.col("px_after") / F.col("px_now") - 1})
    return j.filter("rb is not null and rf is not null").groupBy("zone").agg(
        F.count(F.lit(1)).alias("n"), corr("sent", "rb").alias("corr_before"), corr("sent", "rf").alias("corr_after"))


def _news_bars(news: DataFrame, bars: DataFrame, values: list[str], first: int, last: int) -> DataFrame:
    """Items inside the clock window with the bar that contains them, on the same day."""
    n = news.filter(clock("published_at").between(first, last)).select("news_id", "ticker", "sent", "published_at")
    j = asof_join(n, bars, "published_at", "ts", values, "backward", prefix="b_")
    return j.filter(F.to_date("b_ts") == F.to_date("published_at"))


def bar_window(news: DataFrame, bars: DataFrame, offsets: list[int], first: int = 34500, last: int = 50100,
               strong: float = 0.6) -> DataFrame:
    """Enter at the close of the containing bar, leave h bars later in the same session; with
    the move of the h bars before, and the subset of strong sentiment."""
    b = bar_offsets(bars, [h for h in offsets] + [-h for h in offsets])
    vals = ["close"] + [f"close_{s}{h}" for h in offsets for s in ("p", "m")]
    j = _news_bars(news, b, vals, first, last)
    rows = F.array(*[F.struct(F.lit(h).alias("bars"), (F.col(f"b_close_p{h}") / F.col("b_close") - 1).alias("fwd"),
                              (F.col("b_close") / F.col(f"b_close_m{h}") - 1).alias("pre")) for h in offsets])
    r = j.select("sent", F.inline(rows)).filter((F.abs("sent") > TINY) & (F.col("fwd") != 0))
    is_strong = F.abs("sent") >= strong
    hit = same_sign(F.col("sent"), F.col("fwd"))
    pre = F.coalesce(same_sign(F.col("sent"), F.col("pre")), F.lit(False))
    return r.groupBy("bars").agg(
        F.count(F.lit(1)).alias("n"), share(hit).alias("acc"), corr("sent", "fwd").alias("corr"),
        share(pre).alias("pre_acc"), F.count(F.when(is_strong, 1)).alias("n_strong"),
        F.avg(F.when(is_strong, hit.cast("int"))).alias("acc_strong"))


def volume_spike(news: DataFrame, bars: DataFrame, offsets: list[int], k: int, need: int, times: float,
                 first: int = 34500, last: int = 54000) -> DataFrame:
    """Enter at the open of the containing bar; accuracy on all items and on those whose bar
    has more than ``times`` the rolling median volume."""
    b = bar_offsets(rolling_median_volume(bars, k, need, order="ts"), offsets)
    b = b.withColumn("spike", F.coalesce(F.col("volume") > times * F.col("vmed"), F.lit(False)))
    j = _news_bars(news, b, ["open", "spike"] + [f"close_p{h}" for h in offsets], first, last)
    rows = F.array(*[F.struct(F.lit(h).alias("bars"), (F.col(f"b_close_p{h}") / F.col("b_open") - 1).alias("fwd")) for h in offsets])
    r = j.select("sent", F.col("b_spike").alias("spike"), F.inline(rows)).filter((F.abs("sent") > TINY) & (F.col("fwd") != 0))
    hit = same_sign(F.col("sent"), F.col("fwd"))
    return r.groupBy("bars").agg(
        F.count(F.lit(1)).alias("n"), share(hit).alias("acc"), F.count(F.when(F.col("spike"), 1)).alias("n_spike"),
        F.avg(F.when(F.col("spike"), hit.cast("int"))).alias("acc_spike"))


def lead_lag(panel: DataFrame, sent: DataFrame, at_least: int = 30) -> DataFrame:
    """Sentiment of a day against the return of the same day, the next day and, lagged, today;
    sign accuracy without flat days; and by size of the move."""
    w = by_ticker()
    d = panel.join(sent.select("ticker", "date", "sent"), ["ticker", "date"], "left").withColumns({
        "sent_prev": F.lag("sent").over(w), "ret_next": F.lead("ret").over(w)})
    size = (F.when(F.abs("ret") < 0.01, "0-1%").when(F.abs("ret") < 0.03, "1-3%")
            .when(F.abs("ret") < 0.06, "3-6%").otherwise("6%+"))
    pairs = F.array(*[F.struct(F.lit(n).alias("test"), F.col(a).alias("s"), b.alias("r")) for n, a, b in (
        ("same_day", "sent", F.col("ret")), ("next_day", "sent", F.col("ret_next")), ("prev_sent", "sent_prev", F.col("ret")))])
    by_size = F.array(F.struct(F.concat(F.lit("size_"), size).alias("test"), F.col("sent_prev").alias("s"),
                               F.when(F.col("sent_prev").isNotNull(), F.signum("ret")).alias("r")))
    r = d.select(F.inline(F.concat(pairs, by_size)))
    both = F.col("s").isNotNull() & F.col("r").isNotNull()
    return r.filter(both).groupBy("test").agg(
        F.count(F.lit(1)).alias("n"), guarded_corr("s", "r", at_least).alias("corr"),
        F.avg(F.when(F.col("r") != 0, same_sign(F.col("s"), F.col("r")).cast("int"))).alias("acc"))


def preopen_test(overnight: DataFrame) -> DataFrame:
    """Overnight sentiment against the session move and against the gap it should explain."""
    pairs = F.array(*[F.struct(F.lit(n).alias("move"), F.col(c).alias("r")) for n, c in (("open_close", "oc"), ("gap", "gap"))])
    r = overnight.filter("on_cnt > 0").select("on_sent", F.inline(pairs)).filter("r is not null and r <> 0")
    return r.groupBy("move").agg(F.count(F.lit(1)).alias("n"), corr("on_sent", "r").alias("corr"),
                                 share(same_sign(F.col("on_sent"), F.col("r"))).alias("acc"))


def magnitude_test(overnight: DataFrame) -> DataFrame:
    """News counts against the size of moves, and mean gap on busy and on quiet nights."""
    v = overnight.filter("gap is not null")
    q = R.exact_quantiles(v, "on_cnt", [0.5, 0.9]).groupBy(F.lit(1).alias("_o")).agg(
        F.max(F.when(F.col("prob") == 0.5, F.col("q"))).alias("q50"), F.max(F.when(F.col("prob") == 0.9, F.col("q"))).alias("q90"))
    j = R.with_scalars(v, q.drop("_o")).withColumns({"ag": F.abs("gap"), "ao": F.abs("oc"), "cnt": F.col("on_cnt").cast("double")})
    return j.agg(
        F.count(F.lit(1)).alias("n"), corr("cnt", "ag").alias("corr_gap"), corr("cnt", "ao").alias("corr_intraday"),
        F.stddev_samp("gap").alias("sd_gap"), F.stddev_samp("oc").alias("sd_intraday"),
        F.avg(F.when(F.col("cnt") >= F.col("q90"), F.col("ag"))).alias("gap_busy"),
        F.avg(F.when(F.col("cnt") <= F.col("q50"), F.col("ag"))).alias("gap_quiet"))


def flow_event(flows: DataFrame, panel: DataFrame) -> DataFrame:
    """Does yesterday's net flow give today's direction? All rows, and the extreme deciles."""
    w = by_ticker()
    d = flows.withColumn("net", F.col("buy") - F.col("sell")).withColumns({
        "f1": F.lag("net").over(w), "f5": F.when(F.count("net").over(w.rowsBetween(-5, -1)) == 5, F.sum("net").over(w.rowsBetween(-5, -1)))})
    d = d.join(panel.filter("ret is not null").select("ticker", "date", "ret"), ["ticker", "date"])
    out = None
    for name in ("f1", "f5"):
        r = R.rank_deciles(d.filter(F.col(name).isNotNull()).select("ticker", "date", "ret", F.col(name).alias("f")), "f", ["ticker", "date"])
        ok = F.signum("f") == F.when(F.col("ret") > 0, 1).otherwise(-1)
        up = (F.col("ret") > 0).cast("int")
        ext = F.col("decile").isin(0, 9)
        t = r.agg(F.lit(name).alias("flow"), F.count(F.lit(1)).alias("n"), share(ok).alias("acc"),
                  F.avg(F.when(F.col("decile") == 9, up)).alias("up_top"), F.avg(F.when(F.col("decile") == 0, up)).alias("up_bottom"),
                  F.avg(F.when(ext, ok.cast("int"))).alias("acc_extreme"))
        out = t if out is None else out.unionByName(t)
    return out
