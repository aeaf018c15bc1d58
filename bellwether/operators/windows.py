"""Lagged and rolling features of a panel.

Every frame ends at the previous row, so a feature of row (ticker, D) uses only rows
before D. Windows are partitioned by ticker: a bar series holds one row per session, so
the longest partition is the number of sessions of the calendar, whatever the data size.
All features of one call share one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from bellwether.functions.scalar import clip, flow_imbalance, safe_div


def by_ticker(order: str = "date") -> WindowSpec:
    return Window.partitionBy("ticker").orderBy(order)


def prior(k: int, order: str = "date") -> WindowSpec:
    """The k rows before the current one."""
    return by_ticker(order).rowsBetween(-k, -1)


def full(agg: Column, x: Column, w: WindowSpec, need: int) -> Column:
    """``agg`` over ``w`` once at least ``need`` values of ``x`` are there, else null."""
    return F.when(F.count(x).over(w) >= need, agg.over(w))


def rolling(fn, x: Column | str, k: int, need: int | None = None) -> Column:
    """A prior-row rolling aggregate; by default all k values must exist."""
    c = F.col(x) if isinstance(x, str) else x
    return full(fn(c), c, prior(k), k if need is None else need)


def numbered(df: DataFrame, order: list[Column], name: str, by: list[str] | None = None) -> DataFrame:
    """Row numbers inside ``by``; without ``by`` only for tables of bounded size."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w))


def price_panel(bars: DataFrame) -> DataFrame:
    """Previous close and date, close-to-close return, open gap, relative range, bar number."""
    w = by_ticker()
    return bars.withColumns({
        "prev_close": F.lag("close").over(w), "prev_date": F.lag("date").over(w),
        "rn": F.row_number().over(w),
    }).withColumns({
        "ret": F.col("close") / F.col("prev_close") - 1,
        "gap": F.col("open") / F.col("prev_close") - 1,
        "hl": safe_div(F.col("high") - F.col("low"), "close"),
    })


def bar_index(bars: DataFrame) -> DataFrame:
    """Number of each bar inside its (ticker, day), from 1."""
    return numbered(bars, [F.asc("ts")], "bar_ix", ["ticker", "day"])


def shift_lead(panel: DataFrame, k: int = 1) -> DataFrame:
    w = by_ticker()
    return panel.withColumns({f"close_lag{k}": F.lag("close", k).over(w),
                              f"close_lead{k}": F.lead("close", k).over(w)})


def lagged_returns(panel: DataFrame, lags=(1, 2, 3, 5, 10)) -> DataFrame:
    return panel.withColumns({f"lagret_{k}": F.lag("ret", k).over(by_ticker()) for k in lags})


def momentum(panel: DataFrame, ks=(5, 10, 20)) -> DataFrame:
    w = by_ticker()
    return panel.withColumns(
        {f"mom_{k}": F.lag("close", 1).over(w) / F.lag("close", 1 + k).over(w) - 1 for k in ks})


def volatility(panel: DataFrame, ks=(5, 10, 20)) -> DataFrame:
    return panel.withColumns({f"vol_{k}": rolling(F.stddev_samp, "ret", k) for k in ks})


def average_ratio(panel: DataFrame, ks=(5, 10, 20)) -> DataFrame:
    prev = F.lag("close").over(by_ticker())
    return panel.withColumns({f"maratio_{k}": prev / rolling(F.avg, "close", k) - 1 for k in ks})


def relative_strength(panel: DataFrame, k: int = 14) -> DataFrame:
    """Relative strength index from simple averages of past close differences."""
    d = F.col("close") - F.col("prev_close")
    p = panel.withColumns({"_up": F.greatest(d, F.lit(0.0)), "_dn": F.greatest(-d, F.lit(0.0))})
    p = p.withColumns({"_up": F.when(d.isNotNull(), F.col("_up")), "_dn": F.when(d.isNotNull(), F.col("_dn"))})
    rs = rolling(F.avg, "_up", k) / (rolling(F.avg, "_dn", k) + 1e-9)
    return p.withColumn("rsi", 100 - 100 / (1 + rs)).drop("_up", "_dn")


def range_distance(panel: DataFrame, k: int = 20) -> DataFrame:
    prev = F.lag("close").over(by_ticker())
    return panel.withColumns({"dist_hi": prev / rolling(F.max, "close", k) - 1,
                              "dist_lo": prev / rolling(F.min, "close", k) - 1})


def volume_score(panel: DataFrame, k: int = 20) -> DataFrame:
    prev = F.lag("volume").over(by_ticker())
    return panel.withColumns({
        "logvol": F.log(prev + 1),
        "volz": (prev - rolling(F.avg, "volume", k)) / (rolling(F.stddev_samp, "volume", k) + 1e-9)})


def sign_streak(panel: DataFrame, k: int = 3) -> DataFrame:
    return panel.withColumn("streak", rolling(F.sum, F.signum("ret"), k))


def buy_streak(flows: DataFrame, value: str, ks=(5, 10)) -> DataFrame:
    """How many of the last k rows were positive; a missing row counts as not positive."""
    pos = F.coalesce((F.col(value) > 0).cast("int"), F.lit(0))
    f = flows.withColumn("_rn", F.row_number().over(by_ticker()))
    # the shifted series has one row more than the series itself: its first entry is "not positive"
    return f.withColumns({
        f"streak_{k}": F.when(F.col("_rn") >= k, F.coalesce(F.sum(pos).over(prior(k)), F.lit(0)))
        for k in ks}).drop("_rn")


def flow_features(flows: DataFrame) -> DataFrame:
    """Lagged flow, rolling sums, rolling mean imbalance, rolling deviation."""
    f = flows.withColumns({"net": F.col("buy") - F.col("sell"), "imb": flow_imbalance("buy", "sell")})
    w = by_ticker()
    return f.withColumns({
        "net_l1": F.lag("net").over(w), "imb_l1": F.lag("imb").over(w),
        "net_5": rolling(F.sum, "net", 5), "net_20": rolling(F.sum, "net", 20),
        "imb_5": rolling(F.avg, "imb", 5), "imb_sd5": rolling(F.stddev_samp, "imb", 5)})


def market_lags(panel: DataFrame) -> DataFrame:
    """Equal-weight market return per date, with its lags; the daily table is one row per date."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    day = panel.filter("ret is not null").groupBy("date").agg(F.avg("ret").alias("mkt"))
    return day.withColumns({
        "mkt_lag1": F.lag("mkt", 1).over(w), "mkt_lag2": F.lag("mkt", 2).over(w),
        "mkt_mom5": F.when(F.count("mkt").over(w.rowsBetween(-5, -1)) == 5,
                           F.avg("mkt").over(w.rowsBetween(-5, -1)))})


def volatility_target(panel: DataFrame, k: int = 20) -> DataFrame:
    """Is today's move larger than the median of the k moves before it?"""
    med = rolling(lambda c: F.percentile(c, F.lit(0.5)), F.abs("ret"), k)
    return panel.withColumn("med", med).withColumn(
        "big", F.when(F.col("med").isNotNull(), F.abs("ret") > F.col("med")))


def rolling_median_volume(bars: DataFrame, k: int = 60, need: int = 10, order: str = "date") -> DataFrame:
    """Median volume of the last k rows, today included."""
    w = by_ticker(order).rowsBetween(-(k - 1), 0)
    med = F.when(F.count("volume").over(w) >= need, F.percentile("volume", F.lit(0.5)).over(w))
    return bars.withColumn("vmed", med)


def forward_return(panel: DataFrame, h: int) -> DataFrame:
    """Cumulative log price, and its change over the next h rows."""
    w = by_ticker()
    # a missing return is skipped by sum, and its own log price stays null
    logp = F.when(F.col("ret").isNotNull(),
                  F.sum(F.log1p("ret")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return panel.withColumn("logp", logp).withColumn("fwd", F.lead("logp", h).over(w) - F.col("logp"))


def hit_priors(panel: DataFrame) -> DataFrame:
    """Past share of days that reached +5 % or -5 % from the open."""
    p = panel.withColumns({
        "up5": ((F.col("high") >= F.col("open") * 1.05) & (F.col("open") > 0)).cast("int"),
        "dn5": ((F.col("low") <= F.col("open") * 0.95) & (F.col("open") > 0)).cast("int")})
    return p.withColumns({
        "u20": rolling(F.avg, "up5", 20, 10), "d20": rolling(F.avg, "dn5", 20, 10),
        "u120": rolling(F.avg, "up5", 120, 40), "d120": rolling(F.avg, "dn5", 120, 40)})


def liquidity(bars: DataFrame, k: int = 20, need: int = 10) -> DataFrame:
    return bars.withColumn("turn20", rolling(F.avg, F.col("volume") * F.col("close"), k, need))


def range_features(panel: DataFrame, k: int = 20) -> DataFrame:
    """Mean range, population deviation of returns (first return is zero), previous range and move."""
    w = by_ticker()
    r1 = F.coalesce("ret", F.lit(0.0))
    return panel.withColumns({
        "hl20": F.avg("hl").over(prior(k)),
        "std20": F.when(F.col("rn") > 3, F.stddev_pop(r1).over(prior(k))).otherwise(0.0),
        "hl_prev": F.coalesce(F.lag("hl").over(w), F.lit(0.0)),
        "absr1_prev": F.abs(F.lag(r1).over(w))})


def candle_shape(panel: DataFrame) -> DataFrame:
    """Where today opens in yesterday's range, and yesterday's body and shadows."""
    w = by_ticker()
    o, h, l, c = (F.lag(x).over(w) for x in ("open", "high", "low", "close"))
    p = panel.withColumns({"_o": o, "_h": h, "_l": l, "_c": c}).filter("_c is not null")
    rng = F.col("_h") - F.col("_l")
    pos = F.when(rng > 0, (F.col("open") - F.col("_l")) / rng).otherwise(0.5)
    return p.withColumns({
        "open_pos": clip(pos, -1.0, 2.0),
        "body": F.when(F.col("_o") > 0, (F.col("_c") - F.col("_o")) / F.col("_o")).otherwise(0.0),
        "upper": F.when(F.col("_c") > 0, (F.col("_h") - F.greatest("_o", "_c")) / F.col("_c")).otherwise(0.0),
        "lower": F.when(F.col("_c") > 0, (F.least("_o", "_c") - F.col("_l")) / F.col("_c")).otherwise(0.0),
    }).drop("_o", "_h", "_l", "_c")


def day_signals(panel: DataFrame) -> DataFrame:
    """The five per-day series that the price-window aggregates summarise."""
    p = rolling_median_volume(panel)
    v, m = F.col("volume"), F.col("vmed")
    return p.withColumns({
        "s_r1": F.coalesce("ret", F.lit(0.0)), "s_hl": F.coalesce("hl", F.lit(0.0)),
        "s_gap": F.coalesce("gap", F.lit(0.0)),
        "s_vol": clip(F.when((v > 0) & (m > 0), F.log(v / m)).otherwise(0.0), -3.0, 3.0),
        "s_hit": ((F.col("high") >= F.col("open") * 1.02) & (F.col("open") > 0)).cast("double")})


def price_window_aggregates(panel: DataFrame, spans=(5, 10, 30)) -> DataFrame:
    """Mean, population deviation, max and min of five series over prior spans, plus the last
    value: 65 columns for rows with a whole longest span, in one exchange and one sort.
    Longer spans are merged from shorter ones (``windowstates``)."""
    from bellwether.operators import windowstates as S

    names = ("r1", "hl", "gap", "vol", "hit")
    p = S.rolling_states(day_signals(panel), [f"s_{s}" for s in names], list(spans))
    cols: dict[str, Column] = {}
    for s in names:
        for k in spans:
            for label, fn in (("mean", S.mean), ("std", S.std_pop), ("max", S.high), ("min", S.low)):
                cols[f"{s}_{label}{k}"] = fn(f"s_{s}__{k}")
        cols[f"{s}_last"] = F.lag(f"s_{s}").over(by_ticker())
    return p.withColumns(cols).drop(*[f"s_{s}__{k}" for s in names for k in spans]).filter(F.col("rn") > max(spans))


def market_context(day: DataFrame) -> DataFrame:
    """Lags of the per-date context table (one row per date): rates of yesterday, 5-day means,
    3-day breadth; today's mean gap is known at the open."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")

    def mean(c: str, k: int, need: int) -> Column:
        f = w.rowsBetween(-k, -1)
        return F.when(F.count(c).over(f) >= need, F.avg(c).over(f))

    out = {"ur1": F.lag("u").over(w), "dr1": F.lag("d").over(w),
           "ur5": mean("u", 5, 2), "dr5": mean("d", 5, 2), "breadth1": mean("u", 3, 1),
           "mvol1": F.lag("mv").over(w), "mret1": F.lag("mr").over(w),
           "mgap_t": F.col("mg"), "fgap2_t": F.col("fg")}
    return day.select("date", *[F.coalesce(e, F.lit(0.0)).alias(n) for n, e in out.items()])


def expanding_gate(pred: DataFrame, conf: str, kappa: float, warmup: int, by: str = "ticker",
                   second: str | None = None) -> DataFrame:
    """Act when the confidence reaches the (1 - kappa) quantile of strictly earlier
    confidences, once ``warmup`` of them exist; optionally a second gate at the prior median."""
    w = Window.partitionBy(by).orderBy("date")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    out = pred.withColumns({
        "tau": F.percentile(conf, F.lit(1 - kappa)).over(past),
        "ready": F.row_number().over(w) > warmup})
    act = F.col("ready") & (F.col(conf) >= F.col("tau"))
    if second is not None:
        out = out.withColumn("tau2", F.coalesce(F.percentile(second, F.lit(0.5)).over(past), F.lit(0.5)))
        act = act & F.coalesce(F.col(second) >= F.col("tau2"), F.lit(False))
    return out.withColumn("act", F.coalesce(act, F.lit(False)))


def every_hth(panel: DataFrame, h: int) -> DataFrame:
    """Every h-th row per ticker, so that h-row outcomes do not overlap."""
    return panel.withColumn("k", F.row_number().over(by_ticker()) - 1).filter(F.col("k") % h == 0)


def session_close(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker", "day").agg(F.max_by("close", "ts").alias("last_close"))


def equity_curve(daily: DataFrame, ret: str, by: str) -> DataFrame:
    """Compounded equity, its running peak and drawdown; equity stays 0 after a total loss."""
    w = Window.partitionBy(by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    lost = F.max((F.col(ret) <= -1).cast("int")).over(w) == 1
    logsum = F.sum(F.when(F.col(ret) > -1, F.log1p(ret)).otherwise(0.0)).over(w)
    d = daily.withColumn("equity", F.when(lost, 0.0).otherwise(F.exp(logsum)))
    return d.withColumn("peak", F.max("equity").over(w)).withColumn(
        "drawdown", F.col("equity") / F.col("peak") - 1)


def cumulative(daily: DataFrame, value: str, by: str, out: str = "running") -> DataFrame:
    w = Window.partitionBy(by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn(out, F.sum(value).over(w))
