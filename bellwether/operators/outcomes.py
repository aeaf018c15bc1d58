"""Outcome labels and trading-rule tables: row-wise outcomes and aggregates, no event loop."""

from __future__ import annotations

from functools import reduce
from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bellwether.operators import ranks as R
from bellwether.operators.aggregates import share
from bellwether.operators.joins import calendar_fill
from bellwether.operators.selection import top_per_day
from bellwether.operators.windows import equity_curve

# Capital per signal, take-profit and cover levels, sessions per year.
CAPITAL = 10000.0
TAKE_PROFIT, COVER = 0.02, 0.01
SESSIONS = 248


def sharpe(r: str) -> Column:
    """Yearly Sharpe ratio of daily returns; null when they do not vary."""
    sd = F.stddev_samp(r)
    return F.when(sd > 1e-9, F.avg(r) / (sd + 1e-12) * sqrt(SESSIONS))


def hit_labels(bars: DataFrame, ks=(0.02, 0.03, 0.05)) -> DataFrame:
    """UPk: the high reached open * (1 + k). DNk: the low reached open * (1 - k)."""
    cols = {}
    for k in ks:
        p = int(round(k * 100))
        cols[f"UP{p}"] = (F.col("high") >= F.col("open") * (1 + k)) & (F.col("open") > 0)
        cols[f"DN{p}"] = (F.col("low") <= F.col("open") * (1 - k)) & (F.col("open") > 0)
    return bars.withColumns(cols)


def long_profit() -> Column:
    """Profit of buying at the open: +2 % when the high reaches it, else the close."""
    o, target = F.col("o"), F.col("o") * (1 + TAKE_PROFIT)
    return CAPITAL * (F.when(F.col("h") >= target, target).otherwise(F.col("c")) / o - 1.0)


def short_profit() -> Column:
    """Profit of selling at the open: covered 1 % lower when the low reaches it, else the close."""
    o, cover = F.col("o"), F.col("o") * (1 - COVER)
    return CAPITAL * (1.0 - F.when(F.col("l") <= cover, cover).otherwise(F.col("c")) / o)


def long_short_pnl(pred: DataFrame, prob: str = "prob", threshold: float | None = None) -> DataFrame:
    """Side and profit of each row; with a threshold, rows inside [1 - t, t] do not trade."""
    p = F.col(prob)
    side = (F.when(p > 0.5, 1).otherwise(-1) if threshold is None
            else F.when(p > threshold, 1).when(p < 1 - threshold, -1).otherwise(0))
    return pred.withColumn("side", side).withColumn(
        "profit", F.when(F.col("side") == 1, long_profit()).when(F.col("side") == -1, short_profit()).otherwise(0.0))


def tp_or_close(picks: DataFrame, tp: float = 0.05, cost: float = 0.003, strict: bool = False,
                exit_mode: str = "EOD") -> DataFrame:
    """Target hit gives tp; otherwise the close (EOD) or the next open (NO), less cost.
    Strict fills need the high 0.2 % beyond the target."""
    hit = F.col("h") >= F.col("o") * (1 + tp) * (1.002 if strict else 1.0)
    close = F.col("c") / F.col("o") - 1.0
    miss = F.coalesce(F.col("next_o") / F.col("o") - 1.0, close) if exit_mode == "NO" else close
    return picks.withColumns({"hit": hit, "net": F.when(hit, tp).otherwise(miss) - cost})


def tp_sl_pessimistic(picks: DataFrame, tp: float = 0.05, sl: float | None = -0.03, cost: float = 0.003) -> DataFrame:
    """Daily bars cannot order two touches, so the stop counts first when both happen."""
    o = F.col("o")
    stop = F.lit(False) if sl is None else F.col("l") <= o * (1 + sl)
    target = F.col("h") >= o * (1 + tp)
    exit_px = (F.when(stop, o * (1 + (sl or 0.0))).when(target, o * (1 + tp)).otherwise(F.col("c")))
    return picks.withColumns({"stopped": stop, "tp": target & ~stop, "net": exit_px / o - 1.0 - cost,
                              "mae": F.col("l") / o - 1.0})


def _touch(frame: DataFrame, keys: list[str], entry_ix: str, entry_px: str, tp_px: Column, sl_px: Column) -> DataFrame:
    """First bar from ``entry_ix`` on touching the stop or the target; both in one bar counts
    as the stop (reason 3), neither leaves the last close (reason 2)."""
    ix = F.col("bar_ix")
    live = ix >= F.col(entry_ix)
    g = frame.withColumns({"_tp": tp_px, "_sl": sl_px}).groupBy(*keys).agg(
        F.min(F.when(live & (F.col("low") <= F.col("_sl")), ix)).alias("_s"),
        F.min(F.when(live & (F.col("high") >= F.col("_tp")), ix)).alias("_t"),
        F.max_by("close", "bar_ix").alias("_c"), F.max("bar_ix").alias("_n"),
        F.first(entry_ix).alias("_e"), F.first(entry_px).alias("entry_px"),
        F.first("_tp").alias("_tp"), F.first("_sl").alias("_sl"))
    s, t = F.col("_s"), F.col("_t")
    reason = (F.when(F.col("_e").isNull(), 4).when(s.isNull() & t.isNull(), 2).when(s == t, 3)
              .when(t.isNull() | (s < t), 0).otherwise(1))
    g = g.withColumn("reason", reason)
    r = F.col("reason")
    px = F.when(r.isin(0, 3), F.col("_sl")).when(r == 1, F.col("_tp")).otherwise(F.col("_c"))
    bar = F.when(r == 4, 0).when(r == 2, F.col("_n") - F.col("_e") + 1).otherwise(F.least(s, t) - F.col("_e") + 1)
    return g.select(*keys, "entry_px", "reason", bar.alias("bar_hit"),
                    F.when(r == 4, 0.0).otherwise(px / F.col("entry_px") - 1.0).alias("ret_gross"))


def first_touch_intraday(bars: DataFrame, tp: float, stops: list[float]) -> DataFrame:
    """Outcome of buying each session's first open, for several stop levels in one pass.

    One exchange on (ticker, day): the window and both groupings share it.
    """
    day = Window.partitionBy("ticker", "day")
    b = bars.withColumns({"_o": F.min_by("open", "bar_ix").over(day), "_k": F.max("bar_ix").over(day),
                          "_one": F.lit(1)}).filter("_k >= 2 and _o > 0")
    b = b.withColumn("sl", F.explode(F.array(*[F.lit(float(s)) for s in stops])))
    return _touch(b, ["ticker", "day", "sl"], "_one", "_o", F.col("_o") * (1 + tp), F.col("_o") * (1 - F.col("sl")))


def entry_rules(bars: DataFrame, tp: float, sl: float, delay: int = 600, dip: float = 0.01,
                opening_range: int = 120) -> DataFrame:
    """Six ways to enter a session, then the first touch from the entry bar: the stop is taken
    from the entry price, the target from the session open. Days not entered get reason 4.
    Minutes are counted from midnight."""
    day = Window.partitionBy("ticker", "day")
    ix = F.col("bar_ix")
    b = bars.withColumns({
        "_m": F.hour("ts") * 60 + F.minute("ts"), "_op": F.min_by("open", "bar_ix").over(day),
        "_c0": F.min_by("close", "bar_ix").over(day)})
    b = b.withColumn("_m0", F.min("_m").over(day))
    opening = F.col("_m") < F.col("_m0") + opening_range
    late = F.when(F.col("_m") >= delay, ix)
    low = F.col("_op") * (1 - dip)
    b = b.withColumns({
        "_rh": F.max(F.when(opening, F.col("high"))).over(day),
        "_de": F.min(late).over(day), "_dp": F.min_by("open", late).over(day),
        "_di": F.min(F.when(F.col("low") <= low, ix)).over(day)})
    b = b.withColumns({
        "_ob": F.min(F.when(~opening & (F.col("high") >= F.col("_rh")), ix)).over(day),
        "_rc": F.min(F.when((ix >= F.col("_di")) & (F.col("high") >= F.col("_op")), ix)).over(day)})

    def rule(name: str, e: Column, px: Column) -> Column:
        return F.struct(F.lit(name).alias("rule"), e.cast("int").alias("e"), F.when(e.isNotNull(), px).alias("px"))

    rules = F.array(
        rule("open", F.lit(1), F.col("_op")), rule("firstclose", F.lit(1), F.col("_c0")),
        rule("delay", F.col("_de"), F.col("_dp")), rule("dip", F.col("_di"), low),
        rule("orb", F.col("_ob"), F.col("_rh")), rule("dipreclaim", F.col("_rc"), F.col("_op")))
    r = b.select("ticker", "day", "bar_ix", "high", "low", "close", "_op", F.inline(rules))
    return _touch(r, ["ticker", "day", "rule"], "e", "px", F.col("_op") * (1 + tp), F.col("px") * (1 - sl))


def multi_day_exit(scores: DataFrame, configs: list[tuple[float, float, float | None, int]]) -> DataFrame:
    """Hold from each open for at most H bars; configs are (sl, tp, trail, H),
    sl and trail negative.

    Order inside a bar: an open beyond the stop (after day one), then both levels touched
    (stop first in ``ret_pess``, target first in ``ret_opt``), stop, target, then the
    trailing stop is raised and the time limit applies. The next H bars of a row come from
    one window frame, and a fold walks them inside the row.
    """
    longest = max(c[3] for c in configs)
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(0, longest - 1)
    s = scores.withColumn("_path", F.collect_list(F.struct("o", "h", "l", "c")).over(w))
    cfg = F.array(*[F.struct(
        F.lit(i).alias("config"), F.lit(float(sl)).alias("sl"), F.lit(float(tp)).alias("tp"),
        F.lit(None if tr is None else float(tr)).cast("double").alias("trail"), F.lit(hold).alias("hold"))
        for i, (sl, tp, tr, hold) in enumerate(configs)])
    s = s.select("ticker", "date", "o", "h", "_path", F.inline(cfg))
    entry = F.col("o")

    def state(done, pess, opt, held, reason, stop, hi):
        return F.struct(done.alias("done"), pess.alias("pess"), opt.alias("opt"), held.alias("held"),
                        reason.alias("reason"), stop.alias("stop"), hi.alias("hi"))

    start = state(F.lit(False), F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(2), entry * (1 + F.col("sl")), F.col("h"))

    def step(st, bar):
        stop, target, hd = st["stop"], entry * (1 + F.col("tp")), st["held"] + 1
        gapped = (hd > 1) & (bar["o"] <= stop)
        s_t, t_t = bar["l"] <= stop, bar["h"] >= target
        last = hd >= F.col("hold")
        hi = F.greatest(st["hi"], bar["h"])
        raised = F.when(F.col("trail").isNull(), stop).otherwise(F.greatest(stop, hi * (1 + F.col("trail"))))
        done = gapped | s_t | t_t | last
        pess = F.when(gapped, bar["o"]).when(s_t, stop).when(t_t, target).otherwise(bar["c"])
        opt = F.when(gapped, bar["o"]).when(t_t, target).when(s_t, stop).otherwise(bar["c"])
        reason = F.when(gapped, 0).when(s_t & t_t, 3).when(s_t, 0).when(t_t, 1).otherwise(2)
        # an undecided bar leaves its close behind, which is the exit if the series ends
        moved = state(done, pess, opt, hd, reason, raised, hi)
        return F.when(st["done"], st).otherwise(moved)

    out = s.withColumn("_r", F.aggregate("_path", start, step))
    ok = entry > 0
    return out.select("ticker", "date", "config",
                      F.when(ok, F.col("_r.pess") / entry - 1.0).otherwise(0.0).alias("ret_pess"),
                      F.when(ok, F.col("_r.opt") / entry - 1.0).otherwise(0.0).alias("ret_opt"),
                      F.col("_r.held").alias("held"), F.col("_r.reason").alias("reason"))


def risk_sized_equity(trades: DataFrame, stop: float, risk: float = 0.01, cap: float = 0.2) -> DataFrame:
    """Daily compounding with positions of min(risk / stop, cap) of equity in score order, the
    last one cut to the cash left. Fractions do not depend on equity, so a rank decides them."""
    f = min(risk / stop, cap)
    w = Window.partitionBy("date").orderBy(F.desc("score"), "ticker")
    t = trades.withColumn("_i", F.row_number().over(w) - 1)
    left = 1.0 - F.col("_i") * f
    t = t.withColumn("fraction", F.greatest(F.least(F.lit(f), left), F.lit(0.0))).filter("fraction > 1e-6")
    day = t.groupBy("date").agg(F.sum(F.col("fraction") * F.col("net")).alias("r"), F.count(F.lit(1)).alias("n"))
    return equity_curve(day.withColumn("book", F.lit("all")), "r", "book")


def equal_slot_equity(picks: DataFrame, k: int, deploy: float = 1.0) -> DataFrame:
    """k equal slots a day, empty ones in cash; days without picks earn nothing."""
    day = picks.groupBy("date").agg((F.sum("net") / k * deploy).alias("r")).withColumn("book", F.lit("all"))
    return equity_curve(calendar_fill(day, "book", "r"), "r", "book")


def performance(trades: DataFrame, curve: DataFrame) -> DataFrame:
    """One row: growth rate, Sharpe ratio, drawdown, win rate, profit factor, worst day, shares
    of stopped and target trades, median adverse move.

    ``curve`` holds one row per day, ``trades`` any number.
    """
    t = trades.agg(
        F.count(F.lit(1)).alias("n"), share(F.col("net") > 0).alias("win"),
        (F.sum(F.when(F.col("net") > 0, F.col("net")).otherwise(0.0))
         / F.greatest(-F.sum(F.when(F.col("net") < 0, F.col("net")).otherwise(0.0)), F.lit(1e-9))).alias("profit_factor"),
        share(F.col("stopped")).alias("stop_share"), share(F.col("tp")).alias("tp_share"))
    mae = R.exact_quantiles(trades, "mae", [0.5]).select(F.col("q").alias("mae_median"))
    years = F.greatest(F.datediff(F.max("date"), F.min("date")) / 365.25, F.lit(0.1))
    c = curve.agg(
        (F.pow(F.max_by("equity", "date"), 1 / years) - 1).alias("cagr"),
        sharpe("r").alias("sharpe"),
        F.min("drawdown").alias("mdd"), F.min("r").alias("worst_day"))
    return R.with_scalars(R.with_scalars(t, mae), c)


def parameter_grid(scores: DataFrame, ks: list[int], floors: list[float], gap_caps: list[float],
                   exits: list[str], split: str, min_trades: int, tp: float = 0.05, cost: float = 0.003) -> DataFrame:
    """All settings of the daily rule in one pass; the best training Sharpe with enough trades
    is marked, and read on the test part.

    Only the gap cap changes who ranks where, so ranking is done once per cap and keeps
    max(ks) rows a day; the other settings multiply those few rows only.
    """
    d = scores.withColumn("gap_cap", F.explode(F.array(*[F.lit(float(g)) for g in gap_caps]))).filter("gap <= gap_cap")
    w = Window.partitionBy("gap_cap", "date").orderBy(F.desc("score"), "ticker")
    d = d.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= max(ks))
    grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(f)).alias("floor"), F.lit(e).alias("exit"))
                     for k in ks for f in floors for e in exits])
    d = d.select("*", F.inline(grid)).filter((F.col("rk") <= F.col("k")) & (F.col("score") >= F.col("floor")))
    eod = tp_or_close(d, tp, cost).withColumnRenamed("net", "_eod")
    nxt = tp_or_close(eod, tp, cost, exit_mode="NO").withColumn(
        "net", F.when(F.col("exit") == "NO", F.col("net")).otherwise(F.col("_eod")))
    keys = ["exit", "k", "floor", "gap_cap"]
    part = F.when(F.col("date") < F.lit(split).cast("date"), "train").otherwise("test")
    day = nxt.withColumn("part", part).groupBy(*keys, "part", "date").agg(
        (F.sum("net") / F.first("k")).alias("r"), F.count(F.lit(1)).alias("n"),
        F.sum(F.col("hit").cast("int")).alias("hits"), F.sum("net").alias("net"))
    m = day.groupBy(*keys, "part").agg(
        F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("hit"), (F.sum("net") / F.sum("n")).alias("ev"),
        sharpe("r").alias("sharpe"))
    g = m.groupBy(*keys).agg(*[
        F.max(F.when(F.col("part") == p, F.col(c))).alias(f"{p}_{c}") for p in ("train", "test") for c in ("n", "hit", "ev", "sharpe")])
    # one row per setting from here on
    best = Window.partitionBy(F.lit(0)).orderBy(
        F.desc_nulls_last(F.when(F.col("train_n") >= min_trades, F.round("train_sharpe", 9))), *keys)
    return g.withColumn("best", F.row_number().over(best) == 1)


def threshold_sweep(pred: DataFrame, thresholds: list[float], prob: str = "prob", by: str = "split") -> DataFrame:
    """Profit and trades at each threshold, per split.

    A row trades long at every threshold below its probability, so rows are first added up
    per number of thresholds passed; only those few sums meet the thresholds.
    """
    th = [float(t) for t in thresholds]
    p = F.col(prob)
    ups = reduce(lambda a, b: a + b, [(p > t).cast("int") for t in th])
    dns = reduce(lambda a, b: a + b, [(p < 1 - t).cast("int") for t in th])
    side = F.explode(F.array(F.struct(ups.alias("passed"), long_profit().alias("profit")),
                             F.struct(dns.alias("passed"), short_profit().alias("profit"))))
    g = pred.select(by, side.alias("s")).filter("s.passed > 0").groupBy(by, "s.passed").agg(
        F.sum("s.profit").alias("profit"), F.count(F.lit(1)).alias("trades"))
    table = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(th)])
    return g.select(by, "passed", "profit", "trades", F.inline(table)).filter("i <= passed").groupBy(by, "threshold").agg(
        F.sum("profit").alias("profit"), F.sum("trades").alias("trades"))


def frozen_sweep(curve: DataFrame, by: str = "split", fit: str = "dev", test: str = "test") -> DataFrame:
    """Best threshold of the fit split (lowest wins ties), and what it earns on the test split."""
    best = curve.filter(F.col(by) == fit).agg(
        F.max_by("threshold", F.struct(F.round("profit", 6), -F.col("threshold"))).alias("best"),
        F.max("profit").alias("fit_profit"))
    t = R.with_scalars(curve.filter(F.col(by) == test), best).filter("threshold = best")
    return t.select("threshold", "fit_profit", F.col("profit").alias("test_profit"), F.col("trades").alias("test_trades"))


def daily_topk_hit(scores: DataFrame, k: int = 1, tp: float = 0.05) -> DataFrame:
    """Hit rate of the k best-scored rows of each day, against the rate of all rows.

    Hits are counted once over all rows; the picks come from per-task top-k lists.
    """
    d = scores.filter("o > 0 and h > 0").withColumn("hit", (F.col("h") >= F.col("o") * (1 + tp)).cast("int"))
    picks = top_per_day(d.select("date", "ticker", "score", "hit"), k).agg(
        F.avg("hit").alias("hit_rate"), F.count_distinct("date").alias("n_days"), F.count(F.lit(1)).alias("n_picks"))
    base = d.agg(F.avg("hit").alias("base_rate"))
    return R.with_scalars(picks, base).select(
        F.lit(k).alias("k"), F.lit(float(tp)).alias("tp"), "hit_rate", "base_rate", "n_days", "n_picks")


def gap_cells(scores: DataFrame, bounds: list[tuple[float, float]], ks: list[int], floor: float,
              tp: float = 0.05, cost: float = 0.003, at_least: int = 30) -> DataFrame:
    """Expected value, hit rate and value of the misses per gap range and number of picks."""
    cells = F.array(*[F.struct(F.lit(float(a)).alias("gap_lo"), F.lit(float(b)).alias("gap_hi")) for a, b in bounds])
    d = scores.filter(F.col("score") >= floor).select("*", F.inline(cells)).filter("gap > gap_lo and gap <= gap_hi")
    w = Window.partitionBy("gap_lo", "gap_hi", "date").orderBy(F.desc("score"), "ticker")
    d = d.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= max(ks))
    d = tp_or_close(d, tp, cost).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter("rk <= k")
    return d.groupBy("gap_lo", "gap_hi", "k").agg(
        F.count(F.lit(1)).alias("n"), share(F.col("hit")).alias("hit"), F.avg("net").alias("ev"),
        F.avg(F.when(~F.col("hit"), F.col("net"))).alias("ev_miss"), F.count_distinct("date").alias("days")
    ).filter(F.col("n") >= at_least)
