"""Resampling, significance and threshold choice.

Bootstraps by date work on one row of counts per date, so their cost depends on the
calendar and the number of draws, not on the rows behind the counts.
"""

from __future__ import annotations

import math

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bellwether.functions.scalar import mix
from bellwether.operators import ranks as R
from bellwether.operators.aggregates import confusion, mcc_of
from bellwether.operators.outcomes import long_profit, short_profit

LOW, HIGH = 0.025, 0.975


def interval(draws: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Mean, 95 % percentile interval and share at or below zero of the drawn values."""
    return draws.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("draws"), F.avg(value).alias("mean"),
        F.percentile(value, F.lit(LOW)).alias("lo"), F.percentile(value, F.lit(HIGH)).alias("hi"),
        F.avg(F.when(F.col(value) <= 0, 1.0).otherwise(0.0)).alias("p_nonpos"))


def resample(rows: DataFrame, order: list[Column], n_draws: int, seed: int) -> DataFrame:
    """For each draw b, as many rows as the table has, picked with replacement.

    Rows are numbered, each of its n places hashes to a row number, and an equi-join on
    that evenly spread number fetches the row.
    """
    numbered = R.global_rank(rows, order, "_rk").withColumn("_ix", F.col("_rk") - 1)
    n = numbered.agg(F.count(F.lit(1)).alias("_n"))
    places = R.with_scalars(numbered.select(F.col("_ix").alias("_place")), n).repartition("_place")
    draws = places.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1)))).select(
        "b", (mix(F.col("b"), F.col("_place"), seed) % F.col("_n")).alias("_ix"))
    return draws.join(numbered.drop("_rk"), "_ix").drop("_ix")


def randomization_totals(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """(trial, total): total profit of each of n trials with random sides."""
    d = rows.withColumns({"_lp": long_profit(), "_sp": short_profit()}).select("item", "_lp", "_sp").repartition("item")
    t = d.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    side = mix(F.col("trial"), F.col("item"), seed) % 2 == 1
    return t.groupBy("trial").agg(F.sum(F.when(side, F.col("_lp")).otherwise(F.col("_sp"))).alias("total"))


def randomization(rows: DataFrame, model_profit: DataFrame, n: int, seed: int) -> DataFrame:
    """Total profit of n trials with random sides, and the share reaching the model's total.

    ``rows`` is (item, o, h, l, c) with a whole-number item; ``model_profit`` is one row.
    """
    return R.with_scalars(randomization_totals(rows, n, seed), model_profit).agg(
        F.count(F.lit(1)).alias("trials"), F.avg("total").alias("mean"), F.stddev_samp("total").alias("sd"),
        F.max("model").alias("model"), F.avg(F.when(F.round("total", 6) >= F.round("model", 6), 1.0).otherwise(0.0)).alias("p"))


def bootstrap(values: DataFrame, value: str, order: list[Column], n_draws: int, seed: int) -> DataFrame:
    """Intervals of the total, the mean and the Sharpe ratio of ``value``."""
    d = resample(values, order, n_draws, seed)
    g = d.groupBy("b").agg(F.sum(value).alias("total"), F.avg(value).alias("avg"),
                           (F.avg(value) / (F.stddev_pop(value) + 1e-12) * sqrt(248)).alias("sharpe"))
    stat = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(c).alias("v")) for s, c in (
        ("total", "total"), ("mean", "avg"), ("sharpe", "sharpe"))])
    return interval(g.select(F.inline(stat)), "v", ["stat"])


def cluster_bootstrap_mcc(pred: DataFrame, y: Column, p: Column, n_draws: int, seed: int) -> DataFrame:
    """MCC with an interval from resampled dates."""
    day = confusion(pred, y, p, ["date"]).select("date", "tp", "fp", "fn", "tn")
    d = resample(day, [F.asc("date")], n_draws, seed).groupBy("b").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    cells = [F.col(c) for c in ("tp", "fp", "fn", "tn")]
    point = day.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]).select(mcc_of(*cells).alias("point"))
    return R.with_scalars(interval(d.select(mcc_of(*cells).alias("v")), "v"), point)


def cluster_bootstrap_rate(rows: DataFrame, hit: Column, chosen: Column, n_draws: int, seed: int) -> DataFrame:
    """Hit rate of the chosen rows with an interval from resampled dates."""
    day = rows.groupBy("date").agg(F.sum(F.when(chosen & hit, 1).otherwise(0)).alias("num"),
                                   F.sum(F.when(chosen, 1).otherwise(0)).alias("den"))
    rate = F.sum("num") / F.greatest(F.sum("den"), F.lit(1))
    d = resample(day, [F.asc("date")], n_draws, seed).groupBy("b").agg(rate.alias("v"))
    return R.with_scalars(interval(d, "v"), day.agg(rate.alias("point")))


def _log_gamma(x: Column) -> Column:
    """ln(gamma(x)) for x >= 1: Stirling's series eight steps further up."""
    z = x + 8
    shift = F.log(x * (x + 1) * (x + 2) * (x + 3)) + F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def binomial_tail(hits: Column, n: Column, p: Column) -> Column:
    """P(X >= hits) for n trials.

    Terms further than ten deviations (and 100 hits) from the mean don't matter, so the sum starts at
    ``hits`` or at that bound and ends there or at n: its length grows with the root of n. The
    first term comes from log-gamma, the others by the ratio of neighbours.
    """
    m = n.cast("double")
    reach = 10 * F.sqrt(m * p * (1 - p)) + 100
    start = F.greatest(hits.cast("double"), F.floor(m * p - reach).cast("double"), F.lit(0.0))
    end = F.least(m, F.greatest(start, F.ceil(m * p + reach).cast("double")))
    beyond = F.least(m, start + 100)  # past the mean the terms fall by the ratio, so a few more suffice
    end = F.greatest(end, beyond).cast("bigint")
    first = (_log_gamma(m + 1) - _log_gamma(start + 1) - _log_gamma(m - start + 1) + start * F.log(p) + (m - start) * F.log(1 - p))
    state = F.struct(first.alias("t"), F.exp(first).alias("s"))

    def step(st, k):
        t = st["t"] + F.log((m - k + 1) / k) + F.log(p) - F.log(1 - p)
        return F.struct(t.alias("t"), (st["s"] + F.exp(t)).alias("s"))

    rest = F.when(start < end, F.sequence((start + 1).cast("bigint"), F.greatest(end, (start + 1).cast("bigint")))).otherwise(
        F.array().cast("array<bigint>"))
    total = F.aggregate(rest, state, step, lambda st: st["s"])
    return F.when(hits <= 0, F.lit(1.0)).when(hits > n, F.lit(0.0)).otherwise(F.least(F.lit(1.0), total))


def bonferroni(p: Column, tests: Column | int) -> Column:
    return F.least(F.lit(1.0), p * tests)


def stability(pred: DataFrame, y: Column, p: Column, chunks: int = 4) -> DataFrame:
    """MCC in contiguous chunks of dates; dates are numbered once and joined back."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    parts = pred.select("date").distinct().withColumn("chunk", F.ntile(chunks).over(w))
    return confusion(pred.join(F.broadcast(parts), "date"), y, p, ["chunk"])


def threshold_table(rows: DataFrame, score: str, y: str, keys: list[str], grid: list[float], probs: list[float]) -> DataFrame:
    """Confusion counts and MCC at each candidate: a grid plus the table's own quantiles.

    Rows are added up between neighbouring candidates first; the counts above each
    candidate are then running sums over that short list.
    """
    q = R.exact_quantiles(rows, score, probs, by=keys).select(*keys, F.col("q").alias("th"))
    sets = q.groupBy(*keys).agg(F.collect_set("th").alias("_q"))
    cand = sets.select(*keys, F.array_sort(F.array_union("_q", F.array(*[F.lit(float(g)) for g in grid]))).alias("_c"))
    j = rows.join(F.broadcast(cand), keys) if keys else R.with_scalars(rows, cand)
    slot = F.size(F.filter("_c", lambda t: F.col(score) >= t))
    g = j.withColumn("_slot", slot).groupBy(*keys, "_slot").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(y).cast("int")).alias("_h"))
    c = cand.select(*keys, F.posexplode("_c").alias("_i", "threshold"))
    # a row with slot s is at or above candidates 1..s
    above = c.join(g, keys) if keys else R.with_scalars(
        c, g.agg(F.collect_list(F.struct("_slot", "_n", "_h")).alias("_g"))).select("_i", "threshold", F.inline("_g"))
    up = F.col("_slot") > F.col("_i")
    s = above.groupBy(*keys, "threshold").agg(
        F.sum(F.when(up, F.col("_h")).otherwise(0)).alias("tp"), F.sum(F.when(up, F.col("_n") - F.col("_h")).otherwise(0)).alias("fp"),
        F.sum(F.when(~up, F.col("_h")).otherwise(0)).alias("fn"), F.sum(F.when(~up, F.col("_n") - F.col("_h")).otherwise(0)).alias("tn"))
    return s.withColumn("mcc", mcc_of(*[F.col(x) for x in ("tp", "fp", "fn", "tn")]))


def best_threshold(rows: DataFrame, score: str, y: str, keys: list[str] | None = None,
                   grid: list[float] | None = None, probs: list[float] | None = None) -> DataFrame:
    """The candidate with the largest MCC among those that split the rows; the lowest wins ties."""
    keys = keys or []
    grid = grid or [round(0.02 + 0.02 * i, 2) for i in range(49)]
    probs = probs or [0.5 + (0.995 - 0.5) * i / 79 for i in range(80)]
    t = threshold_table(rows, score, y, keys, grid, probs).filter("tp + fp > 0 and fn + tn > 0")
    return t.groupBy(*keys).agg(
        F.max_by("threshold", F.struct(F.round("mcc", 9), -F.col("threshold"))).alias("threshold"), F.max("mcc").alias("mcc"))


def blend_weight(rows: DataFrame, a: str, b: str, y: str, steps: int = 10) -> DataFrame:
    """Weight of ``a`` in the blend w*a + (1-w)*b with the best MCC at its best threshold.

    All weights are tried in one pass, keyed by the weight; every one is returned, the
    best one marked (the smallest wins ties).
    """
    w = F.explode(F.array(*[F.lit(i / steps) for i in range(steps + 1)])).alias("w")
    d = rows.select(a, b, y, w).withColumn("_s", F.col("w") * F.col(a) + (1 - F.col("w")) * F.col(b))
    t = best_threshold(d, "_s", y, ["w"])
    o = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("mcc", 9)), "w")  # steps + 1 rows
    return t.withColumn("best", F.row_number().over(o) == 1)


def tp_fp_profile(rows: DataFrame, score: str, y: Column, features: list[str], fraction: float = 0.1) -> DataFrame:
    """Feature means of true positives, false positives and the rest, for the top fraction."""
    r = R.global_rank(rows, [F.desc(score), F.asc("ticker"), F.asc("date")])
    n = r.agg(F.count(F.lit(1)).alias("_n"))
    top = F.col("rank") <= F.floor(F.col("_n") * fraction)
    g = R.with_scalars(r, n).withColumn("grp", F.when(~top, "rest").when(y, "tp").otherwise("fp"))
    return g.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in features])
