"""Top-k per day, thresholds, coverage and deterministic de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bellwether.operators import ranks as R
from bellwether.operators.aggregates import share


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in a total order, in which nulls come first.

    An aggregate with map-side combine picks the winner's order values; long text keys
    are compared by digest. A key with a third of all rows costs one row per task.
    """
    digest = F.sha2(F.concat_ws("\x01", *[F.coalesce(F.col(k).cast("string"), F.lit("\x02")) for k in keys]), 256)
    d = df.withColumn("_key", digest)
    first = F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]))
    best = d.groupBy(F.col("_key").alias("_k")).agg(first.alias("_first")).select("_k", "_first.*")
    same = F.col("_key") == F.col("_k")
    for i, c in enumerate(order):
        same = same & F.col(c).eqNullSafe(F.col(f"_o{i}"))
    return d.join(best, same, "left_semi").drop("_key")


def top_per_day(scores: DataFrame, k: int, floor: float | None = None, gap_above: float | None = None,
                gap_cap: float | None = None) -> DataFrame:
    """The k best scores of each date, ties by ticker.

    Spark turns ``row_number <= k`` into a per-task limit before the exchange, so a date
    with very many rows moves at most k rows per task.
    """
    d = scores
    if floor is not None:
        d = d.filter(F.col("score") >= floor)
    if gap_above is not None:
        d = d.filter(F.col("gap") > gap_above)
    if gap_cap is not None:
        d = d.filter(F.col("gap") <= gap_cap)
    w = Window.partitionBy("date").orderBy(F.desc("score"), F.asc("ticker"))
    return d.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)


def threshold_table(fit: DataFrame, test: DataFrame, probs: list[float]) -> DataFrame:
    """Hit rate of test rows at or above each quantile of the fit rows' scores."""
    q = R.exact_quantiles(fit, "score", probs)
    edges = q.agg(F.collect_list(F.struct("prob", "q")).alias("_e"))  # len(probs) entries
    t = R.with_scalars(test, edges)
    return (t.select("score", "h", "o", F.inline("_e")).filter(F.col("score") >= F.col("q"))
            .groupBy("prob", "q").agg(F.count(F.lit(1)).alias("n"), share(F.col("h") >= F.col("o") * 1.05).alias("hit")))


def most_frequent(df: DataFrame, col: str, k: int) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col).limit(k)


def directional_selector(df: DataFrame, up: str, dn: str, th_up: float, th_dn: float,
                         fractions: list[float], least: int) -> DataFrame:
    """Select by the larger margin over its threshold; score the side with the higher value."""
    m = df.withColumn("margin", F.round(F.greatest(F.col(up) - th_up, F.col(dn) - th_dn), 9))
    t = R.top_fraction(m, "margin", fractions, least, ["ticker", "date"])
    long = F.col(up) >= F.col(dn)
    return t.groupBy("fraction").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(long, F.col("up5")).otherwise(F.col("dn5"))).alias("hit"),
        share(long).alias("long_frac"))
