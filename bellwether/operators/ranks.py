"""Whole-table ranks, running sums, quantile bins and top fractions.

Spark's window functions need one partition per group, which a whole-table rank (or a
group holding a third of all rows) cannot afford. Here the rows are range-sorted, so any
run of equal keys is spread by its tie-breaker; each partition is numbered on its own and
shifted by the size of the partitions before it. The sorted rows are checkpointed first,
because a recomputed sort may cut its ranges elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bellwether.functions.scalar import safe_div
from bellwether.operators.quantiles import exact_quantiles
from bellwether.session import frozen

_SLOT = 1 << 33  # monotonically_increasing_id keeps the partition in the bits above this


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, Column | str]) -> DataFrame:
    """Rows in ``order`` with ``rank`` (from 1) and an inclusive running sum per entry."""
    cols = {f"_v_{k}": (F.col(e) if isinstance(e, str) else e) for k, e in sums.items()}
    s = frozen(df.withColumns(cols).orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
               if cols else df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    s = s.withColumns({"_p": F.floor(F.col("_id") / _SLOT), "_i": F.col("_id") % _SLOT})
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # one row per sorted partition: at most spark.sql.shuffle.partitions rows
    parts = s.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t{c}") for c in cols])
    offsets = parts.select(
        "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_on"),
        *[F.coalesce(F.sum(f"_t{c}").over(before), F.lit(0)).alias(f"_o{c}") for c in cols])
    j = s.join(F.broadcast(offsets), "_p").withColumn("rank", F.col("_on") + F.col("_i") + 1)
    if cols:
        inside = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
        j = j.withColumns({k: F.col(f"_o_v_{k}") + F.sum(f"_v_{k}").over(inside) for k in sums})
    drop = ["_id", "_p", "_i", "_on"] + list(cols) + [f"_o{c}" for c in cols]
    return j.drop(*drop)


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    r = running_totals(df, order, {})
    return r if name == "rank" else r.withColumnRenamed("rank", name)


def quantile_bins(df: DataFrame, value: str, probs: list[float], name: str) -> DataFrame:
    """Left-closed bin number of each row against the table's own quantiles."""
    edges = exact_quantiles(df, value, probs).groupBy(F.lit(1).alias("_one")).agg(
        F.array_sort(F.collect_list("q")).alias("_e"))  # len(probs) numbers
    return with_scalars(df, edges.drop("_one")).withColumn(
        name, F.size(F.filter("_e", lambda e: F.col(value) >= e))).drop("_e")


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table (a global aggregate) to every row.

    A scalar subquery: Spark computes the row once and puts it into the plan as a constant.
    """
    row = one_row.select(F.struct(*one_row.columns).alias("_row")).scalar()
    return df.withColumn("_row", row).select("*", "_row.*").drop("_row")


def top_fraction(df: DataFrame, score: str, fractions: list[float], least: int, tie: list[str]) -> DataFrame:
    """Rows in the top fraction by score, at least ``least`` rows; one copy per fraction."""
    r = global_rank(df, [F.desc(score), *[F.asc(t) for t in tie]])
    n = r.agg(F.count(F.lit(1)).alias("_n"))
    f = F.explode(F.array(*[F.lit(float(x)) for x in fractions])).alias("fraction")
    return with_scalars(r, n).select("*", f).filter(
        F.col("rank") <= F.greatest(F.floor(F.col("_n") * F.col("fraction")), F.lit(least))).drop("_n")


def rank_deciles(df: DataFrame, value: str, tie: list[str], bins: int = 10) -> DataFrame:
    """Equal-count bins 0..bins-1 by first-occurrence rank over the whole table."""
    r = global_rank(df, [F.asc(value), *[F.asc(t) for t in tie]])
    n = r.agg(F.count(F.lit(1)).alias("_n"))
    cut = F.ceil(safe_div((F.col("rank") - 1) * bins, F.col("_n") - 1))
    return with_scalars(r, n).withColumn("decile", F.greatest(cut, F.lit(1)) - 1).drop("_n")


def rank_correlation(df: DataFrame, a: str, b: str, tie: list[str]) -> DataFrame:
    """Correlation of ordinal ranks; ties take the order of ``tie``."""
    from bellwether.operators.aggregates import corr

    keys = [F.asc(t) for t in tie]
    r = global_rank(df.select(a, b, *tie), [F.asc(a), *keys], "_ra")
    r = global_rank(r, [F.asc(b), *keys], "_rb")
    return r.agg(F.count(F.lit(1)).alias("n"), corr("_ra", "_rb").alias("ic"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Precision at each distinct score weighted by its gain in recall, summed."""
    g = df.groupBy(score).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("int")).alias("_h"))
    r = running_totals(g, [F.desc(score)], {"_cn": "_n", "_ch": "_h"})
    return r.agg(safe_div(F.sum(F.col("_h") * F.col("_ch") / F.col("_cn")), F.sum("_h")).alias("ap"),
                 F.sum("_n").alias("n"), F.sum("_h").alias("positives"))
