"""Exact quantiles by refining histograms: counting passes, no sort and no copy of the table.

The first pass counts each group's values by a monotone code of sign and logarithm and keeps the least and the greatest value
of every code. The running counts say which code holds a wanted rank. A code with one value answers it; a larger one is
cut into equal steps and counted again, alone, until it holds few enough values to be sorted. Ends always fall into different
steps, so every pass narrows. What is counted is aggregated before it is shuffled, by (group, step): a hot group or
value costs its rows and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of a pass, values that are sorted at the end, and intervals that are broadcast.
STEPS, FEW, BROADCAST = 4096, 1 << 16, 100_000
#: Codes: sixty-four steps between powers of two; powers of two of doubles lie over -1100 and under 1100.
_FINE, _POWERS = 64, 1100


def monotone_code(x: Column) -> Column:
    """A whole number that never falls as a double rises; zeros, infinities and NaN (the greatest) have their own."""
    size = F.floor(F.log2(F.abs(x)) * _FINE) + _POWERS * _FINE
    side = F.when(x < 0, -1).otherwise(1)
    far = F.lit(2 * _POWERS * _FINE + 1)
    return F.when(F.isnan(x), far + 1).when(x == 0, 0).when(F.abs(x) == float("inf"), side * far).otherwise(side * size)


def _kept(small: DataFrame) -> DataFrame:
    """A table of a few rows per group or step that later passes read again."""
    return small.persist()


def _meet(left: DataFrame, right: DataFrame, keys: list[str], on: Column | None = None, small: bool = False) -> DataFrame:
    """Inner join on keys that may be null; ``on`` adds to the condition. A ``small`` right side is broadcast."""
    renamed = right.withColumnsRenamed({k: f"_right_{i}" for i, k in enumerate(keys)})
    condition = F.lit(True) if on is None else on
    for i, k in enumerate(keys):
        condition &= F.col(k).eqNullSafe(F.col(f"_right_{i}"))
    return left.join(F.broadcast(renamed) if small else renamed, condition).drop(*[f"_right_{i}" for i in range(len(keys))])


def _ranked(counts: DataFrame, within: list[str], step: str) -> DataFrame:
    """Adds ``_from``, the number of values before each step."""
    before = Window.partitionBy(*within, F.lit(0)).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def select_ranks(values: DataFrame, ranks: DataFrame, first: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _rank, _x): the values of wanted ranks (from 0) of (keys, _x), given the counts of a first pass
    (keys, _step, _n, _low, _high)."""
    holds = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_n"))
    found = _meet(_ranked(first, keys, "_step"), ranks, keys, holds)
    state = _kept(found.select(*keys, "_rank", (F.col("_rank") - F.col("_from")).alias("_at"), "_n", "_low", "_high"))
    ends = [*keys, "_low", "_high"]
    inside = (F.col("_x") >= F.col("_low")) & (F.col("_x") <= F.col("_high"))
    wide = (F.col("_low") < F.col("_high")) & (F.col("_n") > FEW)
    while True:
        size, left = state.agg(F.count("*"), F.count_if(wide)).first()
        if not left:
            break
        rows = _meet(values, state.filter(wide).select(ends).distinct(), keys, inside, size <= BROADCAST)
        step = F.floor((F.col("_x") - F.col("_low")) / (F.col("_high") - F.col("_low")) * STEPS)
        counts = rows.groupBy(*ends, step.alias("_step")).agg(F.count("*").alias("_n"), F.min("_x").alias("_l"), F.max("_x").alias("_h"))
        counts = _ranked(counts, ends, "_step")
        targets = state.filter(wide).select(*ends, "_rank", "_at")
        holds = (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_from") + F.col("_n"))
        narrow = _meet(counts, targets, ends, holds)
        narrow = narrow.select(*keys, "_rank", (F.col("_at") - F.col("_from")).alias("_at"), "_n", F.col("_l").alias("_low"), F.col("_h").alias("_high"))
        state = _kept(state.filter(~wide).unionByName(narrow))
    answered = state.filter("_low = _high").select(*keys, "_rank", F.col("_low").alias("_x"))
    few = state.filter("_low < _high")
    rows = _meet(values, few.select(ends).distinct(), keys, inside, size <= BROADCAST)
    sorted_ = rows.groupBy(*ends).agg(F.sort_array(F.collect_list("_x")).alias("_all"))  # at most ``FEW`` values
    picked = _meet(sorted_, few.select(*ends, "_rank", "_at"), ends)
    return answered.unionByName(picked.select(*keys, "_rank", F.get("_all", F.col("_at").cast("int")).alias("_x")))


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """Linear-interpolated quantiles of ``value``, as one row per (by..., prob).

    Groups may be of any size and number; a null key is a group, null values are left out, a NaN is the greatest value.
    The (by, value) columns are kept by the executors while the passes run, and read anew where one is lost.
    """
    keys = by or []
    values = df.select(*keys, F.col(value).cast("double").alias("_x")).filter("_x is not null").persist()
    counts = values.groupBy(*keys, monotone_code(F.col("_x")).alias("_step"))
    first = _kept(counts.agg(F.count("*").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high")))
    h = (F.col("_size") - 1) * F.col("prob")
    want = first.groupBy(*keys).agg(F.sum("_n").alias("_size")).filter("_size is not null")
    want = want.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
    want = want.select(*keys, "prob", F.floor(h).alias("_lo"), F.ceil(h).alias("_hi"), (h - F.floor(h)).alias("_f"))
    ranks = want.select(*keys, F.explode(F.array("_lo", "_hi")).alias("_rank")).distinct()
    found = _kept(select_ranks(values, ranks, first, keys))
    found.count()
    values.unpersist()
    for rank, name in (("_lo", "_a"), ("_hi", "_b")):
        want = _meet(want, found.select(*keys, F.col("_rank").alias("_r"), F.col("_x").alias(name)), keys, F.col(rank) == F.col("_r")).drop("_r")
    return want.select(*keys, "prob", F.when(F.col("_f") == 0, F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("q"))
