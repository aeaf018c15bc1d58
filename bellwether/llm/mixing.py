"""Mixing sources to target weights by temperature, as budgeted block permutations.

The token share p of each source is raised to an exponent and normalised: 1 keeps the
natural mix, 0 makes all sources equal. The exponent is bisected until the weights meet a target
entropy, or until the most repeated source stays within a repetition limit. The
budget of a source is its weight times the whole budget; it is spent on passes over the source. A pass takes the
source's blocks in a permuted order, and the rows of a block in a permuted order; the last pass ends
where the budget does. A block has about the square root of the source's rows, so neither the blocks
of a source nor the rows of a block pile up in one task, however large one source is.

Decisions need one row per source and two hashes of a row, so texts need not move to be mixed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bellwether.llm.common import stored

STEPS = 60


def words_in(text: Column) -> Column:
    """Token count by white space, at least 1, so that empty and null texts take part in the mix."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))).cast("bigint")


def _bisected(wanted_low, steps: int = STEPS) -> float:
    """Smallest exponent in [0, 1] for which ``wanted_low(exponent)`` is false, given that it is true below it."""
    if not wanted_low(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if wanted_low(middle) else (low, middle)
    return high


def exponent_for_repetition(largest: int, smallest: int, limit: float) -> float:
    """Smallest exponent with which, once the largest source is taken once, the smallest is repeated at most ``limit`` times."""
    if limit < 1:
        raise ValueError("the repetition limit is at least 1")
    ratio = math.log(largest / smallest)
    return _bisected(lambda a: (1 - a) * ratio > math.log(limit))


def _entropy(sources: DataFrame, exponent: float) -> float:
    w = F.exp(exponent * F.log("tokens"))
    s, t = sources.agg(F.sum(w), F.sum(w * F.log(w))).first()
    return math.log(s) - t / s


def exponent_for_entropy(sources: DataFrame, entropy: float, steps: int = 30) -> float:
    """Largest exponent in [0, 1] whose weights have at least the given entropy (in nats), or 0.

    Each step is one small aggregate over the table of sources (source, tokens)."""
    if _entropy(sources, 1.0) >= entropy:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if _entropy(sources, middle) >= entropy else (low, middle)
    return low


def source_table(sized: DataFrame, source: str, tokens: str = "_tokens") -> DataFrame:
    """(source, docs, tokens), stored; a null source is a source of its own."""
    return stored(sized.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("docs"), F.sum(tokens).alias("tokens")), "sources")


def plan(sources: DataFrame, max_repeats: float | None = 2.0, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """(source, docs, tokens, share, exponent, weight, budget, passes, rest, blocks).

    Give ``max_repeats`` or ``entropy``. Without a ``budget`` every row is taken at least once: the budget is the
    least with which no source is cut. ``passes`` full passes and ``rest`` tokens of one more spend a source's budget.
    """
    largest, smallest, total = sources.agg(F.max("tokens"), F.min("tokens"), F.sum("tokens")).first()
    if total is None:
        exponent, total, largest, norm = 1.0, 1, 1, 1.0
    else:
        exponent = exponent_for_repetition(largest, smallest, max_repeats) if entropy is None else exponent_for_entropy(sources, entropy)
        norm = sources.agg(F.sum(F.exp(exponent * F.log(F.col("tokens") / total)))).first()[0]
    share = F.col("tokens") / F.lit(total)
    weight = F.exp(exponent * F.log(share)) / norm
    if budget is None:  # in units of the largest source's share: it is taken exactly once
        spend = F.round(F.col("tokens") * F.exp((1 - exponent) * F.log(F.lit(largest) / F.col("tokens"))))
    else:
        spend = F.round(weight * budget)
    return stored(
        sources.select(
            "source", "docs", "tokens", share.alias("share"), F.lit(exponent).alias("exponent"), weight.alias("weight"),
            spend.cast("bigint").alias("budget"),
        ).withColumns({
            "passes": F.floor(F.col("budget") / F.col("tokens")).cast("int"),
            "rest": F.col("budget") % F.col("tokens"),
            "blocks": F.ceil(F.sqrt("docs")).cast("bigint"),
        }),
        "mixing-plan",
    )


def _copies(rows: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    """Rows (k, s, ...) with their source's plan, block, and one row per pass (the last one perhaps in part)."""
    at = planned.select(F.col("source").alias("_source"), "passes", "rest", "blocks")
    rows = rows.join(at, F.col("s").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "k"), F.col("blocks")))
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    return rows.withColumns({"block_at": F.xxhash64(F.lit(seed), "pass", "block"), "row_at": F.xxhash64(F.lit(seed + 1), "pass", "k")})


def mix(docs: DataFrame, sized: DataFrame, planned: DataFrame, source: str = "source", key: str = "doc_id", seed: int = 7) -> DataFrame:
    """The rows of ``docs`` in the multiplicity of ``planned``, plus pass (0 for the first copy), block, block_at and row_at.

    ``sized`` has the same rows as (key, source, _tokens). A source is read in the order of pass, block_at, row_at. The
    last pass takes whole blocks in permuted order while they fit, then the rows of the next block in
    permuted order while they fit. Rows that agree in key (repeated rows, null keys) stay together; columns of
    ``docs`` with the names of the four results are replaced. An empty table gives an empty table.
    """
    last = _copies(sized.select(F.col(key).alias("k"), F.col(source).alias("s"), "_tokens"), planned, seed).filter("pass = passes and rest > 0")
    blocks = stored(last.groupBy("s", "block", "block_at", "rest").agg(F.sum("_tokens").alias("t")), "blocks")
    upto = Window.partitionBy("s").orderBy("block_at", "block").rowsBetween(Window.unboundedPreceding, 0)
    over = blocks.withColumn("t_upto", F.sum("t").over(upto)).filter("t_upto > rest")
    first = F.min(F.struct("block_at", "block", (F.col("rest") - F.col("t_upto") + F.col("t")).alias("left"))).alias("e")
    edges = stored(over.groupBy("s").agg(first).select(F.col("s").alias("_s"), F.col("e.block_at").alias("edge_at"), F.col("e.block").alias("edge_block"), "e.left"), "budget-edges")
    split = last.join(edges, F.col("s").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("edge_block")))
    split = split.groupBy("_s", "row_at", "left").agg(F.sum("_tokens").alias("t"))
    upto = Window.partitionBy("_s").orderBy("row_at").rowsBetween(Window.unboundedPreceding, 0)
    row_edge = split.withColumn("t_upto", F.sum("t").over(upto)).filter("t_upto > left").groupBy(F.col("_s").alias("_t")).agg(F.min("row_at").alias("edge_row"))
    cuts = stored(edges.join(row_edge, F.col("_s").eqNullSafe(F.col("_t")), "left").drop("_t", "left"), "cuts")

    kept = docs.drop("pass", "block", "block_at", "row_at").columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(key).alias("k"), F.col(source).alias("s"))
    out = _copies(packed, planned, seed).join(cuts, F.col("s").eqNullSafe(F.col("_s")), "left")
    earlier = (F.col("block_at") < F.col("edge_at")) | ((F.col("block_at") == F.col("edge_at")) & (F.col("block") < F.col("edge_block")))
    in_edge = (F.col("block") == F.col("edge_block")) & (F.col("row_at") < F.col("edge_row"))
    taken = (F.col("pass") < F.col("passes")) | ((F.col("rest") > 0) & (F.col("edge_at").isNull() | earlier | in_edge))
    return out.filter(taken).select("row.*", "pass", "block", "block_at", "row_at")


def sized_rows(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, source, _tokens), stored: all that the decisions need of the documents."""
    return stored(docs.select(key, source, words_in(F.col(text)).alias("_tokens")), "sized")


def mixed(docs: DataFrame, max_repeats: float | None = 2.0, entropy: float | None = None, budget: int | None = None,
          source: str = "source", key: str = "doc_id", text: str = "text", seed: int = 7) -> DataFrame:
    """Count tokens, plan and mix; see ``plan`` and ``mix``."""
    sized = sized_rows(docs, source, key, text)
    planned = plan(source_table(sized, source), max_repeats, entropy, budget)
    return mix(docs, sized, planned, source, key, seed)
