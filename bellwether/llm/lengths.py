"""Token counts: an exact length histogram whose suffix sums answer every context limit.

Documents are encoded once and counted by encoded length. From the histogram alone come, for
any limit, the documents and tokens that fit, the tokens left after truncation, and exact quantiles.
The histogram has a row per different length; its running sums are taken within bins of
lengths and across bins, so neither window holds more than a part of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bellwether.llm.tokens import encoder, vocabulary

BIN = 1024

def encoded_length(spark: SparkSession, blob: bytes | None = None):
    """A column function: number of tokens of a text, special strings being ordinary text; null counts as empty.

    ``blob`` is a vocabulary file of about a megabyte, broadcast.
    """
    shared = spark.sparkContext.broadcast(vocabulary() if blob is None else blob)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(shared.value)
        for texts in batches:
            yield texts.map(lambda t: len(encode(t))).astype("int64")

    lengths = F.pandas_udf(count, "bigint", F.PandasUDFType.SCALAR_ITER)
    return lambda text: lengths(F.coalesce(text, F.lit("")))


def histogram(docs: DataFrame, length: Column) -> DataFrame:
    """(length, docs): how many documents have each encoded length."""
    return docs.select(length.alias("length")).groupBy("length").agg(F.count("*").alias("docs"))


def suffix_sums(counts: DataFrame, limits: tuple[int, ...] = ()) -> DataFrame:
    """Per length in the histogram and per extra limit, one row that answers this context limit exactly:

    docs with this length; docs_fit and tokens_fit at or under the limit; docs_over and tokens_over above it;
    truncated_tokens if every document is cut at the limit; total_docs and total_tokens;
    first_percentile and last_percentile: the percentiles (0 to 100) whose exact quantile, the smallest
    length with that share of documents at or under it, is this length (null if there are none).

    Without documents there are only the rows of the extra limits, all zero.
    """
    spark = counts.sparkSession
    asked = spark.createDataFrame([(int(x), 0) for x in limits], "length bigint, docs bigint")
    rows = counts.unionByName(asked).groupBy("length").agg(F.sum("docs").alias("docs")).withColumn("bin", F.floor(F.col("length") / BIN))
    tokens = F.col("length") * F.col("docs")
    bins = rows.groupBy("bin").agg(F.sum("docs").alias("bin_docs"), F.sum(tokens).alias("bin_tokens"))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.select(
        "bin",
        *(F.coalesce(F.sum(f"bin_{c}").over(before), F.lit(0)).alias(f"{c}_before") for c in ("docs", "tokens")),
        *(F.sum(f"bin_{c}").over(whole).alias(f"total_{c}") for c in ("docs", "tokens")),
    )
    upto = Window.partitionBy("bin").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    fit = rows.join(starts, "bin").select(
        "length", "docs", "total_docs", "total_tokens",
        (F.col("docs_before") + F.sum("docs").over(upto)).alias("docs_fit"),
        (F.col("tokens_before") + F.sum(tokens).over(upto)).alias("tokens_fit"),
    )
    over = F.col("total_docs") - F.col("docs_fit")
    # percentile p belongs to the first length with 100 * docs_fit >= p * total_docs
    first = F.expr("if(docs_fit = docs, 0, (100 * (docs_fit - docs)) div greatest(total_docs, 1) + 1)")
    last = F.expr("(100 * docs_fit) div greatest(total_docs, 1)")
    has = (F.col("docs") > 0) & (first <= last)
    return fit.select(
        "length", "docs", "docs_fit", "tokens_fit",
        over.alias("docs_over"),
        (F.col("total_tokens") - F.col("tokens_fit")).alias("tokens_over"),
        (F.col("tokens_fit") + F.col("length") * over).alias("truncated_tokens"),
        "total_docs", "total_tokens",
        F.when(has, first).alias("first_percentile"),
        F.when(has, last).alias("last_percentile"),
    )
