"""Row-wise derivations and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bellwether.functions.scalar import clock
from bellwether.functions.text import matches


def split_tag(date: str, dev_start: str, test_start: str) -> Column:
    """train / dev / test by date bounds."""
    d = F.col(date)
    return (F.when(d < F.lit(dev_start).cast("date"), "train")
            .when(d < F.lit(test_start).cast("date"), "dev").otherwise("test"))


def direction_label(panel: DataFrame) -> DataFrame:
    """+1 / -1 by sign of the return; flat rows are dropped only after returns exist."""
    return panel.filter("ret is not null and ret <> 0").withColumn(
        "label", F.when(F.col("ret") > 0, 1).otherwise(-1))


def eligible(df: DataFrame, date: str, cutoff: str) -> DataFrame:
    return df.withColumn("emb_eligible", F.col(date) < F.lit(cutoff).cast("date"))


def valid_session(panel: DataFrame, history: int = 31, limit_up: float = 0.295) -> DataFrame:
    """Tradable rows: positive open, volume and previous close, open gap under the limit,
    and enough earlier bars."""
    return panel.filter((F.col("open") > 0) & (F.col("volume") > 0) & (F.col("prev_close") > 0)
                        & (F.col("gap") < limit_up) & (F.col("rn") > history))


def date_range(df: DataFrame, date: str, start: str, end: str) -> DataFrame:
    """Half-open [start, end)."""
    return df.filter((F.col(date) >= F.lit(start).cast("date")) & (F.col(date) < F.lit(end).cast("date")))


def drop_legal_notices(news: DataFrame, pattern: str, title: str = "title") -> DataFrame:
    """Rows whose title does not match the phrases of legal notices, in any case."""
    return news.filter(~matches(title, pattern))


def clock_between(df: DataFrame, ts: str, first: int, last: int) -> DataFrame:
    """Clock time in [first, last], both in seconds since midnight."""
    return df.filter(clock(ts).between(first, last))


def columns_with_prefix(df: DataFrame, prefixes: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, *[c for c in df.columns if c.startswith(prefixes) and c not in keep])


def neutralise(scores: DataFrame, cap: float) -> DataFrame:
    """Score -1 where the open gap is above the cap."""
    return scores.withColumn("score", F.when(F.col("gap") > cap, F.lit(-1.0)).otherwise(F.col("score")))
