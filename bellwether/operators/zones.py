"""Time zones as a table of offset intervals.

A zone is a list of intervals of UTC with one offset each, derived from the rule of its clock changes.
Times meet the interval by their day, so the conversion is an equi-join with one row per day and
interval (bounded by the calendar, whatever the data), and the same table works in any engine.
It also tells which wall times do not exist and which occur twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# New York is five hours behind UTC, four in summer; clocks change at 2:00 by the wall.
# (first year, month and number of the Sunday of the spring change, the same of the autumn change); Sunday 0 is the last one.
STANDARD, SUMMER = -300, -240
RULES = [(1967, 4, 0, 10, 0), (1976, 4, 0, 10, 0), (1987, 4, 1, 10, 0), (2007, 3, 2, 11, 1)]


def _sunday(year: Column, month: Column, number: Column) -> Column:
    """The numbered Sunday of a month, the last one for 0."""
    first = F.next_day(F.date_sub(F.make_date(year, month, F.lit(1)), 1), "Sunday")
    last = F.date_sub(F.next_day(F.last_day(first), "Sunday"), 7)
    return F.when(number == 0, last).otherwise(F.date_add(first, (number.cast("int") - 1) * 7))


def offset_intervals(spark: SparkSession, first_year: int = 1976, last_year: int = 2037) -> DataFrame:
    """(since, until, offset): the UTC interval [since, until) and the minutes to add to UTC, two rows a year.

    The first interval begins with the first year, the last ends with the last one. Years before 1976 are refused: their changes
    followed no yearly rule."""
    if not 1976 <= first_year <= last_year:
        raise ValueError("years from 1976")
    rule = F.lit(None).cast("struct<a:int,b:int,c:int,d:int>")
    y = F.col("y")
    for since, *values in RULES:
        made = F.struct(*[F.lit(x).alias(n) for x, n in zip(values, "abcd", strict=True)])
        rule = F.when(y >= since, made).otherwise(rule)
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y")).withColumn("r", rule)

    def at(date: Column, minutes: int) -> Column:
        return F.timestamp_add("MINUTE", F.lit(minutes), date.cast("timestamp_ntz"))

    spring = at(_sunday(y, F.col("r.a"), F.col("r.b")), 120 - STANDARD)
    autumn = at(_sunday(y, F.col("r.c"), F.col("r.d")), 120 - SUMMER)
    begin, end = (at(F.make_date(y + k, F.lit(1), F.lit(1)), -STANDARD) for k in (0, 1))
    part = lambda a, b, o: F.struct(a.alias("since"), b.alias("until"), F.lit(o).alias("offset"))
    parts = F.array(part(begin, spring, STANDARD), part(spring, autumn, SUMMER), part(autumn, end, STANDARD))
    return years.select(F.explode(parts).alias("i")).select("i.*")


def _by_day(intervals: DataFrame, start: Column, stop: Column) -> DataFrame:
    """One row per interval and day that it touches, with its bounds in the clock of the times to convert."""
    last = F.to_date(F.timestamp_add("SECOND", F.lit(-1), F.col("_stop")))
    rows = intervals.select(start.alias("_start"), stop.alias("_stop"), F.col("offset").alias("_offset"))
    return rows.withColumn("_day", F.explode(F.sequence(F.to_date("_start"), last)))


def _shift(ts: Column, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes, ts)


def _met(df: DataFrame, ts: str, days: DataFrame, found: list[Column]) -> DataFrame:
    """Each row with the intervals of its time, as one array ``hits`` ordered by start; a day has at most two intervals."""
    day = days.groupBy("_day").agg(F.sort_array(F.collect_list(F.struct("_start", "_stop", "_offset"))).alias("_all"))
    row = df.select(F.struct("*").alias("_row"), F.col(ts).cast("timestamp_ntz").alias("_ts"))
    j = row.join(day, F.to_date("_ts") == F.col("_day"), "left")
    j = j.withColumn("_hits", F.filter("_all", lambda i: (F.col("_ts") >= i["_start"]) & (F.col("_ts") < i["_stop"])))
    return j.withColumn("_found", F.struct(*found)).select("_row.*", "_found.*")


def from_utc(df: DataFrame, ts: str, intervals: DataFrame, out: str = "local") -> DataFrame:
    """Adds the wall time of a UTC time; null for null times and those outside the intervals. Rows are kept as they are."""
    days = _by_day(intervals, F.col("since"), F.col("until"))
    return _met(df.drop(out), ts, days, [_shift(F.col("_ts"), F.get("_hits", F.lit(0))["_offset"]).alias(out)])


def to_utc(df: DataFrame, wall: str, intervals: DataFrame, out: str = "utc", kind: str = "wall_kind") -> DataFrame:
    """Adds the UTC time of a wall time and what the wall time is: ``single``, ``double`` (the hour that
    occurs twice: the first is taken), ``missing`` (the hour that is skipped: read with the offset before the
    change, so 2:30 becomes the instant of 3:30) or null where the time is null or outside the intervals."""
    days = _by_day(intervals, _shift(F.col("since"), F.col("offset")), _shift(F.col("until"), F.col("offset")))
    hits, all_ = F.size("_hits"), F.col("_all")
    earlier = F.filter(all_, lambda i: i["_stop"] <= F.col("_ts"))
    later = F.exists(all_, lambda i: i["_start"] > F.col("_ts"))
    skipped = (hits == 0) & (F.size(earlier) > 0) & later
    offset = F.when(hits > 0, F.get("_hits", F.lit(0))["_offset"]).when(skipped, F.get(earlier, F.size(earlier) - 1)["_offset"])
    what = F.when(hits == 1, "single").when(hits > 1, "double").when(skipped, "missing")
    return _met(df.drop(out, kind), wall, days, [_shift(F.col("_ts"), -offset).alias(out), what.alias(kind)])


def utc_sessions(cal: DataFrame, intervals: DataFrame) -> DataFrame:
    """The calendar with its opens and closes, given by the wall, in UTC as well: ``open_utc`` and ``close_utc``."""
    c = to_utc(cal, "open_ts", intervals, "open_utc", "_open_kind")
    return to_utc(c, "close_ts", intervals, "close_utc", "_close_kind").drop("_open_kind", "_close_kind")
