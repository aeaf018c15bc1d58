"""Offset intervals against the zone rules of the standard library."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from bellwether.operators import zones as Z

NY, UTC = ZoneInfo("America/New_York"), dt.timezone.utc
# around both changes under each rule, and at the ends of years
DAYS = [dt.date(*d) for d in ((1976, 4, 25), (1986, 4, 27), (1987, 4, 5), (1987, 10, 25), (2006, 4, 2), (2006, 10, 29), (2007, 3, 11), (2007, 11, 4),
                              (2024, 3, 10), (2024, 11, 3), (2000, 1, 1), (2023, 12, 31), (2024, 7, 4), (2030, 3, 10), (2030, 11, 3))]
TIMES = [dt.datetime.combine(d, dt.time()) + dt.timedelta(minutes=15 * k) for d in DAYS for k in range(-8, 104)]


@pytest.fixture(scope="module")
def intervals(spark):
    return Z.offset_intervals(spark, 1976, 2037)


@pytest.fixture(scope="module")
def times(spark):
    rows = [(i, t) for i, t in enumerate(TIMES)] + [(-1, None), (-2, dt.datetime(1960, 6, 1)), (-3, dt.datetime(2060, 6, 1)), (0, TIMES[0])]
    return spark.createDataFrame(rows, "i int, _ts timestamp_ntz").withColumnRenamed("_ts", "ts")


def test_from_utc(times, intervals):
    got = Z.from_utc(times, "ts", intervals).collect()
    assert len(got) == len(TIMES) + 4
    for r in got:
        want = r.ts.replace(tzinfo=UTC).astimezone(NY).replace(tzinfo=None) if r.i >= 0 else None
        assert r.local == want, r


def test_to_utc(times, intervals):
    seen = set()
    for r in Z.to_utc(times, "ts", intervals).collect():
        if r.i < 0:
            assert r.utc is None and r.wall_kind is None
            continue
        first, second = (r.ts.replace(tzinfo=NY, fold=k).utcoffset() for k in (0, 1))
        kind = "single" if first == second else "double" if first > second else "missing"
        assert (r.utc, r.wall_kind) == (r.ts - first, kind), r
        seen.add(kind)
    assert seen == {"single", "double", "missing"}


def test_clashing_names_and_empty_tables(spark, intervals):
    df = spark.createDataFrame([(dt.datetime(2024, 7, 1, 12), 1, 2, 3, "x")], "ts timestamp_ntz, _ts int, _offset int, _day int, _all string")
    r = Z.from_utc(df, "ts", intervals).first()
    assert (r["_ts"], r["_offset"], r["_day"], r["_all"], r["local"]) == (1, 2, 3, "x", dt.datetime(2024, 7, 1, 8))
    assert Z.to_utc(df.limit(0), "ts", intervals).count() == 0
    with pytest.raises(ValueError):
        Z.offset_intervals(spark, 1960, 1970)


def test_sessions_open_an_hour_earlier_in_utc_in_summer(spark, intervals):
    from bellwether.operators.calendar import calendar

    bars = spark.createDataFrame([(dt.date(2024, 3, 8),), (dt.date(2024, 3, 11),), (dt.date(2024, 11, 4),)], "date date")
    got = [(r.open_utc, r.close_utc) for r in Z.utc_sessions(calendar(bars, 570, 960), intervals).orderBy("td").collect()]
    assert [(a.hour, a.minute, b.hour) for a, b in got] == [(14, 30, 21), (13, 30, 20), (14, 30, 21)]
