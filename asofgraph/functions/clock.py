"""Market clock: wall time in Shanghai, comparison in UTC (session time zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Shanghai"
CLOSE_HOUR = 15


def local_instant(wall: Column) -> Column:
    """The UTC instant of a wall-clock timestamp in the market's zone."""
    return F.to_utc_timestamp(wall.cast("timestamp"), ZONE)


def local_day(instant: Column) -> Column:
    """The market's calendar day of an instant."""
    return F.to_date(F.from_utc_timestamp(instant, ZONE))


def local_year(instant: Column) -> Column:
    return F.year(F.from_utc_timestamp(instant, ZONE))


def close_instant(day: Column) -> Column:
    """When the market closes on a day: 15:00 in Shanghai."""
    return local_instant(day.cast("timestamp") + F.expr(f"INTERVAL {CLOSE_HOUR} HOURS"))


def year_end(year: Column) -> Column:
    """The last microsecond of a calendar year in the market's zone."""
    return local_instant(F.make_timestamp(year + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))) - F.expr("INTERVAL 1 MICROSECOND")
