"""Interval joins without nested loops: calendar positions, islands, as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofgraph.functions.clock import close_instant


def numbered(calendar: DataFrame) -> DataFrame:
    """(date, pos): trading dates in order from 0. One row a date, so one task is enough."""
    return calendar.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


def day_table(calendar: DataFrame) -> DataFrame:
    """(day, before, close): for every calendar day of the span, the dates before it and, on a trading date, its close.

    Its size is bounded by the days the calendar spans, whatever the data, so it may be broadcast.
    """
    dates = numbered(calendar)
    span = dates.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.filter("a IS NOT NULL").select(F.explode(F.sequence("a", F.date_add("b", 1))).alias("day"))
    joined = days.join(dates, F.col("day") == F.col("date"), "left")
    seen = F.count("date").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    return joined.select("day", seen.alias("before"), F.when(F.col("date").isNotNull(), close_instant(F.col("date"))).alias("close"))


def closes_before(rows: DataFrame, instant: str, days: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: how many trading dates close strictly before ``instant`` (null: none counted, null).

    An equi-join on the instant's day with a broadcast day table, in place of a range join.
    """
    edge = days.agg(F.min("day").alias("first_day"), F.max("before").alias("total"))
    table = days.select(F.col("day").alias("_day"), F.col("before").alias("_before"), F.col("close").alias("_close"))
    count = F.coalesce(F.col("_before") + F.when(F.col("_close") < F.col(instant), 1).otherwise(0), F.when(F.to_date(instant) < F.col("first_day"), 0).otherwise(F.col("total")))
    joined = rows.crossJoin(F.broadcast(edge)).join(F.broadcast(table), F.to_date(instant) == F.col("_day"), "left")
    return joined.withColumn(name, F.when(F.col(instant).isNotNull(), count)).drop("first_day", "total", "_day", "_before", "_close")


def islands(rows: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Union of the half-open intervals [low, high) of each key as disjoint intervals."""
    order = Window.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(low) > reach), 1).otherwise(0)
    marked = rows.filter(F.col(low) < F.col(high)).withColumn("_new", new).withColumn("_island", F.sum("_new").over(order))
    return marked.groupBy(*keys, "_island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("_island")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def overlaps(rules: DataFrame, keys: list[str], start: str, end: str, inclusive: bool = True) -> DataFrame:
    """Rules that begin before an earlier one of their key has ended; a null end is open."""
    window = Window.partitionBy(*keys).orderBy(F.col(start).asc_nulls_first(), F.col(end).asc_nulls_last(), *rules.columns)
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    open_before = F.max(F.col(end).isNull().cast("int")).over(earlier) == 1
    reach = F.max(end).over(earlier)
    clash = F.col(start) <= reach if inclusive else F.col(start) < reach
    return rules.withColumn("_clash", F.coalesce(open_before, F.lit(False)) | F.coalesce(clash, F.lit(False))).filter("_clash").drop("_clash")


def consecutive_runs(rows: DataFrame, value: str) -> DataFrame:
    """(run_start, run_end, run_length) of consecutive whole numbers."""
    numbers = rows.select(F.col(value).alias("v")).distinct()
    island = F.col("v") - F.row_number().over(Window.orderBy("v"))
    runs = numbers.withColumn("island", island).groupBy("island").agg(F.min("v").alias("run_start"), F.max("v").alias("run_end"), F.count("*").alias("run_length"))
    return runs.drop("island")
