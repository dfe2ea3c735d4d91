"""Refusals: conditions that must not hold, as errors inside the plan or from one aggregate over a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unless(bad: Column, value: Column, message: str, *shown: Column) -> Column:
    """``value``, but an error where ``bad`` is true. Evaluated with the row, so nothing is collected."""
    text = F.concat_ws(" ", F.lit(message), *(c.cast("string") for c in shown))
    return F.when(~F.coalesce(bad, F.lit(False)), value).otherwise(F.raise_error(text))


def refuse_rows(rows: DataFrame, bad: Column, message: str, *shown: Column) -> DataFrame:
    """The same rows; reading one for which ``bad`` is true is an error.

    The test is marked as not deterministic, so that the optimizer doesn't move it before filters that come first.
    """
    return rows.filter(unless(bad & (F.spark_partition_id() >= 0), F.lit(True), message, *shown))


def settled(rows: DataFrame) -> DataFrame:
    """The same rows; what is computed on them stays after what made them, as a test that isn't deterministic lets nothing past.

    For distinct rows: the optimizer would compute later filters and grouping expressions on every row before it makes them distinct.
    """
    return rows.filter(F.spark_partition_id() >= 0)


def refuse(table: DataFrame, label: str, conditions: dict[str, Column], keys: list[str] | None = None, empty: bool = False) -> DataFrame:
    """The table itself, or an error that names the conditions that some row meets, repeated keys and, if asked, that there is no row.

    One aggregate, and a second one for keys. Null counts as not met.
    """
    counts = table.agg(F.count("*").alias("rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{k}") for k, c in enumerate(conditions.values()))).first()
    found = [name for k, name in enumerate(conditions) if counts[f"c{k}"]]
    if keys and table.groupBy(*keys).count().filter("count > 1").limit(1).count():
        found.append(f"repeated {', '.join(keys)}")
    if empty and not counts["rows"]:
        found.append("no rows")
    if found:
        raise ValueError(f"{label}: {'; '.join(found)}")
    return table
