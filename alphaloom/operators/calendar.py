"""Trading calendars: ordinals, neighbours and rebalance dates. A calendar has one row per date, so its windows are small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar(table: DataFrame) -> DataFrame:
    """``date, ix, prev_date, next_date`` of the distinct dates in rising order (``ix`` from 0)."""
    order = Window.orderBy("date")
    days = table.select("date").distinct()
    return days.select("date", (F.row_number().over(order) - 1).alias("ix"), F.lag("date").over(order).alias("prev_date"), F.lead("date").over(order).alias("next_date"))


def common_calendar(one: DataFrame, other: DataFrame) -> DataFrame:
    """``calendar`` of the dates that both tables have; each is reduced to its dates first, so no rows are joined."""
    both = one.select("date").distinct().union(other.select("date").distinct())
    return calendar(both.groupBy("date").count().where("count = 2"))


def rebalance_dates(table: DataFrame, every: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """Every ``every``-th date within the inclusive bounds, counted from the first that is left."""
    days = table.select("date").distinct()
    if start:
        days = days.where(F.col("date") >= start)
    if end:
        days = days.where(F.col("date") <= end)
    return days.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("ix")).where(F.col("ix") % every == 0).select("date")
