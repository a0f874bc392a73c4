"""Industry membership by validity interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = "99991231"


def clean_history(history: DataFrame) -> DataFrame:
    """``ticker, industry, in_date, out_date`` with open ends (null, blank, nan, None) as ``99991231``."""
    end = F.trim(F.col("out_date").cast("string"))
    return history.withColumn("out_date", F.when(end.isNull() | F.lower(end).isin("", "nan", "none"), OPEN_END).otherwise(end))


def overlaps(history: DataFrame) -> DataFrame:
    """Rows that start no later than an earlier interval of their ticker ends (touching ends overlap)."""
    order = Window.partitionBy("ticker").orderBy("in_date", "out_date")
    return clean_history(history).withColumn("earlier_end", F.lag("out_date").over(order)).where(F.col("in_date") <= F.col("earlier_end"))


def industry_asof(keys: DataFrame, history: DataFrame) -> DataFrame:
    """``keys`` (distinct ``date, ticker``) with the industry valid on the date, both ends inclusive; others are dropped.

    Two intervals that are valid on one date stop the job, naming ticker and date.
    """
    h = clean_history(history).select(F.col("ticker").alias("_t"), F.col("industry").alias("_industry"), "in_date", "out_date")
    met = keys.join(h, (F.col("ticker") == F.col("_t")) & F.col("date").between(F.col("in_date"), F.col("out_date"))).select(*keys.columns, "_industry")
    one = met.groupBy(*keys.columns).agg(F.count("*").alias("_n"), F.min("_industry").alias("industry"))
    twice = F.raise_error(F.concat(F.lit("two industries are valid for "), "ticker", F.lit(" on "), "date")).cast("string")
    return one.select(*keys.columns, F.when(F.col("_n") == 1, F.col("industry")).otherwise(twice).alias("industry"))
