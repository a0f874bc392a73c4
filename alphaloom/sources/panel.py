"""A market panel mapped from the star-schema test tables.

Suppliers stand for tickers and months for trading dates: price is revenue per
unit, market capitalisation is revenue, the signal is the negated mean discount
and a name is tradable in months in which enough units were sold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MIN_UNITS = 60


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def market_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``date, ticker, price, ret, cap, prev_cap, industry, prediction, tradable``, one row per month in which a ticker trades.

    The panel is a small fraction of the lines it sums up and every query reads
    it several times, so it is kept (in memory and on disk) after its first use.
    """
    lines = read_table(spark, sf_dir, "lineitem")
    supplier, nation = read_table(spark, sf_dir, "supplier"), read_table(spark, sf_dir, "nation")
    # lines are summed by key and month as numbers; a cell's texts are made once, after the sum
    cells = (
        lines.groupBy("l_suppkey", F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("month"))
        .agg(F.sum("l_quantity").alias("units"), F.round(F.sum("l_extendedprice"), 2).alias("cap"), F.round(F.sum("l_discount"), 2).alias("off"), F.count("*").alias("n"))
        .withColumns({"ticker": F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")), "date": F.date_format("month", "yyyyMMdd")})
    )
    by_ticker = Window.partitionBy("ticker").orderBy("date")
    regions = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("industry"))
    return (
        cells.join(regions, "l_suppkey")
        .withColumn("price", F.col("cap") / F.col("units"))
        .withColumn("ret", F.col("price") / F.lag("price").over(by_ticker) - 1)
        .withColumn("prev_cap", F.lag("cap").over(by_ticker))
        .select("date", "ticker", "price", "ret", "cap", "prev_cap", "industry", (-F.col("off") / F.col("n")).alias("prediction"), (F.col("units") >= MIN_UNITS).alias("tradable"))
        .persist()
    )


def returns_of(panel: DataFrame) -> DataFrame:
    return panel.where("ret is not null").select("date", "ticker", F.col("ret").alias("return"))


def caps_of(panel: DataFrame) -> DataFrame:
    return panel.select("date", "ticker", "cap")


def benchmark_of(panel: DataFrame) -> DataFrame:
    """``date, ticker, benchmark_weight``: shares of the previous month's capitalisation."""
    day = Window.partitionBy("date")
    return panel.where("prev_cap is not null").select("date", "ticker", (F.col("prev_cap") / F.sum("prev_cap").over(day)).alias("benchmark_weight"))


def dense_returns(panel: DataFrame) -> DataFrame:
    """Returns on the full grid of dates and tickers, zero where a ticker did not trade (for the backtest only)."""
    grid = panel.select("date").distinct().crossJoin(panel.select("ticker").distinct())
    return grid.join(panel.select("date", "ticker", "ret"), ["date", "ticker"], "left").select("date", "ticker", F.coalesce("ret", F.lit(0.0)).alias("return")).persist()


def industry_history(panel: DataFrame) -> DataFrame:
    """``ticker, industry, in_date, out_date``: validity from a ticker's first month on, open-ended."""
    return panel.groupBy("ticker", "industry").agg(F.min("date").alias("in_date")).withColumn("out_date", F.lit("99991231"))
