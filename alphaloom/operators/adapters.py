"""Input adapters: from foreign tables to the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.functions.expressions import finite
from alphaloom.operators.calendar import calendar


def signal_quality(signal: DataFrame, eligibility: DataFrame) -> DataFrame:
    """One row of counts: rows, bad keys, bad values, duplicate keys, dates, and rows that are tradable."""
    flags = signal.join(eligibility.where("tradable").select("date", "ticker").distinct().withColumn("ok", F.lit(True)), ["date", "ticker"], "left")
    return flags.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("ticker").isNull() | (F.trim("ticker") == "")).alias("bad_keys"),
        F.count_if(finite("prediction").isNull()).alias("bad_values"),
        (F.count("*") - F.count_distinct(F.struct("date", "ticker"))).alias("duplicates"),
        F.count_distinct("date").alias("n_dates"),
        F.count_if(F.coalesce("ok", F.lit(False))).alias("n_tradable"),
    )


def renormalize_benchmark(benchmark: DataFrame, eligible: DataFrame) -> DataFrame:
    """``date, ticker, benchmark_weight, retained``: eligible weights divided by the date's retained sum."""
    kept = benchmark.where("benchmark_weight > 0").join(eligible.select("date", "ticker"), ["date", "ticker"], "left_semi")
    day = Window.partitionBy("date")
    return kept.withColumn("retained", F.sum("benchmark_weight").over(day)).select("date", "ticker", (F.col("benchmark_weight") / F.col("retained")).alias("benchmark_weight"), "retained")


def excluded_benchmark(benchmark: DataFrame, eligible: DataFrame) -> DataFrame:
    """``date, n_excluded, excluded_weight``: what ``renormalize_benchmark`` leaves out."""
    out = benchmark.where("benchmark_weight > 0").join(eligible.select("date", "ticker"), ["date", "ticker"], "left_anti")
    return out.groupBy("date").agg(F.count("*").alias("n_excluded"), F.sum("benchmark_weight").alias("excluded_weight"))


def store_returns(store: DataFrame) -> DataFrame:
    """``date, ticker, return, cap, tradable`` of a daily equity table.

    A return needs positive close and previous close; a name is tradable with
    status 0 and positive volume and amount; capitalisation is null unless
    positive and finite.
    """
    close, before = finite("close"), finite("pre_close")
    return store.select(
        "date", F.col("symbol").alias("ticker"),
        F.when((close > 0) & (before > 0), close / before - 1).alias("return"),
        F.when(finite("market_value") > 0, finite("market_value")).alias("cap"),
        F.coalesce((F.col("trade_status") == 0) & (F.col("volume") > 0) & (F.col("amount") > 0), F.lit(False)).alias("tradable"),
    )


def terminal_returns(returns: DataFrame, end: str, terminal: float = -1.0) -> DataFrame:
    """``date, ticker, return, terminal``: returns with one terminal row for each ticker that ends early.

    A ticker whose last date is at most ``end`` and not the calendar's last gets
    ``terminal`` on the next calendar date.
    """
    days = calendar(returns)
    last = returns.groupBy("ticker").agg(F.max("date").alias("date")).where(F.col("date") <= end)
    events = last.join(F.broadcast(days), "date").where("next_date is not null").select(F.col("next_date").alias("date"), "ticker", F.lit(terminal).alias("return"), F.lit(True).alias("terminal"))
    return returns.select("date", "ticker", "return", F.lit(False).alias("terminal")).unionByName(events)


def existing_experiment(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """``date, ticker, alpha_score, benchmark_weight``: candidates with a covariance row, and an equal-weight benchmark (disclosed: no index)."""
    kept = candidates.join(known.select("ticker").distinct(), "ticker", "left_semi")
    return kept.select("date", "ticker", "alpha_score", (1.0 / F.count("*").over(Window.partitionBy("date"))).alias("benchmark_weight"))


def coverage_by_date(signal: DataFrame, candidates: DataFrame, benchmark: DataFrame, universe: DataFrame) -> DataFrame:
    """``date, n_signal, n_candidates, n_benchmark, n_universe``."""
    counts = [t.groupBy("date").agg(F.count("*").alias(n)) for t, n in ((signal, "n_signal"), (candidates, "n_candidates"), (benchmark, "n_benchmark"), (universe, "n_universe"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.join(c, "date", "left")
    return out.na.fill(0)
